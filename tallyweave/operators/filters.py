"""Filters on criteria and indicators, as values that become columns."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ANY, CRITERIA, INDICATORS

# Operator names and their SQL signs.
OPERATORS = {"lower_than": "<", "lower_than_equal": "<=", "equal": "=", "like": "LIKE", "in": "IN", "different": "!=", "greater_than": ">", "greater_than_equal": ">="}
NUMERIC = ("lower_than", "lower_than_equal", "greater_than", "greater_than_equal")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def compare(left: Column, operator: str, right) -> Column:
    match operator:
        case "lower_than":
            return left < right
        case "lower_than_equal":
            return left <= right
        case "equal":
            return left == right
        case "different":
            return left != right
        case "greater_than":
            return left > right
        case "greater_than_equal":
            return left >= right
        case "like":
            return left.like(right)
    raise ValueError(f"operator {operator!r}")


@dataclass(frozen=True)
class Filter:
    """One test of a criterion; equal filters are equal values."""

    type: str
    operator: str
    value: tuple[str, ...]

    def __post_init__(self):
        object.__setattr__(self, "value", (self.value,) if isinstance(self.value, str) else tuple(map(str, self.value)))
        if self.type not in CRITERIA:
            raise ValueError(f"criterion {self.type!r}")
        if self.operator not in OPERATORS:
            raise ValueError(f"operator {self.operator!r}")
        if self.operator != "in" and len(self.value) != 1:
            raise ValueError("only the operator in takes several values")

    def to_json(self) -> str:
        return json.dumps({"type": self.type, "operator": self.operator, "value": list(self.value)}, separators=(",", ":"))

    @classmethod
    def from_json(cls, text: str) -> Filter:
        d = json.loads(text)
        value = d["value"]
        return cls(d["type"], d["operator"], tuple(value) if isinstance(value, list) else value)

    def to_sql(self) -> str:
        """Readable form; evaluation uses ``to_column``."""
        if self.operator == "in":
            right = "(" + ",".join(map(_quoted, self.value)) + ")"
        else:
            right = self.value[0] if self.operator in NUMERIC else _quoted(self.value[0])
        return f"{self.type} {OPERATORS[self.operator]} {right}"

    def to_column(self, lexical: bool = False) -> Column:
        """The test. Orders are numeric, cells without a number fail; ``lexical`` compares texts."""
        if self.operator == "in":
            return F.col(self.type).isin(*self.value)
        if self.operator in NUMERIC and not lexical:
            return compare(F.expr(f"try_cast({self.type} as double)"), self.operator, float(self.value[0]))
        return compare(F.col(self.type), self.operator, self.value[0])


@dataclass(frozen=True)
class FilterGroup:
    """``and`` or ``or`` of filters and groups; an empty group is true."""

    type: str
    filters: tuple[Filter | FilterGroup, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "filters", tuple(self.filters))
        if self.type not in ("and", "or"):
            raise ValueError(f"group {self.type!r}")

    def to_column(self, lexical: bool = False) -> Column:
        parts = [f.to_column(lexical) for f in self.filters]
        return reduce(Column.__and__ if self.type == "and" else Column.__or__, parts) if parts else F.lit(True)

    def add(self, item: Filter | FilterGroup) -> FilterGroup:
        return FilterGroup(self.type, (*self.filters, item))

    def remove(self, item: Filter | FilterGroup) -> FilterGroup:
        kept = (f.remove(item) if isinstance(f, FilterGroup) else f for f in self.filters if f != item)
        return FilterGroup(self.type, tuple(kept))

    def to_dict(self) -> dict:
        return {"type": self.type, "filters": [f.to_dict() if isinstance(f, FilterGroup) else json.loads(f.to_json()) for f in self.filters]}

    @classmethod
    def from_dict(cls, d: dict) -> FilterGroup:
        return cls(d["type"], tuple(cls.from_dict(f) if f["type"] in ("and", "or") else Filter.from_json(json.dumps(f)) for f in d["filters"]))


def _by_criterion(filters) -> dict[str, Filter]:
    return {f.type: f for f in filters}  # a later filter replaces an earlier one


def point_predicate(filters) -> Column:
    """Exactly one cell per combination: wildcards where no filter is, ``ok`` for status."""
    given = _by_criterion(filters)
    rest = lambda c: F.col(c) == ("ok" if c == "status" else ANY)
    return reduce(Column.__and__, [given[c].to_column() if c in given else rest(c) for c in CRITERIA])


def series_predicate(axes, filters, lexical: bool = False) -> Column:
    """Cells along ``axes``: these explicit, others wildcards. A filter keeps the explicit guard too, so no wildcard cell slips in."""
    given, parts = _by_criterion(filters), []
    for c in CRITERIA:
        if c in given:
            parts.append(given[c].to_column(lexical) & (F.col(c) != ANY if c != "status" and given[c].value != (ANY,) else F.lit(True)))
        elif c in axes:
            parts.append(F.col(c) != ANY)
        else:
            parts.append(F.col(c) == ("ok" if c == "status" else ANY))
    return reduce(Column.__and__, parts)


def measure_predicate(measure: Column, operator: str, value: str) -> Column:
    """A test of an indicator or ratio; the value must be digits."""
    if not str(value).isdigit():
        raise ValueError(f"not a number: {value!r}")
    return compare(measure, operator, int(value))


def measure(name: str) -> Column:
    """An indicator or one of the ratios ``avg_size`` and ``duplication``."""
    from ..functions.criteria import average_content_size, duplication_ratio

    if name in INDICATORS:
        return F.col(name)
    if name in ("avg_size", "duplication"):
        return average_content_size() if name == "avg_size" else duplication_ratio()
    raise ValueError(f"measure {name!r}")
