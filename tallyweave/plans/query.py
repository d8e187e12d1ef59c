"""Questions to a cube: single cells, series, top lists, years compared."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import Filter, FilterGroup, measure, measure_predicate, point_predicate, series_predicate
from ..schema import CRITERIA, INDICATORS


def point_cells(facets: DataFrame, filters=()) -> DataFrame:
    return facets.where(point_predicate(filters))


def get_stats(facets: DataFrame, filters=()) -> dict[str, int]:
    """Indicators of one cell; ``LookupError`` if no cell matches the filters, ``ValueError`` if several do."""
    rows = point_cells(facets, filters).select(*INDICATORS).head(2)
    if not rows:
        raise LookupError("no data in table")
    if len(rows) > 1:
        raise ValueError("several cells match: their distinct counts do not add up")
    return rows[0].asDict()


@dataclass(frozen=True)
class ChartQuery:
    """A question from the query form. ``top`` gives the 100 highest and takes no key."""

    x: str = "month"
    y: str = "meta_count"
    key: str | None = None
    filters: tuple[Filter, ...] = ()
    where: FilterGroup | None = None
    y_operator: str | None = None
    y_value: str | None = None
    chart: str = "hbar"
    sort: str = ""
    top: int | None = None
    lexical: bool = False
    axes: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self):
        if self.x not in CRITERIA or (self.key is not None and self.key not in CRITERIA):
            raise ValueError("x and key are criteria")
        if self.chart == "stream" and self.x != "month":
            raise ValueError("stream charts need the date on x")
        if self.top and self.key:
            raise ValueError("a top list takes no key")
        if self.y_value is not None and not str(self.y_value).isdigit():
            raise ValueError("the measure filter takes a number")
        if self.chart == "stream":
            object.__setattr__(self, "sort", "x")
        object.__setattr__(self, "axes", tuple(c for c in (self.x, self.key) if c))

    def run(self, facets: DataFrame) -> DataFrame:
        y = measure(self.y)
        cells = facets.where(series_predicate(self.axes, self.filters, self.lexical))
        if self.where is not None:
            cells = cells.where(self.where.to_column(self.lexical))
        if self.y_value is not None:
            cells = cells.where(measure_predicate(y, self.y_operator or "greater_than", self.y_value))
        out = cells.select(*self.axes, y.alias(self.y))
        return out.orderBy(F.col(self.y).desc(), self.x).limit(self.top) if self.top else out


def compare_years(query: ChartQuery, first: DataFrame, second: DataFrame) -> DataFrame:
    """``(x, key, y)`` of two years' tables under the keys (A) and (B); months lose their year."""
    x = F.substring(query.x, 6, 2) if query.x == "month" else F.col(query.x)
    rows = lambda t, k: query.run(t).select(x.alias("x"), F.lit(k).alias("key"), F.col(query.y).alias("y"))
    return rows(first, "(A)").unionByName(rows(second, "(B)"))
