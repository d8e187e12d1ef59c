"""Free SQL text: placeholder, result lines, cache, retry."""

from __future__ import annotations

import re
import time
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import fetched


# what is left alone, and the placeholder
_PLACE = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/|\bTABLE\b""", re.S)
_BEFORE = re.compile(r"\b(create|drop|alter|truncate|refresh|analyze|cache|uncache|lazy|repair|describe|desc|external|temporary|global)\s+$", re.I)
_INTO = re.compile(r"\b(into|overwrite)\s+$", re.I)
_NAMED = re.compile(r"\s+(?!select\b|values\b|partition\b|replace\b|table\b)[A-Za-z_`]", re.I)


def with_table(sql: str, table: str) -> str:
    """``TABLE`` as a word stands for ``table``; not in literals, quoted names and comments, nor where it is SQL's own keyword."""

    def of(m: re.Match) -> str:
        before = sql[: m.start()]
        own = m[0] != "TABLE" or _BEFORE.search(before) or (_INTO.search(before) and _NAMED.match(sql, m.end()))
        return m[0] if own else table

    return _PLACE.sub(of, sql)


class SqlText:
    """Runs SQL and keeps the lines of small results, 50 texts, the least recently used first out.

    A result is fetched line by line; one of more than ``most_fetched`` lines raises, as such belong in a table.
    """

    def __init__(self, spark: SparkSession, default_table: str | None = None, keep: int = 50, most_lines: int = 5000, most_fetched: int = 1_000_000):
        self.spark, self.default_table, self.keep, self.most, self.most_fetched = spark, default_table, keep, most_lines, most_fetched
        self._kept: OrderedDict[str, list[str]] = OrderedDict()
        self.last_seconds = 0.0

    def query(self, sql: str) -> DataFrame:
        """``TABLE`` as a word stands for the default table, if there is one."""
        return self.spark.sql(with_table(sql, self.default_table) if self.default_table else sql)

    def update(self, sql: str) -> None:
        self.query(sql)
        self.clear()

    def clear(self) -> None:
        self._kept.clear()

    def lines(self, sql: str) -> list[str]:
        if sql in self._kept:
            self._kept.move_to_end(sql)
            return self._kept[sql]
        began = time.monotonic()
        for attempt in (0, 1):
            try:
                found = fetched(self.query(sql), self.most_fetched)
                break
            except Exception as e:
                if attempt or "OutOfMemoryError" not in str(e):
                    raise
        self.last_seconds = time.monotonic() - began
        if len(found) < self.most:
            self._kept[sql] = found
            while len(self._kept) > self.keep:
                self._kept.popitem(last=False)
        return found

    def csv(self, sql: str, html: bool = False) -> str:
        """Lines as text; a failure is the line ``failure:`` with its message."""
        try:
            text = "\n".join(self.lines(sql))
        except Exception as e:
            text = f"failure:{e}"
        return f"<pre>{text}</pre>" if html else text
