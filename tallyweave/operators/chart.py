"""Shaping of results for charts: typed points, collapse, zero fill, order, shares."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_ITEMS = 250


@dataclass(frozen=True)
class ChartInfo:
    """How columns of a result become a chart. Indexes that cannot be read are -1, absent."""

    x: int = 0
    y: int = 1
    key: int = -1
    x_type: str = "int"
    sort: str = ""
    type: str = "bar"
    transform: str = ""

    @classmethod
    def parse(cls, d: dict) -> ChartInfo:
        def index(v) -> int:
            try:
                return int(v)
            except (TypeError, ValueError):
                return -1

        x_type, sort = d.get("x-type"), d.get("sort")
        return cls(index(d.get("x")), index(d.get("y")), index(d.get("key")), x_type if x_type in ("int", "date", "string") else "int", sort if sort in ("", "x", "y", "key") else "", d.get("type") or "bar", d.get("transform") or "")

    def encoded_transform(self) -> str:
        return quote(self.transform, safe="!'()*-._~")


def number(text: Column) -> Column:
    """Blank text counts as 0, other text that is no number as null."""
    t = F.trim(text.cast("string"))
    return F.when(t == "", F.lit(0.0)).otherwise(F.nullif(t.try_cast("double"), F.lit(float("nan"))))


def chart_date(text: Column) -> Column:
    """``Y[-M[-D]]``, month and day 1 by default and carried over if too large; null without a year or where a part is no number."""
    part = lambda i: F.get(F.split(text, "-"), F.lit(i))
    number_of = lambda i, missing: F.when(part(i).isNull(), missing).otherwise(F.when(part(i) == "", 0).otherwise(part(i).try_cast("int")))
    year = F.when(part(0) != "", part(0).try_cast("int"))
    january = F.try_make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return F.date_add(F.add_months(january, number_of(1, F.lit(1)) - 1), number_of(2, F.lit(1)) - 1)


def points(df: DataFrame, info: ChartInfo, label: str = "A", row_filter: str | None = None, transform: Column | None = None) -> DataFrame:
    """``(x, key, y)`` points of a result.

    Rows of one column, rows whose y is no number, and rows whose date has no year or is none are dropped, as
    are points that ``transform`` makes null. An absent x or y is 0, an absent key column the label, a missing
    key ``-``. ``row_filter`` is an SQL condition on the columns; ``transform`` a struct column of x, key, y over the points.
    """
    if row_filter:
        df = df.where(row_filter)
    names = df.columns
    if max(info.x, info.y, info.key) >= len(names):
        raise ValueError("x, y and key must be columns")
    if len(names) < 2:
        df = df.limit(0)
    col = lambda i: F.col(f"`{names[i]}`") if i >= 0 else None
    x = col(info.x)
    if x is None:
        x = F.lit(0).cast("long")
    elif info.x_type == "int":
        x = number(x).cast("long")
    elif info.x_type == "date":
        x = chart_date(x) if isinstance(df.schema[info.x].dataType, T.StringType) else F.to_date(x)
    else:
        x = x.cast("string")
    key = F.lit(f"({label})") if info.key < 0 else F.coalesce(col(info.key).cast("string"), F.lit("-"))
    y = F.lit(0.0) if info.y < 0 else number(col(info.y))
    out = df.select(x.alias("x"), key.alias("key"), y.alias("y")).where("y is not null")
    if info.x >= 0 and info.x_type == "date":
        out = out.where("x is not null")
    if transform is not None:
        out = out.select(transform.alias("p")).where("p is not null").select("p.*")
    return out


def merge_series(*series: DataFrame) -> DataFrame:
    """Series of several sources under their keys."""
    out = series[0]
    for s in series[1:]:
        out = out.unionByName(s)
    return out


def collapse(pts: DataFrame) -> DataFrame:
    """One point for each x and key: their sum. Nothing from nothing."""
    return pts.groupBy("x", "key").agg(F.sum("y").alias("y"))


def zero_fill(pts: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """A point for every x of every key; missing ones are 0.

    The result is by definition every distinct x with every distinct key, and only these lists are
    paired, never rows; more than ``most`` x raise, as in ``check_size``.
    """
    check_size(pts, most)
    xs = pts.select("x").distinct()
    keys = pts.select("key").distinct()
    return xs.crossJoin(keys).join(pts, ["x", "key"], "left").select("x", "key", F.coalesce("y", F.lit(0.0)).alias("y"))


def ordered(pts: DataFrame, by: str = "", x_is_text: bool = False) -> DataFrame:
    if by in ("key",) or (by == "x" and x_is_text):
        return pts.orderBy(F.collate(F.col(by), "UNICODE"), "x" if by == "key" else "key")
    return pts.orderBy(by, *(c for c in ("x", "key") if c != by)) if by else pts


def nested(pts: DataFrame) -> DataFrame:
    """One row for each key with its points by x."""
    return pts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("values"))


def pie_shares(pts: DataFrame) -> DataFrame:
    """Share of each x in percent, one decimal, of the first key."""
    first = pts.agg(F.min("key").alias("first"))
    one = pts.join(F.broadcast(first), F.col("key") == F.col("first")).drop("first")
    total = one.agg(F.sum("y").alias("total"))  # one row
    return one.join(F.broadcast(total)).select("x", "key", "y", F.round(F.try_divide(F.col("y") * 100, F.col("total")), 1).alias("percent"))


def check_size(pts: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    n = pts.select("x").distinct().limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} items on the x axis")
    return pts


def top(df: DataFrame, by: str, n: int = 100, ties: tuple[str, ...] = ()) -> DataFrame:
    return df.orderBy(F.col(by).desc(), *ties).limit(n)


def running(pts: DataFrame) -> DataFrame:
    """Cumulative y along x of each key (for cumulative lines)."""
    w = Window.partitionBy("key").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return pts.withColumn("y", F.sum("y").over(w))


def si_format(value: Column) -> Column:
    """Three significant digits with an SI suffix."""
    out = None
    for power, suffix in ((12, "T"), (9, "G"), (6, "M"), (3, "k")):
        t = F.concat(F.format_number(value / F.lit(10.0**power), 2), F.lit(suffix))
        out = F.when(F.abs(value) >= 10.0**power, t) if out is None else out.when(F.abs(value) >= 10.0**power, t)
    return out.otherwise(F.format_number(value, 2))
