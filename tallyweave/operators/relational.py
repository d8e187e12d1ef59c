"""Relational operators of scripts that are more than one DataFrame call."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def union_on_schema(*tables: DataFrame) -> DataFrame:
    """Rows of all tables by column name; a table without a column has nulls there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def split(df: DataFrame, conditions: dict[str, Column], otherwise: str | None = None) -> dict[str, DataFrame]:
    """A row goes to every table whose condition holds, and to ``otherwise`` if none does; a null condition does not hold."""
    held = {name: F.coalesce(c, F.lit(False)) for name, c in conditions.items()}
    out = {name: df.where(c) for name, c in held.items()}
    if otherwise:
        out[otherwise] = df.where(~reduce(Column.__or__, held.values()))
    return out


def top_by(df: DataFrame, keys: list[str], by: str, n: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` rows of each group with the highest ``by``. Groups are cut to ``n`` before and after the exchange."""
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc(), *ties)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def bloom_semi_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of ``left`` with a partner. Spark builds a Bloom filter of the smaller side at run time where that pays."""
    return left.join(right.select(on).distinct(), on, "left_semi")


def likely_partners(left: DataFrame, on: str, right: DataFrame, key: str, slots: int = 1 << 24) -> DataFrame:
    """Rows of ``left`` that may have a partner in ``right``, all that have one among them; for a join that would exchange far more.

    The keys of ``right``, whole numbers, are hashed to ``slots`` bits, which are broadcast 64 a row (2^18 rows at most, whatever the table).
    With far more keys than ``slots`` nearly all rows stay.
    """
    types = left.schema[on].dataType, right.schema[key].dataType
    if types[0] != types[1] or not isinstance(types[0], T.IntegralType):  # equal values of other types may have other hashes
        return left
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots))
    bits = right.where(F.col(key).isNotNull()).select(slot(key).alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("_word"))
    words = bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(_slot & 63 as int))")).alias("_bits"))
    has = F.col("_bits").bitwiseAND(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{on}`), {slots}L) & 63 as int))")) != 0
    return left.join(F.broadcast(words), (F.shiftright(slot(on), 6) == F.col("_word")) & has, "left_semi")


def cogroup(left: DataFrame, right: DataFrame, key: str, **sums: Column) -> DataFrame:
    """One row for each key of either side, with the sides' aggregates ``left_*`` and ``right_*`` in ``sums``, 0 where a side has no row."""
    side = lambda df, name: df.groupBy(key).agg(*[c.alias(n) for n, c in sums.items() if n.startswith(name)])
    return side(left, "left").join(side(right, "right"), key, "full").na.fill(0, list(sums))


def distinct_listing(df: DataFrame, column: str) -> DataFrame:
    """``(value, n, distinct)``: rows of each value, and the number of values."""
    each = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return each.join(F.broadcast(each.agg(F.count("value").alias("distinct"))))  # one row
