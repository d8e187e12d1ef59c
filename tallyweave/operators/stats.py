"""Order statistics, key counts, samples and runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import checkpoint


def box_plot(df: DataFrame, key: str | None, value: str, parts: int = 4) -> DataFrame:
    """``(key, i, v)``: the order statistics at ``min(floor(size / parts * i), size - 1)``, i from 0 to ``parts``.

    NaN and null values are skipped; without ``key`` all rows are one group. Equal values are counted
    before any exchange, then dealt by ranges of key and value, so a hot key is spread over tasks and
    a hot value is one row. A range knows how many rows of a key lie before it.
    """
    rows = df.select((F.col(key) if key else F.lit("")).alias("key"), F.col(value).try_cast("double").alias("v")).where("v is not null and not isnan(v)")
    counted = rows.groupBy("key", "v").agg(F.count(F.lit(1)).alias("n"))
    ranged = checkpoint(counted.repartitionByRange("key", "v").withColumn("_part", F.spark_partition_id()))
    of_key = Window.partitionBy("key")
    ranges = ranged.groupBy("_part", "key").agg(F.sum("n").alias("m"))
    earlier = F.sum("m").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(F.col("_part").alias("_p"), F.col("key").alias("_key"), F.coalesce(earlier, F.lit(0)).alias("_before"), F.sum("m").over(of_key).alias("_size"))
    upto = ranged.withColumn("_upto", F.sum("n").over(Window.partitionBy("_part", "key").orderBy("v")))
    placed = upto.join(ranges, (F.col("_part") == F.col("_p")) & F.col("key").eqNullSafe(F.col("_key"))).withColumn("_to", F.col("_before") + F.col("_upto"))

    def is_here(i: Column) -> Column:
        rank = F.least(F.floor(F.col("_size") / F.lit(float(parts)) * i), F.col("_size") - 1)
        return (rank < F.col("_to")) & (rank >= F.col("_to") - F.col("n"))

    return placed.select("key", F.explode(F.filter(F.sequence(F.lit(0), F.lit(parts)), is_here)).alias("i"), "v")


def in_key_order(plot: DataFrame) -> DataFrame:
    """A box plot's rows by key, the null key first, then by place."""
    return plot.orderBy(F.col("key").asc_nulls_first(), "i")


def count_by_key(df: DataFrame, key: Column) -> DataFrame:
    """``(key, n)``; null keys are not counted."""
    return df.select(key.alias("key")).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def sample_by_key(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """``(key, sha)``: the least value of each key, so that the choice is the same every time."""
    return df.select(key.alias("key"), value.alias("sha")).where("key is not null").groupBy("key").agg(F.min("sha").alias("sha"))


def fold_by_key(df: DataFrame, keys: list[str], fold: Callable[[DataFrame], list[Column]] | None = None) -> DataFrame:
    """Groups of equal keys folded by aggregate columns; a count by default."""
    return df.groupBy(*keys).agg(*(fold(df) if fold else [F.count(F.lit(1)).alias("n")]))


def runs(df: DataFrame, order: list[str], keys: list[str], within: list[str] | None = None) -> DataFrame:
    """Runs of equal keys along an order: ``(run, keys..., n)``, the last run included.

    Without ``within`` the order is one sequence; windows are then taken by ranges of ``order`` and
    joined at their ends, so no task gets all rows.
    """
    if within:
        w = Window.partitionBy(*within).orderBy(*order)
        same = [F.col(k).eqNullSafe(F.lag(k).over(w)) for k in keys]
        begins = ~same[0]
        for s in same[1:]:
            begins = begins | ~s
        marked = df.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(begins.cast("int")))
        return marked.withColumn("run", F.sum("_new").over(w)).groupBy(*within, "run", *keys).agg(F.count(F.lit(1)).alias("n"))
    # ranges of the order, one per partition; each knows its key at both ends and how many runs it begins
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    ranged = checkpoint(ranged.select("_part", *order, *keys))
    local = Window.partitionBy("_part").orderBy(*order)
    same = F.struct(*keys).eqNullSafe(F.lag(F.struct(*keys)).over(local))
    marked = ranged.withColumn("_first", F.row_number().over(local) == 1).withColumn("_new", F.when(F.col("_first"), 1).otherwise((~same).cast("int")))
    local_runs = marked.withColumn("_run", F.sum("_new").over(local)).groupBy("_part", "_run", *keys).agg(F.count(F.lit(1)).alias("n"))
    # one row for each partition: its first and last key, its number of runs
    ends = local_runs.groupBy("_part").agg(F.max("_run").alias("_runs"), F.min_by(F.struct(*keys), "_run").alias("_head"), F.max_by(F.struct(*keys), "_run").alias("_tail"))
    over = Window.orderBy("_part")
    joined = ends.withColumn("_glue", F.coalesce(F.col("_head").eqNullSafe(F.lag("_tail").over(over)) & (F.lag("_part").over(over).isNotNull()), F.lit(False)).cast("int"))
    before = joined.withColumn("_base", F.coalesce(F.sum(F.col("_runs") - F.col("_glue")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_glue"))
    numbered = local_runs.join(before.select("_part", "_base"), "_part").withColumn("run", F.col("_base") + F.col("_run"))
    return numbered.groupBy("run", *keys).agg(F.sum("n").alias("n"))
