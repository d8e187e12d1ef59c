"""Readers and writers: containers, records, facet tables, delimited results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.normalize import from_container
from ..schema import CONTAINER, CRITERIA, FACETS, INDICATORS, RECORD


def read_containers(spark: SparkSession, paths: str | list[str], fmt: str = "parquet") -> DataFrame:
    """Records from files of string maps; ``avro`` needs Spark's avro module. Paths may be a comma-separated text."""
    names = [p.strip() for p in paths.split(",")] if isinstance(paths, str) else list(paths)
    reader = spark.read if fmt == "avro" else spark.read.schema(CONTAINER)
    return from_container(reader.format(fmt).load(names))


def _typed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    schema = T.StructType([*RECORD.fields, *(T.StructField(c, T.StringType()) for c in ("record_class", "record_type", "_corrupt_record"))])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(paths)
    wrong = F.when(F.col("record_class") != "Record", "wrong_record_class").when(F.col("record_type") != "metadata_json", "wrong_content_class")
    return raw.withColumn("wrong", wrong).drop("record_class", "record_type")


def read_json_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records from JSON lines, broken lines with ``_corrupt_record``.

    Typed streams carry ``record_class`` and ``record_type``; only metadata of the class ``Record`` is kept.
    """
    return _typed(spark, paths).where("wrong is null").drop("wrong")


def wrong_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Counts of lines of a stream that are left out: no records, or no metadata."""
    return _typed(spark, paths).where("wrong is not null").groupBy(F.col("wrong").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def write_facet_text(facets: DataFrame, path: str) -> None:
    """``|``-separated rows; separators and quotes in values are escaped."""
    facets.select(*CRITERIA, *INDICATORS).write.mode("overwrite").option("sep", "|").option("emptyValue", '""').csv(path)


def read_facet_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACETS).option("sep", "|").csv(path)


def write_counts(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("compression", "none").csv(path)


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a result's part files."""
    return spark.read.option("pathGlobFilter", "part-*").text(folder)


def iterate_parts(spark: SparkSession, folder: str):
    for row in read_parts(spark, folder).toLocalIterator():
        yield row["value"]


def read_split_lines(spark: SparkSession, path: str, separator: str = ",", fields: int | None = None) -> DataFrame:
    """Lines split by a regular expression; lines of fewer than ``fields`` are left out."""
    rows = spark.read.text(path).select(F.split("value", separator).alias("fields"))
    return rows.where(F.size("fields") >= fields) if fields else rows


def read_chart_csv(spark: SparkSession, *paths: str) -> list[DataFrame]:
    """Rows of one or two CSV sources of a chart, as texts, in the order in which their series are keyed: the last source first."""
    if not 1 <= len(paths) <= 2:
        raise ValueError("one or two sources")
    return [spark.read.option("header", False).option("inferSchema", False).csv(p) for p in reversed(paths)]


#: Loaders of scripts by name, and the formats they read and write.
LOADERS = {"PigStorage": "csv", "JsonLoader": "json", "JsonStorage": "json", "TextLoader": "text", "BinStorage": "parquet"}


def load(spark: SparkSession, path: str, loader: str = "PigStorage", schema: T.StructType | str | None = None, separator: str = "\t") -> DataFrame:
    """``LOAD path USING loader AS schema``."""
    if loader not in LOADERS:
        raise ValueError(f"loader {loader!r}; one of {sorted(LOADERS)}")
    reader = spark.read.schema(schema) if schema and loader != "TextLoader" else spark.read
    return reader.format(LOADERS[loader]).options(**({"sep": separator} if loader == "PigStorage" else {})).load(path)


def store(df: DataFrame, path: str, loader: str = "PigStorage", separator: str = "\t") -> None:
    """``STORE df INTO path USING loader``; an existing path raises."""
    if loader not in LOADERS:
        raise ValueError(f"loader {loader!r}; one of {sorted(LOADERS)}")
    df.write.format(LOADERS[loader]).options(**({"sep": separator} if loader == "PigStorage" else {})).save(path)


def fetched(df: DataFrame, most: int) -> list[str]:
    """A result's lines on the driver, a partition at a time; more than ``most`` raise before they are held."""
    out = []
    for r in csv_lines(df).toLocalIterator():
        if len(out) == most:
            raise ValueError(f"more than {most} lines")
        out.append(r["line"])
    return out


def csv_lines(df: DataFrame) -> DataFrame:
    """``line``: values joined by commas, unquoted; nulls print ``null``."""
    return df.select(F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in df.columns]).alias("line"))
