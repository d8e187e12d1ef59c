"""Records that arrive as a stream: validated, normalized, and appended by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.normalize import normalize
from ..schema import RECORD


def stream_records(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RECORD).json(folder)


def append_normalized(records: DataFrame, year: str | int, out: str, checkpoint: str) -> StreamingQuery:
    """Accepted records to Parquet by month; a month's half of the cube can then be rebuilt by itself."""
    return normalize(records, year).writeStream.format("parquet").partitionBy("month").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
