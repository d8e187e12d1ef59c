"""What several training-data operators share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import checkpoint, remove, scratch_path, shared_dir  # noqa: F401


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, though ``body`` names it often."""
    return F.transform(F.array(value), body).getItem(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
