"""Facet tables by year: import of text, Parquet tables, listing, dropping."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CRITERIA
from .tables import read_facet_text


class FacetStore:
    """Tables ``facets_<year>p`` in a database. Rows lie by status and month, so point questions skip row groups."""

    def __init__(self, spark: SparkSession, database: str = "tallyweave_facets"):
        if not re.fullmatch(r"\w+", database):
            raise ValueError(f"database {database!r}")
        self.spark, self.database = spark, database
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        self.listeners: list = []

    def table(self, year: int | str) -> str:
        if not str(year).isdigit():
            raise ValueError(f"year {year!r}")
        return f"{self.database}.facets_{year}p"

    def save(self, facets: DataFrame, year: int | str) -> None:
        sorted_ = facets.repartitionByRange(*[F.col(c) for c in ("status", "month", "site")]).sortWithinPartitions(*CRITERIA)
        sorted_.write.mode("overwrite").format("parquet").saveAsTable(self.table(year))
        for changed in self.listeners:
            changed()

    def import_year(self, source: str, year: int | str) -> None:
        """Delimited text of a finished cube to the year's table."""
        if not source:
            raise ValueError("source is required")
        self.table(year)
        self.save(read_facet_text(self.spark, source), year)

    def facets(self, year: int | str) -> DataFrame:
        return self.spark.table(self.table(year))

    def years(self) -> list[str]:
        names = (t.name for t in self.spark.catalog.listTables(self.database))
        return sorted(m[1] for n in names if (m := re.fullmatch(r"facets_(\d+)p", n)))

    def drop(self, year: int | str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table(year)}")
        for changed in self.listeners:
            changed()
