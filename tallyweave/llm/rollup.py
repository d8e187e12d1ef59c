"""Token totals by source, language and tokenizer version, maintained from deltas.

A batch of changes becomes one small table of signed sums. Batches are committed in two steps: the
sums are written under a name of their own, then the batch's marker is created, which names them. A
marker is created without overwriting, so a batch that is applied again, or by two writers, counts once
(where the file system creates files atomically, as HDFS does; on others let one writer commit at a time).
An empty marker is a commit that was cut off, and is none. Totals are the sum over marked batches.
``compact`` sums these up in a snapshot that also lists their names, and takes their files away.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import encoder

KEY = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_bytes")
DELTA_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"


def token_counts(docs: DataFrame, *, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``keep`` and n_tokens, n_bytes of whole texts; null counts as empty; kept names of results raise ``ValueError``."""
    if clash := {c.lower() for c in keep} & {"n_tokens", "n_bytes", "_text", "_size"}:
        raise ValueError(f"columns in use: {sorted(clash)}")
    schema = T.StructType([*docs.select(*keep).schema.fields, *T._parse_datatype_string("n_tokens long, n_bytes long").fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(vocabulary).counts
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            n = count(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(n, pa.int64()), batch.column(at + 1)], names=[f.name for f in schema.fields])

    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    return docs.select(*keep, F.col(text).alias("_text"), size.alias("_size")).mapInArrow(rows, schema)


def signed_deltas(changes: DataFrame) -> DataFrame:
    """Signed sums by key of change rows.

    ``changes``: op (``insert``, ``delete``, ``revise``), the key, n_tokens, n_bytes, and for ``revise``
    old_tokens and old_bytes. Null counts are 0; null key parts are keys of their own; an unknown or
    null op raises. Sums are formed before the exchange, so a hot source costs no more than others.
    """
    op, n = F.col("op"), lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op, F.lit("null")))).cast("long")
    signed = lambda new, old: F.when(op == "insert", n(new)).when(op == "delete", -n(new)).when(op == "revise", n(new) - n(old)).otherwise(wrong)
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(wrong).cast("long")
    return changes.groupBy(*KEY).agg(F.sum(docs).alias("n_docs"), F.sum(signed("n_tokens", "old_tokens")).alias("n_tokens"), F.sum(signed("n_bytes", "old_bytes")).alias("n_bytes"))


class TokenRollup:
    """A rollup kept under ``path``, in a file system that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _files(self, folder: str) -> list[str]:
        top = self._path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(top)) if self._fs.exists(top) else []

    def snapshot(self) -> str | None:
        """Folder of the newest whole snapshot."""
        done = [n for n in self._files("snapshots") if self._fs.exists(self._path(f"{self.path}/snapshots/{n}/DONE"))]
        return f"{self.path}/snapshots/{done[-1]}" if done else None

    def committed(self) -> dict[str, str]:
        """Batch to the folder of its sums, of batches since the snapshot."""
        if not self._files("commits"):
            return {}
        found = self.spark.read.option("wholetext", True).text(f"{self.path}/commits").select(F.input_file_name(), "value").collect()
        marked = {name.rpartition("/")[2]: data.strip() for name, data in found if data.strip()}  # one row per batch
        return {b: d for b, d in marked.items() if b not in self._in_snapshot(list(marked))}

    def _in_snapshot(self, batches: list[str]) -> set[str]:
        at = self.snapshot()
        return {r["batch"] for r in self.spark.read.parquet(f"{at}/batches").where(F.col("batch").isin(batches)).collect()} if at and batches else set()

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Count a batch of changes, also an empty one; False if it was counted before (nothing is written then)."""
        if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
            raise ValueError(f"batch name {batch!r}")
        marker = self._path(f"{self.path}/commits/{batch}")
        if self._fs.exists(marker) and not self._fs.getFileStatus(marker).getLen():
            self._fs.delete(marker, False)
        if self._fs.exists(marker) or self._in_snapshot([batch]):
            return False
        data = uuid.uuid4().hex
        signed_deltas(changes).write.parquet(f"{self.path}/deltas/{data}")
        return self._mark(marker, data)

    def _mark(self, marker, data: str) -> bool:
        try:
            out = self._fs.create(marker, False)
        except Py4JJavaError as e:
            if "Exist" not in e.java_exception.getClass().getName():
                raise
            return False  # another writer was first
        out.write(bytearray(data.encode()))
        out.close()
        return True

    def _rows(self, batches: dict[str, str]) -> DataFrame:
        at = self.snapshot()
        parts = [*([f"{at}/sums"] if at else []), *(f"{self.path}/deltas/{d}" for d in batches.values())]
        return self.spark.read.schema(DELTA_SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], DELTA_SCHEMA)

    def totals(self) -> DataFrame:
        """Totals by key over all batches; keys of no remaining documents and counts are left out."""
        return _summed(self._rows(self.committed()))

    def compact(self) -> None:
        """One snapshot in place of all committed batches, so that readers list a bounded number of files; by one writer at a time."""
        batches, old = self.committed(), self.snapshot()
        if not batches:
            return
        number = 1 + int(old.rpartition("/")[2]) if old else 0
        new = f"{self.path}/snapshots/{number:012d}"
        self._fs.delete(self._path(new), True)  # of an attempt that was cut off
        _summed(self._rows(batches)).write.parquet(f"{new}/sums")
        names = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        (self.spark.read.parquet(f"{old}/batches").unionByName(names) if old else names).write.parquet(f"{new}/batches")
        self._fs.create(self._path(f"{new}/DONE"), False).close()
        for b, d in batches.items():  # from here on the snapshot knows them
            self._fs.delete(self._path(f"{self.path}/commits/{b}"), False)
            self._fs.delete(self._path(f"{self.path}/deltas/{d}"), True)
        if old:
            self._fs.delete(self._path(old), True)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in SUMS]).where(" or ".join(f"{c} <> 0" for c in SUMS))
