"""Histogram sort of documents into shards of near-equal bytes.

Each row has a 128-bit sort key: a hash of the text, then a hash of the id with a row number, so
equal texts lie together and yet a group of copies of any size can be cut. The driver proposes key
boundaries (probes); every round counts the exact bytes and rows between probes over all
partitions and closes in on the boundaries, until the error of each is under the tolerance or its
bracket holds one row. Only then are the rows exchanged, once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint

TOP = 1 << 128
_MASK = (1 << 64) - 1
_SIGN = -(1 << 63)


def _order(high: np.ndarray, low: np.ndarray, probes_high: np.ndarray, probes_low: np.ndarray) -> np.ndarray:
    """For each key (high, low), the number of probes that are at or below it."""
    first = np.searchsorted(probes_high, high, side="left")
    last = np.searchsorted(probes_high, high, side="right")
    out = last.copy()
    for i in np.flatnonzero(last > first):  # keys that share their high half with a probe
        out[i] = first[i] + np.searchsorted(probes_low[first[i] : last[i]], low[i], side="right")
    return out


def _halves(probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([p >> 64 for p in probes], np.uint64), np.array([p & _MASK for p in probes], np.uint64)


def _unsigned(column: pd.Series) -> np.ndarray:
    return column.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def count_below(keyed: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows between successive probes (one cell more than probes).

    The driver gets one row per cell that has rows, at most ``len(probes) + 1``.
    """
    high, low = _halves(probes)
    cells = len(probes) + 1

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, rows = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for pdf in batches:
            at = _order(_unsigned(pdf["_high"]), _unsigned(pdf["_low"]), high, low)
            np.add.at(size, at, pdf["_size"].to_numpy(np.int64))
            rows += np.bincount(at, minlength=cells)
        some = np.flatnonzero(rows)
        yield pd.DataFrame({"cell": some, "size": size[some], "n": rows[some]})

    found = (
        keyed.select("_high", "_low", "_size")
        .mapInPandas(counts, "cell long, size long, n long")
        .groupBy("cell")
        .agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
        .collect()
    )
    size, rows = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    for r in found:
        size[r["cell"]], rows[r["cell"]] = r["size"], r["n"]
    return size, rows


@dataclass
class Splitters:
    """``cuts[i]`` is the first key of shard ``i + 1``; ``fine`` are all boundaries of exchange cells."""

    cuts: list[int]
    fine: list[int]
    first_slot: list[int]
    shard_of: list[int]
    rounds: int


def find_splitters(keyed: DataFrame, shards: int, tolerance: float, fanout: int, cell_bytes: int) -> Splitters:
    """Refine probes until each boundary is within ``tolerance`` of a shard's share of the bytes."""
    size, rows = count_below(keyed, [TOP * i // (shards * fanout) for i in range(1, shards * fanout)])
    probes = [0, *[TOP * i // (shards * fanout) for i in range(1, shards * fanout)], TOP]
    total = int(size.sum())
    below, count = [0, *np.cumsum(size).tolist()], [0, *np.cumsum(rows).tolist()]
    wanted = [total * i / shards for i in range(1, shards)]
    known = {p: (b, c) for p, b, c in zip(probes, below, count)}
    bracket = []
    for w in wanted:
        k = max(0, min(int(np.searchsorted(below, w, side="right")) - 1, len(probes) - 2))
        bracket.append((probes[k], probes[k + 1]))
    rounds = 1
    slack = tolerance * total / max(1, shards)

    def open_(i: int) -> bool:
        lo, hi = bracket[i]
        near = min(abs(known[lo][0] - wanted[i]), abs(known[hi][0] - wanted[i]))
        return near > slack and known[hi][1] - known[lo][1] > 1 and hi - lo > 1

    while todo := [i for i in range(len(wanted)) if open_(i)]:
        asked = sorted({lo + (hi - lo) * j // fanout for lo, hi in {bracket[i] for i in todo} for j in range(1, fanout)} - set(known))
        size, rows = count_below(keyed, asked)
        for p, b, c in zip(asked, np.cumsum(size).tolist(), np.cumsum(rows).tolist()):
            known[p] = (int(b), int(c))
        order = sorted(known)
        sums = [known[p][0] for p in order]
        for i in todo:
            k = max(0, min(int(np.searchsorted(sums, wanted[i], side="right")) - 1, len(order) - 2))
            bracket[i] = (order[k], order[k + 1])
        rounds += 1
    cuts = [min(bracket[i], key=lambda p: abs(known[p][0] - wanted[i])) for i in range(len(wanted))]
    cuts = [max(cuts[: i + 1]) for i in range(len(cuts))]
    # boundaries of exchange cells: the cuts, and known probes about every cell_bytes
    fine, at = [], 0
    for p in sorted(known):
        if p in (0, TOP):
            continue
        if p in cuts or known[p][0] - at >= cell_bytes:
            fine.append(p)
            at = known[p][0]
    shard_of, first_slot = [], []
    for lo in [0, *fine]:
        shard = sum(1 for c in cuts if c <= lo)
        start = cuts[shard - 1] if shard else 0
        shard_of.append(shard)
        first_slot.append(known[lo][1] - known[start][1])
    return Splitters(cuts, fine, first_slot, shard_of, rounds)


def shard_documents(
    docs: DataFrame,
    *,
    shards: int,
    size: str,
    group: str,
    tie: str,
    tolerance: float = 0.0005,
    fanout: int = 32,
    cell_bytes: int = 128 << 20,
) -> DataFrame:
    """Rows of ``docs`` plus ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    ``size`` names a long column to balance; ``group`` one whose equal values lie together;
    ``tie`` one that orders a group's rows, so that a large group can be cut. Null sizes count as
    0, null groups and ties are values of their own, repeated rows stay separate rows, an empty
    table gives an empty result. ``docs`` may not have columns ``_high``, ``_low``, ``_size``,
    ``shard`` and ``slot``; clashing ones raise ``ValueError``.
    """
    if clash := {"_high", "_low", "_size", "shard", "slot", "_cell"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns in use: {sorted(clash)}")
    # the low half: 31 bits of the tie's hash, then 33 of a hash of it and the row's number
    unique = F.monotonically_increasing_id()
    low = F.shiftleft(F.xxhash64(tie), 33).bitwiseXOR(F.xxhash64(tie, unique).bitwiseAND(F.lit((1 << 33) - 1)))
    keyed = checkpoint(
        docs.withColumns(
            {"_high": F.xxhash64(group), "_low": low, "_size": F.coalesce(F.col(size).cast("long"), F.lit(0))}
        )
    )
    found = find_splitters(keyed, shards, tolerance, fanout, cell_bytes)
    high, low_ = _halves(found.fine)
    first, shard_of = np.array(found.first_slot, np.int64), np.array(found.shard_of, np.int32)

    @F.pandas_udf("int")
    def cell(h: pd.Series, l: pd.Series) -> pd.Series:
        return pd.Series(_order(_unsigned(h), _unsigned(l), high, low_).astype(np.int32))

    spread = keyed.withColumn("_cell", cell("_high", "_low"))
    # ordering by the cell number exchanges the rows once; a cell's rows stay in one partition
    spread = spread.repartition(max(1, len(shard_of)), "_cell").sortWithinPartitions("_cell", "_high", "_low")
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    names = docs.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = -1, 0
        for batch in batches:
            at = batch.column("_cell").to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.arange(len(at))
            begins = np.diff(at, prepend=last) != 0
            run = np.maximum.accumulate(np.where(begins, n, -1))
            rank = np.where(run >= 0, n - run, n + seen)
            if len(at):
                last, seen = int(at[-1]), int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(shard_of[at], pa.int32()), pa.array(first[at] + rank, pa.int64())],
                names=[*names, "shard", "slot"],
            )

    return spread.mapInArrow(number, schema)
