"""Packing documents into sequences by linear grouping, configurations and best fit.

Executors tokenize and cut; the driver only gets the histogram of piece lengths, at most
``capacity`` numbers. From it the plan is made: lengths over a bound are sorted, dealt into groups
of equal cardinality and rounded up to the largest of their group; the few sizes are packed by
configurations whose counts come from a linear programme (column generation, rounded down); actual
lengths then take the places of the rounded ones; what is left, small pieces foremost, goes by best
fit into what room remains. As pieces of one length are alike, the plan is a short list of rules
"ranks lo to hi of length l go to sequences from s on, q to each, at offset o", which executors apply
to each piece's exact rank among its length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint
from .tokens import encoder


#: Tasks that tokenize, for each core: a file is written by each, and for a file Hadoop without its native part starts a process out of the executor.
TASKS_PER_CORE = 4
#: Most counts by task and length that go to all executors at once; more are exchanged.
MOST_BROADCAST = 1 << 18


class _Knapsack:
    """Best multiset of sizes within the capacity, by value; one layer for each further item."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity, self.layers = sizes, capacity, capacity // int(sizes.min())
        before = np.arange(capacity + 1)[:, None] - sizes
        self.before = np.where(before < 0, capacity + 1, before)  # the last place is no place

    def best(self, values: np.ndarray) -> tuple[float, np.ndarray]:
        f, took = np.append(np.zeros(self.capacity + 1), -np.inf), []
        for _ in range(self.layers):
            gain = f[self.before] + values
            item = gain.argmax(axis=1)
            top = gain[np.arange(self.capacity + 1), item]
            better = top > f[:-1] + 1e-12
            took.append(np.where(better, item, -1))
            f = np.append(np.where(better, top, f[:-1]), -np.inf)
        counts, c = np.zeros(len(self.sizes), np.int64), self.capacity
        for item in reversed(took):
            if item[c] >= 0:
                counts[item[c]] += 1
                c -= int(self.sizes[item[c]])
        return float(f[self.capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """Configurations (count of each size) and how often to use each, rounded down: never over demand."""
    k = len(sizes)
    basis, knapsack = np.diag((capacity // sizes).astype(float)), _Knapsack(sizes, capacity)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        value, column = knapsack.best(np.maximum(price, 0))
        if value <= 1 + 1e-6:
            break
        x, y = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, column.astype(float))
        ratio = np.where(y > 1e-9, np.maximum(x, 0) / np.where(y > 1e-9, y, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    x = np.linalg.solve(basis, demand.astype(float))
    left, out = demand.astype(np.int64).copy(), []
    for j in np.argsort(-x):
        column = basis[:, j].astype(np.int64)
        used = column > 0
        n = min(int(np.floor(max(0.0, x[j]) + 1e-9)), int((left[used] // column[used]).min()))
        if n > 0:
            left -= column * n
            out.append((column, n))
    return out


@dataclass
class Plan:
    """Rules as columns: length, lo, hi (ranks), sequence, per_sequence, offset."""

    capacity: int
    rules: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0

    def add(self, length: int, lo: int, n: int, sequence: int, per: int, offset: int) -> None:
        if n:
            self.rules.append((length, lo, lo + n, sequence, per, offset))


def _grouped(hist: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """(length, count), longest first, dealt into groups of equal cardinality; a length may be cut."""
    total = sum(n for _, n in hist)
    share = max(1, -(-total // groups))
    out: list[list[list[int]]] = [[]]
    room = share
    for length, n in hist:
        while n:
            if not room:
                out.append([])
                room = share
            take = min(n, room)
            out[-1].append([length, take])
            n, room = n - take, room - take
    merged: list[list[list[int]]] = []
    for g in out:
        if not g:
            continue
        if merged and merged[-1][0][0] == g[0][0]:  # same rounded size: one size of the programme
            merged[-1] += g
        else:
            merged.append(g)
    return merged


def make_plan(histogram: dict[int, int], capacity: int, large: int, groups: int) -> Plan:
    """The plan for ``histogram`` (length: count), lengths over ``large`` by linear grouping."""
    plan = Plan(capacity)
    rank = dict.fromkeys(histogram, 0)  # next rank of each length

    def take(length: int, n: int) -> int:
        rank[length] += n
        return rank[length] - n

    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (sequence, count)
    left = {length: n for length, n in histogram.items() if n and length < capacity}
    if n := histogram.get(capacity, 0):
        plan.add(capacity, take(capacity, n), n, 0, 1, 0)
        plan.sequences = n
    big = sorted(((length, n) for length, n in left.items() if length > large), reverse=True)
    if big:
        dealt = _grouped(big, groups)
        sizes = np.array([g[0][0] for g in dealt])
        demand = np.array([sum(n for _, n in g) for g in dealt])
        for column, n in configurations(sizes, demand, capacity):
            slots = []  # for each place: (length, first rank, count) that fill it, bin after bin
            for g in np.flatnonzero(column):
                for _ in range(column[g]):
                    need, runs = n, []
                    while need:
                        length, have = dealt[g][0]
                        part = min(need, have)
                        runs.append((length, take(length, part), part))
                        left[length] -= part
                        need -= part
                        dealt[g][0][1] -= part
                        if not dealt[g][0][1]:
                            dealt[g].pop(0)
                    slots.append(runs)
            at, heads = 0, [[0, 0] for _ in slots]  # bins done; per slot: run, pieces of it used
            while at < n:
                step = min(runs[h[0]][2] - h[1] for runs, h in zip(slots, heads))
                offset = 0
                for runs, h in zip(slots, heads):
                    length, first, count = runs[h[0]]
                    plan.add(length, first + h[1], step, plan.sequences + at, 1, offset)
                    offset += length
                    h[1] += step
                    if h[1] == count:
                        h[0], h[1] = h[0] + 1, 0
                rooms[capacity - offset].append((plan.sequences + at, step))
                at += step
            plan.sequences += n
    used = [r for r in range(capacity + 1) if rooms[r]]
    heapq.heapify(used)
    open_rooms = set(used)
    for length in sorted((x for x, n in left.items() if n), reverse=True):
        n = left[length]
        candidates = sorted(r for r in open_rooms if r >= length)
        k = 0
        while n:
            if k < len(candidates):
                r = candidates[k]
                if not rooms[r]:
                    open_rooms.discard(r)
                    k += 1
                    continue
            else:
                r = capacity
                new = -(-n // (capacity // length))
                rooms[r].append((plan.sequences, new))
                plan.sequences += new
            sequence, bins = rooms[r].pop()
            per = r // length
            full = min(bins, n // per)
            plan.add(length, take(length, full * per), full * per, sequence, per, capacity - r)
            n -= full * per
            rest = bins - full
            if full:
                rooms[r - per * length].append((sequence, full))
                open_rooms.add(r - per * length)
            if n and rest:  # fewer than one bin holds
                plan.add(length, take(length, n), n, sequence + full, per, capacity - r)
                rooms[r - n * length].append((sequence + full, 1))
                open_rooms.add(r - n * length)
                full, rest, n = full + 1, rest - 1, 0
            if rest:
                rooms[r].append((sequence + full, rest))
                open_rooms.add(r)
    return plan


def best_plan(histogram: dict[int, int], capacity: int, settings: tuple[tuple[int, int], ...]) -> Plan:
    return min((make_plan(dict(histogram), capacity, large, groups) for large, groups in settings), key=lambda p: p.sequences)


def pieces(docs: DataFrame, keep: list[str], text: str, capacity: int, vocabulary: str | None) -> DataFrame:
    """Tokenize and cut. Adds ``_pid`` (task) and ``_rank`` (of its length in the task)."""
    added = "piece int, start long, length long, ids_crc32 long, _pid int, _rank long"
    schema = T.StructType([*docs.select(*keep).schema.fields, *T._parse_datatype_string(added).fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, pid = encoder(vocabulary).texts, [0] * (capacity + 1), TaskContext.get().partitionId()
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for i, t in enumerate(encode(batch.column(at))):
                ids = t.tobytes() + b"\0\0\0\0"
                n = len(ids) // 4
                lo, k = 0, 0
                while lo < n:
                    hi = min(n, lo + ((n - 1) % capacity + 1 if not lo else capacity))
                    row.append(i)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(ids[4 * lo : 4 * hi]))
                    rank.append(seen[hi - lo])
                    seen[hi - lo] += 1
                    lo, k = hi, k + 1
            kept = [c.take(pa.array(row, pa.int64())) for c in batch.columns[:at]]
            made = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([pid] * len(row), pa.int32()), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[f.name for f in schema.fields])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(rows, schema)


def pack_documents(
    docs: DataFrame,
    *,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    capacity: int = 2048,
    vocabulary: str | None = None,
    settings: tuple[tuple[int, int], ...] = ((512, 64), (384, 64)),
) -> DataFrame:
    """One row per piece: ``keep``, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then id 0; null and empty texts are the one id 0. Longer ones than
    ``capacity`` are cut into full pieces, the first may be shorter. ``settings`` are (bound of
    large lengths, groups) pairs; the plan of fewest sequences is used. Repeated rows are separate
    documents; an empty table gives an empty result; columns outside ``keep`` are not read, and a kept
    column that is named like a result or begins with an underscore raises ``ValueError``.
    """
    if clash := [c for c in keep if c.lower() in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset") or c.startswith("_")]:
        raise ValueError(f"columns in use: {clash}")
    tasks = TASKS_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism
    cut = checkpoint(pieces(docs.coalesce(tasks), list(keep), text, capacity, vocabulary))
    by_task = cut.groupBy("_pid", "length").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # <= capacity rows
    plan = best_plan(histogram, capacity, settings)
    rules = np.array(sorted(plan.rules), np.int64).reshape(-1, 6)
    keys = (rules[:, 0] << 44) + rules[:, 1]
    before = Window.partitionBy("length").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if tasks * capacity <= MOST_BROADCAST:  # then the pieces stay in the tasks that read them
        bases = F.broadcast(bases)
    ranked = cut.join(bases, ["_pid", "length"]).select(*keep, "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_rank")).alias("_r"))
    schema = T.StructType([*ranked.schema.fields[:-1], *T._parse_datatype_string("sequence_id long, offset long").fields])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, r = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_r"))
            rule = rules[np.searchsorted(keys, (length << 44) + r, side="right") - 1] if len(rules) else np.zeros((0, 6), np.int64)
            i = r - rule[:, 1]
            arrays = [*batch.columns[:-1], pa.array(rule[:, 3] + i // rule[:, 4]), pa.array(rule[:, 5] + length * (i % rule[:, 4]))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return ranked.mapInArrow(place, schema)
