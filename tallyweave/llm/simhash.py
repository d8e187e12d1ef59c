"""SimHash fingerprints, and the near-duplicate join over a segment-popcount embedding.

A 64-bit fingerprint is cut into segments and mapped to the vector of their bit counts. The
Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints, so
it serves as a lower bound. The join is a range join on a grid of that space: with radius 4, two
vectors within it are within 2 on one half of the segments, and then share a grid point within 1 of
each. So each distinct fingerprint is sent to its own point and the neighbouring points of each
half, points meet by equality, the Manhattan bound filters, and the exact distance decides.

Within a grid point no list of pairs is made: small points compare shifted columns, large ones grow
components outwards from a seed, so at most one link per fingerprint leaves a point. A point of more
than ``SPLIT`` fingerprints is cut by a second grid over the other half of the segments: vectors within
the radius differ by at most one on some quarter of that half, and share a point within one of each there.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, scratch_path
from .graph import connected_components

BITS = 64
#: Fingerprints of a grid point that one task compares; more are dealt by a second grid.
SPLIT = 8192
#: Tasks over which the fingerprints of one component are dealt when they learn its first row.
SALTS = 16
_EVEN = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)
_PLACES = np.arange(8, dtype=np.int64) * 256
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42, block: int = 1 << 15) -> int:
    """A bit is 1 if it is set in over half the XXH64 hashes of the word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    hash_, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    ones = np.zeros(BITS, np.int64)
    while part := list(itertools.islice(joined, block)):
        hashes = np.fromiter((hash_(s, seed) for s in part), ">u8", len(part))
        by_place = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048).reshape(8, 256)
        ones += (by_place @ _BYTE_BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """The ``keep`` columns and ``_fp``, the fingerprint as a signed long. Null text: no words, 0."""
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("_fp", T.LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            fps = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(at)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(fps.view(np.int64))], names=[*keep, "_fp"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(rows, schema)


def thermometer(fps: np.ndarray) -> np.ndarray:
    """Bit counts of 2-bit segments in unary (00, 01, 11): XOR and popcount then give Manhattan distance."""
    high, low = (fps >> _ONE) & _EVEN, fps & _EVEN
    return ((high & low) << _ONE) | (high | low)


def _neighbours(part: np.ndarray, segments: int, tag: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(index, point) rows of ``segments`` counts in unary: the own point and all at distance 1."""
    n = np.arange(len(part))
    index, point = [n], [part | tag]
    for k in range(segments):
        low, high = np.uint64(1 << 2 * k), np.uint64(2 << 2 * k)
        count = ((part & low) > 0).astype(np.int8) + ((part & high) > 0)
        up, down = count < 2, count > 0  # 0 -> 1, 1 -> 2; 2 -> 1, 1 -> 0
        index += [n[up], n[down]]
        point += [part[up] | np.where(count[up] == 0, low, high) | tag, part[down] & ~np.where(count[down] == 2, high, low) | tag]
    return np.concatenate(index), np.concatenate(point)


def grid_points(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of fingerprint, grid point) rows: per half, the own point and all neighbours at distance 1."""
    u = thermometer(fps)
    rows = [_neighbours((u >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF), 16, np.uint64(half << 32)) for half in (0, 1)]
    return np.concatenate([i for i, _ in rows]), np.concatenate([p for _, p in rows])


def second_points(points: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, second point) rows of fingerprints at first points: per quarter of the other half, the own and all neighbours."""
    other = (thermometer(fps) >> np.where(points >> np.uint64(32) == 0, np.uint64(32), np.uint64(0))) & np.uint64(0xFFFFFFFF)
    rows = [_neighbours((other >> np.uint64(8 * k)) & np.uint64(0xFF), 4, np.uint64(k << 8)) for k in range(4)]
    return np.concatenate([i for i, _ in rows]), np.concatenate([p for _, p in rows])


def _hot_links(fps: np.ndarray, u: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join all components of one grid point: breadth first, each fingerprint reached once."""
    rest, rest_u, out = fps, u, []
    while len(rest):
        queue, rest, rest_u = [(rest[0], rest_u[0])], rest[1:], rest_u[1:]
        while queue and len(rest):
            f, fu = queue.pop()
            near = np.flatnonzero(np.bitwise_count(rest_u ^ fu) <= radius)
            near = near[np.bitwise_count(rest[near] ^ f) <= radius]
            if len(near):
                out.append((np.full(len(near), f), rest[near]))
                queue += zip(rest[near], rest_u[near])
                kept = np.ones(len(rest), bool)
                kept[near] = False
                rest, rest_u = rest[kept], rest_u[kept]
    return out


def links_of_points(points: np.ndarray, fps: np.ndarray, radius: int, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints of equal grid points; ``points`` is sorted."""
    starts = np.flatnonzero(np.diff(points, prepend=points[:1] ^ _ONE) != 0) if len(points) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(points)))
    left, right = [], []
    for s, n in zip(starts[sizes > small], sizes[sizes > small]):
        for a, b in _hot_links(fps[s : s + n], thermometer(fps[s : s + n]), radius):
            left.append(a)
            right.append(b)
    few = np.repeat(sizes <= small, sizes)
    p, f = points[few], fps[few]
    u = thermometer(f)
    for k in range(1, small):
        same = np.flatnonzero(p[k:] == p[:-k])
        if not len(same):
            break
        same = same[np.bitwise_count(u[same] ^ u[same + k]) <= radius]
        same = same[np.bitwise_count(f[same] ^ f[same + k]) <= radius]
        left.append(f[same])
        right.append(f[same + k])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def near_links(fps: DataFrame, radius: int = 4, split: int = SPLIT) -> DataFrame:
    """Links ``(a, b)`` between distinct ``_fp`` values that join all components at ``radius`` <= 4."""
    if not 0 <= radius <= 4:
        raise ValueError("the grid of halves serves radii from 0 to 4")

    def to_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("_fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(f), 20_000):
                i, p = grid_points(f[at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(f[at + i].view(np.int64))], names=["point", "f"])

    def to_second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, f = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("point", "a"))
            i, second = second_points(p, f)
            yield pa.RecordBatch.from_arrays([pa.array(p[i].view(np.int64)), pa.array(second.view(np.int64)), pa.array(f[i].view(np.int64))], names=["first", "second", "f"])

    def to_links(batches: Iterator[pa.RecordBatch], most: int | None, keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
        """Links of sorted points; where a point has over ``most``, its rows ``(f, null, point)`` instead."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held, over = 0, None  # rows of the last point so far; a point that is let through

        def out(a: np.ndarray, b: np.ndarray | None, point: np.ndarray | None) -> pa.RecordBatch:
            column = lambda v: pa.nulls(len(a), pa.int64()) if v is None else pa.array(np.ascontiguousarray(v).view(np.int64))
            return pa.RecordBatch.from_arrays([column(a), column(b), column(point)], names=["a", "b", "point"])

        def links(p: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = links_of_points(p, f, radius)
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
            return out(pairs[:, 0], pairs[:, 1], None)

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (*keys, "f")]
            p, f = cols[0] if len(keys) == 1 else cols[0] * np.uint64(1024) + cols[1], cols[-1]
            ends = [*(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
            whole = ends[-2] if len(ends) > 1 else 0  # from here on the last point, which may go on
            for lo, hi in ((0, ends[0]), (ends[0], whole), (max(whole, ends[0]), len(p))):
                if lo >= hi:
                    continue
                if (parts or over is not None) and p[lo] != (parts[0][0][0] if parts else over):
                    if parts:
                        yield links(*(np.concatenate(x) for x in zip(*parts)))
                    parts, held, over = [], 0, None
                sizes = np.diff(np.append(np.flatnonzero(np.diff(p[lo:hi], prepend=p[lo : lo + 1] ^ _ONE)), hi - lo))
                if len(sizes) > 1:  # whole points
                    big = np.repeat(sizes > most, sizes) if most else np.zeros(hi - lo, bool)
                    yield links(p[lo:hi][~big], f[lo:hi][~big])
                    if big.any():
                        yield out(f[lo:hi][big], None, p[lo:hi][big])
                    continue
                if over is None:
                    parts.append((p[lo:hi], f[lo:hi]))
                    held += hi - lo
                    if most and held > most:
                        over = p[lo]
                        for q, g in parts:
                            yield out(g, None, q)
                        parts = []
                else:
                    yield out(f[lo:hi], None, p[lo:hi])
        if parts:
            yield links(*(np.concatenate(x) for x in zip(*parts)))

    schema = "a long, b long, point long"
    points = fps.select("_fp").where(F.col("_fp").isNotNull()).mapInArrow(to_points, "point long, f long")
    first = points.repartition("point").sortWithinPartitions("point").mapInArrow(partial(to_links, most=split, keys=("point",)), schema)
    path = scratch_path(fps.sparkSession, "simhash-links")
    first.write.parquet(path)
    first = fps.sparkSession.read.schema(schema).parquet(path)
    second = first.where("b is null").select("point", "a").mapInArrow(to_second, "first long, second long, f long").repartition("first", "second").sortWithinPartitions("first", "second")
    second = second.mapInArrow(partial(to_links, most=None, keys=("first", "second")), schema)
    return first.where("b is not null").unionByName(second).select("a", "b")


def _components(prints: DataFrame, first: Column, radius: int) -> DataFrame:
    """``(_fp, first)``: for each distinct ``_fp``, the least ``first`` of its component.

    Rows are counted down to distinct fingerprints before any exchange. Only fingerprints with links
    are joined by component; a component of very many fingerprints is salted over ``SALTS`` tasks.
    The result is checkpointed, so that a later join by ``_fp`` reads exchanges on both sides and
    adaptive execution can split a hot fingerprint.
    """
    distinct = prints.groupBy("_fp").agg(F.min(first).alias("least"))
    linked = connected_components(near_links(distinct, radius)).select(F.col("node").alias("_fp"), "component")
    salt = F.pmod(F.xxhash64("_fp"), F.lit(SALTS)).cast("int")
    firsts = linked.join(distinct, "_fp").groupBy("component").agg(F.min("least").alias("first"))
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # a merge of both sides: with the links broadcast instead, all of a component would come out of one task
    moved = linked.withColumn("salt", salt).join(firsts.hint("merge"), ["component", "salt"]).select("_fp", "first")
    return checkpoint(distinct.join(moved, "_fp", "left").select("_fp", F.coalesce("first", "least").alias("first")))


def simhash_components(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42, radius: int = 4  # noqa: A002
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs``.

    Fingerprints that differ in at most ``radius`` bits are linked; ``component_id`` is the
    smallest id reachable over links. Null and word-free texts have fingerprint zero and are linked
    like others. A row with a null id takes part but names no component (null if none of it has an
    id). Equal texts and repeated rows share a fingerprint and so a component; an empty table gives
    an empty result. Other columns of ``docs`` are not read.
    """
    marked = checkpoint(with_fingerprints(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", shingle, seed))
    named = _components(marked, F.col("doc_id"), radius).withColumnRenamed("first", "component_id")
    return marked.join(named, "_fp").select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42, radius: int = 4  # noqa: A002
) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest id (a null id comes last).

    Rows of one id but different texts are told apart by a hash of the text, the smallest stays; of
    rows equal in both any one stays. A component without ids keeps one row too. Null and word-free
    texts are one component (and those linked to it). A column ``__row`` raises ``ValueError``.
    """
    if "__row" in {c.lower() for c in docs.columns}:
        raise ValueError("a column is called __row")
    row = F.struct(F.col(id).isNull().alias("no_id"), F.col(id).alias("id"), F.xxhash64(text).alias("text"))
    marked = checkpoint(with_fingerprints(docs.select(row.alias("row"), F.col(text).alias("text")), ["row"], "text", shingle, seed))
    keep = _components(marked, F.col("row"), radius).select(F.col("first").alias("__row")).distinct()
    # one key, compared as a whole, so that the join and the choice among equal rows share an exchange
    return docs.withColumn("__row", row).join(keep, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
