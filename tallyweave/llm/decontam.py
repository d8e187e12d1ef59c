"""Benchmark decontamination: SimHash of item-sized windows, multi-index blocks, exact verification.

Words are runs of letters and digits, lower case. A window has as many words as the item. A window
similar to an item shares a shingle with it, so only windows of the sizes and places where some item
shares one are fingerprinted: that passes over no similar window. Their weighted 128-bit SimHashes come
from running sums of the shingles' bits, so overlapping windows cost no more than their ends.

The items' fingerprints lie in a multi-index of eight blocks of 16 bits. Fingerprints that differ in the
radius (31) or fewer bits differ in three or fewer of some block; items are listed under all values one
flip away, windows ask for all values two flips away, which meet at three. The index alone proposes items
for a window. These are verified by the exact weighted similarity of shingles: sums of minimum and maximum
weight, a shingle's weight being its count times its number of characters.

Items are a query set of stated size, broadcast after a check of its bytes; a pass over the texts has a
bounded number of them, so what a worker holds does not grow with the benchmark.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_WORD = re.compile(r"[^\W_]+")
ANY_SHINGLE = 5
BLOCKS, WIDTH = 8, 16
BITS = BLOCKS * WIDTH


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], size: int) -> list[tuple[str, ...]]:
    """Word shingles; a shorter text is one shingle, an empty one has none."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def similarity(a: list[tuple[str, ...]], b: list[tuple[str, ...]]) -> float:
    """Weighted Jaccard similarity of two lists of shingles."""
    ca, cb = Counter(a), Counter(b)
    weight = lambda s: sum(map(len, s))
    low = sum(min(ca[s], cb[s]) * weight(s) for s in ca.keys() & cb.keys())
    high = sum(max(ca[s], cb[s]) * weight(s) for s in ca.keys() | cb.keys())
    return low / high if high else 0.0


def window_hashes(grams: list[tuple[str, ...]], size: int) -> np.ndarray:
    """Weighted SimHash of each run of ``size`` shingles, as BLOCKS 16-bit numbers: a bit is 1 if over half the weight has it."""
    hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(" ".join(s).encode("utf-8", "surrogatepass")) for s in grams), np.uint8)
    weight = np.array([sum(map(len, s)) for s in grams], np.int64)
    bits = np.unpackbits(hashes.reshape(-1, BITS // 8), axis=1) * weight[:, None]
    upto = np.concatenate([np.zeros((1, BITS), np.int64), np.cumsum(bits, axis=0)])
    whole = np.concatenate([[0], np.cumsum(weight)])
    over = 2 * (upto[size:] - upto[:-size]) > (whole[size:] - whole[:-size])[:, None]
    return np.packbits(over, axis=1).view(">u2").astype(np.int64)


def simhash(grams: list[tuple[str, ...]]) -> np.ndarray:
    return window_hashes(grams, len(grams))[0]


def _flips(most: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for r in range(most + 1) for c in combinations(range(WIDTH), r)], np.int64)


class HammingIndex:
    """All fingerprints within ``radius`` of a query: one of their blocks differs in ``radius // BLOCKS`` bits or less."""

    def __init__(self, fps: list[np.ndarray], radius: int):
        self.fps, self.radius = np.array(fps, np.int64).reshape(-1, BLOCKS), radius
        near = radius // BLOCKS
        own = _flips(near // 2)  # those of items; queries flip the rest
        self.asked, self.tables = _flips(near - near // 2), []
        for k in range(BLOCKS):
            values = (self.fps[:, k, None] ^ own).ravel()
            order = np.argsort(values, kind="stable")
            items = np.repeat(np.arange(len(self.fps), dtype=np.int32), len(own))
            self.tables.append((np.searchsorted(values[order], np.arange((1 << WIDTH) + 1)), items[order]))

    def proposed(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) pairs of which a block is near, before whole fingerprints are compared."""
        found = [np.zeros(0, np.int64)]
        for k, (starts, items) in enumerate(self.tables):
            at = self.asked ^ fps[:, k, None]
            lo, n = starts[at], starts[at + 1] - starts[at]
            query, n, lo = np.repeat(np.arange(len(fps)), n.sum(axis=1)), n.ravel(), lo.ravel()
            place = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
            found.append(np.unique(query * len(self.fps) + items[place]))
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.fps)), pairs % max(1, len(self.fps))

    def near(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) pairs within the radius, in order."""
        query, item = self.proposed(fps)
        held = np.bitwise_count(self.fps[item] ^ fps[query]).sum(axis=1) <= self.radius
        return query[held], item[held]


class Scanner:
    """Finds windows of texts that are similar to one of a block of items."""

    def __init__(self, items: list[tuple[object, list[str]]], shingle: int, threshold: float, radius: int):
        self.items, self.shingle, self.threshold = items, shingle, threshold
        self.grams = [shingles(w, shingle) for _, w in items]
        self.index = HammingIndex([simhash(g) for g in self.grams], radius)
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        rng = np.random.default_rng(7)
        self.salt = rng.integers(1, 1 << 63, (shingle, len(self.vocabulary) + 1), dtype=np.int64).astype(np.uint64)
        sizes: dict[int, set[int]] = {}  # key of a shingle to the sizes of items that have it
        self.short: dict[int, set[tuple[str, ...]]] = {}  # items of fewer words than a shingle are one of their size
        for _, w in items:
            if len(w) >= shingle:
                for k in self._keys(np.array([self.vocabulary[x] for x in w])).tolist():
                    sizes.setdefault(k, set()).add(len(w))
            else:
                self.short.setdefault(len(w), set()).add(tuple(w))
        self.keys = np.array(sorted(sizes), np.uint64)
        self.sizes = [sorted(sizes[k]) for k in self.keys.tolist()]

    def _keys(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - self.shingle + 1
        out = np.zeros(max(0, n), np.uint64)
        for k in range(self.shingle if n > 0 else 0):
            out ^= self.salt[k][ids[k : k + n]]
        return out

    def starts(self, words: list[str]) -> dict[int, np.ndarray]:
        """Window size to the sorted starts of windows that hold a shingle of an item of that size."""
        places: dict[int, list[int]] = {}
        if len(words) >= self.shingle and len(self.keys):
            get = self.vocabulary.get
            ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
            run = np.convolve(ids > 0, np.ones(self.shingle, np.int64), "valid") == self.shingle
            if run.any():
                keys = self._keys(ids)
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                for p in np.flatnonzero(run & (self.keys[at] == keys)).tolist():
                    for n in self.sizes[at[p]]:
                        places.setdefault(n, []).append(p)
        out = {}
        for n, found in places.items():  # all windows of the size that hold the shingle; a shorter text is one window
            last = max(0, len(words) - n)
            change = np.zeros(last + 2, np.int64)
            p = np.array(found)
            np.add.at(change, np.clip(p + self.shingle - n, 0, last), 1)
            np.add.at(change, np.minimum(p, last) + 1, -1)
            out[n] = np.flatnonzero(np.cumsum(change)[:-1] > 0)
        for n, texts in self.short.items():
            found = [p for p in range(len(words) - n + 1) if tuple(words[p : p + n]) in texts]
            if found:
                out[n] = np.array(found)
        return out

    def scan(self, words: list[str]) -> list[tuple[object, int, int, float]]:
        """(item id, first word, words, similarity) of each found item's most similar, first window."""
        best: dict[int, tuple[float, int]] = {}
        for n, starts in sorted(self.starts(words).items()):
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                for at in range(0, len(run), 512):  # a bounded number of windows at a time
                    s, e = int(run[at]), int(run[min(at + 512, len(run)) - 1])
                    grams = shingles(words[s : e + n], self.shingle)
                    size = min(len(grams), max(1, n - self.shingle + 1))
                    for k, i in zip(*(x.tolist() for x in self.index.near(window_hashes(grams, size)))):
                        if len(self.items[i][1]) == n:
                            x = similarity(grams[k : k + size], self.grams[i])
                            if x >= self.threshold and x > best.get(i, (0.0, 0))[0]:
                                best[i] = (x, s + k)
        return [(self.items[i][0], s, len(self.items[i][1]), x) for i, (x, s) in sorted(best.items())]


_BUILT: dict[str, list[Scanner]] = {}


def _scanners(tag: str, items: list, shingle: int, threshold: float, radius: int, block: int) -> list[Scanner]:
    """Built once in a worker process for all its tasks of one call; only the last call's are kept."""
    if tag not in _BUILT:
        _BUILT.clear()
        _BUILT[tag] = [Scanner(items[k : k + block], shingle, threshold, radius) for k in range(0, len(items), block)]
    return _BUILT[tag]


def _searches(
    benchmark: DataFrame, item_id: str, item_text: str, shingle: int, threshold: float, radius: int, block: int, per_pass: int, most_items: int, most_bytes: int
) -> list[Callable[[], list[Scanner]]]:
    """For each pass, what gives a worker its scanners. Items travel as one broadcast of at most ``most_bytes`` of text."""
    spark = benchmark.sparkSession
    distinct = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    n, size = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    if n > most_items or size > most_bytes:
        raise ValueError(f"{n} benchmark items of {size} bytes; at most {most_items} and {most_bytes}")
    items = [(r["i"], w) for r in distinct.orderBy("i", "t").collect() if (w := words_of(r["t"]))]
    sent, tag = spark.sparkContext.broadcast(items), uuid.uuid4().hex
    return [
        lambda k=k: _scanners(f"{tag}-{k}", sent.value[k : k + per_pass], shingle, threshold, radius, block) for k in range(0, len(items), per_pass)
    ]


def _limits(shingle: int = ANY_SHINGLE, threshold: float = 0.8, radius: int = 31, block: int = 1000, per_pass: int = 10_000, most_items: int = 100_000, most_bytes: int = 256 << 20) -> tuple:
    return shingle, threshold, radius, block, per_pass, most_items, most_bytes


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", **limits) -> DataFrame:  # noqa: A002
    """``(doc_id, item_id, start_word, n_words, similarity)`` for each document and item it holds.

    The stated query set is the benchmark: its distinct items with words, at most ``most_items`` of
    ``most_bytes`` in all (more raise ``ValueError``), searched in blocks of ``block``. Each ``per_pass``
    items take one pass over the texts, so a worker holds the index of so many at most. Ids keep their
    types. Null texts have no words and match nothing; repeated documents are reported each; items of one
    text are reported each; a null id is carried as null; empty tables give empty results; other columns,
    whatever their names, are not read.
    """
    searches = _searches(benchmark, item_id, item_text, *_limits(**limits))
    kind = benchmark.schema[item_id].dataType
    schema = T.StructType([T.StructField("doc_id", docs.schema[id].dataType), T.StructField("item_id", kind), *T._parse_datatype_string("start_word long, n_words long, similarity double").fields])
    kinds = (to_arrow_type(kind), pa.int64(), pa.int64(), pa.float64())

    def found(search: Callable[[], list[Scanner]]):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits, row = [], []
                for n, t in enumerate(b.column("_text")):
                    words = words_of(t.as_py())
                    new = [h for s in search() for h in s.scan(words)]
                    hits += new
                    row += [n] * len(new)
                cols = list(zip(*hits)) if hits else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=schema.names)

        return rows

    texts = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("_text"))
    return reduce(DataFrame.unionAll, [texts.mapInArrow(found(s), schema) for s in searches or [list]])


def without_items(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", **limits) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts hold no item; found as by ``decontaminate``, and dropped where they lie, without an exchange."""

    def clean(search: Callable[[], list[Scanner]]):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                held = [any(s.scan(words) for s in search()) for words in (words_of(t.as_py()) for t in b.column(text))]
                yield b.filter(pa.array([not h for h in held], pa.bool_()))

        return rows

    return reduce(lambda df, s: df.mapInArrow(clean(s), docs.schema), _searches(benchmark, item_id, item_text, *_limits(**limits)), docs)
