"""Masked pseudo-likelihood of documents under a bidirectional window network in numpy.

Every word is predicted from the two words on either side. The most frequent words of the corpus,
counted over all of it, are leaves of a tree of three softmax steps; any other word is a leaf for its
first byte, then spelled out byte by byte by a table of the corpus's unlisted words, so every word has a
probability of its own and none is unknown. The network starts as the corpus's unigram table.

What recurs is remembered beside the network, in a table that grows with the corpus. Texts are cut into
chunks at pairs of words whose hash says so (one in ``ONE_IN``), so that equal passages are cut alike. A
chunk's context is the pair on either side of it. Where the context stands elsewhere too, the chunk's
probability is the mean of these other places' chunks and of the network's product over its words, which
counts as ``PRIOR`` places. A document's score is the sum of the conditional log-probabilities.

Training covers all documents. They are dealt by a hash of id and text into parts of a fixed number of
words, however the table lies in files; in each round the parts learn from the same weights, and the
weights, by number of words, are averaged in a tree of bounded groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, remove, scratch_path

SHIFT = 5
BRANCH = 1 << SHIFT  # choices of a softmax step
NODES = (1, BRANCH, BRANCH**2)  # of each step
VOCABULARY = BRANCH**3
RARE = 32  # leaves of words outside the list, by first byte
HIDDEN = 16
OFFSETS = (-2, -1, 1, 2)
EDGE = VOCABULARY  # what lies beyond a text's ends
SHAPES = ((VOCABULARY + 1, HIDDEN), (len(OFFSETS), HIDDEN, HIDDEN), (HIDDEN,), *(s for n in NODES for s in ((n, HIDDEN, BRANCH), (n, BRANCH))))
END, SPELLED = 256, 257  # a word's end, and the number of things that may come next in it
BEFORE = 32 * 256  # what the spelling looks back at: the last byte, and the one before it modulo 32
ONE_IN = 16
PRIOR = 1.0
SALTS = 16
PIECE = 1 << 13  # words that go through the network together: what they need stays in a core's own cache
UPDATED = 1 << 14  # weights that are updated together, for the same reason
CHUNK = 2 << 20  # bytes of text that a worker codes and scores at a time
UNIT = 1 << 32  # logarithms are summed as whole numbers of 1 / UNIT, so that no order of rows changes a sum


def start_weights(counts: np.ndarray | None = None, seed: int = 5) -> list[np.ndarray]:
    """Random inputs and outputs of no effect, so that the biases alone give the shares of ``counts`` by id."""
    rng = np.random.default_rng(seed)
    out = [rng.normal(0, 0.5, SHAPES[0]), rng.normal(0, HIDDEN**-0.5, SHAPES[1]), np.zeros(SHAPES[2])]
    counts = (np.zeros(VOCABULARY) if counts is None else counts) + 0.5
    for n in NODES:
        out += [np.zeros((n, HIDDEN, BRANCH)), np.log(counts.reshape(n, BRANCH, -1).sum(axis=2))]
    return [w.astype(np.float32) for w in out]


def packed(weights: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


def unpacked(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for s in SHAPES:
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s).copy())
        at += n
    return out


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, where each word begins and the last ends) of strings without nulls."""
    words = words.cast(pa.large_binary())
    _, starts, data = words.buffers()
    starts = np.frombuffer(starts, np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(data or b"", np.uint8), starts


def spelling_steps(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of each word; BEFORE and next thing, as one number, of all later steps; number of these by word)."""
    data, starts = _bytes_of(words)
    size = np.diff(starts)
    flat = np.zeros(int(size.sum()) + 3 * len(size), np.int32)  # two zeros, then the bytes and the end, word by word
    to = np.cumsum(size + 3) - (size + 3)
    place = np.arange(int(size.sum())) + np.repeat(to + 2 - (starts[:-1] - starts[0]), size)
    flat[place] = data[starts[0] : starts[-1]]
    flat[to + size + 2] = END
    later = np.ones(len(flat), bool)
    later[to] = later[to + 1] = later[to + 2] = False
    at = np.flatnonzero(later)
    return flat[to + 2], ((flat[at - 2] & 31) * 256 + flat[at - 1]) * SPELLED + flat[at], size


@dataclass
class Words:
    """The listed words, and the logarithms by which others are spelled."""

    listed: pa.Array
    first: np.ndarray  # of a first byte among those of its leaf
    steps: np.ndarray  # of the next thing after what lies before

    @classmethod
    def of(cls, listed: list[str], cells: np.ndarray, sums: np.ndarray) -> Words:
        """From counts of steps; cells from BEFORE * SPELLED on count first bytes."""
        counts = np.zeros((BEFORE + 1) * SPELLED)
        counts[cells] = sums
        first = counts[BEFORE * SPELLED :][:256] + 0.5
        by_leaf = np.bincount(np.arange(256) % RARE, weights=first)
        steps = counts[: BEFORE * SPELLED].reshape(BEFORE, SPELLED)
        whole = steps.sum(axis=0) + 0.5
        back = 4 * whole / whole.sum()  # four steps' worth of the counts of any place
        steps = (steps + back) / (steps.sum(axis=1, keepdims=True) + 4)
        return cls(pa.array(listed, pa.large_string()), np.log(first / by_leaf[np.arange(256) % RARE]).astype(np.float32), np.log(steps).astype(np.float32).ravel())

    def leaves(self, words: pa.Array) -> np.ndarray:
        """The leaf of each of some distinct words, without spelling any."""
        ids = pc.fill_null(pc.index_in(words, value_set=self.listed), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        rare = np.flatnonzero(ids < 0)
        data, starts = _bytes_of(words)
        ids[rare] = VOCABULARY - RARE + (data[starts[:-1][rare]] % RARE).astype(np.int64)
        return ids

    def coded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, log-probability of the word in its leaf) of distinct words."""
        ids = pc.fill_null(pc.index_in(words, value_set=self.listed), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        spell, rare = np.zeros(len(ids), np.float32), np.flatnonzero(ids < 0)
        if len(rare):
            head, steps, size = spelling_steps(words.take(pa.array(rare)))
            ids[rare] = VOCABULARY - RARE + head % RARE
            spell[rare] = self.first[head] + np.add.reduceat(self.steps[steps], np.cumsum(size) - size)
        return ids, spell


def split_words(texts: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(words of some texts, number by text), in order, about ``chunk`` bytes at a time. Words have no ASCII white space."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // chunk
    edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            split = pc.ascii_split_whitespace(texts[a:b])
            bounds, words = split.offsets.to_numpy(), split.flatten()
            bounds = bounds - bounds[0]
            real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
            yield words.filter(pa.array(real)), np.diff(np.concatenate([[0], np.cumsum(real)])[bounds])


def word_counts(docs: DataFrame, text: str = "text", most_held: int = 1 << 20) -> DataFrame:
    """``(word, n)`` over all texts. A task adds up counts of about ``most_held`` words before it sends any."""

    def added(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            for words, _ in split_words(b.column(0), 4 * CHUNK):  # fewer counts to add up
                found = pc.value_counts(words)
                held.append(pa.table([found.field(0).cast(pa.string()), found.field(1)], names=["word", "n"]))
                if sum(map(len, held)) > most_held:
                    held = [added(held)]
                    if len(held[0]) > most_held // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from added(held).to_batches()

    return docs.select(text).mapInArrow(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, most: int) -> list:
    """Rows of the ``most`` largest counts, then by word. Tasks send only words near the bound or above it, not ``most`` each."""
    step = F.floor(F.log2("n") * 16)
    rest, least = most, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):  # 1024 rows at most
        rest, least = rest - r["words"], r["step"]
        if rest <= 0:
            break
    return counts.where(step >= least).orderBy(F.desc("n"), "word").limit(most).collect()


def learn_words(counts: DataFrame) -> tuple[Words, np.ndarray]:
    """The words of ``counts``, and the number of occurrences of each id."""
    top = _most_frequent(counts, VOCABULARY - RARE)
    listed = [r["word"] for r in top]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = pa.array(listed, pa.string()), np.zeros((BEFORE + 1) * SPELLED, np.int64)
        for b in batches:
            rare = pa.array(pc.is_null(pc.index_in(b.column("word"), value_set=known)))
            n = b.column("n").filter(rare).to_numpy(zero_copy_only=False)
            head, steps, size = spelling_steps(b.column("word").filter(rare))
            np.add.at(total, BEFORE * SPELLED + head, n)
            np.add.at(total, steps, np.repeat(n, size))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    # at most (BEFORE + 1) * SPELLED cells, whatever the corpus
    cells = counts.select("word", "n").mapInArrow(rows, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cell, n = cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.int64)
    by_id = np.zeros(VOCABULARY)
    by_id[: len(listed)] = [r["n"] for r in top]
    first = cell >= BEFORE * SPELLED
    np.add.at(by_id, VOCABULARY - RARE + (cell[first] - BEFORE * SPELLED) % RARE, n[first])
    return Words.of(listed, cell, n), by_id


def windows(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, their context ids) of texts laid end to end with edges between."""
    edge = np.full(2, EDGE, ids[0].dtype if ids else np.uint16)
    flat = np.concatenate([edge, *(x for d in ids for x in (d, edge))])
    at = np.flatnonzero(flat != EDGE)
    return flat[at], np.stack([flat[at + o] for o in OFFSETS])


def _hidden(weights: list[np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inputs side by side, hidden values and a 1, by which outputs have their bias) of words whose context ids are rows."""
    inputs = weights[0].take(context, axis=0).reshape(len(context), -1)
    h = np.ones((len(context), HIDDEN + 1), inputs.dtype)
    inner = inputs @ weights[1].reshape(-1, HIDDEN)
    inner += weights[2]
    np.tanh(inner, out=h[:, :HIDDEN])
    return inputs, h


def _outputs(weights: list[np.ndarray]) -> list[np.ndarray]:
    """Of each softmax step, the weights by node with the biases as their last row."""
    return [np.concatenate([weights[3 + 2 * k], weights[4 + 2 * k][:, None]], axis=1) for k in range(len(NODES))]


def _steps(outputs: list[np.ndarray], h: np.ndarray, target: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]], np.ndarray, np.ndarray, np.ndarray]]:
    """For each softmax step: (its number, nodes in use and where their words begin and end, choice of each word, exponentials, their sums). ``target`` is sorted."""
    z = np.empty((len(h), BRANCH), h.dtype)
    for k, w in enumerate(outputs):
        node, choice = target >> SHIFT * (3 - k), target >> SHIFT * (2 - k) & BRANCH - 1
        begin = np.flatnonzero(np.diff(node, prepend=-1))
        used = list(zip(node[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(node)]))
        for n, a, b in used:
            np.dot(h[a:b], w[n], out=z[a:b])
        np.clip(z, -60, 60, out=z)  # hidden values are within 1, so logits stay far below this
        np.exp(z, out=z)
        yield k, used, choice, z, z @ np.ones(BRANCH, z.dtype)


def _sorted_pieces(target: np.ndarray, context: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, leaves, context ids by row) of ``PIECE`` words at a time, sorted by leaf, so that words of a node lie together."""
    order = np.argsort(target.astype(np.uint16, copy=False), kind="stable")
    for a in range(0, len(order), PIECE):
        places = order[a : a + PIECE]
        yield places, target[places], context.T[places]


def log_probabilities(weights: list[np.ndarray], target: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Log-probability of each leaf given both sides."""
    outputs, out = _outputs(weights), np.empty(len(target), np.float64)
    for places, leaves, ids in _sorted_pieces(target, context):
        at = np.arange(len(leaves))
        _, h = _hidden(weights, ids)
        p = np.ones(len(leaves), h.dtype)
        for _, _, choice, z, sums in _steps(outputs, h, leaves):
            p *= z[at, choice] / sums
        out[places] = np.log(np.maximum(p, 1e-30))
    return out


def _room(weights: list[np.ndarray]) -> list[np.ndarray]:
    return [np.empty_like(w) for w in (weights[0], weights[1].reshape(-1, HIDDEN), weights[2], *_outputs(weights))]


def gradients(weights: list[np.ndarray], target: np.ndarray, context: np.ndarray, outputs: list[np.ndarray] | None = None, room: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Of the mean negative log-probability. ``outputs`` are those of ``weights`` if at hand; ``room`` of an earlier call's size is overwritten."""
    outputs, inner, dtype = outputs or _outputs(weights), weights[1].reshape(-1, HIDDEN), weights[0].dtype
    of_inputs, of_inner, of_bias, *of_outputs = room or _room(weights)
    for g in (of_inputs, of_inner, of_bias, *of_outputs):
        g.fill(0)
    pairs = np.complex64 if dtype == np.float32 else np.complex128  # two sums at a time
    part = dtype.type(1 / max(1, len(target)))
    for _, leaves, ids in _sorted_pieces(target, context):
        at = np.arange(len(leaves))
        inputs, h = _hidden(weights, ids)
        gh = np.zeros((len(h), HIDDEN), dtype)
        for k, used, choice, z, sums in _steps(outputs, h, leaves):
            z *= (part / sums)[:, None]
            z[at, choice] -= part
            w, gw = outputs[k][:, :HIDDEN].transpose(0, 2, 1), of_outputs[k]
            for i, a, b in used:
                gw[i] += np.dot(h[a:b].T, z[a:b])  # a node's words may go on in the next piece
                gh[a:b] += np.dot(z[a:b], w[i])
        h = h[:, :HIDDEN]
        h *= h
        gh *= 1 - h
        of_bias += gh.sum(axis=0)
        of_inner += inputs.T @ gh
        ids = ids.astype(np.uint16).ravel()
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.diff(ids[order], prepend=ids[order[0]] ^ 1))
        by_id = (gh @ inner.T).view(pairs).reshape(len(ids), -1).take(order, axis=0)
        of_inputs[ids[order[first]]] += np.add.reduceat(by_id, first, axis=0).view(dtype)
    return [of_inputs, of_inner.reshape(weights[1].shape), of_bias, *(g for w in of_outputs for g in (w[:, :HIDDEN], w[:, HIDDEN]))]


class Learner:
    """Adam over mini-batches of words that arrive text by text."""

    def __init__(self, weights: list[np.ndarray], rate: float, batch: int):
        self.outputs = _outputs(weights)  # the weights that follow are parts of these
        self.weights = [*weights[:3], *(w for o in self.outputs for w in (o[:, :HIDDEN], o[:, HIDDEN]))]
        self.rate, self.batch, self.room = rate, batch, _room(weights)
        self.m, self.v, self.step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        self.held: list[np.ndarray] = []
        self.n = self.words = 0

    def add(self, ids: np.ndarray) -> None:
        if len(ids):
            self.held.append(ids)
            self.n += len(ids)
            if self.n >= self.batch:
                self.learn()

    def learn(self) -> None:
        if not self.held:
            return
        target, context = windows(self.held)
        self.words += self.n
        self.held, self.n = [], 0
        for at in range(0, len(target), 2 * self.batch):
            self.step += 1
            scale = self.rate * (1 - 0.99**self.step) ** 0.5 / (1 - 0.9**self.step)
            found = gradients(self.weights, target[at : at + 2 * self.batch], context[:, at : at + 2 * self.batch], self.outputs, self.room)
            for whole in zip(self.weights, self.m, self.v, found):
                rows = max(1, UPDATED // max(1, whole[0][:1].size))
                for a in range(0, len(whole[0]), rows):
                    self.update(*(x[a : a + rows] for x in whole), scale)

    @staticmethod
    def update(w: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, scale: float) -> None:
        m *= 0.9
        m += 0.1 * g
        g *= g
        v *= 0.99
        g *= 0.01
        v += g
        np.sqrt(v, out=g)
        g += 1e-8
        np.divide(m, g, out=g)
        g *= scale
        w -= g


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of what parts learned, which is small and travels in half precision."""
    n = pdf["n"].to_numpy(np.float64)
    flat = np.zeros(sum(int(np.prod(s)) for s in SHAPES))
    for k, w in sorted(zip(n, pdf["change"])):
        flat += k * np.frombuffer(w, np.float16)
    return pd.DataFrame({"place": [int(pdf["place"].iloc[0])], "n": [int(n.sum())], "change": [(flat / max(1.0, n.sum())).astype(np.float16).tobytes()]})


def dealt(docs: DataFrame, words: Words, id_: str, text: str, parts: int, rounds: int) -> DataFrame:
    """``(round, part, key, ids)`` of all texts with words; both places are a hash's, so they do not depend on files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for found, n in split_words(b.column("t")):
                coded = found.dictionary_encode()
                flat = words.leaves(coded.dictionary).astype("<u2")[coded.indices.to_numpy(zero_copy_only=False)]
                ends = np.concatenate([[0], np.cumsum(n)]) * 2
                ids = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat.tobytes())]).cast(pa.binary())
                some = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([b.column("key").slice(at, len(n)).filter(some), ids.filter(some)], names=["key", "ids"])
                at += len(n)

    keyed = docs.select(F.xxhash64(id_, text).alias("key"), F.col(text).alias("t")).mapInArrow(rows, "key long, ids binary")
    return keyed.select(F.pmod("key", F.lit(rounds)).cast("int").alias("round"), F.pmod(F.shiftright("key", 20), F.lit(parts)).cast("int").alias("part"), "key", "ids")


def train(docs: DataFrame, words: Words, counts: np.ndarray, *, id: str = "doc_id", text: str = "text", rounds: int = 4, rate: float = 0.02, steps: int = 64, most: int = 32768, part_words: int = 1 << 21, least_parts: int = 8, fan_in: int = 8) -> list[np.ndarray]:  # noqa: A002
    """Weights learned from every document once, in ``rounds`` of about ``part_words`` words a part, less where ``least_parts`` parts of ``steps`` steps can be had; a step has 1024 words at least and ``most`` at most."""
    flat, schema = packed(start_weights(counts)), "place int, n long, change binary"
    of_round = float(counts.sum()) / rounds
    parts = max(1, round(max(of_round / part_words, min(least_parts, of_round / (1024 * steps)))))
    batch = int(np.clip(of_round / parts / steps, 1024, most))
    path = scratch_path(docs.sparkSession, "lm-ids")
    dealt(docs, words, id, text, parts, rounds).write.partitionBy("round").parquet(path)
    every = docs.sparkSession.read.schema("part int, key long, ids binary, round int").parquet(path)
    for r in range(rounds):

        def learn(batches: Iterator[pa.RecordBatch], start: np.ndarray = flat) -> Iterator[pa.RecordBatch]:
            learner, now = None, -1
            out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([learner.words], pa.int64()), pa.array([(packed(learner.weights) - start).astype(np.float16).tobytes()], pa.binary())], names=["place", "n", "change"])
            for b in batches:
                for part, ids in zip(b.column("part").to_pylist(), b.column("ids")):
                    if part != now:
                        if learner:
                            learner.learn()
                            yield out()
                        learner, now = Learner(unpacked(start), rate, batch), part
                    learner.add(np.frombuffer(ids.as_buffer(), "<u2"))
            if learner:
                learner.learn()
                yield out()

        part = every.where(F.col("round") == r).select("part", "key", "ids").repartition(parts, "part").sortWithinPartitions("part", "key", "ids")
        level, places = part.mapInArrow(learn, schema), parts
        while places > 1:  # averages of fan_in, then of those
            places = -(-places // fan_in)
            level = level.withColumn("place", F.floor(F.col("place") / fan_in).cast("int")).groupBy("place").applyInPandas(_average, schema)
        found = level.collect()  # one row, or none if no text has a word
        if found:
            flat = flat + np.frombuffer(found[0]["change"], np.float16).astype(np.float32)
    remove(docs.sparkSession, path)
    return unpacked(flat)


def score_texts(weights: list[np.ndarray], ids: list[np.ndarray], block: int = 1 << 16) -> np.ndarray:
    """Conditional log-probabilities of the leaves of all words of some texts, a bounded number at a time."""
    if not sum(map(len, ids)):
        return np.zeros(0)
    target, context = windows(ids)
    return np.concatenate([log_probabilities(weights, target[a : a + block], context[:, a : a + block]) for a in range(0, len(target), block)])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * np.uint64(0xD6E8FEB86659FD93)) ^ (b * np.uint64(0xA0761D6478BD642F))
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xE7037ED1A0B428DB)
    return out ^ (out >> np.uint64(29))


@dataclass
class Chunks:
    """Chunks of texts laid end to end: where they begin and end, hashes of their contexts and words, their number by text."""

    start: np.ndarray
    end: np.ndarray
    context: np.ndarray
    target: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray) -> Chunks:
        """From word hashes. A text's ends bound its first and last chunk; nothing lies between pairs that touch."""
        n, ends = len(hashes), np.cumsum(counts)
        text = np.repeat(np.arange(len(counts)), counts)
        pair = _mixed(hashes[:-1], hashes[1:])
        cut = np.flatnonzero((pair % np.uint64(ONE_IN) == 0) & (text[:-1] == text[1:])) if n else np.zeros(0, np.int64)
        some = np.flatnonzero(counts)
        at = np.concatenate([ends[some] - counts[some], cut])  # texts' beginnings come before a pair at the same place
        order = np.argsort(at, kind="stable")
        of_text = np.concatenate([some, text[cut]])[order]
        start = np.concatenate([ends[some] - counts[some], cut + 2])[order]
        left = np.concatenate([np.zeros(len(some), np.uint64), pair[cut] if n else np.zeros(0, np.uint64)])[order]
        last = np.append(of_text[1:] != of_text[:-1], True)[: len(start)]
        end = np.where(last, ends[of_text], np.append(at[order][1:], 0)[: len(start)])
        right = np.where(last, np.uint64(0), np.append(left[1:], np.uint64(0))[: len(start)])
        held = np.flatnonzero(end > start)
        start, end, of_text = start[held], end[held], of_text[held]
        # a polynomial in an odd number, whose inverse moves each chunk to its own beginning
        up, down = (np.cumprod(np.append(np.uint64(1), np.full(n, r, np.uint64))) for r in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
        sums = np.append(np.uint64(0), np.cumsum(hashes * up[:n]))
        target = _mixed((sums[end] - sums[start]) * down[start], (end - start).astype(np.uint64))
        return cls(start, end, _mixed(left[held], right[held]), target, np.bincount(of_text, minlength=len(counts)))


def _scores(docs: DataFrame, words: Words, weights: list[np.ndarray], id_: str, text: str) -> DataFrame:
    """``(doc_id, n_words, total, contexts, targets, logs)``: sums in UNITs; of each chunk the hashes and the log-probability."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_].dataType), *T._parse_datatype_string("n_words long, total long, contexts array<long>, targets array<long>, logs array<float>").fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = 0
            for found, n in split_words(b.column("_text")):
                coded = found.dictionary_encode()
                at = coded.indices.to_numpy(zero_copy_only=False)
                ids, spell = words.coded(coded.dictionary)
                data, starts = _bytes_of(coded.dictionary)
                data = data.tobytes()
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist())), np.uint64, len(ids))
                ends = np.concatenate([[0], np.cumsum(n)])
                p = score_texts(weights, np.split(ids.astype(np.uint16)[at], ends[1:-1])) + spell[at]
                sums = np.concatenate([[0], np.cumsum(np.round(p * UNIT).astype(np.int64))])
                c = Chunks.of(hashes[at], n)
                lists = pa.array(np.concatenate([[0], np.cumsum(c.counts)]).astype(np.int32))
                arrays = [b.column("doc_id").slice(row, len(n)), pa.array(n), pa.array(sums[ends[1:]] - sums[ends[:-1]])]
                logs = ((sums[c.end] - sums[c.start]) / UNIT).astype(np.float32)
                arrays += [pa.ListArray.from_arrays(lists, pa.array(v)) for v in (c.context.view(np.int64), c.target.view(np.int64), logs)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
                row += len(n)

    return docs.select(F.col(id_).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(rows, schema)


def remembered(scored: DataFrame) -> DataFrame:
    """``(row, gain)``: what the other places of recurring contexts add to a row's sum, in UNITs.

    A context's places are counted by partial sums before the exchange, and chunks whose context does not
    recur are left behind by a join, which adaptive execution splits where a context is very common.
    """
    spark = scored.sparkSession
    each = scored.select("row", F.explode(F.arrays_zip("contexts", "targets", "logs")).alias("m")).select("row", F.col("m.contexts").alias("context"), F.col("m.targets").alias("target"), F.col("m.logs").alias("log"))
    places = F.count(F.lit(1))
    again = checkpoint(each.groupBy("context").agg(places.alias("n"), F.min("target").alias("least"), F.max("target").alias("most")).where("n > 1"))
    path = scratch_path(spark, "lm-recurring")
    each.join(again, "context").write.parquet(path)
    hits = spark.read.parquet(path)
    # other contexts have one chunk in all places; a very common chunk is dealt over SALTS tasks
    mixed = hits.where("least <> most").groupBy("context", "target").agg(places.alias("same")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = hits.where("least <> most").withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    found = salted.join(mixed, ["context", "target", "salt"]).drop("salt").unionByName(hits.where("least = most").withColumn("same", F.col("n")))
    p = (F.col("same") - 1 + PRIOR * F.exp(F.col("log").cast("double"))) / (F.col("n") - 1 + PRIOR)
    return found.groupBy("row").agg(F.sum(F.round((F.log(p) - F.col("log")) * UNIT).cast("long")).alias("gain"))


def pseudo_likelihood(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **how) -> DataFrame:  # noqa: A002
    """``(doc_id, n_words, log_likelihood, mean_log_likelihood)`` for each row of ``docs``.

    Counts, training and scores cover every document's whole text. Words are runs without ASCII white
    space. Texts without words (null, empty, blank) have 0 words, sum 0.0 and a null mean; repeated rows
    are scored each, and recur; a null id is carried as null; an empty table gives an empty result; other
    columns are not read. How ``docs`` lies in partitions only matters to single-precision rounding.
    """
    spark = docs.sparkSession
    words, by_id = learn_words(checkpoint(word_counts(docs, text)))
    weights = train(docs, words, by_id, id=id, text=text, **how)
    path = scratch_path(spark, "lm-scores")  # written once, so that a row keeps its number
    _scores(docs, words, weights, id, text).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    scored = spark.read.parquet(path)
    whole = (F.col("total") + F.coalesce(F.col("gain"), F.lit(0))) / UNIT
    return scored.select("row", "doc_id", "n_words", "total").join(remembered(scored), "row", "left").select(
        "doc_id", "n_words", whole.alias("log_likelihood"), F.when(F.col("n_words") > 0, whole / F.col("n_words")).alias("mean_log_likelihood")
    )
