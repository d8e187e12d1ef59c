"""A byte-level convolutional network in numpy, trained on a bounded sample, that scores whole texts.

A text's bytes are cut into chunks that overlap by a filter's width, so that every place is in a
chunk. Learned filters run over each chunk; the largest response of each filter in each chunk is
kept; the mean and the largest of these over all chunks are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint

WIDTH, STRIDE, CHUNK, EMBED, FILTERS = 8, 1, 256, 6, 24  # CHUNK: places of a chunk; it spans WIDTH - 1 bytes more


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH x EMBED x FILTERS
    bias: np.ndarray  # FILTERS
    weight: np.ndarray  # 2 * FILTERS
    offset: np.ndarray  # 1

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.weight, self.offset]

    def tables(self) -> np.ndarray:
        """Response of each filter place to each byte: WIDTH x 256 x FILTERS."""
        return np.einsum("be,kef->kbf", self.embed, self.filters).astype(np.float32)


def new_network(seed: int) -> Network:
    rng = np.random.default_rng(seed)
    f = np.float32
    return Network(
        rng.normal(0, 0.5, (256, EMBED)).astype(f), rng.normal(0, 0.3, (WIDTH, EMBED, FILTERS)).astype(f), np.zeros(FILTERS, f), rng.normal(0, 0.1, 2 * FILTERS).astype(f), np.zeros(1, f)
    )


def padded(data: bytes) -> np.ndarray:
    """Bytes with at least WIDTH zeros after them, to a whole number of chunks."""
    n = -(-(len(data) + WIDTH) // CHUNK) * CHUNK
    return np.frombuffer(data + bytes(n - len(data)), np.uint8)


def responses(flat: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Responses at every STRIDE-th place of whole chunks: (chunks, CHUNK / STRIDE, FILTERS)."""
    long = np.append(flat, np.zeros(WIDTH, np.uint8))
    out = tables[0][long[0 : len(flat) : STRIDE]]
    for k in range(1, WIDTH):
        out += tables[k][long[k : k + len(flat) : STRIDE]]
    return out.reshape(-1, CHUNK // STRIDE, FILTERS)


def _end_texts(r: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Take out the places of texts' last chunks that reach into the next text (the padding before them stays)."""
    r[last, (CHUNK - WIDTH) // STRIDE + 1 :] = -np.inf
    return r


def chunk_maxima(flat: np.ndarray, tables: np.ndarray, bias: np.ndarray, last: np.ndarray, block: int = 512) -> np.ndarray:
    """(chunks, FILTERS), a bounded number of chunks at a time; ``last`` tells the last chunk of each text."""
    out, size = [], block * CHUNK
    for at in range(0, len(flat), size):
        part = flat[at : at + size + WIDTH]  # the next block's first bytes belong to this one's last chunk
        whole = min(size, len(flat) - at)
        if len(part) > whole:
            n = -(-len(part) // CHUNK) * CHUNK
            part = np.append(part, np.zeros(n - len(part), np.uint8))
        r = responses(part, tables)[: whole // CHUNK]
        out.append(_end_texts(r, last[at // CHUNK : at // CHUNK + len(r)]).max(axis=1))
    return np.maximum(np.concatenate(out) + bias, 0)


def _combined(top: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.hstack([np.add.reduceat(top, starts, axis=0) / counts[:, None], np.maximum.reduceat(top, starts, axis=0)])


def _last(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(int(counts.sum()), bool)
    out[np.cumsum(counts) - 1] = True
    return out


def scores(network: Network, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 for each whole text; null counts as empty."""
    tables, out = network.tables(), []
    batch: list[np.ndarray] = []

    def flush() -> None:
        counts = np.array([len(b) // CHUNK for b in batch])
        top = chunk_maxima(np.concatenate(batch), tables, network.bias, _last(counts))
        x = _combined(top, np.cumsum(counts) - counts, counts)
        out.append(1 / (1 + np.exp(-(x.astype(np.float64) @ network.weight.astype(np.float64) + float(network.offset[0])))))
        batch.clear()

    size = 0
    for t in texts:
        batch.append(padded((t or "").encode("utf-8", "surrogatepass")))
        size += len(batch[-1])
        if size > 1 << 20:
            flush()
            size = 0
    if batch:
        flush()
    return np.concatenate(out) if out else np.zeros(0)


def fit(texts: list[str], labels: list[int], *, epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 11) -> Network:
    """Adam on the logistic loss, classes weighted to equal sums; gradients go back through the largest responses."""
    net, rng = new_network(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    if not len(y):
        return net
    share = {c: max(1, int((y == c).sum())) for c in (0.0, 1.0)}
    w = np.array([len(y) / (2 * share[float(c)]) for c in y], np.float32)
    data = [padded(t.encode("utf-8", "surrogatepass")) for t in texts]
    params = net.parameters()
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    total = epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            some = order[at : at + batch]
            tables = net.tables()
            counts = np.array([len(data[i]) // CHUNK for i in some])
            starts = np.cumsum(counts) - counts
            flat = np.concatenate([data[i] for i in some])
            where, top, last = [], [], _last(counts)
            for c in range(0, int(counts.sum()), 512):  # a bounded number of chunks at a time
                r = responses(flat[c * CHUNK : (c + 513) * CHUNK], tables)[: min(512, int(counts.sum()) - c)]
                r = _end_texts(r, last[c : c + len(r)])
                best = r.argmax(axis=1)
                where.append(best * STRIDE + (np.arange(len(r)) + c)[:, None] * CHUNK)
                top.append(np.take_along_axis(r, best[:, None, :], axis=1)[:, 0])
            where, pre = np.concatenate(where), np.concatenate(top) + net.bias
            act = np.maximum(pre, 0)
            x = _combined(act, starts, counts)
            p = 1 / (1 + np.exp(-np.clip(x @ net.weight + net.offset[0], -30, 30)))
            g = (w[some] * (p - y[some]) / len(some)).astype(np.float32)
            gx = g[:, None] * net.weight[None, :]
            doc = np.repeat(np.arange(len(some)), counts)
            ga = gx[doc, :FILTERS] / counts[doc][:, None]
            peak = act == x[doc, FILTERS:].astype(act.dtype)
            ga += np.where(peak, gx[doc, FILTERS:], 0)
            ga = np.where(pre > 0, ga, 0)
            long = np.append(flat, np.zeros(WIDTH, np.uint8))
            cols = np.broadcast_to(np.arange(FILTERS), where.shape).ravel()
            ge, gf = np.zeros_like(net.embed), np.zeros_like(net.filters)
            for k in range(WIDTH):
                gt = np.bincount(long[where + k].ravel().astype(np.int64) * FILTERS + cols, weights=ga.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS).astype(np.float32)
                gf[k] = net.embed.T @ gt
                ge += gt @ net.filters[k].T
            grads = [ge, gf, ga.sum(axis=0), (g[:, None] * x).sum(axis=0) + 1e-4 * net.weight, np.array([g.sum()], np.float32)]
            step += 1
            lr = rate * (1 - 0.9 * step / total)
            for q, (pp, gg) in enumerate(zip(params, grads)):
                m[q] = 0.9 * m[q] + 0.1 * gg
                v[q] = 0.999 * v[q] + 0.001 * gg * gg
                pp -= lr * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.999**step)) + 1e-8)
    return net


def is_held_out(id_: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_).cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled rows of each label, least hash of the id first, none held out."""
    clean = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~is_held_out("doc_id"))
    ordered = lambda c: clean.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    picked = ordered(0).unionByName(ordered(1))
    # at most 2 * per_class ids, so the small side is bounded
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "quality")


def classify(docs: DataFrame, labels: DataFrame, *, per_class: int = 2000, most_bytes: int = 64 << 20, threshold: float = 0.3, epochs: int = 8) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    The network is fitted on the driver to a bounded sample: ``per_class`` labelled documents of each
    label and ``most_bytes`` of text in all, whole texts, by order of a hash of the id. Every document is
    scored over its whole text. Null texts count as empty; a null id is not held out and never learned
    from; several labels of one document count as the least, and of several texts of one id the one of
    least hash is learned from; unlabelled tables give an untrained, but valid score; an empty table
    gives an empty result; only the columns doc_id, text and quality are read, whatever others are called.
    """
    sample = training_rows(docs, labels, per_class).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    size = F.octet_length("text")
    texts, y, used = [], [], 0
    for r in checkpoint(sample.withColumn("_size", size)).orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        if used + r["_size"] <= most_bytes:
            texts.append(r["text"])
            y.append(r["quality"])
            used += r["_size"]
    network = fit(texts, y, epochs=epochs)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string("held_out boolean, score double, predicted int").fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores(network, [t.as_py() for t in b.column("_text")])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[f.name for f in schema.fields])

    return docs.select("doc_id", is_held_out("doc_id").alias("held_out"), F.col("text").alias("_text")).mapInArrow(rows, schema)
