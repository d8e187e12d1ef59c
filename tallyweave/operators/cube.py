"""The cube: five exact indicators for every combination of criteria and wildcards.

Every record gives two rows, one for its content (with its number and sizes) and one for its URL. Equal
rows are grouped, then dealt by content or URL and sorted by it. As all rows of a content or URL are then
in one task, it is counted there once for each of its cells, over integer codes, a grouping at a time:
the 64-fold expansion is never a table, and only sums by cell leave the task. A content or URL of very
many records has, once grouped, no more rows than there are combinations of criteria.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ANY, CRITERIA, INDICATORS

#: Free criteria of each mode; others but status keep their values or are wildcards throughout.
MODES = ("normal", "explicit_month", "wildcard_month")
FREE = CRITERIA[1:]


def grouping_sets(mode: str) -> list[tuple[str, ...]]:
    """The criteria, besides status, that each grouping keeps."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r}; one of {MODES}")
    rest = FREE if mode == "normal" else FREE[1:]
    sets = [c for n in range(len(rest) + 1) for c in combinations(rest, n)]
    return [("month", *s) for s in sets] if mode == "explicit_month" else sets


#: Rows that a task counts at a time; a content or URL is never cut.
CHUNK = 1 << 20
_SUMS = "meta_count long, url_count long, sha_count long, meta_size long, real_size long"


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Small integers for values, null being one of them, and the values."""
    coded = column.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _combined(columns: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """One integer for each combination of codes; ``columns`` are (codes, number of codes)."""
    code, size = columns[0]
    for c, n in columns[1:]:
        if size * n >= 2**62:
            values, code = np.unique(code, return_inverse=True)
            size = len(values)
        code, size = code * n + c, size * n
    return code


def _sum(at: np.ndarray, values: np.ndarray, cells: int) -> np.ndarray:
    out = np.zeros(cells, values.dtype)
    np.add.at(out, at, values)
    return out


def _counted(rows: pa.RecordBatch, masks: list[int]) -> Iterator[list]:
    """Columns grouping, criteria (null for wildcards) and sums of the cells of ``rows``, which hold all rows of their keys."""
    get = lambda c: rows.column(rows.schema.get_field_index(c))
    coded = [_codes(get(c)) for c in CRITERIA]
    key, _ = _codes(get("key"))
    known, is_url = get("key").is_valid().to_numpy(zero_copy_only=False), get("is_url").to_numpy(zero_copy_only=False)
    _, first, base = np.unique(_combined([(c, len(v)) for c, v in coded]), return_index=True, return_inverse=True)
    digits, content = [c[first] for c, _ in coded], ~is_url
    urls, shas, named = (key[is_url & known], base[is_url & known]), (key[content], base[content]), known[content]
    sized = get("ms").is_valid().to_numpy(zero_copy_only=False)[content]
    number = lambda c: pc.fill_null(get(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)[content]
    size = number("ms")
    if np.abs(size.astype(float)).sum() >= 2.0**62:
        size = size.astype(object)  # exact; beyond a long it fails when it becomes a column
    base_n, base_size, base_sized = (_sum(shas[1], x, len(first)) for x in (number("n"), size, sized.astype(np.int64)))
    # of several lengths of a content in a cell the largest counts: the last, by rank, 0 being none
    lengths, longest = np.unique(number("rs"), return_inverse=True)
    longest = np.where(get("rs").is_valid().to_numpy(zero_copy_only=False)[content], longest + 1, 0)
    lengths = np.append(0, lengths).astype(size.dtype)
    for mask in masks:
        keeps = [True, *(bool(mask >> i & 1) for i in range(len(FREE)))]
        _, top, cell = np.unique(_combined([(d, len(v)) for d, (_, v), k in zip(digits, coded, keeps) if k]), return_index=True, return_inverse=True)
        n = len(top)
        pairs = np.sort(urls[0] * n + cell[urls[1]])
        url_count = np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])] % n, minlength=n) if len(pairs) else np.zeros(n, np.int64)
        values, pair = np.unique(shas[0] * n + cell[shas[1]], return_inverse=True)
        at, most = values % n, np.sort(pair * len(lengths) + longest)
        most = most[np.append(most[1:] // len(lengths) != most[:-1] // len(lengths), True)] % len(lengths) if len(most) else most
        has = np.zeros(len(values), bool)
        has[pair] = named
        real, any_real = _sum(at, lengths[most], n), np.bincount(at, most > 0, n) > 0
        sums = [(_sum(cell, base_n, n), None), (url_count, None), (np.bincount(at[has], minlength=n), None), (_sum(cell, base_size, n), _sum(cell, base_sized, n) == 0), (real, ~any_real)]
        yield [
            pa.array(np.full(n, mask, np.int32)),
            *(v.take(pa.array(d[top])) if k else pa.nulls(n, v.type) for d, (_, v), k in zip(digits, coded, keeps)),
            *(pa.array(x.tolist() if x.dtype == object else x, pa.int64(), mask=none) for x, none in sums),
        ]


def _whole_keys(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows in pieces of about ``most``, cut only between keys."""
    held, rows, target = [], 0, most
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < target:
            continue
        whole = pa.concat_batches(held)
        last = whole.slice(rows - 1)
        other = pa.array(np.zeros(rows, bool))
        for c in ("is_url", "key"):
            column, value = whole.column(whole.schema.get_field_index(c)), last.column(last.schema.get_field_index(c))[0]
            differs = pc.fill_null(pc.not_equal(column, value), True) if value.is_valid else column.is_valid()
            other = pc.or_(other, differs)
        before = np.flatnonzero(other.to_numpy(zero_copy_only=False))
        cut = int(before[-1]) + 1 if len(before) else 0
        if cut:
            yield whole.slice(0, cut)
        held, rows = [whole.slice(cut)], rows - cut
        target = max(most, 2 * rows)
    if rows:
        yield pa.concat_batches(held)


def _packed(key: Column) -> Column:
    """Bytes that tell keys apart as their texts do: hex digits in pairs take half the room, anything else stays as it is."""
    text = key.cast("string")
    return F.when(text.rlike(r"\A([0-9a-f]{2})+\z"), F.concat(F.lit(bytearray(b"\1")), F.unhex(text))).otherwise(F.concat(F.lit(bytearray(b"\0")), text.cast("binary")))


def cube(normal: DataFrame, mode: str = "normal", only: list[tuple[str, ...]] | None = None) -> DataFrame:
    """Facet rows of normalized records: seven criteria, five indicators.

    ``real_size`` adds each distinct content of a cell once; a content with several lengths counts
    with the largest. Null criteria are values of their own, shown as null. ``only`` names the
    groupings to compute, by their explicit criteria, where not all cells are wanted.
    """
    keep = grouping_sets(mode) if only is None else [tuple(c for c in FREE if c in s) for s in only]
    none, one = F.lit(None).cast("long"), F.lit(1).cast("long")
    content = F.struct(F.lit(False).alias("is_url"), _packed(F.col("sha")).alias("key"), one.alias("n"), F.col("length").alias("ms"), F.col("length").alias("rs"))
    url = F.struct(F.lit(True).alias("is_url"), _packed(F.col("url_md5")).alias("key"), none.alias("n"), none.alias("ms"), none.alias("rs"))
    sums = [F.sum("n").alias("n"), F.sum("ms").alias("ms"), F.max("rs").alias("rs")]
    both = normal.select(*CRITERIA, F.explode(F.array(content, url)).alias("r")).select(*CRITERIA, "r.*")
    masks = [sum(1 << FREE.index(c) for c in s) for s in keep]
    # a cell leaves every task that meets it, so tasks are no more than keep the cores busy
    spark = normal.sparkSession
    tasks = max(1, min(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = both.groupBy(*CRITERIA, "is_url", "key").agg(*sums).repartition(tasks, "is_url", "key").sortWithinPartitions("is_url", "key")
    named = [T.StructField(f.name, f.dataType) for c in CRITERIA for f in [normal.schema[c]]]
    schema = T.StructType([T.StructField("grouping", T.IntegerType()), *named, *T._parse_datatype_string(_SUMS).fields])
    most = CHUNK

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _whole_keys(batches, most):
            for columns in _counted(piece, masks):
                cells = pa.RecordBatch.from_arrays(columns, names=schema.names)
                for at in range(0, cells.num_rows, 1 << 16):
                    yield cells.slice(at, 1 << 16)

    by_task = rows.mapInArrow(counted, schema).repartition("grouping", *CRITERIA)
    cells = by_task.groupBy("grouping", *CRITERIA).agg(*[F.sum(c).alias(c) for c in INDICATORS])
    # told by the grouping, so that a real ``*`` or null is never taken for a wildcard
    shown = {c: F.when(F.col("grouping").bitwiseAND(F.lit(1 << i)) != 0, F.col(c)).otherwise(ANY) for i, c in enumerate(FREE)}
    return cells.withColumns(shown).select(*CRITERIA, *INDICATORS)


def roll_up(facets: DataFrame, *keep: str) -> DataFrame:
    """Sums over stored cells of the additive indicators; distinct counts do not add up and are left out."""
    return facets.groupBy(*keep).agg(F.sum("meta_count").alias("meta_count"), F.sum("meta_size").alias("meta_size"))
