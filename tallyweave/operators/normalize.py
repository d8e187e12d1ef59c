"""Validation of raw records and projection to the criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import criteria as C
from ..schema import MISSING, RECORD_KEYS, STATUSES

REASON = "reject_reason"


def from_container(df: DataFrame, column: str = "content", stringify: bool = True) -> DataFrame:
    """Record columns from a map column; ``stringify`` makes missing keys the text ``null``.

    A null map is no record and is skipped. A map with the key ``parse_error`` has a ``_corrupt_record``.
    """
    get = lambda k: F.try_element_at(F.col(column), F.lit(k))
    broken = F.when(F.map_contains_key(column, "parse_error"), F.coalesce(get("parse_error"), F.lit("")))
    return df.where(F.col(column).isNotNull()).select(*[(F.coalesce(get(k), F.lit(MISSING)) if stringify else get(k)).alias(k) for k in RECORD_KEYS], broken.alias("_corrupt_record"))


def record_length() -> Column:
    """Size in bytes: 0 for missing ones and for empty content, null where the text is no integer."""
    raw = F.col("length")
    none = raw.isNull() | raw.isin("", MISSING) | (F.lower("content") == C.EMPTY_SHA)
    return F.when(none, F.lit(0).cast("long")).when(raw.rlike("^[+-]?[0-9]+$"), F.expr("try_cast(length as bigint)"))


def reject_reason(year: str | int) -> Column:
    """The first rule that a record breaks, in order; null if it is accepted."""
    text = F.col("content")
    checks = [
        (F.coalesce(F.col("_corrupt_record").isNotNull(), F.lit(False)), "meta_parse_error"),
        (C.month_of(F.col("date")).isNull(), "no_date"),
        (~C.month_of(F.col("date")).startswith(str(year)), f"not_year:{year}"),
        (F.col("url").isNull() | (F.col("url") == ""), "no_url"),
        (F.length(F.unhex(F.md5("url"))) != 16, "bad_url_md5_length"),
        (text.isNull() | ~text.rlike("^([0-9A-Fa-f]{2})*$"), "bad_sha"),
        (F.length(text) != 64, "bad_sha_length"),
        (record_length().isNull(), "bad_length"),
        (~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "bad_status"),
    ]
    out = None
    for wrong, name in checks:
        out = F.when(wrong, name) if out is None else out.when(wrong, name)
    return out


def checked(records: DataFrame, year: str | int) -> DataFrame:
    """``records`` with ``reject_reason``, null for accepted ones."""
    if "_corrupt_record" not in records.columns:
        records = records.withColumn("_corrupt_record", F.lit(None).cast("string"))
    return records.withColumn(REASON, reject_reason(year))


def normalize(records: DataFrame, year: str | int) -> DataFrame:
    """Accepted records as criteria, content keys and length."""
    ok = checked(records, year).where(F.col(REASON).isNull())
    length = record_length()
    return ok.select(
        "status",
        C.month_of(F.col("date")).alias("month"),
        C.site_of(F.col("crawl_session")).alias("site"),
        C.content_category(F.col("type"), F.col("url")).alias("content"),
        C.tld_of(F.col("url")).alias("tld"),
        C.size_class(length).alias("size"),
        F.coalesce("level", F.lit(MISSING)).alias("level"),
        F.md5("url").alias("url_md5"),
        F.lower("content").alias("sha"),
        length.alias("length"),
    )


def audit(records: DataFrame, year: str | int) -> DataFrame:
    """Counts of rejects by reason, and of ``used_meta``."""
    return checked(records, year).groupBy(F.coalesce(REASON, F.lit("used_meta")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
