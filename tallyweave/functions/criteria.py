"""Column expressions that derive criteria from raw metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MISSING

# Lower bounds (exclusive) of the size classes, largest first, and their labels.
SIZE_CLASSES = (
    (125829120, "h120M+"),
    (15728640, "g15M-110M"),
    (1468006.4, "f1.4M-15M"),
    (153600, "e150K-1.4M"),
    (15360, "d15K-150K"),
    (1228.8, "c1.2K-15K"),
)
SMALLEST, EMPTY = "b0-1.2K", "a0"
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
# Extensions of content categories.
EXTENSIONS = {"HTML": ("html", "htm", "xhtml", "php", "asp", "aspx", "jsp"), "IMAGE": ("png", "jpg", "jpeg", "gif", "svg", "webp", "ico"), "VIDEO": ("mp4", "webm", "flv", "avi", "mov"), "AUDIO": ("mp3", "ogg", "wav", "m4a", "aac")}


def size_class(length: Column) -> Column:
    out = F.when(length == 0, EMPTY)
    for above, label in SIZE_CLASSES:
        out = out.when(length > F.lit(above), label)
    return F.when(length.isNotNull(), out.otherwise(SMALLEST))


def month_of(date: Column) -> Column:
    """``yyyy-MM`` of an ISO-8601 text; null if it does not start with a valid month."""
    return F.nullif(F.regexp_extract(date, r"^([0-9]{4}-(?:0[1-9]|1[0-2]))", 1), F.lit(""))


def site_of(session: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(session, "^([^@]+)@", 1), F.lit("")), F.lit(MISSING))


def tld_of(url: Column) -> Column:
    """Last label of the host, lower case; no host, an address or a host without a dot gives ``null`` text."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    named = host.rlike(r"\.[^.]+$") & ~host.rlike(r"^[0-9.]+$") & ~host.startswith("[")
    return F.when(named, F.regexp_extract(host, r"\.([^.]+)$", 1)).otherwise(MISSING)


def content_category(mime: Column, url: Column) -> Column:
    m = F.lower(F.trim(F.regexp_extract(F.coalesce(mime, F.lit("")), "^([^;]*)", 1)))
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    ext = F.regexp_extract(path, r"\.([a-z0-9]+)$", 1)
    by_ext = None
    for label, names in EXTENSIONS.items():
        by_ext = F.when(ext.isin(*names), label) if by_ext is None else by_ext.when(ext.isin(*names), label)
    return (
        F.when((m == "") | (m == MISSING), by_ext.otherwise(MISSING))
        .when((m == "text/html") | m.startswith("application/xhtml"), "HTML")
        .when(m.startswith("image/"), "IMAGE")
        .when(m.startswith("video/"), "VIDEO")
        .when(m.startswith("audio/"), "AUDIO")
        .otherwise("OTHER")
    )


def average_content_size() -> Column:
    return F.try_divide(F.col("real_size").cast("double"), F.col("sha_count").cast("double"))


def duplication_ratio() -> Column:
    return F.try_divide(F.col("meta_size").cast("double"), F.col("real_size").cast("double"))


def ascii_only(text: Column) -> Column:
    """Other characters as ``?``: for text files read by tools that expect ASCII keys."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")
