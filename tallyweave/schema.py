"""Types of the engine: records, criteria, indicators."""

from __future__ import annotations

from pyspark.sql import types as T

# Record keys, criteria in key order, indicators, accepted statuses.
RECORD_KEYS = ("date", "crawl_session", "content", "url", "length", "status", "level", "type")
CRITERIA = ("status", "month", "site", "content", "tld", "size", "level")
INDICATORS = ("meta_count", "url_count", "sha_count", "meta_size", "real_size")
STATUSES = ("ignored", "ok", "redirection", "request_error", "server_error")
ANY = "*"
MISSING = "null"

RECORD = T.StructType([T.StructField(k, T.StringType()) for k in RECORD_KEYS])
CONTAINER = T.StructType([T.StructField("content", T.MapType(T.StringType(), T.StringType()))])
FACETS = T.StructType([*(T.StructField(c, T.StringType()) for c in CRITERIA), *(T.StructField(i, T.LongType()) for i in INDICATORS)])
#: What the cube is made of: the criteria, two content keys, a size.
NORMAL = T.StructType([*(T.StructField(c, T.StringType()) for c in CRITERIA), T.StructField("url_md5", T.StringType()), T.StructField("sha", T.StringType()), T.StructField("length", T.LongType())])
