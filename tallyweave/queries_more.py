"""More registered queries: sources and sinks, the stored cube, charts, scripts' operators and functions."""

from __future__ import annotations

import json
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import pig
from .operators import chart, cube as cubes, normalize, relational, stats
from .operators.filters import Filter, FilterGroup, series_predicate
from .plans import launch
from .plans.jobs import JobRunner, Script, ScriptStore
from .plans.query import ChartQuery, get_stats, point_cells
from .plans.sqltext import SqlText
from .queries import _ALL, _SIZE, _cube_sql, _m, facets, query, records, table
from .schema import CRITERIA, INDICATORS, STATUSES
from .scratch import scratch_path
from .sources import tables
from .sources.store import FacetStore
from .streaming import ingest

# Content types of made-up crawl records, by page_id modulo 8; the last has none.
_TYPES = ("text/html", "text/html; charset=utf-8", "application/xhtml+xml", "image/png", "Video/mp4", "audio/ogg", "application/pdf")
_CATEGORIES = ("HTML", "HTML", "HTML", "IMAGE", "VIDEO", "AUDIO", "OTHER")


def _crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as raw crawl records of 2013."""
    k = F.col("page_id")
    html = F.coalesce("html", F.lit(""))
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.format_string("2013-%02d-05T10:00:00Z", k % 12 + 1).alias("date"),
        F.when(k % 11 == 0, "plain").otherwise(F.concat(F.lit("site"), (k % 7).cast("string"), F.lit("@2013"))).alias("crawl_session"),
        F.sha2(html, 256).alias("content"),
        "url",
        F.octet_length(html).cast("string").alias("length"),
        pick(STATUSES, 5).alias("status"),
        (k % 3).cast("string").alias("level"),
        F.when(k % 8 < 7, pick((*_TYPES, ""), 8)).alias("type"),
    )


def _crawl_sql(where: str = "true") -> str:
    status = " ".join(f"when {i} then '{s}'" for i, s in enumerate(STATUSES))
    content = " ".join(f"when {i} then '{c}'" for i, c in enumerate(_CATEGORIES))
    return rf"""m as (select case page_id % 5 {status} end as status, '2013-' || lpad(cast(page_id % 12 + 1 as varchar), 2, '0') as month,
 case when page_id % 11 = 0 then 'null' else 'site' || (page_id % 7) end as site, case page_id % 8 {content} else case when regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1) like '%.html' then 'HTML' else 'null' end end as content,
 coalesce(nullif(lower(regexp_extract(url, '^[a-z]+://[^/:?#]*\.([A-Za-z]+)', 1)), ''), 'null') as tld, {_SIZE} as size, cast(page_id % 3 as varchar) as level,
 md5(url) as url_md5, sha256(coalesce(html, '')) as sha, len as length from (select *, cast(strlen(coalesce(html, '')) as bigint) as len from pages) where {where})"""


def _containers(spark: SparkSession, sf_dir: str) -> str:
    """The crawl as containers in two folders: some maps are null, some tell of a parse error, some lack the type."""
    k, rows = F.col("page_id"), _crawl(spark, sf_dir)
    pairs = [x for c in rows.columns[1:-1] for x in (F.lit(c), F.col(c))]
    whole = F.create_map(*pairs)
    typed = F.when(F.col("type").isNull(), whole).otherwise(F.map_concat(whole, F.create_map(F.lit("type"), "type")))
    content = F.when(k % 17 == 0, F.lit(None)).when(k % 13 == 0, F.map_concat(typed, F.create_map(F.lit("parse_error"), F.lit("line 1")))).otherwise(typed)
    path = scratch_path(spark, "containers")
    for part in (0, 1):
        rows.where(k % 2 == part).select(content.alias("content")).write.parquet(f"{path}/{part}")
    return f"{path}/0, {path}/1"


def _listed(df: DataFrame, order: str = "at") -> DataFrame:
    """The rows of a chart-sized result with their places in its order."""
    rows = df.collect()
    return df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{order} long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))


# --- sources and sinks
@query(f"with {_crawl_sql('page_id % 17 <> 0 and page_id % 13 <> 0')} select {', '.join(CRITERIA)}, count(*) as n, cast(sum(length) as bigint) as bytes from m group by all")
def container_scan(spark, sf_dir):
    rows = normalize.normalize(tables.read_containers(spark, _containers(spark, sf_dir)), 2013)
    return rows.groupBy(*CRITERIA).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


@query("select case when page_id % 13 = 0 then 'meta_parse_error' else 'used_meta' end as reason, count(*) as n from pages where page_id % 17 <> 0 group by 1")
def container_audit(spark, sf_dir):
    return normalize.audit(tables.read_containers(spark, _containers(spark, sf_dir)), 2013)


@query("select case page_id % 10 when 0 then 'wrong_record_class' when 1 then 'wrong_content_class' when 2 then 'meta_parse_error' else 'used_meta' end as reason, count(*) as n from pages group by 1")
def json_records_scan(spark, sf_dir):
    k, rows = F.col("page_id"), _crawl(spark, sf_dir)
    line = F.to_json(F.struct(F.when(k % 10 == 0, "Blob").otherwise("Record").alias("record_class"), F.when(k % 10 == 1, "data").otherwise("metadata_json").alias("record_type"), *rows.columns[1:]))
    path = scratch_path(spark, "json-records")
    rows.select(F.when(k % 10 == 2, F.lit('{"date": ')).otherwise(line).alias("value")).write.text(path)
    return normalize.audit(tables.read_json_records(spark, path), 2013).unionByName(tables.wrong_records(spark, path))


@query(r"select key || chr(9) || count(*) as line from (select lower(regexp_extract(url, '^[a-z]+://[^/:?#]*\.([A-Za-z]+)', 1)) as key from pages) group by key")
def counts_text(spark, sf_dir):
    path = scratch_path(spark, "counts")
    tables.write_counts(stats.count_by_key(table(spark, sf_dir, "pages"), normalize.C.tld_of(F.col("url"))), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("select 'lines' as kind, count(*) as n from nation union all select 'iterated', count(*) from nation")
def part_lines(spark, sf_dir):
    path = scratch_path(spark, "parts")
    table(spark, sf_dir, "nation").select("n_name").repartition(3).write.text(path)
    counted, iterated = tables.read_parts(spark, path).count(), sum(1 for _ in tables.iterate_parts(spark, path))
    return spark.createDataFrame([("lines", counted), ("iterated", iterated)], "kind string, n long")


@query("select cast(n_nationkey as varchar) as a, n_name as b, cast(n_regionkey as varchar) as c from nation where n_nationkey % 4 <> 0")
def split_lines(spark, sf_dir):
    k, path = F.col("n_nationkey"), scratch_path(spark, "lines")
    table(spark, sf_dir, "nation").select(F.when(k % 4 == 0, "bad;line").otherwise(F.concat(k.cast("string"), F.lit(";"), "n_name", F.lit(", "), F.col("n_regionkey").cast("string")))).write.text(path)
    rows = tables.read_split_lines(spark, path, r"[;,]\s*", fields=3)
    return rows.select(*[F.col("fields")[i].alias(c) for i, c in enumerate("abc")])


@query("select r_regionkey as k, r_name as name, loader from region cross join (values ('PigStorage'), ('JsonLoader'), ('BinStorage')) v(loader) union all select null, r_regionkey || ' ' || r_name, 'TextLoader' from region")
def pig_load_store(spark, sf_dir):
    rows, out = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), []
    for loader in ("PigStorage", "JsonLoader", "BinStorage"):
        path = scratch_path(spark, loader)
        tables.store(rows, path, loader)
        out.append(tables.load(spark, path, loader, "k int, name string").withColumn("loader", F.lit(loader)))
    path = scratch_path(spark, "TextLoader")
    tables.store(rows.select(F.concat_ws(" ", "k", "name")), path, "TextLoader")
    out.append(tables.load(spark, path, "TextLoader").select(F.lit(None).cast("int").alias("k"), F.col("value").alias("name"), F.lit("TextLoader").alias("loader")))
    return relational.union_on_schema(*out)


# --- the stored cube
def _store(spark: SparkSession, sf_dir: str, name: str = "cube") -> FacetStore:
    """Tables of one session and data folder."""
    return FacetStore(spark, f"tallyweave_{name}_{zlib.crc32(f'{spark.sparkContext.applicationId} {sf_dir}'.encode()):08x}")


def stored_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cube of 1998, computed for the first question of a session and read from its table from then on."""
    store = _store(spark, sf_dir)
    if "1998" not in store.years():
        store.save(cubes.cube(records(spark, sf_dir)), 1998)
    return store.facets(1998)


@query(f"with {_m()}, f as ({_cube_sql([('site', 'content')])}) select {', '.join(INDICATORS)} from f where status = 'ok' and site = 'BUILDING' and content = 'R'")
def stored_point(spark, sf_dir):
    return point_cells(stored_facets(spark, sf_dir), [Filter("site", "equal", "BUILDING"), Filter("content", "equal", "R")]).select(*INDICATORS)


@query(f"with {_m()}, f as ({_cube_sql([('site',)])}) select {', '.join(INDICATORS)} from f where status = 'ok' and site = 'BUILDING'")
def stored_stats(spark, sf_dir):
    found = get_stats(stored_facets(spark, sf_dir), [Filter("site", "equal", "BUILDING")])
    return spark.createDataFrame([tuple(found[i] for i in INDICATORS)], ", ".join(f"{i} long" for i in INDICATORS))


@query(f"with {_m()}, f as ({_cube_sql([('month', 'content')])}) select month, content, url_count from f where status = 'ok' and content <> 'A' and url_count > 10")
def stored_series(spark, sf_dir):
    asked = ChartQuery(x="month", key="content", y="url_count", filters=(Filter("content", "different", "A"),), y_operator="greater_than", y_value="10")
    return asked.run(stored_facets(spark, sf_dir))


@query(f"with {_m()}, f as ({_cube_sql([('tld',)])}) select tld, sha_count from f where status = 'ok' order by sha_count desc, tld limit 10")
def stored_top(spark, sf_dir):
    return ChartQuery(x="tld", y="sha_count", top=10).run(stored_facets(spark, sf_dir))


@query(f"with {_m()} select status, site, count(*) as meta_count, cast(sum(length) as bigint) as meta_size from m group by status, site")
def stored_roll_up(spark, sf_dir):
    cells = stored_facets(spark, sf_dir).where("month <> '*' and site <> '*' and content = '*' and tld = '*' and size = '*' and level = '*'")
    return cubes.roll_up(cells, "status", "site")


@query(f"with {_m()}, f as ({_cube_sql([('month',)])}) select '1998' as year, status, month, {', '.join(INDICATORS)} from f")
def year_tables(spark, sf_dir):
    """Import of two years' text, listing, and dropping of one."""
    store, path = _store(spark, sf_dir, "years"), scratch_path(spark, "facet-text")
    tables.write_facet_text(facets(spark, sf_dir, ("month",)), path)
    for year in (1997, 1998):
        store.import_year(path, year)
    store.drop(1997)
    return relational.union_on_schema(*[store.facets(y).select(F.lit(y).alias("year"), "status", "month", *INDICATORS) for y in store.years()])


@query(f"with {_crawl_sql('page_id % 17 <> 0 and page_id % 13 <> 0')} {_cube_sql([s for s in _ALL if len(s) in (0, 1, 6)])}")
def launched_cube(spark, sf_dir):
    """The job by its arguments, from containers to text; cells of no, one and all explicit criteria."""
    out = launch.run(spark, ["-input", _containers(spark, sf_dir), "-output", scratch_path(spark, "launched"), "-year", "2013", "-reducers", "3"])
    explicit = sum((F.col(c) != "*").cast("int") for c in CRITERIA[1:])
    return tables.read_facet_text(spark, out).where(explicit.isin(0, 1, 6))


@query("select n_regionkey || ',' || count(*) || ',a TABLE b' as line from nation group by n_regionkey")
def sql_text_lines(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("tallyweave_nation")
    text = SqlText(spark, "tallyweave_nation")
    asked = "select n_regionkey, count(*), 'a TABLE b' /* TABLE */ from TABLE group by n_regionkey"
    first = text.lines(asked)
    text.update("create or replace temporary view tallyweave_other as select * from TABLE")
    return spark.createDataFrame([(line,) for line in (text.lines(asked) if first == text.lines(asked) else [])], "line string")


# --- filters and charts
@query(f"with {_m()}, f as ({_cube_sql([('level',), ()])}) select status, level, meta_count from f where level >= '3' and level < '6'")
def filter_lexical(spark, sf_dir):
    group = FilterGroup("and", [Filter("level", "greater_than_equal", "3"), Filter("level", "lower_than", "6")])
    return facets(spark, sf_dir, ("level",), ()).where(group.to_column(lexical=True)).select("status", "level", "meta_count")


def _month_content(spark, sf_dir):
    return facets(spark, sf_dir, ("month", "content")).where(series_predicate(("month", "content"), [])).select("month", "content", "meta_count")


_F = f"with {_m()}, f as ({_cube_sql([('month', 'content')])}), s as (select * from f where status = 'ok')"


@query(f"{_F} select month as x, content as key, cast(meta_count as double) as y from s where meta_count > 30 and content <> 'N'")
def chart_row_filter(spark, sf_dir):
    return chart.points(_month_content(spark, sf_dir), chart.ChartInfo(0, 2, 1, "string"), row_filter="meta_count > 30 and content <> 'N'")


@query(f"{_F} select substr(month, 6) as x, lower(content) as key, meta_count / 2.0 as y from s where content <> 'A'")
def chart_transform(spark, sf_dir):
    point = F.when(F.col("key") != "A", F.struct(F.substr("x", F.lit(6)).alias("x"), F.lower("key").alias("key"), (F.col("y") / 2).alias("y")))
    return chart.points(_month_content(spark, sf_dir), chart.ChartInfo(0, 2, 1, "string"), transform=point)


@query(f"{_F} select content as key, string_agg(month || ':' || meta_count, ' ' order by month) as points from s group by content")
def nested_series(spark, sf_dir):
    pts = chart.nested(chart.points(_month_content(spark, sf_dir), chart.ChartInfo(0, 2, 1, "string")))
    return pts.select("key", F.array_join(F.transform("values", lambda v: F.concat(v["x"], F.lit(":"), v["y"].cast("long").cast("string"))), " ").alias("points"))


@query(f"{_F} select row_number() over (order by meta_count, month, content) - 1 as at, month as x, content as key, cast(meta_count as double) as y from s")
def series_by_value(spark, sf_dir):
    return _listed(chart.ordered(chart.points(_month_content(spark, sf_dir), chart.ChartInfo(0, 2, 1, "string")), "y"))


@query(f"{_F} select row_number() over (order by content, month) - 1 as at, month as x, content as key, cast(meta_count as double) as y from s")
def series_by_key(spark, sf_dir):
    return _listed(chart.ordered(chart.points(_month_content(spark, sf_dir), chart.ChartInfo(0, 2, 1, "string")), "key"))


@query(
    """with p as (select case when o_orderpriority like '1%' then null else o_orderpriority end as key, o_totalprice as v from orders where not isnan(o_totalprice))
select row_number() over (order by key nulls first, i) - 1 as at, key, cast(i as integer) as i, s[1 + least(cast(floor(len(s) / 4.0 * i) as bigint), len(s) - 1)] as v
from (select key, list_sort(list(v)) as s from p group by key), (select unnest(range(5)) as i)"""
)
def boxplot_in_key_order(spark, sf_dir):
    key = F.when(~F.col("o_orderpriority").like("1%"), F.col("o_orderpriority"))
    return _listed(stats.in_key_order(stats.box_plot(table(spark, sf_dir, "orders").withColumn("key", key), "key", "o_totalprice")))


@query(
    """select case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y') || '-01-01' when 1 then strftime(o_orderdate, '%Y-%m') || '-01' else strftime(o_orderdate, '%Y-%m-%d') end as x, '(A)' as key, count(*) as n
from orders where o_orderkey % 5 < 3 group by 1"""
)
def chart_dates(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "yyyy-MM")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).when(k == 3, F.concat(F.lit("-"), F.date_format(d, "MM")))
    pts = chart.points(table(spark, sf_dir, "orders").select(text.alias("x"), F.lit("1").alias("y")), chart.ChartInfo(0, 1, x_type="date"))
    return pts.groupBy(F.col("x").cast("string").alias("x"), "key").agg(F.count(F.lit(1)).alias("n"))


@query(
    """select cast(n_regionkey as bigint) as x, case n_nationkey % 3 when 0 then '-' when 1 then '' else n_name end as key, sum(case when n_nationkey % 2 = 0 then 0.0 else cast(n_nationkey as double) end) as y
from nation where n_nationkey % 7 <> 0 group by 1, 2"""
)
def chart_numbers(spark, sf_dir):
    """Blank numbers are 0, others that are none drop the row; a missing key is ``-``, an empty one stays."""
    k = F.col("n_nationkey")
    y = F.when(k % 7 == 0, "none").when(k % 2 == 0, " ").otherwise(k.cast("string"))
    key = F.when(k % 3 == 1, "").when(k % 3 == 2, F.col("n_name"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string"), y.alias("y"), key.alias("key"))
    return chart.collapse(chart.points(rows, chart.ChartInfo(0, 1, 2)))


@query("select strftime(o_orderdate, '%Y-%m') as x, case strftime(o_orderdate, '%Y') when '1998' then '(A)' else '(B)' end as key, cast(count(*) as double) as y from orders where strftime(o_orderdate, '%Y') in ('1997', '1998') group by 1, 2")
def chart_csv_sources(spark, sf_dir):
    paths = []
    for year in ("1997", "1998"):
        month = F.date_format("o_orderdate", "yyyy-MM")
        paths.append(scratch_path(spark, "chart-csv"))
        table(spark, sf_dir, "orders").where(month.startswith(year)).groupBy(month.alias("x")).agg(F.count(F.lit(1)).alias("n")).write.csv(paths[-1])
    series = [chart.points(s, chart.ChartInfo(0, 1, x_type="string"), label=label) for s, label in zip(tables.read_chart_csv(spark, *paths), "AB")]
    return chart.merge_series(*series)


@query("select n_nationkey as k, case when v >= 1000000 then format('{:.2f}M', v / 1000000.0) when v >= 1000 then format('{:.2f}k', v / 1000.0) else format('{:.2f}', cast(v as double)) end as text from (select n_nationkey, n_nationkey * n_nationkey * 2500 as v from nation)")
def si_formats(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("k"), chart.si_format(k * k * 2500).alias("text"))


@query("select r_name as name, url_encode(r_name) as encoded from region")
def encoded_transforms(spark, sf_dir):
    names = [r["r_name"] for r in table(spark, sf_dir, "region").select("r_name").collect()]  # five
    return spark.createDataFrame([(n, chart.ChartInfo(transform=n).encoded_transform()) for n in names], "name string, encoded string")


_TREE = """{"type": "and", "filters": [{"type": "or", "filters": [{"type": "site", "operator": "in", "value": ["BUILDING", "MACHINERY"]},
 {"type": "content", "operator": "equal", "value": ["N"]}]}, {"type": "status", "operator": "different", "value": ["ok"]}]}"""


@query(f"with {_m()}, f as ({_cube_sql([('site', 'content')])}) select status, site, content, meta_count from f where (site in ('BUILDING', 'MACHINERY') or content = 'N') and status <> 'ok'")
def filter_from_json(spark, sf_dir):
    tree = FilterGroup.from_dict(json.loads(_TREE))
    return facets(spark, sf_dir, ("site", "content")).where(tree.to_column()).select("status", "site", "content", "meta_count")


# --- scripts and streams
@query("select 1 as result, n_regionkey || ',' || count(*) as line from nation group by n_regionkey union all select 1, 'all,' || count(*) from nation union all select 2, 'failed'")
def script_results(spark, sf_dir):
    """Two scripts of a store run one after the other: one of two statements, one that fails in its second."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("tallyweave_nation")
    store = ScriptStore()
    store.add(Script("by region", "select n_regionkey, count(*) from tallyweave_nation group by n_regionkey;\nselect 'all', count(*) from tallyweave_nation"))
    runner = JobRunner(spark, store)
    ids = [runner.submit(store.scripts["by_region"])]
    runner.wait()
    ids.append(runner.submit(Script("wrong", "select 1;\nselect from")))
    runner.wait()
    lines = [(i, line) for i in ids for line in (store.results[i].lines if store.results[i].ok else ["failed"])]
    return spark.createDataFrame(lines, "result int, line string")


@query(f"with {_crawl_sql()} select month, status, count(*) as n, cast(sum(length) as bigint) as bytes from m group by month, status")
def streamed_records(spark, sf_dir):
    """The crawl as a stream of JSON files, normalized and appended by month until all is read."""
    path = scratch_path(spark, "stream")
    _crawl(spark, sf_dir).drop("page_id").repartition(4).write.json(f"{path}/in")
    ingest.append_normalized(ingest.stream_records(spark, f"{path}/in"), 2013, f"{path}/out", f"{path}/log").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy(F.col("month").cast("string").alias("month"), "status").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


# --- relational operators of scripts
@query("select n_name, count(s_suppkey) as suppliers, count(*) as n from supplier right join nation on s_nationkey = n_nationkey group by n_name")
def join_right(spark, sf_dir):
    j = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right")
    return j.groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"), F.count(F.lit(1)).alias("n"))


@query("select r_name, n_name from region cross join nation")
def join_cross(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_name").crossJoin(table(spark, sf_dir, "nation").select("n_name"))


@query("select count(*) as n, count(distinct o_custkey) as customers from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)")
def bloom_semi_join(spark, sf_dir):
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return relational.bloom_semi_join(table(spark, sf_dir, "orders"), poor, "o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("select o_orderpriority, count(*) as n, min(o_totalprice) as low, max(o_totalprice) as high from orders group by o_orderpriority")
def fold_hook(spark, sf_dir):
    return stats.fold_by_key(table(spark, sf_dir, "orders"), ["o_orderpriority"], lambda d: [F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")])


@query("select o_orderstatus as value, count(*) as n, (select count(distinct o_orderstatus) from orders) as distinct from orders group by 1".replace("as distinct", 'as "distinct"'))
def distinct_listing(spark, sf_dir):
    return relational.distinct_listing(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("select c_custkey, c_mktsegment, c_acctbal from (select *, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as r from customer) where r <= 3")
def pig_top(spark, sf_dir):
    return relational.top_by(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_mktsegment"], "c_acctbal", 3, ("c_custkey",))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def pig_order_limit(spark, sf_dir):
    return chart.top(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25, ("o_orderkey",))


@query("select true as near_half, true as all_of_table, count(*) as n from lineitem")
def pig_sample(spark, sf_dir):
    """A sample is random, so what is asked of it is its size and that its rows are the table's."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey")
    n, some = rows.count(), rows.sample(0.5, 7)
    got = some.agg(F.count(F.lit(1)).alias("c")).crossJoin(some.join(rows.distinct(), "l_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("strange")))  # one row each
    return got.select((F.abs(F.col("c") / n - 0.5) < 0.05).alias("near_half"), (F.col("strange") == 0).alias("all_of_table"), F.lit(n).cast("long").alias("n"))


@query("select n_nationkey as k, n_name as name, n_regionkey as region, null as area from nation union all select r_regionkey, r_name, null, r_name from region")
def union_on_schema(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    b = table(spark, sf_dir, "region").select(F.col("r_name").alias("area"), F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return relational.union_on_schema(a, b)


@query("select case when c_acctbal > 8000 then 'rich' when c_acctbal < 0 then 'poor' else 'other' end as part, count(*) as n from customer group by 1 union all select 'any', count(*) from customer where c_acctbal > 5000")
def split_otherwise(spark, sf_dir):
    a = F.col("c_acctbal")
    parts = relational.split(table(spark, sf_dir, "customer"), {"rich": a > 8000, "poor": a < 0}, otherwise="other") | relational.split(table(spark, sf_dir, "customer"), {"any": a > 5000})
    return relational.union_on_schema(*[p.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n")) for name, p in parts.items()])


@query(
    """with c as (select c_mktsegment as g, list(distinct c_nationkey) as l from customer where c_custkey % 3 = 0 group by 1), d as (select c_mktsegment as g, list(distinct c_nationkey) as l from customer where c_custkey % 3 = 1 group by 1)
select g, unnest(list_concat(list_filter(c.l, lambda x: not list_contains(d.l, x)), list_filter(d.l, lambda x: not list_contains(c.l, x)))) as k from c join d using (g)"""
)
def diff_flatten(spark, sf_dir):
    bags = lambda r, name: table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 == r).groupBy(F.col("c_mktsegment").alias("g")).agg(F.collect_set("c_nationkey").alias(name))
    return bags(0, "a").join(bags(1, "b"), "g").select("g", pig.FUNCTIONS["FLATTEN"](pig.FUNCTIONS["DIFF"](F.col("a"), F.col("b"))).alias("k"))


@query("select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by cube (o_orderstatus, o_orderpriority)")
def pig_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select count(*) as n, count(s_acctbal) as with_balance, min(s_acctbal) as low, max(s_acctbal) as high, round(avg(s_acctbal), 6) as mean from supplier")
def pig_group_all(spark, sf_dir):
    b, f = F.col("s_acctbal"), pig.FUNCTIONS
    return table(spark, sf_dir, "supplier").agg(f["COUNT_STAR"]().alias("n"), f["COUNT"](b).alias("with_balance"), f["MIN"](b).alias("low"), f["MAX"](b).alias("high"), F.round(f["AVG"](b), 6).alias("mean"))


@query("select n_nationkey % 5 as k, count(*) as n, max(n_name) as name from nation where n_name is not null and (n_nationkey >= 3 or not (n_name <> 'NATION_1')) and regexp_full_match(n_name, 'NATION_[0-9]+') group by 1")
def pig_foreach_partition(spark, sf_dir):
    """FILTER with all signs, PARTITION BY and PARALLEL, GROUP, FOREACH GENERATE."""
    n, k = F.col("n_name"), F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").where(n.isNotNull() & ((k >= 3) | ~(n != "NATION_1")) & n.rlike("^(?:NATION_[0-9]+)$"))
    return rows.select((k % 5).alias("k"), n.alias("name")).repartition(3, "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"), pig.FUNCTIONS["STRINGMAX"](F.col("name")).alias("name"))


# --- functions of scripts
@query(
    """select n_nationkey as k, round(acos(x), 6) as acos, round(asin(x), 6) as asin, round(cos(x), 6) as cos, round((exp(x) + exp(-x)) / 2, 6) as cosh, round(ln(x + 1), 6) as log, round(log10(x + 1), 6) as log10, round(x * 10) as round,
 round(sin(x), 6) as sin, round((exp(x) - exp(-x)) / 2, 6) as sinh, round(tan(x), 6) as tan, round((exp(x) - exp(-x)) / (exp(x) + exp(-x)), 6) as tanh, true as random from (select n_nationkey, n_nationkey / 25.0 as x from nation)"""
)
def pig_math_rest(spark, sf_dir):
    x, f = F.col("n_nationkey") / 25.0, pig.FUNCTIONS
    six = lambda name, v: F.round(f[name](v), 6).alias(name.lower())
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("k"), *[six(n, x) for n in ("ACOS", "ASIN", "COS", "COSH", "SIN", "SINH", "TAN", "TANH")], *[six(n, x + 1) for n in ("LOG", "LOG10")], f["ROUND"](x * 10).alias("round"), f["RANDOM"](3).between(0, 1).alias("random")
    )


@query(
    r"""select n_nationkey as k, length(n_name) - strpos(reverse(n_name), 'N') as last, strpos(substr(n_name, 3), 'N') + 1 as idx, lower(n_name[1]) || substr(n_name, 2) as lc, substr(n_name, 3, 4) as sub,
 case when regexp_full_match(n_name, '([A-Z]+)_([0-9])') then regexp_extract(n_name, '([A-Z]+)_([0-9])', 1) || '/' || regexp_extract(n_name, '([A-Z]+)_([0-9])', 2) end as groups, string_split(n_name, '_')[2] as part, trim('  ' || n_name || ' ') as trimmed,
 case when regexp_matches(n_name, '_(1[0-9])') then regexp_extract(n_name, '_(1[0-9])', 1) end as teen, length(n_name) as chars from nation"""
)
def pig_string_rest(spark, sf_dir):
    n, f = F.col("n_name"), pig.FUNCTIONS
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("k"), f["LAST_INDEX_OF"](n, "N").alias("last"), f["INDEXOF"](n, "N", 2).alias("idx"), f["LCFIRST"](n).alias("lc"), f["SUBSTRING"](n, 2, 6).alias("sub"),
        F.array_join(f["REGEX_EXTRACT_ALL"](n, "([A-Z]+)_([0-9])"), "/").alias("groups"), f["STRSPLIT"](n, "_")[1].alias("part"), f["TRIM"](f["CONCAT"](F.lit("  "), n, F.lit(" "))).alias("trimmed"),
        f["REGEX_EXTRACT"](n, "_(1[0-9])", 1).alias("teen"), f["STRINGSIZE"](n).cast("long").alias("chars"),
    )


@query(
    "select n_regionkey as k, 3 as bag, 2 as tuple, 1 as map, n_regionkey = 0 as empty, upper(r_name[1]) || substr(r_name, 2) as uc, n_nationkey as second, n_nationkey as value, string_split(r_name, ' ')[1] as first from nation join region on n_regionkey = r_regionkey"
)
def pig_nested_rest(spark, sf_dir):
    f, k = pig.FUNCTIONS, F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    bag, tuple_, map_ = f["TOBAG"](k, k, k), f["TOTUPLE"](F.col("n_name").alias("a"), k.alias("b")), f["TOMAP"](F.lit("key"), k)
    return rows.select(
        F.col("n_regionkey").alias("k"), f["BAGSIZE"](bag).alias("bag"), f["ARITY"](k, k).alias("tuple"), f["MAPSIZE"](map_).alias("map"), f["ISEMPTY"](F.slice(bag, 1, F.least(F.col("n_regionkey"), F.lit(3)))).alias("empty"),
        f["UCFIRST"](F.col("r_name")).alias("uc"), tuple_["b"].alias("second"), map_["key"].alias("value"), f["TOKENIZE"](F.col("r_name"))[0].alias("first"),
    )


@query(
    """select o_orderstatus as g, sum(cast(o_custkey as int)) as int_sum, max(abs(o_custkey - 50)) as long_abs, max(cast(o_totalprice as float)) as float_max, round(avg(o_totalprice), 4) as double_avg, min(o_orderpriority) as string_min, max(o_orderpriority) as string_max
from orders group by 1"""
)
def pig_typed_variants(spark, sf_dir):
    f, c, p = pig.FUNCTIONS, F.col("o_custkey"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("g")).agg(
        f["SUM"](c.cast("int")).alias("int_sum"), f["MAX"](f["ABS"](c - 50)).alias("long_abs"), f["MAX"](p.cast("float")).alias("float_max"), F.round(f["AVG"](p), 4).alias("double_avg"),
        f["STRINGMIN"](F.col("o_orderpriority")).alias("string_min"), f["STRINGMAX"](F.col("o_orderpriority")).alias("string_max"),
    )


@query("select n_nationkey as k, reverse(n_name) || '!' as shouted, cast(greatest(n_nationkey, 12) as varchar) as invoked from nation")
def user_functions(spark, sf_dir):
    """DEFINE: a user's function in SQL text; INVOKEFOR: a static Java method."""
    pig.register(spark, "tallyweave_shout", _shout, "string")
    table(spark, sf_dir, "nation").createOrReplaceTempView("tallyweave_nation")
    rows = spark.sql("select n_nationkey as k, tallyweave_shout(n_name) as shouted from tallyweave_nation")
    return rows.select("k", "shouted", pig.invoke("java.lang.Math", "max", F.col("k"), F.lit(12)).alias("invoked"))


def _shout(names: pd.Series) -> pd.Series:
    return names.str[::-1] + "!"
