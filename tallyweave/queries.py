"""The registered queries of the cube engine and their independent SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import criteria as C
from .operators import chart, cube as cubes, normalize, relational, stats
from .operators.filters import Filter, FilterGroup, measure_predicate, series_predicate
from .plans.query import ChartQuery, compare_years as compare, point_cells
from .schema import CRITERIA, INDICATORS, RECORD
from .scratch import scratch_path
from .sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, year: str = "1998") -> DataFrame:
    """Normalized records over the trade tables: orders as crawls, parts as pages."""
    t = lambda n: table(spark, sf_dir, n)
    from_, to = f"{year}-01-01", f"{int(year) + 1}-01-01"
    orders = t("orders").where((F.col("o_orderdate") >= F.lit(from_).cast("timestamp")) & (F.col("o_orderdate") < F.lit(to).cast("timestamp")))
    placed = orders.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    j = relational.likely_partners(t("lineitem"), "l_orderkey", orders, "o_orderkey").join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = (F.col("l_partkey") % 500).cast("long")
    length = kind * kind * 7
    return j.select(
        F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "redirection").otherwise("server_error").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.col("c_mktsegment").alias("site"),
        F.col("l_returnflag").alias("content"),
        F.lower("n_name").alias("tld"),
        C.size_class(length).alias("size"),
        F.col("l_linenumber").cast("string").alias("level"),
        F.md5(F.col("l_partkey").cast("string")).alias("url_md5"),
        F.sha2(kind.cast("string"), 256).alias("sha"),
        length.alias("length"),
    )


_SIZE = "case when len = 0 then 'a0' when len > 120*1024*1024 then 'h120M+' when len > 15*1024*1024 then 'g15M-110M' when len > 1.4*1024*1024 then 'f1.4M-15M' when len > 150*1024 then 'e150K-1.4M' when len > 15*1024 then 'd15K-150K' when len > 1.2*1024 then 'c1.2K-15K' else 'b0-1.2K' end"


def _m(year: str = "1998", name: str = "m") -> str:
    return f"""{name} as (select case o_orderstatus when 'F' then 'ok' when 'O' then 'redirection' else 'server_error' end as status,
 strftime(o_orderdate, '%Y-%m') as month, c_mktsegment as site, l_returnflag as content, lower(n_name) as tld, {_SIZE} as size,
 cast(l_linenumber as varchar) as level, md5(cast(l_partkey as varchar)) as url_md5, sha256(cast(l_partkey % 500 as varchar)) as sha, len as length
 from (select *, cast((l_partkey % 500) * (l_partkey % 500) * 7 as bigint) as len from lineitem) l
 join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
 where strftime(o_orderdate, '%Y') = '{year}')"""


_FREE = CRITERIA[1:]


def _cell_sql(keep: tuple[str, ...], source: str = "m") -> str:
    """One grouping, told apart by literals: contents are counted from distinct (cell, sha) rows."""
    names = ", ".join(["status", *(f"{c} as {c}" if c in keep else f"'*' as {c}" for c in _FREE)])
    keys = ", ".join(["status", *keep])
    return f"""(select a.*, b.real_size from (select {names}, count(*) as meta_count, count(distinct url_md5) as url_count, count(distinct sha) as sha_count,
 cast(sum(length) as bigint) as meta_size from {source} group by {keys}) a join
 (select {names}, cast(sum(one) as bigint) as real_size from (select {keys}, sha, max(length) as one from {source} group by {keys}, sha) group by {keys}) b
 using ({", ".join(CRITERIA)}))"""


def _cube_sql(sets: list[tuple[str, ...]], source: str = "m") -> str:
    return " union all ".join(f"select {', '.join(('status', *_FREE, *INDICATORS))} from {_cell_sql(s, source)}" for s in sets)


_ALL = [c for n in range(7) for c in combinations(_FREE, n)]
_REST = [c for n in range(6) for c in combinations(_FREE[1:], n)]


def facets(spark: SparkSession, sf_dir: str, *only: tuple[str, ...], year: str = "1998") -> DataFrame:
    return cubes.cube(records(spark, sf_dir, year), only=list(only) or None)


@query(f"with {_m()} select status, month, site, content, tld, size, level, count(*) as n, cast(sum(length) as bigint) as bytes from m group by all")
def normalize_criteria(spark, sf_dir):
    return records(spark, sf_dir).groupBy(*CRITERIA).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


# One raw record for each way to be rejected or accepted in 2013.
_A64, _EMPTY = "a" * 64, C.EMPTY_SHA
_BASE = ("2013-01-01T00:00:00Z", "s@1", _A64, "http://a.b", "1", "ok", "1", "x")
_RAW = [
    _BASE, (None, *_BASE[1:]), ("2012-01-01T00:00:00Z", *_BASE[1:]), (*_BASE[:3], "", *_BASE[4:]), (*_BASE[:3], None, *_BASE[4:]),
    (*_BASE[:2], "zz", *_BASE[3:]), (*_BASE[:2], "abc", *_BASE[3:]), (*_BASE[:2], "abcd", *_BASE[3:]), (*_BASE[:4], " 12 ", *_BASE[5:]),
    (*_BASE[:5], "OK", *_BASE[6:]), (*_BASE[:5], None, *_BASE[6:]), (*_BASE[:2], _EMPTY, "http://a.b", "zz", *_BASE[5:]), (_BASE[0], None, *_BASE[2:4], "null", *_BASE[5:]),
]


def _values(rows) -> str:
    text = lambda v: "null" if v is None else "'" + v + "'"
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


@query(
    f"""with r(date, crawl_session, content, url, length, status, level, type) as (values {_values(_RAW)})
select reason, count(*) as n from (select case
 when date is null or not regexp_matches(date, '^[0-9]{{4}}-(0[1-9]|1[0-2])') then 'no_date' when date not like '2013%' then 'not_year:2013'
 when url is null or url = '' then 'no_url' when content is null or length(content) % 2 = 1 or regexp_matches(content, '[^0-9A-Fa-f]') then 'bad_sha'
 when length(content) <> 64 then 'bad_sha_length'
 when not (length is null or length in ('', 'null') or content = '{_EMPTY}' or regexp_matches(length, '^[+-]?[0-9]+$')) then 'bad_length'
 when status is null or status not in ('ignored', 'ok', 'redirection', 'request_error', 'server_error') then 'bad_status' else 'used_meta' end as reason from r) group by reason"""
)
def reject_audit(spark, sf_dir):
    return normalize.audit(spark.createDataFrame(_RAW, RECORD), 2013)


@query(f"with {_m()} select size, count(*) as n from m group by size")
def size_bucket_hist(spark, sf_dir):
    return records(spark, sf_dir).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_m()} {_cube_sql(_ALL)}")
def cube_full(spark, sf_dir):
    return cubes.cube(records(spark, sf_dir))


@query(f"with {_m()} {_cube_sql([('month', *s) for s in _REST])}")
def cube_explicit_month(spark, sf_dir):
    return cubes.cube(records(spark, sf_dir), "explicit_month")


@query(f"with {_m()} {_cube_sql(_REST)}")
def cube_wildcard_month(spark, sf_dir):
    return cubes.cube(records(spark, sf_dir), "wildcard_month")


@query(f"with {_m()} {_cube_sql([()])}")
def cube_total(spark, sf_dir):
    return facets(spark, sf_dir, ())


@query(f"with {_m()}, f as ({_cube_sql([('site', 'content')])}) select {', '.join(INDICATORS)} from f where status = 'ok' and site = 'BUILDING' and content = 'R'")
def point_query_site_content(spark, sf_dir):
    filters = [Filter("site", "equal", "BUILDING"), Filter("content", "equal", "R")]
    return point_cells(facets(spark, sf_dir, ("site", "content")), filters).select(*INDICATORS)


@query(f"with {_m()}, f as ({_cube_sql([('month',)])}) select month, {', '.join(INDICATORS)} from f where status = 'ok'")
def series_by_month(spark, sf_dir):
    return facets(spark, sf_dir, ("month",)).where(series_predicate(("month",), [])).select("month", *INDICATORS)


@query(f"with {_m()}, f as ({_cube_sql([('month', 'content')])}) select month, content, url_count from f where status = 'ok'")
def series_month_by_content(spark, sf_dir):
    return ChartQuery(x="month", key="content", y="url_count").run(facets(spark, sf_dir, ("month", "content")))


@query(f"with {_m()}, f as ({_cube_sql([('tld',)])}) select tld, sha_count from f where status = 'ok' order by sha_count desc, tld limit 100")
def top100_site_tld(spark, sf_dir):
    return ChartQuery(x="tld", y="sha_count", top=100).run(facets(spark, sf_dir, ("tld",)))


@query(
    f"""with {_m()}, f as ({_cube_sql([('month', 'site', 'content', 'tld')])}) select status, site, content, tld, meta_count from f
where status != 'server_error' and site in ('BUILDING', 'MACHINERY') and content = 'R' and tld like '%1%'"""
)
def filter_ops_string(spark, sf_dir):
    fs = [Filter("status", "different", "server_error"), Filter("site", "in", ("BUILDING", "MACHINERY")), Filter("content", "equal", "R"), Filter("tld", "like", "%1%")]
    rows = facets(spark, sf_dir, ("month", "site", "content", "tld")).where(FilterGroup("and", fs).to_column())
    return rows.select("status", "site", "content", "tld", "meta_count")


@query(f"with {_m()}, f as ({_cube_sql([('level',), ()])}) select status, level, meta_count from f where try_cast(level as double) >= 3 and try_cast(level as double) < 6")
def filter_ops_numeric_level(spark, sf_dir):
    fs = [Filter("level", "greater_than_equal", "3"), Filter("level", "lower_than", "6")]
    return facets(spark, sf_dir, ("level",), ()).where(FilterGroup("and", fs).to_column()).select("status", "level", "meta_count")


@query(
    f"""with {_m()}, f as ({_cube_sql([('site', 'content')])}) select status, site, content, meta_count from f
where (site = 'BUILDING' or (content = 'N' and status = 'ok')) and site <> 'MACHINERY'"""
)
def filter_group_tree(spark, sf_dir):
    tree = FilterGroup("and", [FilterGroup("or", [Filter("site", "equal", "BUILDING"), FilterGroup("and", [Filter("content", "equal", "N"), Filter("status", "equal", "ok")])]), Filter("site", "different", "MACHINERY")])
    return facets(spark, sf_dir, ("site", "content")).where(tree.to_column()).select("status", "site", "content", "meta_count")


@query(f"with {_m()}, f as ({_cube_sql([('tld', 'site')])}) select tld, site, meta_count from f where status = 'ok' and meta_count > 20")
def filter_measure(spark, sf_dir):
    f = facets(spark, sf_dir, ("tld", "site")).where(series_predicate(("tld", "site"), []))
    return f.where(measure_predicate(F.col("meta_count"), "greater_than", "20")).select("tld", "site", "meta_count")


@query(f"with {_m()}, f as ({_cube_sql([('content',)])}) select status, content, round(real_size / nullif(cast(sha_count as double), 0), 6) as avg_size from f")
def ratio_avg_size(spark, sf_dir):
    return facets(spark, sf_dir, ("content",)).select("status", "content", F.round(C.average_content_size(), 6).alias("avg_size"))


@query(f"with {_m()}, f as ({_cube_sql([('site',)])}) select status, site, round(meta_size / nullif(cast(real_size as double), 0), 6) as duplication from f")
def ratio_duplication(spark, sf_dir):
    return facets(spark, sf_dir, ("site",)).select("status", "site", F.round(C.duplication_ratio(), 6).alias("duplication"))


@query(
    f"""with {_m('1997')}, {_m('1998', 'm2')}, a as ({_cube_sql([('month',)])}), b as ({_cube_sql([('month',)], 'm2')})
select substr(month, 6, 2) as x, '(A)' as key, meta_count as y from a where status = 'ok' union all select substr(month, 6, 2), '(B)', meta_count from b where status = 'ok'"""
)
def compare_two_years(spark, sf_dir):
    return compare(ChartQuery(), facets(spark, sf_dir, ("month",), year="1997"), facets(spark, sf_dir, ("month",)))


@query(
    f"""with {_m()}, f as ({_cube_sql([('month', 'content')])}), p as (select month as x, content as key, cast(meta_count as double) as y from f where status = 'ok' and meta_count > 75)
select x, key, coalesce(sum(y), 0) as y from (select x, key, y from (select distinct x from p) cross join (select distinct key from p) left join p using (x, key)) group by x, key"""
)
def zero_filled_series(spark, sf_dir):
    f = facets(spark, sf_dir, ("month", "content")).where(series_predicate(("month", "content"), [])).where("meta_count > 75").select("month", "content", "meta_count")
    return chart.zero_fill(chart.collapse(chart.points(f, chart.ChartInfo(x=0, key=1, y=2, x_type="string"))))


@query(f"with {_m()}, f as ({_cube_sql([('content',)])}) select content as x, '(A)' as key, cast(meta_count as double) as y, round(100.0 * meta_count / sum(meta_count) over (), 1) as percent from f where status = 'ok'")
def pie_share(spark, sf_dir):
    f = facets(spark, sf_dir, ("content",)).where(series_predicate(("content",), [])).select("content", "meta_count")
    return chart.pie_shares(chart.points(f, chart.ChartInfo(x=0, y=1, x_type="string")))


@query(
    """select key, cast(i as integer) as i, s[1 + least(cast(floor(len(s) / 4.0 * i) as bigint), len(s) - 1)] as v
from (select o_orderpriority as key, list_sort(list(o_totalprice)) as s from orders where not isnan(o_totalprice) group by 1), (select unnest(range(5)) as i)"""
)
def boxplot_by_key(spark, sf_dir):
    return stats.box_plot(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


@query("select key, count(*) as n from (select lower(regexp_extract(url, '^[a-z]+://[^/:?#]*\\.([A-Za-z]+)', 1)) as key from pages) group by key")
def extract_count(spark, sf_dir):
    return stats.count_by_key(table(spark, sf_dir, "pages"), C.tld_of(F.col("url")))


@query("select lang || ':' || source as key, min(sha256(coalesce(text, ''))) as sha from documents where lang is not null and source is not null group by 1")
def sample_sha(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return stats.sample_by_key(d, F.concat("lang", F.lit(":"), "source"), F.sha2(F.coalesce("text", F.lit("")), 256))


@query(
    """with a as (select *, event_type is distinct from lag(event_type) over (order by event_id) or row_number() over (order by event_id) = 1 as s from events),
b as (select *, sum(cast(s as int)) over (order by event_id) as run from a) select cast(run as bigint) as run, event_type, count(*) as n from b group by run, event_type"""
)
def subkey_runs(spark, sf_dir):
    return stats.runs(table(spark, sf_dir, "events"), ["event_id"], ["event_type"])


@query(
    """select lang, count(*) as meta_count, count(distinct sha256(coalesce(text, ''))) as sha_count, cast(sum(strlen(coalesce(text, ''))) as bigint) as meta_size,
 (select cast(sum(n) as bigint) from (select distinct coalesce(text, '') as t, strlen(coalesce(text, '')) as n from documents e where e.lang is not distinct from d.lang)) as real_size from documents d group by lang"""
)
def dedup_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    by_sha = d.groupBy("lang", "sha").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("ms"), F.max("size").alias("rs"))
    return by_sha.groupBy("lang").agg(F.sum("n").alias("meta_count"), F.count("sha").alias("sha_count"), F.sum("ms").alias("meta_size"), F.sum("rs").alias("real_size"))


@query("select concat_ws(',', r_regionkey, coalesce(r_name, 'null'), coalesce(cast(case when r_regionkey = 0 then null else r_regionkey end as varchar), 'null')) as line from region")
def csv_lines(spark, sf_dir):
    return tables.csv_lines(table(spark, sf_dir, "region").select("r_regionkey", "r_name", F.nullif("r_regionkey", F.lit(0)).alias("x")))


@query(f"with {_m()} {_cube_sql([('month',), ('site', 'content')])}")
def text_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "facet-text")
    tables.write_facet_text(facets(spark, sf_dir, ("month",), ("site", "content")), path)
    return tables.read_facet_text(spark, path)


@query(f"with {_m()}, f as ({_cube_sql([('month', 'content')])}), g as ({_cube_sql([('content',)])}) select content, cast(naive as bigint) as naive, sha_count as exact from (select status, content, sum(sha_count) as naive from f group by status, content) join g using (status, content) where status = 'ok'")
def naive_vs_cube_distinct(spark, sf_dir):
    f = facets(spark, sf_dir, ("month", "content"), ("content",)).where("status = 'ok'")
    return f.groupBy("content").agg(F.sum(F.when(F.col("month") != "*", F.col("sha_count"))).alias("naive"), F.max(F.when(F.col("month") == "*", F.col("sha_count"))).alias("exact"))


@query("select n_name, count(*) as n, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey group by n_name")
def join_inner(spark, sf_dir):
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("select c_mktsegment, count(*) as n, count(o_orderkey) as orders from customer left join orders on c_custkey = o_custkey group by c_mktsegment")
def join_left(spark, sf_dir):
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count("o_orderkey").alias("orders"))


@query("select lang, count(*) as n from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id) group by lang")
def join_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("select lang, count(*) as n from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id) group by lang")
def join_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as n, count(c_custkey) as customers, count(o_orderkey) as orders, count(distinct coalesce(c_custkey, o_custkey)) as k from customer full join orders on c_custkey = o_custkey")
def join_full(spark, sf_dir):
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "full")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"), F.count_distinct(F.coalesce("c_custkey", "o_custkey")).alias("k"))


@query("select r_name, n_name from region cross join nation where r_regionkey > n_regionkey")
def join_theta(spark, sf_dir):
    return table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") > F.col("n_regionkey")).select("r_name", "n_name")


@query("select coalesce(a.k, b.k) as k, coalesce(a.n, 0) as customers, coalesce(b.n, 0) as suppliers from (select c_nationkey as k, count(*) as n from customer group by 1) a full join (select s_nationkey as k, count(*) as n from supplier group by 1) b on a.k = b.k")
def cogroup_counts(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    both = relational.cogroup(a, b, "k", left_n=F.count(F.lit(1)), right_n=F.count(F.lit(1)))
    return both.select("k", F.col("left_n").alias("customers"), F.col("right_n").alias("suppliers"))


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def set_union(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("select c_custkey as k from customer intersect select o_custkey from orders")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, sf_dir, "orders").select("o_custkey"))


@query("select o_orderkey as k from orders except select l_orderkey from lineitem")
def set_except(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).subtract(table(spark, sf_dir, "lineitem").select("l_orderkey"))


@query("select o_custkey, o_orderkey, r from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r <= 2")
def window_rank(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("r")).where("r <= 2")


@query("select n_nationkey, abs(n_nationkey - 12) as a, ceil(n_nationkey / 7.0)::bigint as c, floor(n_nationkey / 7.0)::bigint as f, round(sqrt(n_nationkey), 6) as s, round(exp(n_nationkey / 10.0), 6) as e, round(cbrt(n_nationkey), 6) as b, round(atan(n_nationkey), 6) as t from nation")
def pig_math(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k, F.abs(k - 12).alias("a"), F.ceil(k / 7.0).alias("c"), F.floor(k / 7.0).alias("f"), F.round(F.sqrt(k), 6).alias("s"), F.round(F.exp(k / 10.0), 6).alias("e"), F.round(F.cbrt(k), 6).alias("b"), F.round(F.atan(k), 6).alias("t"))


@query("select n_nationkey, lower(n_name) as l, upper(n_name) as u, strlen(n_name) as z, instr(n_name, 'A') - 1 as i, replace(n_name, 'A', '_') as r, substr(n_name, 2, 3) as s, regexp_extract(n_name, '([A-Z])([A-Z]+)', 2) as x, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) as c from nation")
def pig_string(spark, sf_dir):
    n = F.col("n_name")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", F.lower(n).alias("l"), F.upper(n).alias("u"), F.octet_length(n).cast("long").alias("z"), (F.instr(n, "A") - 1).cast("long").alias("i"), F.replace(n, F.lit("A"), F.lit("_")).alias("r"), F.substring(n, 2, 3).alias("s"),
        F.regexp_extract(n, "([A-Z])([A-Z]+)", 2).alias("x"), F.concat(F.upper(F.substring(n, 1, 1)), F.lower(F.substr(n, F.lit(2)))).alias("c"),
    )


@query("select token, count(*) as n from (select unnest(string_split(n_name, ' ')) as token from nation) group by token")
def pig_nested(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.explode(F.split("n_name", " ")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("select c_mktsegment as g, count(*) as n, count(distinct c_nationkey) as d, round(avg(c_acctbal), 6) as a, min(c_acctbal) as lo, max(c_acctbal) as hi, round(corr(c_acctbal, c_nationkey), 6) as r, round(covar_pop(c_acctbal, c_nationkey), 4) as v from customer group by 1")
def pig_aggregates(spark, sf_dir):
    b, k = F.col("c_acctbal"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(k).alias("d"), F.round(F.avg(b), 6).alias("a"), F.min(b).alias("lo"), F.max(b).alias("hi"), F.round(F.corr(b, k), 6).alias("r"), F.round(F.covar_pop(b, k), 4).alias("v"))
