import json
import os
from itertools import combinations

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.functions import criteria as C
from tallyweave.operators import chart, cube, normalize, relational, stats
from tallyweave.operators.filters import Filter, FilterGroup
from tallyweave.plans.jobs import JobRunner, Script, ScriptStore, error_position, slug
from tallyweave.plans.query import ChartQuery, get_stats
from tallyweave.plans.sqltext import SqlText
from tallyweave.schema import CRITERIA, INDICATORS, NORMAL, RECORD
from tallyweave.sources import tables

SHA = {"page": "a" * 64, "empty": C.EMPTY_SHA, "image": "b" * 64}
RAW = [
    ("2013-08-01T13:59:00Z", "france2.fr@20130801T123910Z", SHA["page"], "http://www.francetv.org/index.html", "19", "ok", "1", "text/html"),
    ("2013-08-02T14:49:01Z", "tf1.fr@20130802T132904Z", SHA["empty"], "http://facebook.com/blip.png", "0", "ok", "1", "image/png"),
    ("2013-08-10T06:22:22Z", "tf1.fr@20130810T061111Z", SHA["image"], "http://facebook.com/blip.png", "14", "ok", "1", "image/png"),
]


def brute_cube(rows):
    cells = {}
    for r in rows:
        for n in range(7):
            for keep in combinations(CRITERIA[1:], n):
                key = tuple(r[c] if c == "status" or c in keep else "*" for c in CRITERIA)
                cells.setdefault(key, []).append(r)
    out = {}
    for key, rs in cells.items():
        one = {}
        for r in rs:
            one[r["sha"]] = max(one.get(r["sha"], r["length"]), r["length"])
        out[key] = (len(rs), len({r["url_md5"] for r in rs}), len(one), sum(r["length"] for r in rs), sum(one.values()))
    return out


def as_cells(df):
    return {tuple(r[c] for c in CRITERIA): tuple(r[i] for i in INDICATORS) for r in df.collect()}


def test_golden_records(spark):
    normal = normalize.normalize(spark.createDataFrame(RAW, RECORD), 2013)
    cells = as_cells(cube.cube(normal))
    assert len(cells) == 152
    assert cells[("ok", "*", "*", "*", "*", "*", "*")] == (3, 2, 3, 33, 33)
    assert cells[("ok", "2013-08", "france2.fr", "HTML", "org", "b0-1.2K", "1")] == (1, 1, 1, 19, 19)
    assert get_stats(cube.cube(normal), [Filter("site", "equal", "tf1.fr")])["url_count"] == 1
    explicit, wild = as_cells(cube.cube(normal, "explicit_month")), as_cells(cube.cube(normal, "wildcard_month"))
    assert not explicit.keys() & wild.keys() and explicit | wild == cells


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.sampled_from("ab") for _ in range(7)], st.sampled_from("xyz"), st.sampled_from("pq"), st.integers(0, 9)), max_size=12))
def test_cube_equals_enumeration(spark, rows):
    dicts = [dict(zip(NORMAL.names, r)) for r in rows]
    assert as_cells(cube.cube(spark.createDataFrame(rows, NORMAL))) == brute_cube(dicts)


@pytest.mark.parametrize("chunk", [1, 5, 1 << 20])
def test_cube_in_pieces_equals_enumeration(spark, monkeypatch, chunk):
    """Keys met in several pieces, null and starred criteria, contents of several lengths."""
    monkeypatch.setattr(cube, "CHUNK", chunk)
    rows = [(("ok", None)[i % 2], f"{i % 3}", ("a", "*", None)[i % 3], "c", "fr", "s", "1", f"u{i % 7}", f"h{i % 4}", i % 5 * 2**40) for i in range(60)]
    cells = cube.cube(spark.createDataFrame(rows, NORMAL)).collect()
    expected = brute_cube([dict(zip(NORMAL.names, r)) for r in rows if r[2] != "*"])
    # a real star is a cell beside the wildcard's; rows without any are compared with the enumeration
    plain = {tuple(r[c] for c in CRITERIA): tuple(r[i] for i in INDICATORS) for r in cube.cube(spark.createDataFrame([r for r in rows if r[2] != "*"], NORMAL)).collect()}
    assert plain == expected
    starred = [r["meta_count"] for r in cells if r["status"] == "ok" and r["site"] == "*" and {r[c] for c in CRITERIA[1:] if c != "site"} == {"*"}]
    assert sorted(starred) == [10, 30]


def test_cube_has_no_table_of_expanded_rows(spark):
    """Two rows of a record are the most that Spark makes; what a task sends on are sums by cell."""
    rows = [("ok", "m", "a", "c", "fr", "s", "1", f"u{i}", f"h{i}", 1) for i in range(500)]
    made = cube.cube(spark.createDataFrame(rows, NORMAL).repartition(4))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.count("MapInArrow") == 1
    assert made.count() == 64
    (piece,) = cube._whole_keys(iter([pa.RecordBatch.from_pylist([dict(zip(CRITERIA, r)) | {"is_url": False, "key": r[8], "n": 1, "ms": 1, "rs": 1} for r in rows])]), 1000)
    assert [len(columns[0]) for columns in cube._counted(piece, [0, 63])] == [1, 1]


STORED_LINES = ("stored_point", "stored_roll_up", "stored_stats", "stored_top", "stored_series")
STORED = ("stored_point", "stored_roll_up", "stored_stats", "stored_top", "stored_series")


@pytest.mark.parametrize("name", STORED)
def test_stored_question_builds_without_expanded_rows(spark, monkeypatch, name):
    """The first question builds the whole cube, and no plan of that has rows for each grouping."""
    import __spark_entry__ as entry
    from tallyweave import queries_more

    built, save = [], queries_more.FacetStore.save
    monkeypatch.setattr(queries_more.FacetStore, "years", lambda self: [])
    monkeypatch.setattr(queries_more.FacetStore, "save", lambda self, facets, year: (built.append(facets), save(self, facets, year)))
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert [f._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") for f in built] == [1]
    assert spark.table(queries_more._store(spark, "/root/testdata/sf0.001").table(1998)).count() == built[0].count()


@pytest.mark.parametrize("name", STORED_LINES)
def test_stored_question_exchanges_lines_of_the_year(spark, monkeypatch, name):
    """Lines whose order is of another year are dropped where they are read, and customers meet orders before lines do."""
    import __spark_entry__ as entry
    from tallyweave import queries_more

    built, d = [], "/root/testdata/sf0.001"
    monkeypatch.setattr(queries_more.FacetStore, "years", lambda self: [])
    save = queries_more.FacetStore.save
    monkeypatch.setattr(queries_more.FacetStore, "save", lambda self, facets, year: (built.append(facets), save(self, facets, year)))
    assert entry.queries()[name](spark, d).count() > 0
    (plan,) = [f._jdf.queryExecution().optimizedPlan().toString() for f in built]
    assert plan.count("Join LeftSemi") == 1 and plan.index("Join LeftSemi") < plan.index("c_custkey")
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    orders = spark.read.parquet(f"{d}/orders.parquet").where("year(o_orderdate) = 1998")
    kept, exact = relational.likely_partners(lines, "l_orderkey", orders, "o_orderkey"), lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left_semi")
    assert exact.exceptAll(kept).count() == 0 and kept.count() < 0.2 * lines.count()


def test_likely_partners_of_other_types_all_stay(spark):
    """Equal numbers of other types have other hashes; null keys have no partner; few slots lose nothing."""
    left, right = spark.range(100), spark.range(50, 60).withColumnRenamed("id", "k")
    assert relational.likely_partners(left, "id", right.selectExpr("cast(k as int) as k"), "k").count() == 100
    assert {r.id for r in relational.likely_partners(left, "id", right.union(spark.sql("select cast(null as long)")), "k", 1 << 24).collect()} == set(range(50, 60))
    assert {r.id for r in relational.likely_partners(left, "id", right, "k", 64).collect()} >= set(range(50, 60))


def test_cube_packs_keys_and_tells_them_apart(spark):
    """Hex digits in pairs are sent as bytes; keys that look alike or are no hex stay different."""
    keys = ["ab", "AB", "abc", "\u00ab", "\x01\u00ab", "ab\n", "", "00", "\x00", None]
    rows = [("ok", "m", "a", "c", "fr", "s", "1", k, k, 1) for k in keys for _ in range(2)]
    (total,) = cube.cube(spark.createDataFrame(rows, NORMAL), only=[()]).collect()
    assert (total.meta_count, total.url_count, total.sha_count, total.real_size) == (20, 9, 9, 10)
    sizes = spark.createDataFrame([("0f" * 32,), ("xy",)], "k string").select(F.length(cube._packed(F.col("k")))).collect()
    assert [r[0] for r in sizes] == [33, 3]


def test_cube_sums_beyond_a_long_raise():
    row = dict(zip(CRITERIA, ("ok", "m", "a", "c", "fr", "s", "1"))) | {"is_url": False, "n": 1, "ms": 2**62, "rs": 2**62}
    two = pa.RecordBatch.from_pylist([row | {"key": "a"}, row | {"key": "b", "site": "b"}])
    assert [c[11].to_pylist() for c in cube._counted(two, [2])] == [[2**62, 2**62]]
    with pytest.raises(OverflowError):
        list(cube._counted(two, [0]))



def test_size_classes(spark):
    from pyspark.sql import functions as F

    want = {0: "a0", 1: "b0-1.2K", 1228: "b0-1.2K", 1229: "c1.2K-15K", 15360: "c1.2K-15K", 15361: "d15K-150K", 153600: "d15K-150K", 153601: "e150K-1.4M", 1468006: "e150K-1.4M", 1468007: "f1.4M-15M", 15728640: "f1.4M-15M", 15728641: "g15M-110M", 125829120: "g15M-110M", 125829121: "h120M+", -5: "b0-1.2K"}
    got = spark.createDataFrame([(k,) for k in want], "n long").select("n", C.size_class(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in got} == want


def test_filters():
    f = Filter("status", "equal", ("ok",))
    assert f.to_json() == '{"type":"status","operator":"equal","value":["ok"]}' and Filter.from_json(f.to_json()) == f
    assert Filter("status", "in", ("ok", "redirection")).to_sql() == "status IN ('ok','redirection')"
    assert Filter("level", "greater_than_equal", "12").to_sql() == "level >= 12"
    with pytest.raises(ValueError):
        Filter("status", "equal", ("a", "b"))
    g = FilterGroup("or", [f, FilterGroup("and", [Filter("level", "lower_than", "3")])])
    assert FilterGroup.from_dict(json.loads(json.dumps(g.to_dict()))) == g and g.remove(f).filters == g.filters[1:]
    for wrong in ({"chart": "stream", "x": "site"}, {"top": 5, "key": "site"}, {"y_value": "x"}):
        with pytest.raises(ValueError):
            ChartQuery(**wrong)


def test_charts(spark):
    info = chart.ChartInfo.parse({"x": "0", "y": "2", "key": "1", "x-type": "string", "sort": "nope"})
    assert info.sort == "" and chart.ChartInfo.parse({"key": "q"}).key == -1
    df = spark.createDataFrame([("a", "k", "1"), ("a", "k", "2"), ("b", "", ""), ("c", "k", "zz"), ("c", "m", "4")], "x string, k string, y string")
    pts = chart.collapse(chart.points(df, info))
    assert {(r.x, r.key): r.y for r in pts.collect()} == {("a", "k"): 3.0, ("b", ""): 0.0, ("c", "m"): 4.0}
    assert chart.zero_fill(pts).count() == 9
    assert chart.collapse(pts.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chart.check_size(pts, 2)


def test_stats(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (5, 1, 3, 2, 4)] + [("b", float("nan")), ("b", 7.0), (None, None)], "k string, v double")
    got = {(r.key, r.i): r.v for r in stats.box_plot(df, "k", "v").collect()}
    assert [got["a", i] for i in range(5)] == [1.0, 2.0, 3.0, 4.0, 5.0] and got["b", 4] == 7.0 and len(got) == 10
    hot = [("a" if i % 3 else None, float(i * 7 % 11)) for i in range(500)] + [("b", 3.0)] * 400 + [("c", 1.0)]
    want = {}
    for k in {k for k, _ in hot}:
        v = sorted(x for y, x in hot if y == k)
        want |= {(k, i): v[min(int(len(v) / 7 * i), len(v) - 1)] for i in range(8)}
    got = stats.box_plot(spark.createDataFrame(hot, "k string, v double").repartition(5), "k", "v", 7).collect()
    assert {(r.key, r.i): r.v for r in got} == want and len(got) == len(want)
    assert stats.box_plot(df.limit(0), None, "v").count() == 0
    seq = [(i, k) for i, k in enumerate("aabbbaacaa" * 30)]
    runs = stats.runs(spark.createDataFrame(seq, "i long, k string").repartition(7), ["i"], ["k"]).orderBy("run").collect()
    from itertools import groupby

    assert [(r.k, r.n) for r in runs] == [(k, len(list(g))) for k, g in groupby(k for _, k in seq)]


def test_text_files_and_sql(spark, tmp_path):
    normal = normalize.normalize(spark.createDataFrame(RAW, RECORD), 2013)
    facets = cube.cube(normal)
    tables.write_facet_text(facets, str(tmp_path / "t"))
    assert as_cells(tables.read_facet_text(spark, str(tmp_path / "t"))) == as_cells(facets)
    spark.createDataFrame([(1, None), (2, "x")], "a int, b string").createOrReplaceTempView("little")
    sql = SqlText(spark, "little", keep=1)
    assert sql.csv("select * from TABLE order by a") == "1,null\n2,x" and sql.csv("select nope").startswith("failure:")


def test_placeholder_leaves_literals_and_keywords_alone():
    from tallyweave.plans.sqltext import with_table

    for sql, want in {
        "select 'a TABLE b', \"TABLE\", `TABLE` from TABLE -- TABLE": "select 'a TABLE b', \"TABLE\", `TABLE` from t -- TABLE",
        "select 'it''s TABLE' from TABLE, (select * from TABLE)": "select 'it''s TABLE' from t, (select * from t)",
        "REFRESH TABLE x": "REFRESH TABLE x", "show create TABLE x": "show create TABLE x", "ANALYZE TABLE x compute statistics": "ANALYZE TABLE x compute statistics",
        "create TABLE y as select * from TABLE": "create TABLE y as select * from t", "insert into TABLE y select 1": "insert into TABLE y select 1", "insert into TABLE select 1": "insert into t select 1",
        "select TABLES, TABLE.a from TABLE /* TABLE */": "select TABLES, t.a from t /* TABLE */",
    }.items():
        assert with_table(sql, "t") == want


def test_cache_of_results(spark):
    spark.range(10).createOrReplaceTempView("ten")
    text = SqlText(spark, keep=2, most_lines=6, most_fetched=8)
    for q in ("select id from ten where id < 2", "select id from ten where id < 3", "select id from ten where id < 6", "select id from ten where id < 4"):
        text.lines(q)
    assert list(text._kept) == ["select id from ten where id < 3", "select id from ten where id < 4"]  # the longest is not kept, the oldest went
    text.lines("select id from ten where id < 3")
    text.lines("select id from ten where id < 1")
    assert "select id from ten where id < 3" in text._kept and text.csv("select id from ten", html=True).startswith("<pre>failure:more than 8")
    text.update("create or replace temporary view ten as select 1 as id")
    assert not text._kept


def test_cells_and_bounds(spark):
    facets = cube.cube(normalize.normalize(spark.createDataFrame(RAW, RECORD), 2013))
    with pytest.raises(ValueError):
        get_stats(facets, [Filter("site", "in", ("tf1.fr", "france2.fr"))])
    with pytest.raises(LookupError):
        get_stats(facets, [Filter("site", "equal", "nowhere")])
    with pytest.raises(ValueError):
        tables.fetched(facets, 5)
    assert len(tables.fetched(facets, 152)) == 152
    rows = spark.createDataFrame([(None,), ({"date": "2013-01-01", "parse_error": None},), ({"status": "ok"},)], "content map<string,string>")
    assert {r.reason: r.n for r in normalize.audit(normalize.from_container(rows), 2013).collect()} == {"meta_parse_error": 1, "no_date": 1}


def test_chart_edges(spark):
    df = spark.createDataFrame([("2013-2-3", "1"), ("2013", None), ("-05", "1"), ("x-1", "1"), ("2013-14", "2"), (None, "3"), ("", "4"), ("2013-01-", "")], "x string, y string")
    got = {(str(r.x), r.y) for r in chart.points(df, chart.ChartInfo(0, 1, x_type="date")).collect()}
    assert got == {("2013-02-03", 1.0), ("2014-02-01", 2.0), ("2012-12-31", 0.0)}
    both = chart.points(df, chart.ChartInfo(-1, -1, 0)).collect()
    assert {(r.x, r.y) for r in both} == {(0, 0.0)} and {r.key for r in both} >= {"", "-"}
    assert chart.points(df.select("y"), chart.ChartInfo(0, 0)).count() == 0
    with pytest.raises(ValueError):
        chart.points(df, chart.ChartInfo(0, 2))
    with pytest.raises(ValueError):
        chart.zero_fill(chart.points(df, chart.ChartInfo(0, 1, x_type="date")), most=2)


def test_launch_arguments():
    from argparse import ArgumentError

    from tallyweave.plans.launch import arguments

    a = arguments(["-input", "a,b", "-output", "c", "-year", "2013"])
    assert (a.type, a.reducers, a.year) == ("normal", 1, 2013)
    for wrong in (["-year", "x"], ["-year", "2013", "-type", "nope"]):
        with pytest.raises((ArgumentError, SystemExit)):
            arguments(["-input", "a", "-output", "c", *wrong])


def test_jobs(spark, tmp_path):
    store = ScriptStore(str(tmp_path / "s.json"))
    store.add(Script("my script", "select 1 as a; \nselect 'x' as b"))
    with pytest.raises(ValueError):
        store.add(Script("my script", "select 2"))
    runner = JobRunner(spark, store)
    runner._running = type("Busy", (), {"join": lambda self, t: None})()
    assert not runner.wait(0.05)
    runner._running = None
    good = runner.submit(store.scripts[slug("my script")])
    runner.wait()
    bad = runner.submit(Script("bad", "select from where"))
    runner.wait()
    again = ScriptStore(store.path)
    assert again.results[good].lines == ["1", "x"] and not again.results[bad].ok
    assert runner.check(Script("p", "selec 1")).failure and error_position("at line 3, column 7") == (3, 7)


def test_stream(spark, tmp_path):
    from tallyweave.streaming.ingest import append_normalized, stream_records

    (tmp_path / "in").mkdir()
    spark.createDataFrame(RAW, RECORD).coalesce(1).write.mode("overwrite").json(str(tmp_path / "in" / "a"))
    q = append_normalized(stream_records(spark, str(tmp_path / "in" / "a")), 2013, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_oracle_on_small_tables(spark):
    import duckdb

    from tallyweave.queries import ORACLE_SQL, QUERIES

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for f in os.listdir(d):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{d}/{f}'")
    import tallyweave.queries_more  # noqa: F401

    for name in ("cube_total", "series_month_by_content", "boxplot_by_key", "subkey_runs", "reject_audit", "extract_count", "naive_vs_cube_distinct", "container_scan", "container_audit", "json_records_scan", "year_tables", "stored_stats", "launched_cube", "sql_text_lines", "chart_dates", "chart_numbers", "pig_load_store", "diff_flatten", "user_functions", "script_results", "streamed_records", "filter_from_json", "cogroup_counts"):
        rows = QUERIES[name](spark, d)
        names = sorted(rows.columns)
        got = sorted(repr(tuple(r[c] for c in names)) for r in rows.collect())
        assert got == sorted(repr(tuple(r)) for r in con.sql(f"select {', '.join(names)} from ({ORACLE_SQL[name]})").fetchall()), name
