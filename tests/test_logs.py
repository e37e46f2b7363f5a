import datetime as dt

from pyspark.sql import functions as F

from fathomline.operators import logs, ordered, patterns

FIELDS = ("time", "level", "traceid", "prefix", "service", "msg", "path", "status_code", "method", "latency_ms", "callerpath", "content")
SKEL = (
    "seq long, skel struct<time: string, level: string, traceid: string, prefix: string, service: string, msg: string, path: string, "
    "status_code: long, method: string, latency_ms: long, callerpath: string, content: string>, ingested_at timestamp, level string"
)
T0 = dt.datetime(2026, 3, 1, tzinfo=dt.timezone.utc)


def table(spark, rows):
    made = []
    for i, r in enumerate(rows):
        skel = None if r is None else tuple(r.get(f) for f in FIELDS)
        made.append((i, skel, T0 + dt.timedelta(hours=i), "clash"))
    return spark.createDataFrame(made, SKEL)


def test_normalised_defaults(spark):
    rows = logs.normalised(table(spark, [None, {"content": "", "callerpath": "/a.go:1"}, {"level": "FATA", "content": "c"}])).orderBy("seq")
    a, b, c = rows.collect()
    assert (a["msg"], a["service"], a["detail"], a["latency_ms"], a["level_rank"]) == ("", "", None, None, 0)
    assert b["detail"] == "/a.go:1"
    assert (c["detail"], c["level_rank"]) == ("c", 4)


def test_search_is_literal_and_orders_by_severity(spark):
    rows = [
        {"service": "Admin", "level": "INFO", "msg": "50% done"},
        {"service": "admin", "level": "ERRO", "msg": "at 50% failed"},
        {"service": "admin", "level": "ERRO", "msg": "other"},
        {"service": "http", "level": "FATA", "msg": "50%"},
    ]
    got = logs.search(logs.normalised(table(spark, rows)), " ADMIN ", "50%").collect()
    assert [r["seq"] for r in got] == [1, 0]
    assert logs.search(logs.normalised(table(spark, rows)), "admin", limit=1).first()["seq"] == 1


def test_keep_policy(spark):
    rows = [{"level": x, "msg": m} for x, m in (("WARN", ""), ("DEBU", "lease"), ("INFO", "lease"), ("INFO", ""), ("ERRO", ""))]
    df = logs.normalised(table(spark, rows))
    assert sorted(r["seq"] for r in logs.keep_policy(df, ("lease",)).collect()) == [0, 2, 4]
    assert sorted(r["seq"] for r in logs.keep_policy(df, ()).collect()) == [0, 2, 3, 4]


def test_trace_summary_takes_first_of_equal_latencies(spark):
    rows = [
        {"traceid": "t", "service": "b", "time": "2", "latency_ms": 9, "level": "ERRO"},
        {"traceid": "t", "service": "a", "time": "1", "latency_ms": 9},
        {"traceid": "t", "service": "b", "time": "3", "latency_ms": -1},
        {"traceid": "", "service": "b"},
        {"traceid": "u", "service": "a", "time": "1", "latency_ms": None},
    ]
    got = {r["trace_id"]: r for r in logs.trace_summaries(logs.normalised(table(spark, rows))).collect()}
    t = got["t"]
    assert (t["n_spans"], t["error_count"], t["has_error"], t["max_latency_ms"], t["slowest_service"]) == (3, 1, True, 9, "b")
    assert t["services"] == ["a", "b"] and (t["start_ts"], t["end_ts"]) == ("1", "3")
    assert (got["u"]["max_latency_ms"], got["u"]["slowest_service"]) == (0, "")
    assert set(got) == {"t", "u"}


def test_traces_of_service_keep_all_their_lines(spark):
    rows = [{"traceid": "t", "service": "a"}, {"traceid": "t", "service": "b"}, {"traceid": "u", "service": "b"}]
    got = logs.traces_of_service(logs.normalised(table(spark, rows)), "A").collect()
    assert [(r["trace_id"], r["n_spans"]) for r in got] == [("t", 2)]


def test_redelivered(spark):
    rows = [{"msg": "a"}, {"msg": "a"}, {"msg": "b"}, None, None]
    got = {r["seq"]: r["deliveries"] for r in logs.distinct_lines(table(spark, rows)).collect()}
    assert got == {0: 2, 2: 1, 3: 2}


def test_running_sum_equals_one_window(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    got = ordered.running_sum(df, ["k"], "id", F.col("id"), 17, "upto").collect()
    total = {0: 0, 1: 0, 2: 0}
    for r in sorted(got, key=lambda r: r["id"]):
        total[r["k"]] += r["id"]
        assert r["upto"] == total[r["k"]]


def test_caps_keep_or_drop_the_crossing_line(spark):
    df = logs.normalised(table(spark, [{"msg": "x" * 6, "prefix": "e"}] * 4))
    assert logs.within_cap(df, 10, True, 2).count() == 2
    assert logs.within_cap(df, 10, False, 2).count() == 1


def test_as_of_join(spark):
    rows = [(1, "u", 0, "m"), (2, "u", 5, "e"), (3, "u", 100, "e"), (4, "u", 100, "m"), (5, "u", 101, "e"), (6, "v", 1, "e")]
    made = [(i, u, T0 + dt.timedelta(seconds=s), k) for i, u, s, k in rows]
    df = spark.createDataFrame(made, "id long, u string, at timestamp, kind string")
    got = logs.latest_before(df, "u", "at", F.col("kind") == "m", "id", 10_000_000)
    assert {r["id"]: r["mark_id"] for r in got.collect()} == {2: 1, 3: 4, 5: 4, 6: None}


def test_patterns(spark):
    rows = [{"msg": f"took {n} ms", "prefix": e} for n, e in ((1234, "prod"), (5678, "uat"), (99999, "prod"))] + [{"msg": ""}]
    df = logs.normalised(table(spark, rows))
    top = patterns.top_patterns(df, 5).collect()
    assert [(r["pattern"], r["n"], r["share"]) for r in top] == [("took <N> ms", 3, 75.0)]
    env = patterns.by_environment(df, ["prod", "uat"]).first()
    assert (env["n_prod"], env["n_uat"], env["n"]) == (2, 1, 3)
    delta = patterns.before_after(df, "2026-03-02").first()
    assert (delta["before"], delta["after"], delta["delta"]) == (3, 0, -3)


def test_grouping_sets_and_empty_tables(spark):
    df = logs.normalised(table(spark, [{"level": "INFO", "service": "a", "msg": "m"}, {"service": "a"}]))
    got = {(r["kind"], r["key"]): r["n"] for r in logs.counts_by_kind(df).collect()}
    assert got == {("level", "INFO"): 1, ("level", ""): 1, ("service", "a"): 2, ("pattern", "m"): 1}
    none = logs.normalised(table(spark, []))
    for out in (logs.counts_by_kind(none), logs.trace_summaries(none), patterns.top_patterns(none), logs.red_metrics(none)):
        assert out.count() == 0
