import pytest
from pyspark.sql import functions as F

from fathomline.operators import evaluation, synthesis


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def call(tool, **args):
    entries = [x for k, v in args.items() for x in (F.lit(k), F.lit(v))]
    made = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(tool).alias("tool_name"), made.alias("args"))


def want(*tools, **args):
    entries = [x for k, v in args.items() for x in (F.lit(k), F.lit(v))]
    made = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    return F.struct(F.array(*map(F.lit, tools)).alias("tools"), made.alias("args"))


def test_greedy_matching(spark):
    actual = F.array(call("search", service="Edge-Admin"), call("search", service="x"), call("kb"))
    expected = F.array(want("search", service="edge"), want("search", "trace"), want("search"), want("kb"))
    assert value(spark, evaluation.matched_calls(actual, expected)) == [0, 1, -1, 2]
    assert value(spark, evaluation.tool_score(actual, expected)) == 0.75


def test_scores(spark):
    listed = lambda *xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    cite = lambda answer, refs, exp: value(spark, evaluation.citation_score(F.lit(answer), listed(*refs), listed(*exp)))
    assert cite("see pm-1", [], ["pm-1", "pm-2"]) == 0.5
    assert cite("", ["docs/PM-2-long"], ["pm-2"]) == 1.0
    assert cite("", [], []) == 1.0
    conc = lambda a, ks, n: value(spark, evaluation.conclusion_score(F.lit(a), listed(*ks), F.lit(n)))
    assert conc("DNS and cache", ["dns", "cache", "tls"], 3) == pytest.approx(2 / 3)
    assert conc("dns cache", ["dns", "cache"], 1) == 1.0
    assert conc("", ["dns"], 1) == 0.0
    pen = lambda a, ks: value(spark, evaluation.forbidden_penalty(F.lit(a), listed(*ks)))
    assert pen("a b", ["a", "b"]) == pytest.approx(0.2)
    assert pen("a b c d", ["a", "b", "c", "d"]) == pytest.approx(0.3)
    total = lambda d: value(spark, evaluation.total_score(F.lit(d), F.lit(1.0), F.lit(0.5), F.lit(0.0), F.lit(0.1)))
    assert [total(d) for d in ("easy", "medium", "hard", "other")] == [0.45, 0.3, 0.2, 0.45]


def test_nearest_rank_and_histogram(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(1, 11)] + [("b", 5.0), ("b", -1.0), ("c", None)], "g string, v double")
    got = {r["g"]: (r["n"], r["p50"], r["p90"], r["p99"]) for r in evaluation.nearest_rank(df, "g", "v", (0.5, 0.9, 0.99)).collect()}
    assert got == {"a": (10, 6.0, 10.0, 10.0), "b": (1, 5.0, 5.0, 5.0)}
    bins = {r["g"]: (r["n"], r["b0"], r["b1"], r["b2"], r["stuck_share"]) for r in evaluation.histogram(df, "g", "v", [3.0, 8.0], 2, 9.0).collect()}
    assert bins == {"a": (9, 2, 5, 2, pytest.approx(22.222222)), "b": (1, 0, 1, 0, 0.0)}


def test_reports(spark):
    df = spark.createDataFrame([("x", 2, 0.9), ("x", 1, 0.2), ("x", 3, 0.2), ("y", 4, None)], "g string, c int, s double")
    got = evaluation.report_by_group(df, "g", "s", "c").collect()
    assert [(r["g"], r["n"], r["worst_case"]) for r in got] == [("x", 3, 1)]
    classes = {r["g"]: r["class"] for r in evaluation.volatility(df, "g", "s").collect()}
    assert classes == {"x": "large", "y": "all errors"}


def test_fan_out(spark):
    df = spark.createDataFrame([("r", ["a", "b", "c", "d"]), ("e", []), ("n", None)], "run_id string, hypotheses array<string>")
    got = sorted((r["run_id"], r["ord"], r["hypothesis"]) for r in evaluation.fanned_out(df).collect())
    assert got == [("e", 0, "default"), ("n", 0, "default"), ("r", 0, "a"), ("r", 1, "b"), ("r", 2, "c")]
    results = spark.createDataFrame([("r", 0, 0.2, "low"), ("r", 1, 0.9, "high")], "run_id string, ord int, confidence double, summary string")
    assert evaluation.gathered(results).first()["summary"] == "high | low"


def test_templates_are_repeatable_and_gated(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/fault_f3_skeleton.parquet")
    a, b = synthesis.filled(rows), synthesis.filled(rows.repartition(7))
    assert a.exceptAll(b).count() == 0
    assert a.where(F.col("msg").rlike("<(N|C|ROUTE)>")).count() == 0
    assert synthesis.gated(a).where("score < 0.7").count() == 0


def test_gate_tries_twice_and_then_discards(spark):
    rows = [(1, "INFO", "a long enough text", False), (2, "INFO", "fault that is informational", True), (3, "INFO", "<N> left", True), (4, "ERRO", "", True)]
    lines = spark.createDataFrame(rows, "seq long, level string, msg string, fault boolean")
    got = {r["seq"]: (r["level"], r["score"], r["attempts"]) for r in synthesis.gated(lines, 0.75).collect()}
    assert got == {1: ("INFO", 1.0, 1), 2: ("ERRO", 1.0, 2)}


def test_forbidden_rate_counts_scored_runs(spark):
    rows = spark.createDataFrame([("a", 0.9, 0.0), ("a", 0.2, 0.1), ("a", None, 0.3), ("b", 0.5, 0.0)], "g string, total double, penalty double")
    got = {r["g"]: (r["n"], r["forbidden_rate"]) for r in evaluation.forbidden_rate(rows, "g", "total", "penalty").collect()}
    assert got == {"a": (2, 0.5), "b": (1, 0.0)}
