import pytest
from pyspark.sql import functions as F

from fathomline.functions import records, text
from fathomline.operators import evaluation
from fathomline.sources import files
from fathomline.streaming import windows


def test_lines_are_masked_before_they_are_cut(spark):
    token = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.abc"
    df = spark.createDataFrame([("x" * 100 + " " + token,)], "content string")
    shown = df.select(text.truncated(text.mask(F.col("content")), 110).alias("c")).first()["c"]
    assert "eyJ" not in shown and len(shown) == 111
    cut_first = df.select(text.mask(text.truncated(F.col("content"), 110)).alias("c")).first()["c"]
    assert "eyJ" in cut_first


def test_json_lines_round_trip(spark, tmp_path):
    rows = [(1, "a\n\"b\" 一", 2.5), (2, None, None), (3, "", 0.0)]
    df = spark.createDataFrame(rows, "id long, msg string, v double")
    files.write_json_lines(df, str(tmp_path / "out"))
    assert sorted(map(tuple, files.json_lines(spark, str(tmp_path / "out"), "*.json", df.schema).collect())) == rows


def test_lists_are_put_together_by_places(spark):
    df = spark.createDataFrame([(["a", "b"], [1, 2]), (None, [1]), ([], [])], "l array<string>, r array<int>")
    got = [r["z"] for r in df.select(records.zipped(F.col("l"), F.col("r")).alias("z")).collect()]
    assert got == [[("a", 1), ("b", 2)], None, []]
    odd = spark.createDataFrame([(["a"], [1, 2])], "l array<string>, r array<int>")
    with pytest.raises(Exception, match="different lengths"):
        odd.select(records.zipped(F.col("l"), F.col("r"))).collect()


def test_errors_worth_another_try(spark):
    cases = {"ReadTimeout": True, "ConnectionReset": True, "NetworkError: x": True, "request TIMEOUT": True, "ValueError": False, "": False}
    df = spark.createDataFrame([(k,) for k in cases], "e string")
    got = {r["e"]: r["again"] for r in df.select("e", evaluation.retryable(F.col("e"), ("Timeout", "Connect", "Network")).alias("again")).collect()}
    assert got == cases


def test_sparse_windows_and_batches(spark):
    df = spark.createDataFrame([(t,) for t in (0, 59, 60, 299, 300, 330, 660)], "s long").select(F.timestamp_seconds("s").alias("ts"))
    got = {(r["start_ms"], r["n"]) for r in windows.sparse(df, "ts", 60, 300, []).collect()}
    assert got == {(0, 2), (300_000, 2)}
    numbered = files.with_ids(spark.range(50, 80, 3, 4), ["id"], "place").collect()
    assert sorted((r["place"], r["id"]) for r in numbered) == [(i + 1, 50 + 3 * i) for i in range(10)]


def test_medians_and_classes(spark):
    rows = [("a", float(x)) for x in (5, 1, 9, 7)] + [("b", 2.0), ("b", 2.0), ("b", 4000.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    assert {(r["g"], r["median"]) for r in evaluation.medians(df, "g", "v", 3).collect()} == {("a", 6.0), ("b", 2.0)}
    shares = evaluation.class_shares(spark.createDataFrame([("x",), ("x",), ("y",)], "c string"), "c").collect()
    assert {(r["c"], r["n"], r["share"]) for r in shares} == {("x", 2, 66.6667), ("y", 1, 33.3333)}
