import pytest
from pyspark.sql import functions as F

from fathomline.functions import records
from fathomline.plans import tools


def test_shortening_at_any_depth(spark):
    df = spark.createDataFrame(
        [(1, "x" * 10, ["y" * 10, "z"] * 3, {"k": "v" * 10}, (None, ["w" * 10])), (2, None, None, None, None), (3, "short", [], {}, ("a", []))],
        "id int, s string, a array<string>, m map<string,string>, r struct<p: string, q: array<string>>",
    )
    got = {r["id"]: r for r in records.shortened_frame(df, 4, 2).collect()}
    assert got[1]["s"] == "xxxx…" and got[1]["a"] == ["yyyy…", "z"] and got[1]["m"] == {"k": "vvvv…"}
    assert got[1]["r"]["q"] == ["wwww…"] and got[1]["r"]["p"] is None and got[1]["truncated"]
    assert got[2]["s"] is None and got[2]["r"] is None and not got[2]["truncated"]
    assert got[3]["truncated"] and got[3]["s"] == "shor…"


def test_verdicts_need_the_right_number(spark):
    good = '```json\n[{"score": 2, "reason": "' + "r" * 40 + '"}, {"reason": "no score"}]\n```'
    df = spark.createDataFrame([(good,), ("[]",), ("junk",), (None,)], "c string")
    got = [r[0] for r in df.select(records.verdicts(F.col("c"), 2)).collect()]
    assert [(v["score"], len(v["reason"])) for v in got[0]] == [(1.0, 30), (0.5, 8)] and got[1:] == [None] * 3


def test_tables_and_sections(spark):
    text = "## Facts\n| key | value |\n|---|---|\n| id | 7 |\n| id | 8 |\n\n## Next (a)\nbody\nmore\n## End\nx"
    df = spark.createDataFrame([(text,), ("",), (None,)], "c string")
    rows = df.select(records.table_rows(F.col("c")).alias("t"), records.section(F.col("c"), "Next (a)").alias("s")).collect()
    assert [(r["key"], r["value"]) for r in rows[0]["t"]] == [("key", "value"), ("id", "7"), ("id", "8")]
    assert rows[0]["s"] == "body\nmore" and rows[1]["t"] == [] and rows[1]["s"] == ""


def test_tools_check_their_arguments(spark, sf_dir):
    for name, args in (
        ("nothing", {}), ("search_logs", {"service": " "}), ("search_logs", {"service": "a", "minutes": 0}), ("trace_query", {}),
        ("search_documents", {"query": "x", "top_k": 21}), ("search_documents", {"query": "x", "mode": "magic"}), ("search_logs", {"service": "a", "odd": 1}),
    ):
        with pytest.raises(ValueError):
            tools.run(spark, sf_dir, name, **args)
    assert tools.run(spark, sf_dir, "search_logs", service="harbor-gateway").count() == 20
    assert tools.run(spark, sf_dir, "trace_query", service="harbor-gateway").count() == 10
    first = tools.run(spark, sf_dir, "trace_query", service="harbor-gateway").first()
    assert tools.run(spark, sf_dir, "trace_query", trace_id=first["trace_id"]).count() == first["n_spans"]
    assert tools.run(spark, sf_dir, "search_documents", query="token cache").count() == 5
    assert tools.run(spark, sf_dir, "search_documents", query="token cache", mode="keyword").count() == 5
    assert "title" in tools.run(spark, sf_dir, "search_documents", query="token cache", mode="hybrid").columns

    def broken(rows):
        raise ConnectionError("no model")

    assert "snippet" in tools.run(spark, sf_dir, "search_documents", query="token cache", mode="hybrid", embed=broken).columns
    assert set(tools.run(spark, sf_dir, "service_metrics", service="harbor-gateway", metrics=("n", "odd")).columns) == {"service", "start_ms", "n", "truncated"}


def test_catalogue(spark):
    spark.range(1).createOrReplaceTempView("known_table")
    assert "known_table" in {r["name"] for r in tools.catalogue(spark).collect()}
