import json

import pytest

from fathomline.sources import files
from fathomline.sources.paged import PagedSource
from fathomline.streaming import windows


@pytest.fixture
def folder(tmp_path):
    return tmp_path


def test_json_lines_skip_damage(spark, folder):
    (folder / "a.jsonl").write_text('{"msg": "x", "latency_ms": 3}\n\n{broken\n{"Level": "ERRO"}\n')
    (folder / "b.txt").write_text('{"msg": "no"}\n')
    got = files.json_lines(spark, str(folder)).collect()
    assert sorted((r["msg"] or "", r["Level"]) for r in got) == [("", "ERRO"), ("x", None)]


def test_dated_lines_take_their_place(spark, folder):
    path = folder / "prod" / "tls" / "gw"
    path.mkdir(parents=True)
    (path / "2026-03-01.jsonl").write_text('{"msg": "x"}\n')
    (path / "2026-03-02.jsonl").write_text("")
    got = files.dated_lines(spark, str(folder)).collect()
    assert [(r["env"], r["topic"], str(r["day"]), r["msg"]) for r in got] == [("prod", "gw", "2026-03-01", "x")]


def test_markdown_and_listing(spark, folder):
    (folder / "runbooks").mkdir()
    (folder / "runbooks" / "dns.md").write_text("# DNS\ntext")
    (folder / "README.md").write_text("skip")
    got = files.markdown(spark, str(folder)).collect()
    assert [(r["doc_id"], r["category"], r["text"]) for r in got] == [("dns", "runbooks", "# DNS\ntext")]
    report = files.listing_report(files.listing(spark, str(folder))).collect()
    assert {r["first"]: (r["n"], r["bytes"]) for r in report} == {"runbooks": (1, 10), "README.md": (1, 4)}


def test_partitioned_writes_are_repeatable(spark, folder):
    out = str(folder / "out")
    rows = [("p", "t", "2026-01-01", 1), ("p", "t", "2026-01-02", 2)]
    df = spark.createDataFrame(rows, "env string, topic string, day string, n int")
    files.write_days(df, out)
    files.write_days(df.where("n = 2").selectExpr("env", "topic", "day", "n + 10 as n"), out)
    assert sorted(r["n"] for r in spark.read.parquet(out).collect()) == [1, 12]
    files.write_days(df, out, only_new=True)
    assert sorted(r["n"] for r in spark.read.parquet(out).collect()) == [1, 12]


def test_ids_follow_the_order(spark):
    df = spark.range(500).selectExpr("id % 7 as a", "id as b")
    got = files.with_ids(df, ["a", "b"]).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1, 501))
    assert [(r["a"], r["b"]) for r in got] == sorted((i % 7, i) for i in range(500))


def test_pages_are_partitions_and_streams_keep_a_cursor(spark, folder):
    for n in range(3):
        (folder / f"page-{n}.json").write_text(json.dumps([{"id": str(10 * n + i), "body": "b"} for i in range(2)]))
    spark.dataSource.register(PagedSource)
    df = spark.read.format("pages").load(str(folder))
    assert df.rdd.getNumPartitions() == 3
    assert sorted(r["id"] for r in df.collect()) == ["0", "1", "10", "11", "20", "21"]
    assert [r["id"] for r in df.where("id = '11'").collect()] == ["11"]
    stream = spark.readStream.format("pages").load(str(folder))
    assert windows.run_to_end(stream).count() == 6


def test_no_yaml_package_is_needed_to_import():
    assert callable(files.yaml_documents)
