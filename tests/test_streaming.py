import datetime as dt

from pyspark.sql import functions as F

from fathomline.operators import memory
from fathomline.streaming import sessions, windows

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def parts(spark, folder, batches, schema):
    """One file per batch, in order of their names."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_summaries_fall_due_over_batches(spark, tmp_path):
    batches = [[("s", t, "u") for t in range(a, a + 8)] for a in (1, 9, 17, 25)] + [[("t", 7, "u"), (None, 9, "u"), ("t", None, "u")]]
    stream = parts(spark, tmp_path / "in", batches, "session_id string, turn int, role string")
    got = sorted((r["session_id"], r["level"], r["covers_start"], r["covers_end"]) for r in windows.run_to_end(sessions.summaries_due(stream)).collect())
    first = [x for x in got if x[1] == 1]
    assert {x[0] for x in got} == {"s"} and first[0][2] == 1
    for a, b in zip(first, first[1:], strict=False):
        assert b[2] == a[3] + 1
    second = [x for x in got if x[1] == 2]
    assert len(second) == (len(first) >= 4) and all(x[2] == 1 for x in second)


def test_upserts_over_batches(spark, tmp_path):
    schema = "session_id string, turn int, role string, id long, content string"
    batches = [[("s", 1, "user", 1, "a"), ("s", 2, "user", 2, "b")], [("s", 1, "user", 3, "edited")], [("s", 1, "user", 0, "older")]]
    stream = parts(spark, tmp_path / "in", batches, schema)
    last = windows.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), memory.merged)
    got = {(r["turn"], r["content"]) for r in spark.read.parquet(last).collect()}
    assert got == {(1, "edited"), (2, "b")}


def test_late_copies_are_dropped(spark, tmp_path):
    schema = "event_id long, at timestamp"
    batches = [[(1, T0), (1, T0), (2, T0)], [(2, T0 + dt.timedelta(seconds=5)), (3, T0)]]
    stream = parts(spark, tmp_path / "in", batches, schema)
    got = windows.run_to_end(windows.deduplicated(stream, "at", ["event_id"], "1 hour")).collect()
    assert sorted(r["event_id"] for r in got) == [1, 2, 3]


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    schema = "at timestamp, kind string, value double"
    rows = [(T0 + dt.timedelta(minutes=m), "k", 1.0) for m in range(0, 300, 7)]
    stream = parts(spark, tmp_path / "in", [rows[:20], rows[20:]], schema).withWatermark("at", "1 day")
    got = windows.run_to_end(windows.tumbling(stream, "at", "1 hour", ["kind"]), "complete")
    want = windows.tumbling(spark.createDataFrame(rows, schema), "at", "1 hour", ["kind"])
    assert sorted(got.collect()) == sorted(want.collect())
    gaps = windows.sessions(spark.createDataFrame(rows[:3] + rows[10:12], schema), "at", "10 minutes", ["kind"])
    assert sorted(r["n"] for r in gaps.collect()) == [2, 3]
    assert gaps.where(F.col("end_us") <= F.col("start_us")).count() == 0
