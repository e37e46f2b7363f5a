import datetime as dt

from pyspark.sql import functions as F

from fathomline.operators import memory

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "id long, session_id string, turn int, role string, content string, tool_calls string, created_at timestamp, place int"


def turns(spark, n, session="s", calls=None):
    rows = []
    for t in range(1, n + 1):
        for k, role in enumerate(("user", "assistant")):
            rows.append((2 * t + k, session, t, role, f"{role} {t}", calls, T0, 0))
    return spark.createDataFrame(rows, SCHEMA)


def test_last_three_turns(spark):
    got = memory.recent(turns(spark, 10), 3).orderBy("turn", memory.role_order(F.col("role"))).collect()
    assert [r["turn"] for r in got] == [8, 8, 9, 9, 10, 10] and got[0]["role"] == "user"
    assert sorted({r["turn"] for r in memory.recent(turns(spark, 5), 2).collect()}) == [4, 5]


def test_upsert_last_writer_wins(spark):
    base = turns(spark, 2)
    delta = spark.createDataFrame([(99, "s", 2, "user", "edited", None, T0, 0), (100, None, 1, "user", "lost", None, T0, 0)], SCHEMA)
    got = memory.merged(base, delta).where("turn = 2 and role = 'user'").collect()
    assert [r["content"] for r in got] == ["edited"]
    assert memory.merged(base, delta).count() == 4
    assert memory.upserted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_compaction_covers_all_but_the_last(spark):
    got = memory.compaction(turns(spark, 9), keep=3).first()
    assert (got["reason"], got["covers_start"], got["covers_end"]) == ("rounds", 1, 6)
    assert memory.compaction(turns(spark, 7), keep=3).first()["reason"] == "none"


def test_summaries_have_no_gap_or_overlap_and_merge(spark):
    first = memory.summaries(turns(spark, 20), span=4, keep=3)
    spans = sorted((r["covers_start"], r["covers_end"]) for r in first.collect())
    assert spans == [(1, 4), (5, 8), (9, 12), (13, 16)]
    out = memory.superseded(first, 4).collect()
    assert sorted((r["level"], r["superseded"]) for r in out) == [(1, True)] * 4 + [(2, False)]
    assert [(r["covers_start"], r["covers_end"]) for r in out if r["level"] == 2] == [(1, 16)]


def test_marking_by_ids(spark):
    rows = spark.createDataFrame([(1, False), (2, False), (3, True)], "id long, superseded boolean")
    ids = spark.createDataFrame([(2,), (2,)], "id long")
    got = {r["id"]: r["superseded"] for r in memory.marked_superseded(rows, ids).collect()}
    assert got == {1: False, 2: True, 3: True}
    assert memory.marked_superseded(rows, ids.limit(0)).where("superseded").count() == 1


def test_context_renders_summaries_first(spark):
    text = memory.rendered(memory.context(turns(spark, 9), span=4, keep=2)).first()["text"]
    assert text.split("\n") == ["[1-4]", "user: user 8", "assistant: assistant 8", "user: user 9", "assistant: assistant 9"]


def test_tool_calls_survive_damage(spark):
    good = '[{"tool_name": "a", "args": {"service": "x", "minutes": 5}, "success": true, "latency_ms": 3}]'
    rows = [(i, "s", i, "assistant", "", c, T0, 0) for i, c in enumerate([good, "[{\"tool_name\": ", "null", "[]", "{}", None])]
    got = memory.tool_calls(spark.createDataFrame(rows, SCHEMA)).where("tool_name is not null").collect()
    assert [(r["id"], r["tool_name"], r["args"]["service"], r["latency_ms"]) for r in got] == [(0, "a", "x", 3)]


def test_versions(spark):
    rows = [(1, "u", "role", "backend", T0), (2, "u", "role", "SRE", T0 + dt.timedelta(1)), (3, "u", "role", "tie", T0)]
    df = spark.createDataFrame(rows, "id long, user_id string, field string, value string, created_at timestamp")
    assert memory.latest(df, ["user_id", "field"]).first()["value"] == "SRE"
    got = memory.newest(df, ["user_id", "field"], 2).orderBy("place").collect()
    assert [r["value"] for r in got] == ["SRE", "tie"]


def test_summaries_and_recent_turns_hold_every_turn(spark):
    for n in range(1, 22):
        rows = turns(spark, n)
        covered = [t for r in memory.summaries(rows, 4, 3, tail=True).collect() for t in range(r["covers_start"], r["covers_end"] + 1)]
        kept = {r["turn"] for r in memory.recent(rows, 3).collect()}
        assert sorted([*covered, *kept]) == list(range(1, n + 1))
    text = memory.rendered(memory.context(turns(spark, 10), span=4, keep=3, tail=True)).first()["text"]
    assert text.split("\n")[:3] == ["[1-4]", "[5-7]", "user: user 8"]


def test_all_versions_are_numbered_across_periods(spark):
    rows = [(i, "u" if i % 3 else None, "role", f"v{i}", T0 + dt.timedelta(days=7 * (i // 2))) for i in range(40)]
    versions = spark.createDataFrame(rows, "id long, user_id string, field string, value string, created_at timestamp")
    got = {(r["user_id"], r["place"]): r["id"] for r in memory.all_versions(versions, ["user_id", "field"]).collect()}
    want = {}
    for user in ("u", None):
        ids = sorted((r[0] for r in rows if r[1] == user), reverse=True)
        want |= {(user, n + 1): i for n, i in enumerate(ids)}
    assert got == want and len(got) == 40
