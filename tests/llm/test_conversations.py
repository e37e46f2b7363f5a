import datetime as dt
import random

from fathomline.llm import conversations as c

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "id long, session_id string, turn int, role string, content string, created_at timestamp, reasons string, said int"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, T0 + dt.timedelta(minutes=i), "clash", 1) for i, r in enumerate(rows)], SCHEMA)


def brute(rows):
    known = {s: role for role, ss in c.ROLES.items() for s in ss}
    sessions = {}
    for i, (session, turn, role, content) in enumerate(rows):
        if session:
            sessions.setdefault(session, []).append((i, turn, known.get((role or "").strip().lower()), content))
    out = set()
    for session, own in sessions.items():
        last = {}
        for i, turn, role, content in own:
            last[turn, role] = max(last.get((turn, role), (-1, None)), (i, content), key=lambda x: x[0])
        said = lambda s: s is not None and s.strip("​﻿ \t\n　") != ""
        asked = {t for (t, r), (_, s) in last.items() if r == "user" and said(s)}
        answered = {t for (t, r), (_, s) in last.items() if r == "assistant" and said(s)}
        if not asked | answered:
            out.add((session, "empty"))
            continue
        if {t for t in asked if t is not None} - answered:
            out.add((session, "no_reply"))
        turns = sorted(t for t in asked | answered if t is not None)
        odd = any(t is None or r is None for _, t, r, _ in own)
        if odd or answered - asked or turns != list(range(1, len(turns) + 1)):
            out.add((session, "broken"))
    return out


def test_random_tables_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for s in range(150):
        for t in range(1, rng.randrange(1, 5)):
            for role in ("user", "assistant"):
                if rng.random() < 0.93:
                    name = rng.choice([role, role.upper(), f" {role}\t", "human" if role == "user" else "AI"])
                    turn = t if rng.random() < 0.97 else rng.choice([None, 9])
                    rows.append((f"s{s}", turn, name if rng.random() < 0.98 else rng.choice(["?", None, ""]), rng.choice(["hi", "yes", " ", "​", None, "ok"])))
                    if rng.random() < 0.1:
                        rows.append(rows[-1][:3] + (rng.choice(["again", ""]),))
    rows += [(None, 1, "user", "lost"), ("", 1, "user", "lost")]
    rng.shuffle(rows)
    df = frame(spark, rows)
    got = [tuple(r) for r in c.dropped(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    dropped = {s for s, _ in got}
    kept = c.conversations(df).orderBy("session_id", "turn", "position").collect()
    assert {r["session_id"] for r in kept} == {r[0] for r in rows if r[0]} - dropped
    for a, b in zip(kept, kept[1:], strict=False):
        if a["session_id"] == b["session_id"] and a["turn"] == b["turn"]:
            assert (a["role"], b["role"]) == ("user", "assistant") and b["position"] == a["position"] + 1


def test_each_reason(spark):
    rows = [
        ("sound", 1, "Human", "q"), ("sound", 1, "bot", "a"), ("sound", 0, "system", "be kind"),
        ("empty", 1, "user", "﻿"), ("empty", None, "??", "x"),
        ("no_reply", 1, "user", "q"), ("no_reply", 1, "assistant", " "),
        ("gap", 1, "user", "q"), ("gap", 1, "assistant", "a"), ("gap", 3, "user", "q"), ("gap", 3, "assistant", "a"),
        ("orphan", 1, "assistant", "a"),
    ]
    got = {tuple(r) for r in c.dropped(frame(spark, rows)).collect()}
    assert got == {("empty", "empty"), ("no_reply", "no_reply"), ("gap", "broken"), ("orphan", "broken")}
    kept = c.conversations(frame(spark, rows)).orderBy("turn", "position").collect()
    assert [(r["turn"], r["role"]) for r in kept] == [(0, "system"), (1, "user"), (1, "assistant")]


def test_segments_split_at_long_silences(spark):
    made = []
    for i in range(150):
        at = T0 + dt.timedelta(minutes=2 * i + (60 * 48 if i >= 75 else 0))
        made += [(2 * i, "a", i + 1, "user", "x", at, "", 0), (2 * i + 1, "a", i + 1, "assistant", "x", at + dt.timedelta(minutes=1), "", 0)]
    # stored again, blank, without a time, and a session that isn't sound
    made += [(-1, "a", 1, "user", "old", T0 - dt.timedelta(days=9), "", 0), (800, "a", 1, "system", " ", T0 + dt.timedelta(days=90), "", 0)]
    made += [(900, "b", 1, "user", "x", T0, "", 0), (901, "b", 1, "assistant", "x", None, "", 0)]
    made += [(902, None, 1, "user", "x", T0, "", 0), (903, "c", 1, "user", "x", T0, "", 0)]
    df = spark.createDataFrame(made, SCHEMA)
    got = c.segments(df).collect()
    assert sorted((r["session_id"], r["segment"], r["n_messages"], r["n_turns"]) for r in got) == [("a", 1, 150, 75), ("a", 2, 150, 75), ("b", 1, 1, 1)]
    rows = c.conversations(df).collect()
    assert len(rows) == 302
    assert all(r["segment"] == (1 if r["turn"] <= 75 else 2) for r in rows if r["session_id"] == "a")
    assert {(r["role"], r["segment"]) for r in rows if r["session_id"] == "b"} == {("user", 1), ("assistant", None)}


def test_the_gap_is_calibrated_on_the_table(spark):
    gaps = spark.createDataFrame([(1000,)] * 990 + [(10**9,)] * 10 + [(None,), (0,)], "gap_us long")
    limit = c.limit_us(gaps, 0.98, 4.0).first()[0]
    assert 4000 < limit < 4000 * 2.72 ** (1 / c.STEPS)
    assert c.limit_us(gaps, 1.0, 4.0).first()[0] > 4 * 10**9
    assert c.limit_us(gaps.limit(0), 0.99, 4.0).count() == 0


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert c.dropped(none).count() == c.conversations(none).count() == c.segments(none).count() == 0
