import datetime as dt
import random

import pytest

from fathomline.operators import history

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "id long, user_id string, field string, value string, created_at timestamp, entity int, ts string"


def micros(t):
    return round((t - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)).total_seconds() * 1e6)


def brute(rows):
    held = {}
    for i, user, field, value, at, *_ in rows:
        if at is None or value is None or not value.strip():
            continue
        fold = lambda s: None if s is None else " ".join(s.split()).lower()
        key = (fold(user), fold(field), micros(at))
        if key not in held or held[key][0] < i:
            held[key] = (i, fold(value))
    out = set()
    by_key = {}
    for (user, field, at), (_, value) in held.items():
        by_key.setdefault((user, field), []).append((at, value))
    for (user, field), changes in by_key.items():
        changes.sort()
        kept = [c for n, c in enumerate(changes) if n == 0 or c[1] != changes[n - 1][1]]
        for n, (at, value) in enumerate(kept):
            out.add((user, field, value, at, kept[n + 1][0] if n + 1 < len(kept) else -1))
    return out


def test_random_logs_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        at = None if rng.random() < 0.02 else T0 + dt.timedelta(minutes=rng.randrange(0, 3000))
        user = rng.choice(["u1", " U1 ", "u1", "u2", "u 3", "U\t3", None])
        value = rng.choice(["a", "A ", "b", "b  c", "B c", "", "  ", None])
        rows.append((i, user, rng.choice(["x", "X", "y"]), value, at, 7, "clash"))
    log = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    for period in (60_000_000 * 17, 60_000_000 * 600, history.PERIOD_US):
        got = [tuple(r) for r in history.validity(log, period_us=period).collect()]
        assert len(got) == len(want)
        assert set(got) == want


def test_ties_late_rows_and_repeats(spark):
    at = [T0 + dt.timedelta(days=d) for d in range(5)]
    rows = [
        (1, "u", "f", "old", at[0], 0, ""),
        (2, "u", "f", "lost", at[2], 0, ""),
        (3, "u", "f", "won", at[2], 0, ""),
        (4, "u", "f", "late", at[1], 0, ""),
        (5, "u", "f", "won", at[3], 0, ""),
        (6, "u", "f", "won", at[3], 0, ""),
    ]
    got = history.validity(spark.createDataFrame(rows, SCHEMA), period_us=86_400_000_000).orderBy("valid_from_us").collect()
    assert [r["value"] for r in got] == ["old", "late", "won"]
    assert [r["valid_to_us"] for r in got] == [micros(at[1]), micros(at[2]), -1]


def test_empty_log(spark):
    log = spark.createDataFrame([], SCHEMA)
    assert history.validity(log).count() == 0
    assert history.full_versions(log).count() == 0
    assert history.as_of(log, micros(T0)).count() == 0


@pytest.mark.parametrize("days", [0, 3, 40, 200])
def test_as_of_agrees_with_validity(spark, days):
    rng = random.Random(5)
    rows = [
        (i, f"u{rng.randrange(4)}", "f", rng.choice("abc"), T0 + dt.timedelta(days=rng.randrange(0, 150)), 0, "") for i in range(200)
    ]
    log = spark.createDataFrame(rows, SCHEMA)
    at = micros(T0 + dt.timedelta(days=days, hours=12))
    versions = history.validity(log).collect()
    want = {
        (r["entity"], r["attribute"], r["value"], r["valid_from_us"])
        for r in versions
        if r["valid_from_us"] <= at and (r["valid_to_us"] > at or r["valid_to_us"] == -1)
    }
    got = {tuple(r) for r in history.as_of(log, at, period_us=20 * 86_400_000_000).collect()}
    assert got == want


def test_versions_are_stored_whole_and_read(spark):
    day = 86_400_000_000
    at = [T0 + dt.timedelta(days=d) for d in (0, 12, 25, 31, 65)]
    rows = [(1, "u", "f", "a", at[0], 0, ""), (2, "u", "g", "x", at[1], 0, ""), (3, "u", "f", "a", at[2], 0, ""), (4, "u", "f", "b", at[3], 0, ""), (5, "v", "f", "c", at[4], 0, "")]
    store = history.stored(spark.createDataFrame(rows, SCHEMA), period_us=10 * day)
    start = micros(T0) // (10 * day)
    versions = {(r["entity"], r["attribute"], r["version"] - start): (r["value"], r["since"], r["until"]) for r in store.versions.collect()}
    # each version until the next change holds the attribute; what never changes again is there once
    assert {k[2] for k in versions if k[:2] == ("u", "f")} == {1, 2, 3, 4} and {k[2] for k in versions if k[:2] == ("u", "g")} == {2}
    assert versions["u", "f", 3] == ("a", micros(at[0]), micros(at[3])) and versions["u", "f", 4] == ("b", micros(at[3]), -1)
    for d in (0.5, 11, 26, 32, 64, 66, 900):
        moment = micros(T0) + int(d * day)
        got = {tuple(r) for r in history.read_as_of(store, moment).collect()}
        assert got == {
            tuple(r)[:4] for r in history.folded(store).collect() if r["valid_from_us"] <= moment and (r["valid_to_us"] > moment or r["valid_to_us"] == -1)
        }
    # what is read comes from the stored rows: another version changes the answer
    from pyspark.sql import functions as F

    changed = store._replace(versions=store.versions.withColumn("value", F.concat("value", F.lit("!"))))
    assert {r["value"] for r in history.read_as_of(changed, micros(at[4]) + 15 * day).collect()} == {"b!", "x!", "c!"}
