import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from fathomline.llm import percentiles as p

SCHEMA = "day date, g string, v long, n int, grp string"


def rows_of(seed, n=4000):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        g = rng.choice(["hot"] * 6 + ["a", "b", "c", None])
        v = rng.choice([rng.randrange(50), rng.randrange(10**6), int(rng.lognormvariate(5, 2)), -1, None])
        out.append((dt.date(2026, 1, rng.randrange(1, 8)), g, v, 0, "clash"))
    return out + [(dt.date(2026, 1, 1), "one", 7, 0, ""), (None, "a", 5, 0, "")]


def brute(rows):
    by = {}
    for day, g, v, *_ in rows:
        if day and g and v is not None and v >= 0:
            by.setdefault(g, []).append(v)
    return {g: sorted(x) for g, x in by.items()}


@pytest.mark.parametrize("limit", [0, 5, 32, 200])
def test_selection_is_exact_in_any_number_of_rounds(spark, limit):
    rows = rows_of(limit)
    days = p.day_partials(spark.createDataFrame(rows, SCHEMA), "g", "v", "day")
    got = {(r["grp"], r["percentile"]): (r["value"], r["n_values"]) for r in p.select(p.combine(days), last_values=limit).collect()}
    values = brute(rows)
    want = {(g, q): (x[max(1, math.ceil(q * len(x) - 1e-9)) - 1], len(x)) for g, x in values.items() for q in p.PERCENTILES}
    assert got == want


def test_state_that_may_not_be_broadcast_is_joined(spark, monkeypatch):
    rows = rows_of(9)
    counted = p.combine(p.day_partials(spark.createDataFrame(rows, SCHEMA), "g", "v", "day"))
    want = {tuple(r) for r in p.select(counted, last_values=20).collect()}
    monkeypatch.setattr(p, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in p.select(counted, last_values=20).collect()} == want


def test_registered_query_goes_through_rounds(spark, monkeypatch):
    from fathomline.llm.queries import p3_percentiles

    rounds = []
    one = p._round
    monkeypatch.setattr(p, "_round", lambda *args: rounds.append(1) or one(*args))
    p3_percentiles(spark, "/root/testdata/sf0.01").count()
    assert len(rounds) >= 3


def test_no_candidate_is_held_twice(spark, monkeypatch):
    rows = [(dt.date(2026, 1, 1), "g", v, 0, "") for v in range(1000)]
    sizes = []
    moved = p._moved

    def counted(*args):
        out = moved(*args)
        sizes.append(out.count())
        assert out.count() == out.select("value").distinct().count()
        return out

    monkeypatch.setattr(p, "_moved", counted)
    days = p.day_partials(spark.createDataFrame(rows, SCHEMA), "g", "v", "day")
    got = {r["percentile"]: r["value"] for r in p.select(p.combine(days), last_values=4).collect()}
    assert got == {0.5: 499, 0.9: 899, 0.95: 949, 0.99: 989}
    assert sizes == sorted(sizes, reverse=True) and sizes[2] < 500


def test_many_proposals_are_reduced_within_a_partition(spark, monkeypatch):
    monkeypatch.setattr(p, "PROPOSALS_AT_ONCE", 3)
    rows = rows_of(3)
    days = p.day_partials(spark.createDataFrame(rows, SCHEMA), "g", "v", "day")
    got = {(r["grp"], r["percentile"]): r["value"] for r in p.select(p.combine(days), last_values=1).collect()}
    values = brute(rows)
    assert got == {(g, q): x[max(1, math.ceil(q * len(x) - 1e-9)) - 1] for g, x in values.items() for q in p.PERCENTILES}


@pytest.mark.parametrize("error", [0.02, 0.1])
def test_bounded_partials_keep_their_rank_error(spark, error):
    rows = rows_of(21)
    df = spark.createDataFrame(rows, SCHEMA)
    days = p.day_partials(df, "g", "v", "day", error)
    most = days.groupBy("day", "grp").count().agg(F.max("count")).first()[0]
    assert most <= 2 / error + 1
    values = brute(rows)
    parts = [days.where(F.col("day") == d) for d in sorted({r[0] for r in rows if r[0]})]
    again = parts[0]
    for part in parts[1:]:
        again = again.unionByName(part)
    for r in p.select(p.combine(again)).collect():
        x = values[r["grp"]]
        wanted = max(1, math.ceil(r["percentile"] * len(x) - 1e-9))
        low = sum(v < r["value"] for v in x) + 1
        high = sum(v <= r["value"] for v in x)
        off = max(0, low - wanted, wanted - high)
        # each of the seven days may round one rank up
        assert off <= error * len(x) + 7


def test_services_and_their_aliases(spark):
    rows = spark.createDataFrame([(" Svc.A ",), ("SVC_b",), ("other",), ("",), (None,), ("　",)], "name string")
    aliases = spark.createDataFrame([("svc.a", "a-svc"), ("svc_b", "b-svc"), (None, "x"), ("y", None)], "alias string, service string")
    got = [r["service"] for r in p.service_of(rows, aliases, F.col("name")).orderBy("name").collect()]
    assert sorted(x or "" for x in got) == ["", "", "", "a-svc", "b-svc", "other"]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert p.select(p.combine(p.day_partials(none, "g", "v", "day"))).count() == 0
    assert p.day_partials(none, "g", "v", "day", 0.1).count() == 0
