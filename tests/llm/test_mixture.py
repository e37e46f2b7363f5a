import math
import random

import pytest
from pyspark.sql import functions as F

from fathomline.llm import mixture as m

SIZES = "doc_id long, copy long, source string, n_tokens long"
WEIGHTS = "source string, target_share double, max_repeat int"


def made(spark, seed=1, big=3000):
    rng = random.Random(seed)
    counts = {"big": big, "mid": 300, "small": 12, "tiny": 3}
    rows, i = [], 0
    for source, n in counts.items():
        for _ in range(n):
            i += 1
            rows.append((i, 0, source, rng.randrange(20, 900)))
    wanted = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 4), ("tiny", 0.05, 5), ("absent", 0.05, 2)]
    return spark.createDataFrame(rows, SIZES), spark.createDataFrame(wanted, WEIGHTS)


def test_shares_caps_and_uniqueness(spark):
    sizes, wanted = made(spark)
    planned = m.plan(sizes, m.weights(wanted)).cache()
    taken = m.mixture(sizes, planned).cache()
    assert taken.count() == taken.select("doc_id").distinct().count()
    caps = {"big": 1, "mid": 2, "small": 4, "tiny": 5}
    for r in m.report(taken, planned).collect():
        if r["source"] == "absent":
            assert r["actual_share"] == 0.0
            continue
        assert r["most_copies"] <= caps[r["source"]]
        assert r["actual_share"] == pytest.approx(r["target_share"] / 0.95, abs=0.004)
    expected = {r["doc_id"]: r["expected"] for r in m._ranked(sizes, planned).collect()}
    for r in taken.collect():
        assert math.floor(expected[r["doc_id"]]) <= r["copies"] <= math.floor(expected[r["doc_id"]]) + 1


def test_bins_equal_one_sort(spark, monkeypatch):
    sizes, wanted = made(spark, 2)
    planned = m.plan(sizes, m.weights(wanted)).cache()
    binned = {tuple(r) for r in m.mixture(sizes, planned).collect()}
    monkeypatch.setattr(m, "BINS", 1)
    assert {tuple(r) for r in m.mixture(sizes, planned).collect()} == binned


def test_repeatable_and_spread(spark):
    sizes, wanted = made(spark, 3)
    planned = m.plan(sizes, m.weights(wanted)).cache()
    one = {tuple(r) for r in m.mixture(sizes, planned).collect()}
    assert one == {tuple(r) for r in m.mixture(sizes.repartition(7), planned).collect()}
    first = m.mixture(sizes, planned).where("source = 'big'").agg(F.avg("doc_id")).first()[0]
    assert 1300 < first < 1700


def test_odds_differ_with_length(spark):
    """Long documents are drawn more often, as their probabilities say; fails if documents are put in order by the uniform number alone."""
    rows = [(i, 0, "a", 64 if i % 2 else 1024) for i in range(4000)]
    sizes = spark.createDataFrame(rows, SIZES)
    planned = m.plan(sizes, m.weights(spark.createDataFrame([("a", 1.0, 1)], WEIGHTS)), total=500_000.0).cache()
    taken = m.mixture(sizes, planned)
    got = {r["n_tokens"]: r["n"] for r in taken.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    part = {r["n_tokens"]: r["part"] for r in m._ranked(sizes, planned).select("n_tokens", "part").distinct().collect()}
    assert part[1024] == pytest.approx(4 * part[64])
    for n in (64, 1024):
        assert got[n] / 2000 == pytest.approx(part[n], abs=0.035)
    assert taken.agg(F.sum("n_tokens")).first()[0] == pytest.approx(500_000, abs=512)


def test_the_total_may_be_given(spark):
    sizes, wanted = made(spark, 5)
    for total in (20_000.0, 100_000.0):
        planned = m.plan(sizes, m.weights(wanted), total=total)
        assert m.mixture(sizes, planned).agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] == pytest.approx(total, rel=0.02)


def test_factor_meets_the_budget_and_the_cap():
    classes = [(20, 1000), (30, 5000), (40, 200)]
    x = m.factor(3000.0, 1, classes, 0.5)
    assert sum(min(x * 2 ** (c / 8), 1) * t for c, t in classes) == pytest.approx(3000)
    x = m.factor(12_400.0, 2, classes, 0.5)
    assert all(x * 2 ** (c / 8) >= 2 - 1e-9 for c, _ in classes)
    assert m.factor(0.0, 3, [], 0.5) == 0.0


def test_sizes_follow_the_scarce_source():
    assert m.best_size([(0.5, 1, 1000, 100), (0.5, 2, 100, 100)]) == pytest.approx(400)
    assert m.best_size([(0.5, 1, 0, 0)]) == 0.0
    # a source of one token doesn't shrink the mixture to nothing
    assert m.best_size([(0.98, 1, 100_000, 100), (0.02, 1, 1, 1)]) > 10_000


def test_dirty_weights_and_empty_tables(spark):
    wanted = spark.createDataFrame([("a", 0.5, None), ("a", 0.2, 3), (None, 0.3, 1), ("b", 0.0, 1), ("c", None, 1)], WEIGHTS)
    assert [tuple(r) for r in m.weights(wanted).collect()] == [("a", 0.5, 3)]
    docs = spark.createDataFrame(
        [(1, "some text", "a", 9), (2, None, "a", 9), (3, "", "a", 9), (4, "x", None, 9), (5, "x", "zz", 9)],
        "doc_id long, text string, source string, copy int",
    )
    sizes = m.sized(docs, m.weights(wanted))
    assert [r["doc_id"] for r in sizes.collect()] == [1]
    planned = m.plan(sizes, m.weights(wanted))
    assert [(r["doc_id"], r["copies"]) for r in m.mixture(sizes, planned).collect()] == [(1, 3)]
    none = sizes.limit(0)
    empty = m.plan(none, m.weights(wanted))
    assert m.mixture(none, empty).count() == 0 and m.report(m.mixture(none, empty), empty).first()["actual_share"] == 0.0
