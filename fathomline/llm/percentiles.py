"""Percentiles per group by distributed selection, from partial results of single days.

**Partial results**: one row for each day, group and distinct value, with its
count (``day_partials``). Partials of any days are put together by adding counts,
so days can be computed, stored and combined in any order. With a rank error
``e`` > 0 a day keeps for each group at most 2/e + 1 values: the one at the end
of each stretch of e * n ranks, weighted with the stretch, so that any rank
read from combined partials is off by at most e * n.

**Selection** (``select``): a search holds the candidates of one range of one
group and all ranks wanted in it, so at first there is one search per group. In
each round every partition proposes the weighted median of its candidates, the
weighted median of the proposals becomes the search's pivot, and its candidates are
counted below, at and above it. A rank that falls on the pivot is found; the
others go on in the search of their side, and a side without any is discarded.
So the candidates of a group are never held more than once, and fall by about
half in a round until its ranks lie in different ranges. A search that is left with
at most ``LAST_VALUES`` candidates is closed by putting those in order: a last
step of bounded size, so every group of more distinct values goes through rounds.

The state is one row per search; it is broadcast only if the searches there can
ever be fit ``BROADCAST_ROWS``, else joined under salts. What a round leaves is
written, so rounds survive lost executors and don't repeat each other.

Defined cases: rows with a null group, day or value, or a negative value (not
measured), are left out of the partials; ties and repeated rows count each; a
group of one value has it as all its percentiles; an empty table has no group.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fathomline.functions.text import fold_key
from fathomline.operators.ordered import running_sum
from fathomline.session import BROADCAST_ROWS, cut, shared_dir

PERCENTILES = (0.5, 0.9, 0.95, 0.99)
#: Candidates up to which a search is closed by putting them in order.
LAST_VALUES = 128
#: Proposals that a partition gathers before it reduces them to one per search.
PROPOSALS_AT_ONCE = 1_000_000
#: Width of the ranges in which the values of a day are sorted.
RANGE = 1024
#: Salts that spread the rows of one group where the state can't be broadcast.
SALTS = 32


def service_of(rows: DataFrame, aliases: DataFrame, name: Column) -> DataFrame:
    """Adds ``service``: the name without outer white space and letter case, replaced by what it is an alias of."""
    known = (
        aliases.where(F.col("alias").isNotNull() & F.col("service").isNotNull())
        .groupBy(fold_key(F.col("alias")).alias("_name"))
        .agg(F.min(fold_key(F.col("service"))).alias("_service"))
    )
    return (
        rows.withColumn("_name", fold_key(name))
        .join(known, "_name", "left")
        .withColumn("service", F.nullif(F.coalesce("_service", "_name"), F.lit("")))
        .drop("_name", "_service")
    )


def day_partials(rows: DataFrame, group: str, value: str, day: str, rank_error: float = 0.0) -> DataFrame:
    """``day, grp, value, n``: the partial result of each single day."""
    counted = (
        rows.where(F.col(group).isNotNull() & F.col(day).isNotNull() & (F.col(value) >= 0))
        .groupBy(F.col(day).alias("day"), F.col(group).alias("grp"), F.col(value).alias("value"))
        .agg(F.count("*").alias("n"))
    )
    if rank_error <= 0:
        return counted
    totals = counted.groupBy("day", "grp").agg(F.sum("n").alias("total"))
    width = F.greatest(F.floor(F.col("total") * F.lit(rank_error)), F.lit(1))
    return (
        # values are sorted within ranges of RANGE only, however many a group has on a day
        running_sum(counted, ["day", "grp"], "value", F.col("n"), RANGE, "upto")
        .join(totals, ["day", "grp"])
        .withColumn("stretch", F.floor((F.col("upto") - 1) / width))
        .groupBy("day", "grp", "stretch")
        .agg(F.max("value").alias("value"), F.sum("n").alias("n"))
        .select("day", "grp", "value", "n")
    )


def combine(partials: DataFrame, *keys: str) -> DataFrame:
    """``grp, value, n``, and further keys: partial results of any days put together."""
    return partials.groupBy(*keys, "grp", "value").agg(F.sum("n").alias("n"))


def _weighted_medians(search: np.ndarray, value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each search its weighted median and its weight."""
    order = np.lexsort((value, search))
    search, value, n = search[order], value[order], n[order]
    first = np.flatnonzero(np.append(True, search[1:] != search[:-1])[: len(search)])
    upto = np.cumsum(n)
    ends = np.append(first[1:], len(search)) - 1
    before = np.append(0, upto)[first]
    total = upto[ends] - before
    return search[first], value[np.searchsorted(upto, before + (total + 1) // 2)], total


def _proposals(candidates: DataFrame) -> DataFrame:
    """``search, median, weight``: what each partition proposes for each of its searches."""
    names = ["search", "median", "weight"]

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if batch.num_rows:
                parts.append(_weighted_medians(*(c.to_numpy() for c in batch.columns)))
            if sum(len(x[0]) for x in parts) > PROPOSALS_AT_ONCE:
                parts = [_weighted_medians(*map(np.concatenate, zip(*parts, strict=True)))]
                if len(parts[0][0]) > PROPOSALS_AT_ONCE // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts.pop()], names=names)
        if parts:
            made = _weighted_medians(*map(np.concatenate, zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=names)

    kind = candidates.schema["value"].dataType.simpleString()
    return candidates.select("search", "value", "n").mapInArrow(propose, f"search long, median {kind}, weight long")


def _pivots(candidates: DataFrame) -> DataFrame:
    """``search, pivot``: the weighted median of each search's proposals, of which each partition makes one."""
    per_search = Window.partitionBy("search")
    so_far = F.sum("weight").over(per_search.orderBy("median", "weight").rowsBetween(Window.unboundedPreceding, 0))
    return (
        _proposals(candidates)
        .withColumn("so_far", so_far)
        .withColumn("all", F.sum("weight").over(per_search))
        .where(F.col("so_far") * 2 >= F.col("all"))
        .groupBy("search")
        .agg(F.min("median").alias("pivot"))
    )


def _with_state(candidates: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """Candidates joined with one row per search; broadcast if the state is small, else under salts."""
    if small:
        return candidates.join(F.broadcast(state), "search")
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)))
    every = state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(every, ["search", "salt"]).drop("salt")


def _round(candidates: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """One round for all searches: ``search, pivot, root``, the percentiles ``hit`` by it, and what goes on ``below`` and ``above``.

    ``below`` and ``above`` hold the number of the new search, its candidates and its ranks, or are null.
    """
    under, at = F.col("value") < F.col("pivot"), F.col("value") == F.col("pivot")
    none = F.lit(0)
    counts = (
        _with_state(candidates, _pivots(candidates), small)
        .groupBy("search")
        .agg(
            F.first("pivot").alias("pivot"),
            F.coalesce(F.sum(F.when(under, F.col("n"))), none).alias("n_below"),
            F.coalesce(F.sum(F.when(at, F.col("n"))), none).alias("n_at"),
            F.count_if(under).alias("values_below"),
            F.count_if(~under & ~at).alias("values_above"),
        )
    )
    upto = F.col("n_below") + F.col("n_at")
    low = F.filter("ranks", lambda r: r["rank"] <= F.col("n_below"))
    high = F.transform(
        F.filter("ranks", lambda r: r["rank"] > upto),
        lambda r: F.struct(r["percentile"].alias("percentile"), (r["rank"] - upto).alias("rank")),
    )
    hit = F.filter("ranks", lambda r: (r["rank"] > F.col("n_below")) & (r["rank"] <= upto))

    def side(ranks: Column, number: int, values: str) -> Column:
        search = F.xxhash64("search", F.lit(number)).alias("search")
        return F.when(F.size(ranks) > 0, F.struct(search, F.col(values).alias("left"), ranks.alias("ranks")))

    return counts.join(state, "search").select(
        "search",
        "pivot",
        "root",
        F.transform(hit, lambda r: r["percentile"]).alias("hit"),
        side(low, 0, "values_below").alias("below"),
        side(high, 1, "values_above").alias("above"),
    )


def _moved(candidates: DataFrame, outcome: DataFrame, small: bool) -> DataFrame:
    """The candidates that go on, in their new searches: ``search, value, n, left``."""
    paths = [F.col(f"{side}.{name}").alias(f"{side}_{name}") for side in ("below", "above") for name in ("search", "left")]
    on = _with_state(candidates.select("search", "value", "n"), outcome.select("search", "pivot", *paths), small)
    under, over = F.col("value") < F.col("pivot"), F.col("value") > F.col("pivot")
    pick = lambda name: F.when(under, F.col(f"below_{name}")).when(over, F.col(f"above_{name}"))
    moved = on.select(pick("search").alias("search"), "value", "n", pick("left").alias("left"))
    return moved.where(F.col("search").isNotNull())


def _sides(outcome: DataFrame) -> DataFrame:
    """The searches that go on."""
    sides = F.explode(F.array_compact(F.array("below", "above"))).alias("s")
    return outcome.select("root", sides).select("s.search", "root", "s.left", "s.ranks")


class _Rounds:
    """The tables of all rounds below one place in the shared folder, so that all rounds' rows can be read at once."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.place = f"{shared_dir(spark).rstrip('/')}/rounds-{uuid.uuid4().hex}"
        self.schemas: dict[str, StructType] = {}
        self.number = 0

    def written(self, rows: DataFrame, name: str) -> DataFrame:
        self.schemas[name] = rows.schema
        self.number += 1
        path = f"{self.place}/{name}/part={self.number}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def all(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.place}/{name}").select(*self.schemas[name].names)


def _closed(candidates: DataFrame, state: DataFrame) -> DataFrame:
    """``root, percentile, value`` of the searches whose few candidates are put in order."""
    upto = F.sum("n").over(Window.partitionBy("search").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = candidates.select("search", "value", "n").withColumn("upto", upto)
    ranks = state.select("search", "root", F.explode("ranks").alias("r"))
    return (
        placed.join(ranks, "search")
        .where((F.col("upto") >= F.col("r.rank")) & (F.col("upto") - F.col("n") < F.col("r.rank")))
        .select("root", "r.percentile", "value")
    )


def select(
    counted: DataFrame,
    keys: tuple[str, ...] = ("grp",),
    percentiles: tuple[float, ...] = PERCENTILES,
    last_values: int = LAST_VALUES,
) -> DataFrame:
    """Keys and ``percentile, value, n_values``: of each group the value at rank ceil(percentile * n), from keys and ``value, n``.

    The keys of a group have to be null in no row; each value of a group comes in one row.
    """
    base = cut(counted.withColumn("search", F.xxhash64(*keys)))
    # 1e-9 keeps products such as 0.95 * 20 from being lifted over a whole number
    rank = lambda q: F.greatest(F.ceil(F.lit(q) * F.col("total") - 1e-9), F.lit(1))
    wanted = F.array(*[F.struct(F.lit(q).alias("percentile"), rank(q).alias("rank")) for q in percentiles])
    groups = cut(
        base.groupBy("search", *keys)
        .agg(F.sum("n").alias("total"), F.count("*").alias("left"))
        .select("search", *keys, "total", "left", wanted.alias("ranks"))
    )
    # a group's ranks lie in at most as many searches as there are percentiles
    small = groups.count() * len(percentiles) <= BROADCAST_ROWS
    first = _with_state(base.select("search", "value", "n"), groups.select("search", "left"), small)
    start = groups.select("search", F.col("search").alias("root"), "left", "ranks")
    rounds = _Rounds(base.sparkSession)
    few = F.col("left") <= last_values
    candidates, state = first, start
    while not state.where(~few).isEmpty():
        outcome = rounds.written(_round(candidates.where(~few), state.where(~few), small), "outcomes")
        candidates = rounds.written(_moved(candidates.where(~few), outcome, small), "candidates")
        state = _sides(outcome)
    if rounds.schemas:
        outcomes = rounds.all("outcomes")
        rest, states = first.unionByName(rounds.all("candidates")), start.unionByName(_sides(outcomes))
        hits = outcomes.select("root", F.explode("hit").alias("percentile"), F.col("pivot").alias("value"))
        values = _closed(rest.where(few), states.where(few)).unionByName(hits)
    else:
        values = _closed(first, start)
    named = groups.select(F.col("search").alias("root"), *keys, F.col("total").alias("n_values"))
    return named.join(values, "root").select(*keys, "percentile", "value", "n_values")
