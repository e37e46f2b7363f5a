"""Scoring of answers and runs, and statistics of latencies and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators.ordered import running_sum

#: Weights of tools, citations and conclusions by difficulty (fixed values); unknown difficulties count as easy.
WEIGHTS = {"easy": (0.4, 0.3, 0.3), "medium": (0.2, 0.4, 0.4), "hard": (0.1, 0.4, 0.5)}


def args_match(have: Column, wanted: Column) -> Column:
    """Whether every wanted argument is in the given one's value, without regard to case."""
    return F.forall(
        F.map_entries(F.coalesce(wanted, F.create_map().cast("map<string,string>"))),
        lambda e: F.coalesce(
            F.contains(F.lower(F.coalesce(F.try_element_at(have, e["key"]), F.lit(""))), F.lower(e["value"])), F.lit(False)
        ),
    )


def matched_calls(actual: Column, expected: Column) -> Column:
    """Greedy one-to-one matching: for each expected call the place (from 0) of the first unused actual call that fits, or -1.

    ``actual``: array of struct(tool_name, args); ``expected``: array of struct(tools array, args map).
    """
    places = F.when(F.size(actual) > 0, F.sequence(F.lit(0), F.size(actual) - 1)).otherwise(F.array().cast("array<int>"))

    def step(used: Column, want: Column) -> Column:
        fits = F.filter(
            places,
            lambda i: ~F.array_contains(used, i)
            & F.array_contains(want["tools"], F.get(actual, i)["tool_name"])
            & args_match(F.get(actual, i)["args"], want["args"]),
        )
        return F.concat(used, F.array(F.coalesce(F.get(fits, F.lit(0)), F.lit(-1))))

    return F.aggregate(expected, F.array().cast("array<int>"), step)


def tool_score(actual: Column, expected: Column) -> Column:
    """The share of expected calls that were made; further calls cost nothing."""
    places = F.filter(matched_calls(actual, expected), lambda i: i >= 0)
    return F.when(F.size(expected) == 0, 1.0).when(F.size(actual) == 0, 0.0).otherwise(F.size(places) / F.size(expected))


def citation_score(answer: Column, refs: Column, expected: Column) -> Column:
    """The share of expected citations that are part of a reference or of the answer."""
    hit = F.filter(
        expected,
        lambda e: F.exists(refs, lambda r: F.contains(F.lower(r), F.lower(e))) | F.contains(F.lower(answer), F.lower(e)),
    )
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(hit) / F.size(expected))


def keyword_hits(answer: Column, keywords: Column) -> Column:
    return F.size(F.filter(keywords, lambda k: F.contains(F.lower(answer), F.lower(k))))


def conclusion_score(answer: Column, keywords: Column, at_least: Column) -> Column:
    """Keywords in the answer against the number wanted, one at most."""
    none_wanted = (F.size(keywords) == 0) | (at_least <= 0)
    return (
        F.when(none_wanted, 1.0)
        .when(F.coalesce(answer, F.lit("")) == "", 0.0)
        .otherwise(F.least(keyword_hits(answer, keywords) / at_least, F.lit(1.0)))
    )


def forbidden_penalty(answer: Column, words: Column) -> Column:
    """A tenth for each forbidden word, three tenths at most."""
    return F.least(keyword_hits(F.coalesce(answer, F.lit("")), words) * 0.1, F.lit(0.3))


def total_score(difficulty: Column, tool: Column, cite: Column, conclusion: Column, penalty: Column) -> Column:
    """The weighted sum less the penalty, not below zero, to four places."""
    out = sum(w * c for w, c in zip(WEIGHTS["easy"], (tool, cite, conclusion), strict=True))
    for name, weights in WEIGHTS.items():
        out = F.when(difficulty == name, sum(w * c for w, c in zip(weights, (tool, cite, conclusion), strict=True))).otherwise(out)
    return F.round(F.greatest(out - penalty, F.lit(0.0)), 4)


# --- reports -----------------------------------------------------------------


def report_by_group(runs: DataFrame, group: str, score: str, case: str, passed: float = 0.7) -> DataFrame:
    """Cases, mean score, pass rate and the worst case of each group; of equal scores the smallest case is the worst."""
    return runs.where(F.col(score).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"),
        F.round(F.avg(score), 6).alias("mean_score"),
        F.round(F.avg((F.col(score) >= passed).cast("int")), 6).alias("pass_rate"),
        F.min_by(case, F.struct(score, case)).alias("worst_case"),
    )


def forbidden_rate(runs: DataFrame, group: str, score: str, penalty: str) -> DataFrame:
    """The share of each group's scored runs with a penalty above 0."""
    return runs.where(F.col(score).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col(penalty) > 0).cast("int")), 6).alias("forbidden_rate")
    )


def _placed(rows: DataFrame, group: str, value: str, width: float) -> DataFrame:
    """``group, value, _n, _upto, n``: distinct values with their counts, the values up to them, and all of their group.

    Values are sorted within ranges of ``width`` only, so no group is ever put in order in one task. Rows without a value are left out.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    totals = counted.groupBy(group).agg(F.sum("_n").alias("n"))
    return running_sum(counted, [group], value, F.col("_n"), width, "_upto").join(totals, group)


def _at(place: Column, value: str) -> Column:
    """The value at a place, counted from 0, as an aggregate over ``_placed``."""
    return F.max(F.when((F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place), F.col(value)))


def medians(rows: DataFrame, group: str, value: str, width: float) -> DataFrame:
    """The median of each group's values: the mean of the two in the middle."""
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    placed = _placed(rows, group, value, width)
    return placed.groupBy(group).agg(F.round((_at(low, value) + _at(high, value)) / 2, 6).alias("median"))


def volatility(runs: DataFrame, case: str, score: str) -> DataFrame:
    """Runs, median and range of each case's scores, and the class its range falls into."""
    spread = F.col("range")
    stats = runs.groupBy(case).agg(
        F.count("*").alias("n_runs"), F.count(score).alias("n_scored"), F.round(F.max(score) - F.min(score), 6).alias("range")
    )
    return (
        stats.join(medians(runs, case, score, 0.05), case, "left")
        .select(case, "n_runs", "n_scored", "median", "range")
        .withColumn(
            "class",
            F.when(F.col("n_scored") == 0, "all errors")
            .when(spread == 0, "stable")
            .when(spread <= 0.2, "small")
            .when(spread <= 0.3, "medium")
            .otherwise("large"),
        )
    )


def class_shares(cases: DataFrame, of: str) -> DataFrame:
    """Cases of each class and their share in percent; the classes are few."""
    counted = cases.groupBy(of).agg(F.count("*").alias("n"))
    total = F.broadcast(counted.agg(F.sum("n").alias("_all")))
    return counted.crossJoin(total).select(of, "n", F.round(100.0 * F.col("n") / F.col("_all"), 4).alias("share"))


def retryable(error: Column, names: tuple[str, ...]) -> Column:
    """Whether an error is of a kind that another try may get over: by its name, or a timeout in any spelling."""
    return error.rlike("|".join(names)) | F.contains(F.lower(error), F.lit("timeout"))


def latency_stats(rows: DataFrame, group: str, value: str, width: float = 1000) -> DataFrame:
    """Count, mean, median, deviation and range of a group's values."""
    measured = rows.where(F.col(value) >= 0)
    stats = measured.groupBy(group).agg(
        F.count("*").alias("n"),
        F.round(F.avg(value), 6).alias("mean"),
        F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 4).alias("deviation"),
        (F.max(value) - F.min(value)).alias("range"),
    )
    return stats.join(medians(measured, group, value, width), group).select(group, "n", "mean", "median", "deviation", "range")


def nearest_rank(rows: DataFrame, group: str, value: str, shares: tuple[float, ...], width: float = 1000) -> DataFrame:
    """The value at place min(floor(n * share), n - 1), counted from 0, of each group."""
    placed = _placed(rows.where(F.col(value) >= 0), group, value, width)
    place = lambda share: F.least(F.floor(F.col("n") * share), F.col("n") - 1)
    return placed.groupBy(group).agg(F.max("n").alias("n"), *[_at(place(x), value).alias(f"p{round(x * 100)}") for x in shares])


def score_matrix(runs: DataFrame, case: str, run: str, score: str, names: list[str]) -> DataFrame:
    """The mean score of each case in each of the named runs, as columns; null where a run has none."""
    return runs.groupBy(case).pivot(run, names).agg(F.round(F.avg(score), 6))


def histogram(rows: DataFrame, group: str, value: str, edges: list[float], stuck_from: int, most: float) -> DataFrame:
    """Values of each group by ranges between edges, those over ``most`` left out, and the share in the last ranges in percent."""
    kept = rows.where((F.col(value) >= 0) & (F.col(value) <= most))
    bounds = list(zip([0.0, *edges], [*edges, float("inf")], strict=True))
    names = [f"b{i}" for i in range(len(bounds))]
    counts = [F.count_if((F.col(value) >= a) & (F.col(value) < b)).alias(n) for n, (a, b) in zip(names, bounds, strict=True)]
    stuck = sum(F.col(n) for n in names[stuck_from:])
    return kept.groupBy(group).agg(F.count("*").alias("n"), *counts).withColumn("stuck_share", F.round(100.0 * stuck / F.col("n"), 6))


def with_runs(spans: DataFrame, runs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Spans with the run they belong to, and those that no run claims."""
    return spans.join(runs, key), spans.join(runs, key, "left_anti")


def failure_reasons(score: Column, parts: dict[str, Column]) -> Column:
    """Why a run failed: the names of its parts that are below a half, joined; null if it passed."""
    reasons = F.array_compact(F.array(*[F.when(c < 0.5, F.lit(n)) for n, c in parts.items()]))
    return F.when(score < 0.7, F.array_join(reasons, ", "))


# --- fan-out and gather ------------------------------------------------------


def fanned_out(hypotheses: DataFrame, most: int = 3) -> DataFrame:
    """One row for each of the first ``most`` hypotheses of a run; a run without any gets a default one."""
    listed = F.slice("hypotheses", 1, most)
    default = F.array(F.lit("default"))
    chosen = F.when(F.size(F.coalesce("hypotheses", F.array().cast("array<string>"))) > 0, listed).otherwise(default)
    return hypotheses.select("run_id", F.posexplode(chosen).alias("ord", "hypothesis"))


def gathered(results: DataFrame) -> DataFrame:
    """The results of each run in one row, surest first; a run has at most as many as it was fanned out into."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "ord", "summary")))
    return results.groupBy("run_id").agg(
        F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x["summary"]), " | ").alias("summary")
    )
