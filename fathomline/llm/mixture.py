"""A mixture of sources with target shares of the total size, by Pareto order sampling.

The mixture's size is given, or the largest at which the shares deviate least
from the targets; each source's budget of tokens follows from its share. The
copies that are expected of a document grow with its length, as the power
``TILT`` of it, so documents of a source differ in their odds: the factor is
chosen so that the expected copies come to the budget, ``max_repeat`` at
most. Whole copies are certain; the fraction is the probability of one more.

Those are drawn by Pareto order sampling of a fixed size in tokens: documents are
ranked by the odds of a uniform hash divided by the odds of their inclusion,
and the first ones are taken as long as their tokens fit into what certain copies
leave of the budget. What is left then, less than one document, is filled by at most ``FILLS``
further documents of a source, chosen by how well they fit and not by rank.

The order is cut into bins of the rank. Only the sums of bins are added up per
source, and only the bin in which a budget ends is sorted, so no source,
however large, is ever sorted in one task. One row per source, with its tokens by
classes of length, is all that the driver sees.

Defined cases: rows whose source is null or has no (or no positive) weight
stay out; a source without documents has the actual share 0; documents without
tokens are no part of a mixture; a null or smaller ``max_repeat`` than 1 counts as
1; of several weights of a source the largest holds; no document is taken more
than ``max_repeat`` times; repeated rows of one document are documents of their
own; an empty table gives an empty mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.tokens import VOCABULARY, token_counts
from fathomline.session import BROADCAST_ROWS, cut, spread

#: Documents of a source that fill up its budget after the draw.
FILLS = 4
#: Bins of the rank in which tokens are added up.
BINS = 8192
#: Expected copies grow with this power of a document's length; classes of length in an octave.
TILT, CLASSES = 0.5, 4
SEED = 20_240_601


def weights(table: DataFrame) -> DataFrame:
    """``source, target_share, max_repeat``: one row for each source with a positive weight."""
    return (
        table.where(F.col("source").isNotNull() & (F.col("target_share") > 0))
        .groupBy("source")
        .agg(
            F.max("target_share").alias("target_share"),
            F.greatest(F.coalesce(F.max("max_repeat"), F.lit(1)), F.lit(1)).alias("max_repeat"),
        )
    )


def best_size(stats: list[tuple[float, int, int, int]]) -> float:
    """The total at which shares deviate least from the targets, of (target, max_repeat, tokens, documents) by source.

    Beyond a source's capacity its share falls, and below it a share is exact
    up to half a document; the candidates are the sizes at which some source is
    used up. Of equal deviations the largest size is taken.
    """
    have = [(t, r * tokens, tokens / docs / 2) for t, r, tokens, docs in stats if tokens > 0]
    scale = sum(t for t, _, _ in have)

    def deviation(size: float) -> float:
        given = [min(t / scale * size, cap) for t, cap, _ in have]
        total = sum(given)
        off = sum(abs(g / total - t) for g, (t, _, _) in zip(given, have, strict=True))
        grain = sum(half for g, (_, cap, half) in zip(given, have, strict=True) if g < cap) / total
        return round(off + grain, 6)

    sizes = sorted((cap / (t / scale) for t, cap, _ in have), reverse=True)
    return min(sizes, key=deviation) if sizes else 0.0


def _length_class(tokens: Column) -> Column:
    return F.floor(F.log2(tokens) * CLASSES)


def factor(budget: float, most: int, classes: list[tuple[int, int]], tilt: float) -> float:
    """The factor at which expected copies of (class of length, its tokens) come to a budget, ``most`` a document."""

    def given(x: float) -> float:
        return sum(min(x * 2.0 ** (c * tilt / CLASSES), most) * tokens for c, tokens in classes)

    low, high = 0.0, max((most / 2.0 ** (c * tilt / CLASSES) for c, _ in classes), default=0.0)
    if given(high) <= budget:
        return high
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if given(middle) < budget else (low, middle)
    return high


def plan(sizes: DataFrame, wanted: DataFrame, total: float | None = None, tilt: float = TILT) -> DataFrame:
    """``source, target_share, max_repeat, available, budget, factor, tilt`` for each weighted source.

    ``total`` is the size of the mixture in tokens; without it the size with the
    least deviation is taken. A source's budget is never more than all of its
    copies. Only one row per source, with its classes of length, passes through the driver.
    """
    spark = sizes.sparkSession
    by_class = sizes.groupBy("source", _length_class(F.col("n_tokens")).alias("class")).agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")
    )
    have = by_class.groupBy("source").agg(
        F.sum("tokens").alias("available"), F.sum("docs").alias("n_docs"), F.sort_array(F.collect_list(F.struct("class", "tokens"))).alias("classes")
    )
    rows = wanted.join(have, "source", "left").fillna(0, ["available", "n_docs"]).limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} sources have a weight")
    stats = [(r["target_share"], r["max_repeat"], r["available"], r["n_docs"]) for r in rows]
    total = best_size(stats) if total is None else total
    scale = sum(t for t, _, tokens, _ in stats if tokens > 0) or 1.0
    out = []
    for r in sorted(rows, key=lambda r: r["source"]):
        tokens = r["available"]
        budget = min(r["target_share"] / scale * total, float(tokens * r["max_repeat"])) if tokens else 0.0
        of_class = [(c["class"], c["tokens"]) for c in r["classes"] or ()]
        out.append((r["source"], r["target_share"], r["max_repeat"], tokens, budget, factor(budget, r["max_repeat"], of_class, tilt), tilt))
    return spark.createDataFrame(
        out,
        "source string, target_share double, max_repeat int, available long, budget double, factor double, tilt double",
    )


def _ranked(sizes: DataFrame, planned: DataFrame) -> DataFrame:
    """Documents with their certain copies ``whole``, the probability ``part`` of one more, and the Pareto ``rank`` of that, from 0 to 1."""
    uniform = (F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "copy"), F.lit(2**52)) + 0.5) / F.lit(float(2**52))
    expected = F.col("factor") * F.pow(F.lit(2.0), _length_class(F.col("n_tokens")) * F.col("tilt") / CLASSES)
    odds = (F.col("uniform") / (1 - F.col("uniform"))) / (F.col("part") / (1 - F.col("part")))
    return (
        sizes.join(F.broadcast(planned.select("source", "factor", "tilt", "max_repeat", "budget")), "source")
        .withColumn("uniform", uniform)
        .withColumn("expected", F.least(expected, F.col("max_repeat").cast("double")))
        .withColumn("whole", F.floor("expected").cast("int"))
        .withColumn("part", F.col("expected") - F.col("whole"))
        # odds are put into the order of a number below 1, so that bins are ranges of it
        .withColumn("rank", F.when(F.col("part") > 0, odds / (1 + odds)))
        .withColumn("bin", F.coalesce(F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1)), F.lit(-1)).cast("int"))
    )


def mixture(sizes: DataFrame, planned: DataFrame) -> DataFrame:
    """``doc_id, copy, source, n_tokens, copies``: the documents of the mixture and how often each is taken.

    ``sizes`` has ``doc_id, copy, source, n_tokens`` of all documents with tokens.
    """
    ranked = _ranked(sizes, planned)
    earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    drawn = F.when(F.col("part") > 0, F.col("n_tokens")).otherwise(0)
    bins = (
        ranked.groupBy("source", "bin")
        .agg(F.sum(drawn).alias("in_bin"), F.sum(F.col("whole") * F.col("n_tokens")).alias("certain"), F.first("budget").alias("budget"))
        .withColumn("rest", F.col("budget") - F.sum("certain").over(Window.partitionBy("source")))
        .withColumn("before", F.coalesce(F.sum("in_bin").over(earlier), F.lit(0)))
        .where((F.col("before") < F.col("rest")) & (F.col("bin") >= 0))
        .select("source", "bin", "before", "in_bin", "rest")
    )
    placed = ranked.join(bins, ["source", "bin"], "left")
    inside = Window.partitionBy("source", "bin").orderBy("rank", "doc_id", "copy")
    ends_here = F.coalesce(F.col("before") + F.col("in_bin") > F.col("rest"), F.lit(False))
    upto = F.col("before") + F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    sorted_bin = placed.where(ends_here).withColumn("extra", (upto <= F.col("rest")).cast("int"))
    others = placed.where(~ends_here).withColumn("extra", F.col("before").isNotNull().cast("int"))
    columns = ["doc_id", "copy", "source", "n_tokens", "uniform", "whole", "part", "extra"]
    chosen = cut(sorted_bin.unionByName(others).select(*columns))
    filling = _filling(chosen, planned)
    return (
        chosen.join(filling, ["source", "doc_id", "copy"], "left")
        .withColumn("copies", F.col("whole") + F.greatest(F.col("extra"), F.coalesce("fills", F.lit(0))))
        .where(F.col("copies") > 0)
        .select("doc_id", "copy", "source", "n_tokens", "copies")
    )


def _filling(chosen: DataFrame, planned: DataFrame) -> DataFrame:
    """``source, doc_id, copy, fills``: up to FILLS documents of each source that bring it nearer to its budget, the best one first.

    One row per source and step passes through the driver.
    """
    spark = chosen.sparkSession
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * (F.col("whole") + F.col("extra"))).alias("used"))
    gaps = {r["source"]: r["gap"] for r in planned.join(used, "source").select("source", (F.col("budget") - F.col("used")).alias("gap")).collect()}
    left_out = chosen.where((F.col("part") > 0) & (F.col("extra") == 0)).select("source", "doc_id", "copy", "n_tokens", "uniform")
    taken: list[tuple] = []
    schema = "source string, doc_id {0}, copy long, fills int".format(chosen.schema["doc_id"].dataType.simpleString())
    off = F.abs(F.col("gap") - F.col("n_tokens"))
    best = F.min_by(F.struct("doc_id", "copy", "n_tokens"), F.struct(off.alias("off"), F.col("uniform"), F.col("doc_id"), F.col("copy")))
    for step in range(FILLS):
        open_gaps = [(source, float(gap)) for source, gap in gaps.items() if gap > 0]
        if not open_gaps:
            break
        rows = left_out.join(F.broadcast(spark.createDataFrame(open_gaps, "source string, gap double")), "source")
        # only the last one may go over the budget, if it comes nearer so
        rows = rows.where(off < F.col("gap") if step == FILLS - 1 else F.col("n_tokens") <= F.col("gap"))
        if taken:
            rows = rows.join(F.broadcast(spark.createDataFrame(taken, schema)), ["source", "doc_id", "copy"], "left_anti")
        found = rows.groupBy("source").agg(best.alias("b")).collect()
        gaps |= {r["source"]: gaps[r["source"]] - r["b"]["n_tokens"] for r in found}
        taken += [(r["source"], r["b"]["doc_id"], r["b"]["copy"], 1) for r in found]
    return F.broadcast(spark.createDataFrame(taken, schema))


def sized(docs: DataFrame, wanted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, copy, source, n_tokens`` of all documents of weighted sources that have tokens; written once.

    ``copy`` tells rows with the same doc_id apart by a hash of their text.
    """
    rows = spread(docs.select("doc_id", F.xxhash64("text").alias("copy"), "source", "text")).join(
        wanted.select("source"), "source", "left_semi"
    )
    return cut(token_counts(rows, ["doc_id", "copy", "source"], "text", vocabulary).where(F.col("n_tokens") > 0))


def report(taken: DataFrame, planned: DataFrame) -> DataFrame:
    """Target and actual share of each weighted source, with its documents, tokens and most copies of one document."""
    got = taken.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"),
        F.count("*").alias("n_docs"),
        F.sum("copies").alias("n_copies"),
        F.max("copies").alias("most_copies"),
    )
    total = F.sum("tokens").over(Window.partitionBy())
    return (
        planned.select("source", "target_share", "max_repeat", "available")
        .join(got, "source", "left")
        .fillna(0, ["tokens", "n_docs", "n_copies", "most_copies"])
        .withColumn("actual_share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)))
    )
