"""Conversation memory: stored turns, recent context, compaction and versioned profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["session_id", "turn", "role"]

#: What a tool call of a message holds.
TOOL_CALLS = "array<struct<tool_name: string, args: map<string, string>, success: boolean, latency_ms: bigint>>"


def upserted(turns: DataFrame) -> DataFrame:
    """One row per session, turn and role: the last one written, by id. Rows without a full key are no turns."""
    keyed = turns.where(F.col("session_id").isNotNull() & F.col("turn").isNotNull() & F.col("role").isNotNull())
    rest = [c for c in keyed.columns if c not in KEY]
    return keyed.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "id").alias("_m")).select(*KEY, *[F.col(f"_m.{c}").alias(c) for c in rest])


def merged(base: DataFrame, delta: DataFrame) -> DataFrame:
    """A stored table with new rows written over those of the same key, by id."""
    return upserted(base.unionByName(delta))


def role_order(role: Column) -> Column:
    """Question before answer."""
    return F.when(role == "user", 0).otherwise(1)


def recent(turns: DataFrame, n: int = 3) -> DataFrame:
    """The turns of each session whose number is among the last n; numbers count, not rows.

    The largest number per session is aggregated and joined, so no session is sorted.
    """
    last = turns.groupBy("session_id").agg(F.max("turn").alias("_last"))
    return turns.join(last, "session_id").where(F.col("turn") > F.col("_last") - n).drop("_last")


def session_counts(turns: DataFrame) -> DataFrame:
    """Turns, largest turn number and next free number of each session."""
    return turns.groupBy("session_id").agg(
        F.count_distinct("turn").alias("n_turns"),
        F.coalesce(F.max("turn"), F.lit(0)).alias("last_turn"),
        (F.coalesce(F.max("turn"), F.lit(0)) + 1).alias("next_turn"),
    )


def estimated_tokens(turns: DataFrame) -> DataFrame:
    """Half the characters of each session's messages."""
    return turns.groupBy("session_id").agg(
        F.floor(F.coalesce(F.sum(F.length("content")), F.lit(0)) / 2).alias("tokens")
    )


def compaction(turns: DataFrame, keep: int = 3, rounds: int = 8, most_tokens: int = 4000, share: float = 0.7) -> DataFrame:
    """Whether each session is to be compacted, why, and the range of turns a summary would cover."""
    sized = session_counts(turns).join(estimated_tokens(turns), "session_id")
    reason = (
        F.when(F.col("n_turns") >= rounds, "rounds")
        .when(F.col("tokens") >= int(most_tokens * share), "tokens")
        .otherwise("none")
    )
    end = F.col("last_turn") - keep
    return sized.select(
        "session_id", "n_turns", "tokens", reason.alias("reason"),
        F.when((reason != "none") & (end >= 1), F.lit(1)).alias("covers_start"),
        F.when((reason != "none") & (end >= 1), end).alias("covers_end"),
    )


def summaries(turns: DataFrame, span: int = 4, keep: int = 3, tail: bool = False) -> DataFrame:
    """First-level summaries: one per ``span`` turns of a session before its last ``keep``; the spans don't overlap.

    ``session_id, level, covers_start, covers_end, n_rows, n_chars, digest``.
    Without ``tail`` only whole spans are summed up, and the up to ``span`` - 1
    turns between the last one and the kept turns are in none. With it the last
    span ends at the last turn before the kept ones, so every turn from number 1
    on is either in a summary or kept.
    """
    last = turns.groupBy("session_id").agg((F.max("turn") - keep).alias("_end"))
    part = F.floor((F.col("turn") - 1) / span)
    whole = (part + 1) * span
    return (
        turns.where(F.col("turn") >= 1)
        .join(last, "session_id")
        .where((F.col("turn") if tail else whole) <= F.col("_end"))
        .groupBy("session_id", part.alias("part"), F.least(whole, "_end").alias("_to"))
        .agg(
            F.count("*").alias("n_rows"),
            F.sum(F.length(F.coalesce("content", F.lit("")))).alias("n_chars"),
            F.md5(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(":", "turn", "role", "content"))))).alias("digest"),
        )
        .select(
            "session_id", F.lit(1).alias("level"), (F.col("part") * span + 1).cast("int").alias("covers_start"),
            F.col("_to").cast("int").alias("covers_end"), "n_rows", "n_chars", "digest",
        )
    )


def superseded(level1: DataFrame, at_least: int = 4) -> DataFrame:
    """First-level summaries and the second-level ones that replace them in sessions with enough of them."""
    per = level1.groupBy("session_id").agg(
        F.count("*").alias("_n"),
        F.min("covers_start").alias("_start"),
        F.max("covers_end").alias("_end"),
        F.sum("n_rows").alias("_rows"),
    )
    kept = level1.join(per, "session_id").select(
        "session_id", "level", "covers_start", "covers_end", "n_rows", (F.col("_n") >= at_least).alias("superseded")
    )
    second = per.where(F.col("_n") >= at_least).select(
        "session_id", F.lit(2).alias("level"), F.col("_start").alias("covers_start"), F.col("_end").alias("covers_end"),
        F.col("_rows").alias("n_rows"), F.lit(False).alias("superseded"),
    )
    return kept.unionByName(second)


def marked_superseded(summaries: DataFrame, ids: DataFrame) -> DataFrame:
    """Summaries with those of a set of ids marked; no change for an empty set."""
    hit = ids.select(F.col("id").alias("_hit")).distinct()
    return (
        summaries.join(hit, F.col("id") == F.col("_hit"), "left")
        .withColumn("superseded", F.col("superseded") | F.col("_hit").isNotNull())
        .drop("_hit")
    )


def context(turns: DataFrame, span: int = 4, keep: int = 3, tail: bool = False) -> DataFrame:
    """What a session is continued with: active summaries first, then the recent turns word for word.

    With ``tail`` the two together hold every turn, see ``summaries``.
    """
    active = superseded(summaries(turns, span, keep, tail)).where(~F.col("superseded"))
    first = active.select(
        "session_id", F.lit(0).alias("block"), F.col("covers_start").alias("place"), F.col("level").cast("int").alias("rank"),
        F.concat(F.lit("["), "covers_start", F.lit("-"), "covers_end", F.lit("]")).alias("line"),
    )
    then = recent(turns, keep).select(
        "session_id", F.lit(1).alias("block"), F.col("turn").alias("place"), role_order(F.col("role")).alias("rank"),
        F.concat_ws(": ", "role", F.coalesce("content", F.lit(""))).alias("line"),
    )
    return first.unionByName(then)


def rendered(lines: DataFrame) -> DataFrame:
    """The lines of each session as one text; a session's context has a bounded number of them."""
    ordered = F.array_sort(F.collect_list(F.struct("block", "place", "rank", "line")))
    return lines.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def tool_calls(turns: DataFrame) -> DataFrame:
    """One row for each tool call of a message; messages with damaged or empty lists have none."""
    return turns.select(
        "id", "session_id", F.posexplode(F.from_json("tool_calls", TOOL_CALLS)).alias("ord", "call")
    ).select(
        "id", "session_id", "ord", F.col("call.tool_name").alias("tool_name"), F.col("call.args").alias("args"),
        F.col("call.success").alias("success"), F.col("call.latency_ms").alias("latency_ms"),
    )


def latest(versions: DataFrame, keys: list[str], at: str = "created_at", order: str = "id") -> DataFrame:
    """The newest version of each key, by time and then id."""
    rest = [c for c in versions.columns if c not in keys]
    return (
        versions.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(at, order)).alias("_m"))
        .select(*keys, *[F.col(f"_m.{c}").alias(c) for c in rest])
    )


def newest(versions: DataFrame, keys: list[str], n: int, at: str = "created_at", order: str = "id") -> DataFrame:
    """The n newest versions of each key, numbered from 1. Spark keeps n of each key in every task before it shuffles them."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col(order).desc()))
    return versions.withColumn("place", place).where(F.col("place") <= n)


def all_versions(versions: DataFrame, keys: list[str], at: str = "created_at", order: str = "id", period_days: int = 30) -> DataFrame:
    """Every version of each key, numbered from 1, the newest.

    Versions are sorted only within a key and period; the counts of a key's
    periods, one row each, are added up. Null is a key like others.
    """
    binned = versions.withColumn("_bin", F.floor(F.unix_seconds(at) / F.lit(period_days * 86_400)))
    newer = Window.partitionBy(*keys).orderBy(F.col("_bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    before = counts.select(
        *[F.col(c).alias(f"_of_{c}") for c in [*keys, "_bin"]], F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy(F.col(at).desc(), F.col(order).desc())
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*keys, "_bin"]]
    numbered = binned.withColumn("_place", F.row_number().over(inside)).join(before, same)
    return numbered.select(*versions.columns, (F.col("_before") + F.col("_place")).alias("place"))
