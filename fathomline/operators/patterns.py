"""Recurring message patterns and how they differ between environments and days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import fingerprint
from fathomline.session import cut


def _counted(logs: DataFrame, *keys: str) -> DataFrame:
    """``pattern, n`` and keys: equal messages are counted before their pattern is made, once for each of them."""
    messages = logs.groupBy(*keys, "msg").agg(F.count("*").alias("n"))
    return messages.withColumn("pattern", fingerprint(F.col("msg"))).groupBy(*keys, "pattern").agg(F.sum("n").alias("n"))


def pattern_counts(logs: DataFrame) -> DataFrame:
    """``pattern, n, share``: share of all lines in percent, of those with a pattern."""
    counted = _counted(logs)
    total = F.broadcast(counted.agg(F.sum("n").alias("_all")))
    shares = counted.where(F.col("pattern") != "").crossJoin(total)
    return shares.select("pattern", "n", (100.0 * F.col("n") / F.col("_all")).alias("share"))


def top_patterns(logs: DataFrame, limit: int = 20) -> DataFrame:
    return pattern_counts(logs).orderBy(F.col("n").desc(), "pattern").limit(limit)


def by_environment(logs: DataFrame, environments: list[str]) -> DataFrame:
    """Lines of each pattern in each environment and in all of them; zero where it has none."""
    rows = _counted(logs.where(F.col("env").isin(*environments)), "env").where(F.col("pattern") != "")
    of = lambda e: F.sum(F.when(F.col("env") == e, F.col("n")).otherwise(0)).alias(f"n_{e}")
    return rows.groupBy("pattern").agg(*[of(e) for e in environments], F.sum("n").alias("n"))


def before_after(logs: DataFrame, split_day: str) -> DataFrame:
    """Lines of each pattern before a day and from it on, and the difference."""
    early = F.to_date("ingested_at") < F.lit(split_day).cast("date")
    rows = _counted(logs.where(F.col("ingested_at").isNotNull()).withColumn("_early", early), "_early").where(F.col("pattern") != "")
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return (
        rows.groupBy("pattern")
        .agg(of(F.col("_early")).alias("before"), of(~F.col("_early")).alias("after"))
        .withColumn("delta", F.col("after") - F.col("before"))
    )


def movers(logs: DataFrame, split_day: str, limit: int = 10) -> DataFrame:
    """The patterns that grew most, and half as many of those that shrank most."""
    rows = cut(before_after(logs, split_day))
    grown = rows.orderBy(F.col("delta").desc(), "pattern").limit(limit).withColumn("side", F.lit("grown"))
    shrunk = rows.orderBy("delta", "pattern").limit(limit // 2).withColumn("side", F.lit("shrunk"))
    return grown.unionByName(shrunk)
