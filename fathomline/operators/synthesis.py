"""Log lines made from templates, and the gate they have to pass.

Everything is drawn from hashes of the row's number, so a run can be repeated
and the work follows the table of templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drawn(what: str, most: int) -> Column:
    """A number from 0 to ``most`` - 1 that depends on the row's ``seq`` and a purpose only."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(what), F.col("seq").cast("string"))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(most))


def filled(skeletons: DataFrame) -> DataFrame:
    """``seq, service, level, msg, status_code, latency_ms, fault`` of the line that each template gives.

    Fault lines fill their phrase, other lines their route; asynchronous faults have no status.
    """
    phrase = F.coalesce("phrase_hint", F.lit("served <ROUTE> code=<C> in <N>ms"))
    status = F.element_at(F.array(*map(F.lit, (200, 200, 204, 304, 404, 500))), (drawn("status", 6) + 1).cast("int"))
    latency = F.when(F.col("fault"), 1000 + drawn("latency", 29_000)).otherwise(1 + drawn("latency", 400))
    rows = skeletons.select(
        "seq",
        F.coalesce(F.nullif(F.col("skel.service"), F.lit("")), F.lit("unknown")).alias("service"),
        F.coalesce(F.col("skel.level"), F.lit("INFO")).alias("level"),
        phrase.alias("phrase"),
        F.coalesce("is_fault_phrase", F.lit(False)).alias("fault"),
        F.coalesce(F.col("skel.path"), F.lit("/healthz")).alias("route"),
    )
    rows = rows.withColumn("latency_ms", latency).withColumn("status_code", F.when(~F.col("fault"), status))
    text = F.replace(F.col("phrase"), F.lit("<ROUTE>"), F.col("route"))
    text = F.replace(text, F.lit("<C>"), F.coalesce(F.col("status_code").cast("string"), F.lit("0")))
    text = F.replace(text, F.lit("<N>"), F.col("latency_ms").cast("string"))
    return rows.withColumn("msg", text).select("seq", "service", "level", "msg", "status_code", "latency_ms", "fault")


def critic_score(msg: Column, level: Column, fault: Column) -> Column:
    """The default critic: half for a filled text, three tenths for a fitting level, two tenths for a plausible length."""
    whole = (msg != "") & ~msg.rlike("<[A-Z]+>")
    fits = F.when(fault, level.isin("WARN", "ERRO", "FATA")).otherwise(~level.isin("FATA"))
    size = F.length(msg).between(10, 400)
    return F.round(whole.cast("int") * 0.5 + F.coalesce(fits, F.lit(False)).cast("int") * 0.3 + size.cast("int") * 0.2, 4)


def gated(lines: DataFrame, least: float = 0.7) -> DataFrame:
    """Lines with their score; those below the limit are filled once more from their level's fallback, then judged for good."""
    first = critic_score(F.col("msg"), F.col("level"), F.col("fault"))
    again = F.when(F.col("score") < least, F.when(F.col("fault"), F.lit("ERRO")).otherwise(F.lit("INFO"))).otherwise(F.col("level"))
    judged = lines.withColumn("score", first).withColumn("attempts", F.when(F.col("score") < least, 2).otherwise(1))
    retried = judged.withColumn("level", again)
    return retried.withColumn("score", critic_score(F.col("msg"), F.col("level"), F.col("fault"))).where(F.col("score") >= least)
