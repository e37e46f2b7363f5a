"""Log lines: normalising, searching, counting, and the traces they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import text, times
from fathomline.operators.ordered import running_sum
from fathomline.session import spread

#: Levels by rising severity (fixed value); unknown ones rank lowest.
LEVELS = ("DEBU", "INFO", "WARN", "ERRO", "FATA")
ERRORS = ("ERRO", "FATA")


def level_rank(level: Column) -> Column:
    return F.greatest(F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1, F.lit(0)).cast("int")


def normalised(skeletons: DataFrame) -> DataFrame:
    """One flat row per log line. Missing texts are empty, missing numbers null; ``detail`` is the first text given."""
    field = lambda name: F.coalesce(F.col(f"skel.{name}"), F.lit(""))
    return skeletons.select(
        "seq",
        field("time").alias("ts_raw"),
        field("level").alias("level"),
        level_rank(F.col("skel.level")).alias("level_rank"),
        field("traceid").alias("trace_id"),
        field("service").alias("service"),
        field("msg").alias("msg"),
        F.col("skel.status_code").alias("status_code"),
        F.col("skel.method").alias("method"),
        F.col("skel.latency_ms").alias("latency_ms"),
        F.coalesce(F.nullif(F.col("skel.content"), F.lit("")), F.nullif(F.col("skel.callerpath"), F.lit(""))).alias("detail"),
        field("callerpath").alias("caller"),
        field("prefix").alias("env"),
        field("path").alias("path"),
        F.col("ingested_at").cast("timestamp").alias("ingested_at"),
    )


def with_time(logs: DataFrame) -> DataFrame:
    """Adds ``ts``, the parsed time of each line; null if it has none."""
    return logs.withColumn("ts", times.parsed(F.col("ts_raw")))


def haystack() -> Column:
    return F.lower(F.concat_ws(" ", F.col("msg"), F.coalesce("detail", F.lit(""))))


def matching(logs: DataFrame, service: str, keyword: str = "") -> DataFrame:
    """Lines of a service that contain a keyword literally, both without regard to case."""
    hits = logs.where(F.lower("service") == service.strip().lower())
    return hits.where(haystack().contains(keyword.strip().lower())) if keyword.strip() else hits


def search(logs: DataFrame, service: str, keyword: str = "", limit: int = 20) -> DataFrame:
    """The gravest matching lines, earliest first within a level."""
    return matching(logs, service, keyword).orderBy(F.col("level_rank").desc(), "seq").limit(limit)


def keep_policy(logs: DataFrame, keywords: tuple[str, ...], drop_debug: bool = True) -> DataFrame:
    """Warnings and errors always; debug lines never if they are dropped; others if a keyword is in them, or, without keywords, if informational."""
    hay = F.concat_ws(" ", F.coalesce("detail", F.lit("")), F.col("caller"), F.col("msg"))
    any_word = F.lit(False)
    for word in keywords:
        any_word = any_word | hay.contains(word)
    rest = any_word if keywords else F.col("level") == "INFO"
    keep = F.when(F.col("level").isin("WARN", *ERRORS), True)
    if drop_debug:
        keep = keep.when(F.col("level") == "DEBU", False)
    return logs.where(keep.otherwise(rest))


def any_service(base: Column, services: list[str]) -> Column:
    """``base`` and one of the services, or ``base`` alone if there are none."""
    return base & F.col("service").isin(*services) if services else base


def counts_by_kind(logs: DataFrame) -> DataFrame:
    """``kind, key, n``: lines by level, service, caller and pattern, in one pass over grouping sets."""
    rows = spread(logs.select("level", "service", "caller", "msg")).select(
        "level",
        "service",
        text.caller_place(F.col("caller")).alias("caller"),
        text.fingerprint(F.col("msg")).alias("pattern"),
    )
    names = ["level", "service", "caller", "pattern"]
    sets = rows.groupingSets([[F.col(n)] for n in names], *map(F.col, names)).agg(
        F.count("*").alias("n"), F.grouping_id().alias("_set")
    )
    kind, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, n in enumerate(names):
        is_set = F.col("_set") == (0b1111 ^ (1 << (3 - i)))
        kind, key = F.when(is_set, F.lit(n)).otherwise(kind), F.when(is_set, F.col(n)).otherwise(key)
    out = sets.select(kind.alias("kind"), key.alias("key"), "n")
    return out.where((F.col("kind") == "level") | (F.col("key") != ""))


def distinct_lines(skeletons: DataFrame) -> DataFrame:
    """Lines that were delivered again have the same content: ``seq`` of the first, with the number of deliveries.

    Two hashes of all fields, 128 bits together, are shuffled instead of the lines; nulls count as values of their own.
    """
    fields = [F.coalesce(F.col(f"skel.{f.name}").cast("string"), F.lit("\x00")) for f in skeletons.schema["skel"].dataType.fields]
    rows = skeletons.select("seq", F.xxhash64(*fields).alias("_a"), F.xxhash64(F.lit(1), *fields).alias("_b"))
    return rows.groupBy("_a", "_b").agg(F.min("seq").alias("seq"), F.count("*").alias("deliveries")).select("seq", "deliveries")


# --- traces ------------------------------------------------------------------


def trace_summaries(logs: DataFrame) -> DataFrame:
    """One row per trace: spans, errors, largest latency and where it was first reached, ends, and services in order.

    Lines are first reduced per trace and service, so a trace with a tenth of
    all lines is reduced in many tasks and only its services meet.
    """
    rows = logs.where(F.col("trace_id") != "")
    place = F.struct("ts_raw", "seq")
    positive = F.when(F.col("latency_ms") > 0, F.col("latency_ms"))
    per_service = rows.groupBy("trace_id", "service").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("level").isin(*ERRORS)).alias("errors"),
        F.max(positive).alias("latency"),
        F.max(F.when(F.col("latency_ms") > 0, F.struct("latency_ms", (-F.col("seq")).alias("s")))).alias("peak"),
        F.min(place).alias("first"),
        F.max(place).alias("last"),
        F.min("seq").alias("first_seq"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "service"))), lambda x: x["service"])
    return per_service.groupBy("trace_id").agg(
        F.sum("n").alias("n_spans"),
        F.sum("errors").alias("error_count"),
        (F.sum("errors") > 0).alias("has_error"),
        F.coalesce(F.max("latency"), F.lit(0)).alias("max_latency_ms"),
        F.coalesce(F.max_by(F.when(F.col("latency").isNotNull(), F.col("service")), "peak"), F.lit("")).alias("slowest_service"),
        F.min("first.ts_raw").alias("start_ts"),
        F.max("last.ts_raw").alias("end_ts"),
        F.min("first_seq").alias("first_seq"),
        F.filter(ordered, lambda s: s != "").alias("services"),
    )


def trace_timeline(logs: DataFrame) -> DataFrame:
    """The lines of all traces in order; errors and warnings carry the head of their detail. Sorted by ranges, not by trace."""
    grave = F.col("level").isin("WARN", *ERRORS)
    return (
        logs.where(F.col("trace_id") != "")
        .select(
            "trace_id", "ts_raw", "seq", "service", "level", "msg", "latency_ms", "status_code",
            F.when(grave, F.substring("detail", 1, 2000)).alias("detail_snippet"),
        )
        .orderBy("trace_id", "ts_raw", "seq")
    )


def traces_of_service(logs: DataFrame, service: str) -> DataFrame:
    """Summaries of the traces that touch a service, over all of their lines."""
    touched = logs.where((F.lower("service") == service.strip().lower()) & (F.col("trace_id") != ""))
    return trace_summaries(logs.join(touched.select("trace_id").distinct(), "trace_id", "left_semi"))


def suspicious_traces(logs: DataFrame, service: str, limit: int = 10) -> DataFrame:
    """Traces of a service, failed and slow ones first."""
    order = [F.col("has_error").desc(), F.col("max_latency_ms").desc(), F.col("first_seq")]
    return traces_of_service(logs, service).orderBy(*order).limit(limit)


# --- rates and caps ----------------------------------------------------------


def red_metrics(logs: DataFrame, length: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    """Requests, errors, error share and mean duration per service and sliding window of event time."""
    rows = with_time(logs).where(F.col("ts").isNotNull() & (F.col("service") != ""))
    measured = F.when(F.col("latency_ms") >= 0, F.col("latency_ms"))
    return (
        rows.groupBy("service", F.window("ts", length, slide).alias("w"))
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("level").isin(*ERRORS)).alias("errors"),
            F.avg(measured).alias("mean_ms"),
        )
        .select("service", F.unix_millis("w.start").alias("start_ms"), "n", "errors", (F.col("errors") / F.col("n")).alias("error_share"), "mean_ms")
    )


def within_cap(logs: DataFrame, most_bytes: int, keep_crossing: bool = True, width: int = 50_000) -> DataFrame:
    """Lines of each environment and ingestion day up to a number of bytes of message, in order of arrival.

    The line that crosses the cap is kept or not. Running sums are made in bins.
    """
    rows = logs.withColumn("day", F.to_date("ingested_at")).withColumn("bytes", F.octet_length("msg"))
    summed = running_sum(rows, ["env", "day"], "seq", F.col("bytes"), width, "upto")
    fits = (F.col("upto") - F.col("bytes") < most_bytes) if keep_crossing else (F.col("upto") <= most_bytes)
    return summed.where(fits)


def cap_report(logs: DataFrame, most_bytes: int, most_rows: int, width: int = 50_000) -> DataFrame:
    """Of each environment and ingestion day all rows and bytes, those within both caps, and whether a cap was met.

    The row that crosses the cap of bytes is kept, as in ``within_cap``.
    """
    rows = logs.withColumn("day", F.to_date("ingested_at")).withColumn("bytes", F.coalesce(F.octet_length("msg"), F.lit(0)))
    summed = running_sum(rows.select("env", "day", "seq", "bytes"), ["env", "day"], "seq", F.col("bytes"), width, "upto")
    placed = running_sum(summed, ["env", "day"], "seq", F.lit(1), width, "place")
    fits = (F.col("upto") - F.col("bytes") < most_bytes) & (F.col("place") <= most_rows)
    return placed.groupBy("env", "day").agg(
        F.count("*").alias("n"),
        F.sum("bytes").alias("bytes"),
        F.count_if(fits).alias("n_kept"),
        F.coalesce(F.sum(F.when(fits, F.col("bytes"))), F.lit(0)).alias("bytes_kept"),
        (F.count_if(fits) < F.count("*")).alias("capped"),
    )


def level_pivot(logs: DataFrame) -> DataFrame:
    """Lines of each service by level, as columns."""
    return (
        logs.where(F.col("service") != "").groupBy("service").pivot("level", list(LEVELS)).count().na.fill(0, list(LEVELS))
    )


def latest_before(events: DataFrame, key: str, at: str, is_mark: Column, carry: str, width_us: int) -> DataFrame:
    """As-of join of a table with itself: to each row that is no mark, the latest mark of its key at or before its time.

    Times are cut into stretches of ``width_us``; within one the last mark is
    carried forward, and only each stretch's last mark passes to later ones.
    Adds ``mark_<carry>`` and ``mark_us``; null if no mark came before.
    """
    rows = events.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp"))).where(F.col("_us").isNotNull())
    rows = rows.withColumn("_part", F.floor(F.col("_us") / F.lit(width_us)))
    mark = F.when(is_mark, F.struct(F.col("_us").alias("us"), F.col(carry).alias("c")))
    rows = rows.withColumn("_mark", mark)
    inside = Window.partitionBy(key, "_part").orderBy("_us", F.col("_mark").isNull(), carry).rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("_here", F.last("_mark", ignorenulls=True).over(inside))
    ends = rows.groupBy(key, "_part").agg(F.max("_mark").alias("_end"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_earlier", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    found = F.coalesce("_here", "_earlier")
    return (
        here.where(F.col("_mark").isNull())
        .join(carried, [key, "_part"])
        .withColumn(f"mark_{carry}", found["c"])
        .withColumn("mark_us", found["us"])
        .drop("_us", "_part", "_mark", "_here", "_earlier")
    )
