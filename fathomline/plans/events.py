"""Queries over the event stream, as batches and as streams, over orders, and lines made from templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators import evaluation, logs, memory, synthesis
from fathomline.session import read
from fathomline.streaming import sessions, windows

LENGTH, SLIDE, GAP = "1 hour", "15 minutes", "30 minutes"


def _events(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(spark, sf_dir):
    return windows.tumbling(_events(spark, sf_dir), "ts", LENGTH, ["event_type"])


def sliding(spark, sf_dir):
    return windows.sliding(_events(spark, sf_dir), "ts", LENGTH, SLIDE, ["event_type"])


def session(spark, sf_dir):
    return windows.sessions(_events(spark, sf_dir), "ts", GAP, ["user_id"])


def _stream(spark, sf_dir, table: str) -> DataFrame:
    return windows.event_stream(spark, f"{sf_dir}/{table}.parquet", read(spark, sf_dir, table).schema)


def stream_tumbling(spark, sf_dir):
    """The tumbling windows as a stream with a watermark, run over all events there are."""
    stream = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    return windows.run_to_end(windows.tumbling(stream, "ts", LENGTH, ["event_type"]), "complete")


def stream_session(spark, sf_dir):
    stream = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    return windows.run_to_end(windows.sessions(stream, "ts", GAP, ["user_id"]), "complete")


def stream_dedupe(spark, sf_dir):
    """Events by their number, copies within a day dropped: every third event arrives again in the same batch and once more later."""
    rows = _events(spark, sf_dir)
    again = rows.where(F.col("event_id") % 3 == 0)
    run = lambda stream, base: windows.run_to_end(
        windows.deduplicated(stream, "ts", ["event_id"], "1 day").select("event_id", "user_id", "event_type"), base=base
    )
    return windows.in_arrivals([rows.unionByName(again), again], run)


def stream_upsert(spark, sf_dir):
    """Messages merged into a stored table as they arrive in three parts out of order: the last one written of each key stays."""
    rows = read(spark, sf_dir, "episodic_turns").select("session_id", "turn", "role", "id", "content")

    def run(stream, base):
        last = windows.upsert_stream(stream, f"{base}/rows", f"{base}/state", memory.merged)
        return spark.read.schema(stream.schema).parquet(last)

    return windows.in_arrivals([rows.where(F.pmod("id", F.lit(3)) == k) for k in (2, 0, 1)], run)


#: The last turns of the parts in which sessions arrive, and the summaries that a second level replaces.
ARRIVALS, MERGED = (8, 13, 18), 2


def stream_summaries(spark, sf_dir):
    """Summaries of both levels that fall due as sessions arrive in four parts."""
    rows = read(spark, sf_dir, "episodic_turns").select("session_id", "turn")
    bounds = [None, *ARRIVALS, None]
    parts = []
    for low, high in zip(bounds, bounds[1:], strict=False):
        keep = F.lit(True)
        if low is not None:
            keep = keep & ((F.col("turn") > low) | F.col("turn").isNull()) if high is None else keep & (F.col("turn") > low)
        parts.append(rows.where(keep if high is None else keep & (F.col("turn") <= high)))
    run = lambda stream, base: windows.run_to_end(sessions.summaries_due(stream, merge_at=MERGED), base=base)
    return windows.in_arrivals(parts, run)


def change_correlation(spark, sf_dir):
    """For each error the user's last sign-up at or before it."""
    rows = _events(spark, sf_dir).where(F.col("event_type").isin("error", "signup"))
    found = logs.latest_before(rows, "user_id", "ts", F.col("event_type") == "signup", "event_id", 6 * 3_600_000_000)
    return found.select("event_id", "user_id", "mark_event_id", ((F.unix_micros("ts") - F.col("mark_us")) / 1000).cast("long").alias("lag_ms"))


def json_props(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("long")
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(k).alias("total"), F.count_if(k.isNull()).alias("n_without")
    )


def event_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    return rows.groupBy("event_type", F.substring(F.col("ts").cast("string"), 1, 10).alias("day")).agg(F.count("*").alias("n"))


def run_join(spark, sf_dir):
    """Orders of customers in credit as spans of known runs, and the orders of no known run, by priority."""
    runs = read(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    spans = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    mapped, unmapped = evaluation.with_runs(spans, runs, "o_custkey")
    known = mapped.groupBy("o_orderpriority").agg(F.count("*").alias("mapped"), F.count_distinct("c_mktsegment").alias("segments"))
    rest = unmapped.groupBy("o_orderpriority").agg(F.count("*").alias("unmapped"))
    return known.join(rest, "o_orderpriority", "full").fillna(0, ["mapped", "segments", "unmapped"])


def synth_logs(spark, sf_dir):
    return synthesis.filled(read(spark, sf_dir, "fault_f3_skeleton"))


def quality_gate(spark, sf_dir):
    lines = synthesis.filled(read(spark, sf_dir, "fault_f3_skeleton"))
    return synthesis.gated(lines).select("seq", "level", "score", "attempts")


def critic_histogram(spark, sf_dir):
    """Lines by their first score and whether they pass."""
    lines = synthesis.filled(read(spark, sf_dir, "fault_f3_skeleton"))
    score = synthesis.critic_score(F.col("msg"), F.col("level"), F.col("fault"))
    rows = lines.withColumn("score", score)
    return rows.groupBy("score").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.7).alias("n_pass"))


_MARKED = """marked AS (
  SELECT *, CASE WHEN event_type = 'signup' THEN event_id END AS mark, CASE WHEN event_type = 'signup' THEN epoch_us(ts) END AS mark_us
  FROM events WHERE event_type IN ('error', 'signup')
)"""
_FILLED = """raw AS MATERIALIZED (SELECT seq, skel, phrase_hint, is_fault_phrase FROM fault_f3_skeleton),
drawn AS (
  SELECT seq, coalesce(nullif(skel.service, ''), 'unknown') AS service, coalesce(skel.level, 'INFO') AS level,
         coalesce(phrase_hint, 'served <ROUTE> code=<C> in <N>ms') AS phrase, coalesce(is_fault_phrase, false) AS fault,
         coalesce(skel.path, '/healthz') AS route,
         CAST('0x' || substr(md5('status:' || seq), 1, 8) AS BIGINT) % 6 AS s,
         CAST('0x' || substr(md5('latency:' || seq), 1, 8) AS BIGINT) AS l
  FROM raw
),
valued AS (
  SELECT *, CASE WHEN fault THEN 1000 + l % 29000 ELSE 1 + l % 400 END AS latency_ms,
         CASE WHEN NOT fault THEN [200, 200, 204, 304, 404, 500][s + 1] END AS status_code FROM drawn
),
filled AS (
  SELECT seq, service, level, replace(replace(replace(phrase, '<ROUTE>', route), '<C>', coalesce(CAST(status_code AS VARCHAR), '0')), '<N>', CAST(latency_ms AS VARCHAR)) AS msg,
         status_code, latency_ms, fault FROM valued
)"""
_SCORE = """round(CAST(msg <> '' AND NOT regexp_matches(msg, '<[A-Z]+>') AS INTEGER) * CAST(0.5 AS DOUBLE)
  + CAST(CASE WHEN fault THEN level IN ('WARN', 'ERRO', 'FATA') ELSE level <> 'FATA' END AS INTEGER) * CAST(0.3 AS DOUBLE)
  + CAST(length(msg) BETWEEN 10 AND 400 AS INTEGER) * CAST(0.2 AS DOUBLE), 4)"""
_TUMBLING = """SELECT epoch_ms(ts) // 3600000 * 3600000 AS start_ms, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"""
_SESSION = """WITH flagged AS (
  SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 1800000000, true) AS opens FROM events),
numbered AS (SELECT user_id, ts, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM flagged)
SELECT user_id, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) + 1800000000 AS end_us, count(*) AS n FROM numbered GROUP BY user_id, s"""

ORACLE = {
    "tumbling": _TUMBLING,
    "sliding": """SELECT epoch_ms(ts) // 900000 * 900000 - i * 900000 AS start_ms, event_type, count(*) AS n
FROM events, (VALUES (0), (1), (2), (3)) AS t(i) GROUP BY 1, 2""",
    "session": _SESSION,
    "stream_tumbling": _TUMBLING,
    "stream_session": _SESSION,
    "stream_dedupe": "SELECT event_id, user_id, event_type FROM events",
    "stream_upsert": """SELECT session_id, turn, role, id, content FROM episodic_turns
WHERE session_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY session_id, turn, role ORDER BY id DESC) = 1""",
    "stream_summaries": f"""WITH RECURSIVE bounds(k, high) AS (VALUES {", ".join(f"({k}, {b})" for k, b in enumerate((*ARRIVALS, 2**31), 1))}),
lasts AS (
  SELECT session_id, k, greatest(coalesce(max(turn) FILTER (turn <= high), 0), 0) AS last FROM episodic_turns, bounds WHERE session_id IS NOT NULL GROUP BY 1, 2
),
state AS (
  SELECT DISTINCT session_id, 0 AS k, 0 AS covered, 0 AS waiting, 1 AS start, false AS due, 0 AS first, 1 AS merged_from FROM lasts
  UNION ALL
  SELECT session_id, l.k, CASE WHEN last - covered >= 8 THEN last - 3 ELSE covered END,
         CASE WHEN last - covered >= 8 THEN (waiting + 1) % {MERGED} ELSE waiting END,
         CASE WHEN last - covered >= 8 AND waiting + 1 = {MERGED} THEN last - 2 ELSE start END, last - covered >= 8, covered + 1, start
  FROM state s JOIN lasts l USING (session_id) WHERE l.k = s.k + 1
)
SELECT session_id, 1 AS level, first AS covers_start, covered AS covers_end FROM state WHERE due
UNION ALL SELECT session_id, 2, merged_from, covered FROM state WHERE due AND waiting = 0""",
    "change_correlation": f"""WITH {_MARKED}, carried AS (
  SELECT *, last_value(mark IGNORE NULLS) OVER w AS mark_event_id, last_value(mark_us IGNORE NULLS) OVER w AS at_us FROM marked
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, mark IS NULL, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, user_id, mark_event_id, (epoch_us(ts) - at_us) // 1000 AS lag_ms FROM carried WHERE event_type = 'error'""",
    "json_props": """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total,
count(*) FILTER (json_extract_string(props, '$.k') IS NULL) AS n_without FROM events GROUP BY 1""",
    "event_counts": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2",
    "run_join": """WITH spans AS (
  SELECT o_orderpriority, c_mktsegment, c_custkey IS NOT NULL AS known FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0)
SELECT o_orderpriority, count(*) FILTER (known) AS mapped, count(DISTINCT c_mktsegment) AS segments, count(*) FILTER (NOT known) AS unmapped FROM spans GROUP BY 1""",
    "synth_logs": f"WITH {_FILLED} SELECT * FROM filled",
    "quality_gate": f"""WITH {_FILLED}, first AS (SELECT *, {_SCORE} AS score1 FROM filled),
again AS (
  SELECT seq, CASE WHEN score1 < 0.7 THEN CASE WHEN fault THEN 'ERRO' ELSE 'INFO' END ELSE level END AS level, msg, fault,
         CASE WHEN score1 < 0.7 THEN 2 ELSE 1 END AS attempts FROM first)
SELECT * FROM (SELECT seq, level, {_SCORE} AS score, attempts FROM again) WHERE score >= 0.7""",
    "critic_histogram": f"""WITH {_FILLED}, scored AS (SELECT {_SCORE} AS score FROM filled)
SELECT score, count(*) AS n, count(*) FILTER (score >= 0.7) AS n_pass FROM scored GROUP BY 1""",
}
QUERIES = {name: globals()[name] for name in ORACLE}
