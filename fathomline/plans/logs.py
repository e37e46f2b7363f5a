"""Queries over log lines, traces and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import text, times
from fathomline.operators import evaluation, logs, patterns
from fathomline.session import read

#: What the searches ask for.
SERVICE, KEYWORD, TOUCHED = "Harbor-Gateway ", "timed out", "quay-ledger"
KEEP_WORDS = ("lease", "finished")
ANCHOR, MINUTES = "2026-03-15T12:00:00Z", 240
SPLIT_DAY = "2026-03-16"
MOST_BYTES, MOST_ROWS = 10_000, 40
ENVIRONMENTS = ("default", "edge")
SHARES = (0.5, 0.9, 0.99)
EDGES = (10.0, 50.0, 100.0, 500.0, 1000.0, 5000.0)
DIRTY_MS = 300_000.0


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.normalised(read(spark, sf_dir, "fault_f3_skeleton"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logs(spark, sf_dir).where(F.col("service") != "").withColumn("service", F.lower(text.strip(F.col("service"))))


def search_logs(spark, sf_dir):
    hits = logs.search(_logs(spark, sf_dir), SERVICE, KEYWORD)
    return hits.select("seq", "ts_raw", "level", "trace_id", "service", "msg", "status_code", "method", "latency_ms", "detail")


def matching_logs(spark, sf_dir):
    return logs.matching(_logs(spark, sf_dir), SERVICE, KEYWORD).select("seq", "level", "msg", "detail")


def log_times(spark, sf_dir):
    return logs.with_time(_logs(spark, sf_dir)).select("seq", F.unix_millis("ts").alias("ts_ms"))


def log_window_centered(spark, sf_dir):
    at = times.parsed(F.lit(ANCHOR))
    rows = logs.with_time(_logs(spark, sf_dir)).where(times.centred(F.col("ts"), at, MINUTES))
    return rows.select("seq", "service", "level")


def log_window_trailing(spark, sf_dir):
    at = times.parsed(F.lit(ANCHOR))
    rows = logs.with_time(_logs(spark, sf_dir)).where(times.trailing(F.col("ts"), at, MINUTES))
    return rows.select("seq", "service", "level")


def keep_policy(spark, sf_dir):
    return logs.keep_policy(_logs(spark, sf_dir), KEEP_WORDS).select("seq", "level", "msg")


def any_service(spark, sf_dir):
    wanted = logs.any_service(F.col("level") != "DEBU", ["quay-ledger", "tide-ingest"])
    return _logs(spark, sf_dir).where(wanted).select("seq", "service", "level")


def counts_grouping_sets(spark, sf_dir):
    return logs.counts_by_kind(_logs(spark, sf_dir))


def redelivered(spark, sf_dir):
    return logs.distinct_lines(read(spark, sf_dir, "fault_f3_skeleton"))


def trace_timeline(spark, sf_dir):
    return logs.trace_timeline(_logs(spark, sf_dir))


def trace_summaries(spark, sf_dir):
    return logs.trace_summaries(_logs(spark, sf_dir))


def trace_by_service(spark, sf_dir):
    return logs.suspicious_traces(_logs(spark, sf_dir), TOUCHED)


def traces_of_service(spark, sf_dir):
    return logs.traces_of_service(_logs(spark, sf_dir), TOUCHED)


def fingerprint_topk(spark, sf_dir):
    return patterns.top_patterns(_logs(spark, sf_dir)).withColumn("share", F.round("share", 6))


def share_pct(spark, sf_dir):
    return patterns.pattern_counts(_logs(spark, sf_dir)).withColumn("share", F.round("share", 6))


def fingerprint_env_pivot(spark, sf_dir):
    return patterns.by_environment(_logs(spark, sf_dir), list(ENVIRONMENTS))


def fingerprint_delta(spark, sf_dir):
    return patterns.before_after(_logs(spark, sf_dir), SPLIT_DAY)


def fingerprint_movers(spark, sf_dir):
    return patterns.movers(_logs(spark, sf_dir), SPLIT_DAY)


def red_metrics(spark, sf_dir):
    rows = logs.red_metrics(_logs(spark, sf_dir))
    return rows.withColumns({"error_share": F.round("error_share", 6), "mean_ms": F.round("mean_ms", 4)})


def running_cap(spark, sf_dir):
    rows = _logs(spark, sf_dir).where(F.col("ingested_at").isNotNull())
    kept = logs.within_cap(rows, MOST_BYTES)
    return kept.select("seq", "env", F.date_format("day", "yyyy-MM-dd").alias("day"), "bytes", "upto")


def cap_report(spark, sf_dir):
    rows = _logs(spark, sf_dir).where(F.col("ingested_at").isNotNull())
    return logs.cap_report(rows, MOST_BYTES, MOST_ROWS).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def level_pivot(spark, sf_dir):
    return logs.level_pivot(_logs(spark, sf_dir))


def daily_counts(spark, sf_dir):
    """Lines of each UTC day, zero for days without any between the first and the last."""
    rows = logs.with_time(_logs(spark, sf_dir)).where(F.col("ts").isNotNull())
    counted = rows.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    ends = counted.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(counted, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n")
    )


def path_listing(spark, sf_dir):
    """Lines and bytes by the first part of the path, as for stored objects."""
    rows = _logs(spark, sf_dir).where(F.col("path") != "")
    first = F.split(F.regexp_replace("path", "^/+", ""), "/")[0]
    return rows.groupBy(first.alias("first")).agg(F.count("*").alias("n"), F.sum(F.octet_length("msg")).alias("bytes"))


def ticket_ids(spark, sf_dir):
    """The id of the ticket that an error line opens; lines of the same service and text open the same."""
    rows = _logs(spark, sf_dir).where(F.col("level").isin(*logs.ERRORS))
    digest = F.md5(F.concat_ws("|", "service", text.fingerprint(F.col("msg"))))
    return rows.select("seq", F.concat(F.lit("INC-"), F.substring(digest, 1, 6)).alias("ticket"))


def latency_percentiles(spark, sf_dir):
    return evaluation.nearest_rank(_named(spark, sf_dir), "service", "latency_ms", SHARES)


def latency_stats(spark, sf_dir):
    return evaluation.latency_stats(_named(spark, sf_dir), "service", "latency_ms")


def latency_histogram(spark, sf_dir):
    return evaluation.histogram(_named(spark, sf_dir), "service", "latency_ms", list(EDGES), 5, DIRTY_MS)


def caller_counts(spark, sf_dir):
    rows = _logs(spark, sf_dir).where(F.col("caller") != "")
    return rows.groupBy(text.caller_place(F.col("caller")).alias("place")).agg(F.count("*").alias("n"))


def alias_join(spark, sf_dir):
    """Lines by the service that is meant: names that are aliases are replaced, others stand for themselves."""
    alias = read(spark, sf_dir, "service_alias").groupBy(F.lower("alias").alias("name")).agg(F.min("service").alias("real"))
    rows = _named(spark, sf_dir).withColumnRenamed("service", "name").join(alias, "name", "left")
    return rows.groupBy(F.coalesce("real", "name").alias("service_real")).agg(
        F.count("*").alias("n"), F.count_if(F.col("real").isNotNull()).alias("n_alias")
    )


def error_details(spark, sf_dir):
    """The head of each error's or warning's detail and its first line."""
    rows = _logs(spark, sf_dir).where(F.col("level").isin("WARN", *logs.ERRORS) & F.col("detail").isNotNull())
    return rows.select(
        "seq",
        F.substring("detail", 1, 2000).alias("detail_snippet"),
        text.truncated(text.first_line(F.col("detail")), 200).alias("first_line"),
    )


_LOGS = """logs AS MATERIALIZED (
  SELECT seq, coalesce(skel."time", '') AS ts_raw, coalesce(skel.level, '') AS level,
         CASE skel.level WHEN 'INFO' THEN 1 WHEN 'WARN' THEN 2 WHEN 'ERRO' THEN 3 WHEN 'FATA' THEN 4 ELSE 0 END AS level_rank,
         coalesce(skel.traceid, '') AS trace_id, coalesce(skel.service, '') AS service, coalesce(skel.msg, '') AS msg,
         skel.status_code AS status_code, skel.method AS method, skel.latency_ms AS latency_ms,
         coalesce(nullif(skel.content, ''), nullif(skel.callerpath, '')) AS detail, coalesce(skel.callerpath, '') AS caller,
         coalesce(skel.prefix, '') AS env, coalesce(skel.path, '') AS path, timezone('UTC', ingested_at) AS ingested_at
  FROM fault_f3_skeleton
)"""
_TIMED = (
    _LOGS
    + r""",
timed AS (
  SELECT *, epoch_ms(CASE WHEN regexp_matches(ts_raw, '(Z|[+-]\d{2}:?\d{2})\s*$') AND regexp_matches(ts_raw, '^\d{4}-\d{2}-\d{2}[T ]\d')
                 THEN try_cast(ts_raw AS TIMESTAMPTZ) ELSE try_cast(trim(ts_raw) || '+08:00' AS TIMESTAMPTZ) END) AS ts_ms
  FROM logs
)"""
)
_ANCHOR_MS = "epoch_ms(CAST('2026-03-15T12:00:00Z' AS TIMESTAMPTZ))"
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
_NAMED = f"""{_LOGS},
named AS (
  SELECT * REPLACE (lower(regexp_replace(service, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')) AS service) FROM logs WHERE service <> ''
)"""


def fingerprint_sql(column: str) -> str:
    line = f"split_part(regexp_replace({column}, '\\r\\n?', chr(10), 'g'), chr(10), 1)"
    out = f"CASE WHEN length({line}) > 300 THEN substr({line}, 1, 300) || '…' ELSE {line} END"
    for pattern, by in text.FINGERPRINT_RULES:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


_PATTERNS = f"""{_LOGS},
patterned AS (SELECT *, {fingerprint_sql("msg")} AS pattern FROM logs)"""
_TRACES = f"""{_LOGS},
lines AS (SELECT * FROM logs WHERE trace_id <> ''),
tops AS (
  SELECT trace_id, service AS slowest_service FROM lines WHERE latency_ms > 0
  QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY latency_ms DESC, seq) = 1
),
firsts AS (
  SELECT trace_id, service, min((ts_raw, seq)) AS place FROM lines WHERE service <> '' GROUP BY 1, 2
),
lists AS (SELECT trace_id, list(service ORDER BY place) AS services FROM firsts GROUP BY 1),
traces AS (
  SELECT l.trace_id, count(*) AS n_spans, count(*) FILTER (l.level IN ('ERRO', 'FATA')) AS error_count,
         count(*) FILTER (l.level IN ('ERRO', 'FATA')) > 0 AS has_error,
         coalesce(max(l.latency_ms) FILTER (l.latency_ms > 0), 0) AS max_latency_ms,
         coalesce(any_value(t.slowest_service), '') AS slowest_service,
         min(l.ts_raw) AS start_ts, max(l.ts_raw) AS end_ts, min(l.seq) AS first_seq,
         coalesce(any_value(s.services), []) AS services
  FROM lines l LEFT JOIN tops t USING (trace_id) LEFT JOIN lists s USING (trace_id) GROUP BY l.trace_id
)"""
_TOUCHED = f"WHERE trace_id IN (SELECT trace_id FROM lines WHERE lower(service) = '{TOUCHED}')"
_HAY = "lower(concat_ws(' ', msg, coalesce(detail, '')))"
_MATCH = f"lower(service) = '{SERVICE.strip().lower()}' AND contains({_HAY}, '{KEYWORD}')"
_KEEP = "concat_ws(' ', coalesce(detail, ''), caller, msg)"


def _shares_sql() -> str:
    return ", ".join(
        f"max(CASE WHEN r = least(CAST(floor(n * CAST({s} AS DOUBLE)) AS BIGINT), n - 1) THEN latency_ms END) AS p{round(s * 100)}"
        for s in SHARES
    )


def _bins_sql() -> str:
    bounds = list(zip([0.0, *EDGES], [*EDGES, 1e300], strict=True))
    return ", ".join(f"count(*) FILTER (latency_ms >= {a} AND latency_ms < {b}) AS b{i}" for i, (a, b) in enumerate(bounds))


ORACLE = {
    "search_logs": f"""WITH {_LOGS}
SELECT seq, ts_raw, level, trace_id, service, msg, status_code, method, latency_ms, detail FROM logs
WHERE {_MATCH} ORDER BY level_rank DESC, seq LIMIT 20""",
    "matching_logs": f"WITH {_LOGS} SELECT seq, level, msg, detail FROM logs WHERE {_MATCH}",
    "log_times": f"WITH {_TIMED} SELECT seq, ts_ms FROM timed",
    "log_window_centered": f"""WITH {_TIMED} SELECT seq, service, level FROM timed
WHERE ts_ms BETWEEN {_ANCHOR_MS} - {MINUTES // 2 * 60_000} AND {_ANCHOR_MS} + {MINUTES // 2 * 60_000}""",
    "log_window_trailing": f"""WITH {_TIMED} SELECT seq, service, level FROM timed
WHERE ts_ms BETWEEN {_ANCHOR_MS} - {MINUTES * 60_000} AND {_ANCHOR_MS}""",
    "keep_policy": f"""WITH {_LOGS} SELECT seq, level, msg FROM logs
WHERE CASE WHEN level IN ('WARN', 'ERRO', 'FATA') THEN true WHEN level = 'DEBU' THEN false
      ELSE contains({_KEEP}, 'lease') OR contains({_KEEP}, 'finished') END""",
    "any_service": f"""WITH {_LOGS} SELECT seq, service, level FROM logs
WHERE level <> 'DEBU' AND service IN ('quay-ledger', 'tide-ingest')""",
    "counts_grouping_sets": rf"""WITH {_PATTERNS}
SELECT 'level' AS kind, level AS key, count(*) AS n FROM patterned GROUP BY 2
UNION ALL SELECT 'service', service, count(*) FROM patterned WHERE service <> '' GROUP BY 2
UNION ALL SELECT 'caller', regexp_replace(caller, '\.go:\d+', '.go:N', 'g'), count(*) FROM patterned WHERE caller <> '' GROUP BY 2
UNION ALL SELECT 'pattern', pattern, count(*) FROM patterned WHERE pattern <> '' GROUP BY 2""",
    "redelivered": "SELECT min(seq) AS seq, count(*) AS deliveries FROM fault_f3_skeleton GROUP BY skel",
    "trace_timeline": f"""WITH {_LOGS}
SELECT trace_id, ts_raw, seq, service, level, msg, latency_ms, status_code,
       CASE WHEN level IN ('WARN', 'ERRO', 'FATA') THEN substr(detail, 1, 2000) END AS detail_snippet
FROM logs WHERE trace_id <> ''""",
    "trace_summaries": f"WITH {_TRACES} SELECT * FROM traces",
    "traces_of_service": f"WITH {_TRACES} SELECT * FROM traces {_TOUCHED}",
    "trace_by_service": f"""WITH {_TRACES} SELECT * FROM traces {_TOUCHED}
ORDER BY has_error DESC, max_latency_ms DESC, first_seq LIMIT 10""",
    "share_pct": f"""WITH {_PATTERNS}, counted AS (SELECT pattern, count(*) AS n FROM patterned GROUP BY 1)
SELECT * FROM (SELECT pattern, n, round(100.0 * n / sum(n) OVER (), 6) AS share FROM counted) WHERE pattern <> ''""",
    "fingerprint_topk": f"""WITH {_PATTERNS}, counted AS (SELECT pattern, count(*) AS n FROM patterned GROUP BY 1)
SELECT * FROM (SELECT pattern, n, round(100.0 * n / sum(n) OVER (), 6) AS share FROM counted) WHERE pattern <> ''
ORDER BY n DESC, pattern LIMIT 20""",
    "fingerprint_env_pivot": f"""WITH {_PATTERNS}
SELECT pattern, count(*) FILTER (env = 'default') AS n_default, count(*) FILTER (env = 'edge') AS n_edge, count(*) AS n
FROM patterned WHERE pattern <> '' AND env IN ('default', 'edge') GROUP BY 1""",
    "fingerprint_delta": f"""WITH {_PATTERNS}
SELECT pattern, count(*) FILTER (ingested_at < DATE '{SPLIT_DAY}') AS before, count(*) FILTER (ingested_at >= DATE '{SPLIT_DAY}') AS after,
       count(*) FILTER (ingested_at >= DATE '{SPLIT_DAY}') - count(*) FILTER (ingested_at < DATE '{SPLIT_DAY}') AS delta
FROM patterned WHERE pattern <> '' AND ingested_at IS NOT NULL GROUP BY 1""",
    "fingerprint_movers": f"""WITH {_PATTERNS}, deltas AS (
  SELECT pattern, count(*) FILTER (ingested_at < DATE '{SPLIT_DAY}') AS before, count(*) FILTER (ingested_at >= DATE '{SPLIT_DAY}') AS after,
         count(*) FILTER (ingested_at >= DATE '{SPLIT_DAY}') - count(*) FILTER (ingested_at < DATE '{SPLIT_DAY}') AS delta
  FROM patterned WHERE pattern <> '' AND ingested_at IS NOT NULL GROUP BY 1)
(SELECT *, 'grown' AS side FROM deltas ORDER BY delta DESC, pattern LIMIT 10)
UNION ALL (SELECT *, 'shrunk' AS side FROM deltas ORDER BY delta, pattern LIMIT 5)""",
    "red_metrics": f"""WITH {_TIMED}, spread AS (
  SELECT service, level, latency_ms, ts_ms // 1800000 * 1800000 - i * 1800000 AS start_ms
  FROM timed, (VALUES (0), (1)) AS t(i) WHERE ts_ms IS NOT NULL AND service <> '')
SELECT service, start_ms, count(*) AS n, count(*) FILTER (level IN ('ERRO', 'FATA')) AS errors,
       round(count(*) FILTER (level IN ('ERRO', 'FATA')) / count(*), 6) AS error_share,
       round(avg(latency_ms) FILTER (latency_ms >= 0), 4) AS mean_ms
FROM spread GROUP BY 1, 2""",
    "running_cap": f"""WITH {_LOGS}, summed AS (
  SELECT seq, env, strftime(ingested_at, '%Y-%m-%d') AS day, octet_length(encode(msg)) AS bytes,
         CAST(sum(octet_length(encode(msg))) OVER (PARTITION BY env, CAST(ingested_at AS DATE) ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM logs WHERE ingested_at IS NOT NULL)
SELECT * FROM summed WHERE upto - bytes < {MOST_BYTES}""",
    "cap_report": f"""WITH {_LOGS}, summed AS (
  SELECT env, strftime(ingested_at, '%Y-%m-%d') AS day, coalesce(octet_length(encode(msg)), 0) AS bytes,
         sum(coalesce(octet_length(encode(msg)), 0)) OVER (PARTITION BY env, CAST(ingested_at AS DATE) ORDER BY seq ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (PARTITION BY env, CAST(ingested_at AS DATE) ORDER BY seq) AS place
  FROM logs WHERE ingested_at IS NOT NULL),
fitted AS (SELECT *, upto - bytes < {MOST_BYTES} AND place <= {MOST_ROWS} AS fits FROM summed)
SELECT env, day, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (fits) AS n_kept,
       CAST(coalesce(sum(bytes) FILTER (fits), 0) AS BIGINT) AS bytes_kept, count(*) FILTER (fits) < count(*) AS capped FROM fitted GROUP BY 1, 2""",
    "level_pivot": f"""WITH {_LOGS}
SELECT service, count(*) FILTER (level = 'DEBU') AS "DEBU", count(*) FILTER (level = 'INFO') AS "INFO",
       count(*) FILTER (level = 'WARN') AS "WARN", count(*) FILTER (level = 'ERRO') AS "ERRO", count(*) FILTER (level = 'FATA') AS "FATA"
FROM logs WHERE service <> '' GROUP BY 1""",
    "daily_counts": f"""WITH {_TIMED}, counted AS (
  SELECT CAST(make_timestamp(ts_ms * 1000) AS DATE) AS day, count(*) AS n FROM timed WHERE ts_ms IS NOT NULL GROUP BY 1),
days AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM counted)
SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM days LEFT JOIN counted USING (day)""",
    "path_listing": f"""WITH {_LOGS}
SELECT split_part(regexp_replace(path, '^/+', ''), '/', 1) AS first, count(*) AS n, CAST(sum(octet_length(encode(msg))) AS BIGINT) AS bytes
FROM logs WHERE path <> '' GROUP BY 1""",
    "ticket_ids": f"""WITH {_PATTERNS}
SELECT seq, 'INC-' || substr(md5(concat_ws('|', service, pattern)), 1, 6) AS ticket FROM patterned WHERE level IN ('ERRO', 'FATA')""",
    "latency_percentiles": f"""WITH {_NAMED}, ranked AS (
  SELECT service, latency_ms, row_number() OVER (PARTITION BY service ORDER BY latency_ms) - 1 AS r, count(*) OVER (PARTITION BY service) AS n
  FROM named WHERE latency_ms >= 0)
SELECT service, max(n) AS n, {_shares_sql()} FROM ranked GROUP BY 1""",
    "latency_stats": f"""WITH {_NAMED}
SELECT service, count(*) AS n, round(avg(latency_ms), 6) AS mean, round(median(latency_ms), 6) AS median,
       round(coalesce(stddev_samp(latency_ms), 0.0), 4) AS deviation, max(latency_ms) - min(latency_ms) AS range
FROM named WHERE latency_ms >= 0 GROUP BY 1""",
    "latency_histogram": f"""WITH {_NAMED}, kept AS (SELECT * FROM named WHERE latency_ms >= 0 AND latency_ms <= {DIRTY_MS})
SELECT *, round(100.0 * (b5 + b6) / n, 6) AS stuck_share FROM (SELECT service, count(*) AS n, {_bins_sql()} FROM kept GROUP BY 1)""",
    "caller_counts": rf"""WITH {_LOGS}
SELECT regexp_replace(caller, '\.go:\d+', '.go:N', 'g') AS place, count(*) AS n FROM logs WHERE caller <> '' GROUP BY 1""",
    "alias_join": f"""WITH {_NAMED}, alias AS (SELECT lower(alias) AS name, min(service) AS meant FROM service_alias GROUP BY 1)
SELECT coalesce(a.meant, n.service) AS service_real, count(*) AS n, count(a.meant) AS n_alias
FROM named n LEFT JOIN alias a ON a.name = n.service GROUP BY 1""",
    "error_details": rf"""WITH {_LOGS}, lined AS (
  SELECT seq, detail, split_part(regexp_replace(detail, '\r\n?', chr(10), 'g'), chr(10), 1) AS line
  FROM logs WHERE level IN ('WARN', 'ERRO', 'FATA') AND detail IS NOT NULL)
SELECT seq, substr(detail, 1, 2000) AS detail_snippet, CASE WHEN length(line) > 200 THEN substr(line, 1, 200) || '…' ELSE line END AS first_line
FROM lined""",
}
QUERIES = {name: globals()[name] for name in ORACLE}
