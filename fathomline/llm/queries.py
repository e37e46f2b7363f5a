"""Queries of the operators in this subpackage, over whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import conversations, language, mixture, percentiles, pii, splitting, tokens
from fathomline.session import read

#: Rank error of the bounded partial results.
RANK_ERROR = 0.005

_PERSONAL = (("episodic_turns", "content"), ("profile_fault_patterns", "summary"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for table, text in _PERSONAL:
        one = pii.found(read(spark, sf_dir, table), "id", text).select(
            F.lit(table).alias("source_table"), "row_id", "kind", "start_pos"
        )
        out = one if out is None else out.unionByName(one)
    return out


def p1_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for table, text in _PERSONAL:
        rows = read(spark, sf_dir, table).select(
            F.lit(table).alias("source_table"), F.col("id").alias("row_id"), F.col(text).alias("masked")
        )
        one = pii.masked(rows, "masked")
        out = one if out is None else out.unionByName(one)
    return out


def _latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "fault_f3_skeleton").select(
        F.to_date("ingested_at").alias("day"),
        F.col("skel.service").alias("name"),
        F.col("skel.latency_ms").alias("latency_ms"),
    )
    return percentiles.service_of(rows, read(spark, sf_dir, "service_alias"), F.col("name"))


def _answer(rows: DataFrame, rank_error: float, *keys: str) -> DataFrame:
    return rows.select(
        *keys,
        F.col("grp").alias("service"),
        "percentile",
        F.col("value").alias("latency_ms"),
        F.col("n_values").cast("long").alias("n_values"),
        F.lit(rank_error).alias("rank_error"),
    )


def _days(spark: SparkSession, sf_dir: str, rank_error: float = 0.0) -> DataFrame:
    return percentiles.day_partials(_latencies(spark, sf_dir), "service", "latency_ms", "day", rank_error)


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(percentiles.select(percentiles.combine(_days(spark, sf_dir))), 0.0)


def p3_percentiles_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(percentiles.select(percentiles.combine(_days(spark, sf_dir, RANK_ERROR))), RANK_ERROR)


def p3_daily_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles of each single day."""
    days = _days(spark, sf_dir).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return _answer(percentiles.select(days, ("day", "grp")), 0.0, "day")


def p3_day_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("grp").alias("service"), "value", F.col("n").cast("long")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.dropped(read(spark, sf_dir, "episodic_turns"))


def p4_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversations(read(spark, sf_dir, "episodic_turns")).select(
        "session_id", "turn", "position", "role", "content", "id", "segment"
    )


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.segments(read(spark, sf_dir, "episodic_turns"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.kinds(read(spark, sf_dir, "kb_chunks"), "content").select("id", "kind")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ["id", "doc_id", "section", "chunk_index", "source_lines"]
    return splitting.split(read(spark, sf_dir, "kb_chunks"), "content", keep)


def p5_token_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 300 tokens of the public tokenizer, with an overlap of 30."""
    rows = read(spark, sf_dir, "kb_chunks")
    return splitting.split(rows, "content", ["id"], splitting.TOKEN_LIMIT, splitting.TOKEN_OVERLAP, in_tokens=True).drop("text")


def p5_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each chunk come to when they are put together again, and whether all are within the limit."""
    pieces = splitting.split(read(spark, sf_dir, "kb_chunks"), "content", ["id"])
    return splitting.rebuilt(pieces, "id").select(
        "id", F.md5("text").alias("digest"), F.length("text").alias("n_chars"), (F.col("longest") <= splitting.LIMIT).alias("within")
    )


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(read(spark, sf_dir, "documents"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    wanted = mixture.weights(read(spark, sf_dir, "source_weights"))
    sizes = mixture.sized(read(spark, sf_dir, "documents"), wanted)
    planned = mixture.plan(sizes, wanted)
    return mixture.mixture(sizes, planned), planned


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0].select("doc_id", "source", "n_tokens", "copies")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.report(*_mixed(spark, sf_dir))


def _model(spark: SparkSession, sf_dir: str) -> language.Model:
    return language.stored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "lang_reference"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.mislabelled(read(spark, sf_dir, "documents"), _model(spark, sf_dir))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.segments(read(spark, sf_dir, "documents"), _model(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found,
        p1_masked,
        p3_percentiles,
        p3_percentiles_bounded,
        p3_daily_percentiles,
        p3_day_partials,
        p4_found,
        p4_conversations,
        p4_segments,
        p5_found,
        p5_pieces,
        p5_token_pieces,
        p5_rebuilt,
        p6_ids,
        p7_mixture,
        p7_report,
        p8_found,
        p8_segments,
    )
}

_SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
_SERVICE = rf"""
aliases AS (
  SELECT lower(regexp_replace(alias, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')) AS name,
         min(lower(regexp_replace(service, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'))) AS service
  FROM service_alias WHERE alias IS NOT NULL AND service IS NOT NULL GROUP BY 1
),
lines AS MATERIALIZED (
  SELECT CAST(timezone('UTC', ingested_at) AS DATE) AS day,
         lower(regexp_replace(skel.service, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')) AS name,
         skel.latency_ms AS v
  FROM fault_f3_skeleton
),
measured AS (
  SELECT day, coalesce(a.service, l.name) AS service, v
  FROM lines l LEFT JOIN aliases a ON a.name = l.name
  WHERE l.name IS NOT NULL AND coalesce(a.service, l.name) <> '' AND day IS NOT NULL AND v >= 0
)"""
_TURNS = rf"""
cleaned AS (
  SELECT session_id, turn, id, content, created_at,
         lower(regexp_replace(role, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')) AS said_role
  FROM episodic_turns WHERE session_id IS NOT NULL AND session_id <> ''
),
known AS (
  SELECT session_id, turn, id, content, created_at,
         CASE WHEN said_role IN ('user', 'human') THEN 'user'
              WHEN said_role IN ('assistant', 'ai', 'bot') THEN 'assistant'
              WHEN said_role IN ('system', 'tool') THEN said_role END AS role
  FROM cleaned
),
message AS (
  SELECT *, content IS NOT NULL AND regexp_matches(content, '[^{_SPACE}\x{{200B}}\x{{FEFF}}]') AS said
  FROM known QUALIFY row_number() OVER (PARTITION BY session_id, turn, role ORDER BY id DESC) = 1
),
per_turn AS (
  SELECT session_id, turn, bool_or(role IS NULL) AS odd,
         coalesce(bool_or(role = 'user' AND said), false) AS asked,
         coalesce(bool_or(role = 'assistant' AND said), false) AS answered
  FROM message GROUP BY 1, 2
),
per_session AS (
  SELECT session_id, NOT bool_or(asked OR answered) AS is_empty,
         bool_or(turn IS NOT NULL AND asked AND NOT answered) AS no_reply,
         bool_or(turn IS NULL OR odd) OR bool_or(answered AND NOT asked)
           OR min(CASE WHEN asked OR answered THEN turn END) <> 1
           OR max(CASE WHEN asked OR answered THEN turn END) <> count(CASE WHEN asked OR answered THEN turn END) AS broken
  FROM per_turn GROUP BY 1
)"""
_SEGMENTS = f"""
sound AS (SELECT session_id FROM per_session WHERE NOT is_empty AND NOT no_reply AND NOT coalesce(broken, true)),
gapped AS (
  SELECT session_id, turn, role, us, us - lag(us) OVER (PARTITION BY session_id ORDER BY us, turn, role) AS gap
  FROM (SELECT session_id, turn, role, epoch_us(created_at) AS us FROM message WHERE said AND created_at IS NOT NULL) SEMI JOIN sound USING (session_id)
),
steps AS (SELECT floor(ln(greatest(gap, 1)) * {conversations.STEPS}) AS step, count(*) AS n FROM gapped WHERE gap IS NOT NULL GROUP BY 1),
reached AS (SELECT step, sum(n) OVER (ORDER BY step) AS upto, sum(n) OVER () AS total FROM steps),
calibrated AS (SELECT exp((min(step) + 1) / {conversations.STEPS}) * 4 AS gap_limit FROM reached WHERE upto >= total * CAST(0.99 AS DOUBLE)),
segmented AS (
  SELECT session_id, turn, role, us,
         CAST(sum(CAST(gap IS NULL OR gap > gap_limit AS INTEGER)) OVER (PARTITION BY session_id ORDER BY us, turn, role) AS INTEGER) AS segment
  FROM gapped, calibrated
)"""
_NO_BREAK = rf"[^{_SPACE}.,;:!?。，；：！？、]"



def _ranked_sql(*keys: str) -> str:
    by = ", ".join(keys)
    return f"""
WITH {_SERVICE},
named AS (SELECT strftime(day, '%Y-%m-%d') AS day, service, v FROM measured),
ranked AS (
  SELECT {by}, v, row_number() OVER (PARTITION BY {by} ORDER BY v) AS r, count(*) OVER (PARTITION BY {by}) AS n FROM named
)
SELECT {by}, p AS percentile, v AS latency_ms, n AS n_values, CAST(0 AS DOUBLE) AS rank_error
FROM ranked, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE)), (CAST(0.95 AS DOUBLE)), (CAST(0.99 AS DOUBLE))) AS t(p)
WHERE r = greatest(1, CAST(ceil(p * n - 1e-9) AS BIGINT))
"""


ORACLE: dict[str, str] = {
    "p3_percentiles": _ranked_sql("service"),
    "p3_daily_percentiles": _ranked_sql("day", "service"),
    "p3_day_partials": f"""
WITH {_SERVICE}
SELECT strftime(day, '%Y-%m-%d') AS day, service, v AS value, count(*) AS n FROM measured GROUP BY 1, 2, 3
""",
    "p4_found": f"""
WITH {_TURNS}
SELECT session_id, 'empty' AS reason FROM per_session WHERE is_empty
UNION ALL SELECT session_id, 'no_reply' FROM per_session WHERE NOT is_empty AND no_reply
UNION ALL SELECT session_id, 'broken' FROM per_session WHERE NOT is_empty AND coalesce(broken, true)
""",
    "p4_conversations": f"""
WITH {_TURNS}, {_SEGMENTS}
SELECT m.session_id, m.turn,
       CAST(row_number() OVER (PARTITION BY m.session_id, m.turn ORDER BY
         CASE m.role WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'tool' THEN 3 ELSE 4 END) AS INTEGER) AS position,
       m.role, content, id, segment
FROM message m SEMI JOIN sound USING (session_id) LEFT JOIN segmented s ON s.session_id = m.session_id AND s.turn = m.turn AND s.role = m.role
WHERE said
""",
    "p4_segments": f"""
WITH {_TURNS}, {_SEGMENTS}
SELECT session_id, segment, min(us) AS first_us, max(us) AS last_us, count(*) AS n_messages, count(DISTINCT turn) AS n_turns
FROM segmented GROUP BY 1, 2
""",
    "p5_rebuilt": "SELECT id, md5(content) AS digest, CAST(length(content) AS INTEGER) AS n_chars, true AS within FROM kb_chunks WHERE content <> ''",
    "p5_found": f"""
SELECT id, CASE WHEN regexp_matches(content, '{_NO_BREAK}{{1000}}{_NO_BREAK}{{201}}') THEN 'hard' ELSE 'soft' END AS kind
FROM kb_chunks WHERE length(content) > 1200
""",
}
