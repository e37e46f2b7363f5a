"""Queries over what is written out, batched, sampled in order, and retried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions import records, text
from fathomline.operators import evaluation, memory
from fathomline.plans import memory as stored
from fathomline.session import read
from fathomline.sources import files
from fathomline.streaming import windows

PREVIEW, BATCH, FIRST, LATEST = 120, 8, 50, 20
#: Names of errors that are worth another try (fixed values); "timeout" counts in any spelling.
RETRYABLE = ("Timeout", "Connect", "Connection", "Network", "httpx")


def exported_lines(spark, sf_dir) -> DataFrame:
    """Messages as JSON lines, written and read again: masked first and then cut short, so that no token is cut in two and shown."""
    rows = read(spark, sf_dir, "episodic_turns").where(F.col("content").isNotNull())
    clean = rows.select("id", text.mask(F.col("content")).alias("content"))
    shown = clean.select("id", text.truncated(text.first_line(F.col("content")), PREVIEW).alias("msg"), F.length("content").alias("n_chars"))
    path = f"{windows.scratch(spark)}/lines"
    files.write_json_lines(shown, path)
    return files.json_lines(spark, path, "*.json", shown.schema)


def line_batches(spark, sf_dir) -> DataFrame:
    """Messages in order of their ids, in batches of eight: first and last id of each."""
    rows = read(spark, sf_dir, "episodic_turns").select("id")
    numbered = files.with_ids(rows, ["id"], "place")
    return numbered.groupBy(F.floor((F.col("place") - 1) / BATCH).alias("batch")).agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n")
    )


def first_faults(spark, sf_dir) -> DataFrame:
    """The first fault lines in order of arrival, until there are enough."""
    rows = read(spark, sf_dir, "fault_f3_skeleton").where("is_fault_phrase")
    return rows.select("seq", "phrase_hint").orderBy("seq").limit(FIRST)


def latest_changes(spark, sf_dir) -> DataFrame:
    """The newest sign-ups and purchases, newest first."""
    rows = read(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase"))
    return rows.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(LATEST).select("event_id", "event_type", "user_id")


def sparse_windows(spark, sf_dir) -> DataFrame:
    """Events in the first minute of every five."""
    rows = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.sparse(rows, "ts", 60, 300, ["event_type"])


def call_pairs(spark, sf_dir) -> DataFrame:
    """Tools and outcomes of each message's calls, put together by their places."""
    calls = F.filter(F.from_json("tool_calls", memory.TOOL_CALLS), lambda c: c["tool_name"].isNotNull())
    rows = read(spark, sf_dir, "episodic_turns").select("id", calls.alias("calls")).where(F.size("calls") > 0)
    names, outcomes = F.transform("calls", lambda c: c["tool_name"]), F.transform("calls", lambda c: c["success"])
    pairs = rows.select("id", F.posexplode(records.zipped(names, outcomes)).alias("place", "p"))
    return pairs.select("id", "place", F.col("p.left").alias("tool_name"), F.col("p.right").alias("success"))


def retryable_errors(spark, sf_dir) -> DataFrame:
    """Lines of each level, and those of errors that are worth another try."""
    msg = F.coalesce(F.col("skel.msg"), F.lit(""))
    rows = read(spark, sf_dir, "fault_f3_skeleton").select(F.col("skel.level").alias("level"), evaluation.retryable(msg, RETRYABLE).alias("again"))
    return rows.groupBy("level").agg(F.count("*").alias("n"), F.count_if("again").alias("n_again"))


def volatility_classes(spark, sf_dir) -> DataFrame:
    """How many cases are in each class of volatility, and their share in percent."""
    return evaluation.class_shares(stored.volatility(spark, sf_dir), "class")


def profiles_without_pattern(spark, sf_dir) -> DataFrame:
    """Users about whom something was said and who met no fault."""
    users = read(spark, sf_dir, "profile").where(F.col("user_id").isNotNull()).select("user_id").distinct()
    return users.join(read(spark, sf_dir, "profile_fault_patterns").select("user_id"), "user_id", "left_anti")


_MASKED = stored._mask_sql("content")
ORACLE = {
    "exported_lines": f"""WITH clean AS (SELECT id, {_MASKED} AS m FROM episodic_turns WHERE content IS NOT NULL),
lined AS (SELECT id, m, string_split(regexp_replace(m, '\\r\\n?', chr(10), 'g'), chr(10))[1] AS l FROM clean)
SELECT id, CASE WHEN length(l) > {PREVIEW} THEN substr(l, 1, {PREVIEW}) || '…' ELSE l END AS msg, CAST(length(m) AS INTEGER) AS n_chars FROM lined""",
    "line_batches": f"""WITH placed AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM episodic_turns)
SELECT place // {BATCH} AS batch, min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM placed GROUP BY 1""",
    "first_faults": f"SELECT seq, phrase_hint FROM fault_f3_skeleton WHERE is_fault_phrase ORDER BY seq LIMIT {FIRST}",
    "latest_changes": f"""SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('signup', 'purchase')
ORDER BY ts DESC, event_id DESC LIMIT {LATEST}""",
    "sparse_windows": """SELECT epoch_ms(ts) // 300000 * 300000 AS start_ms, event_type, count(*) AS n FROM events
WHERE epoch_ms(ts) % 300000 < 60000 GROUP BY 1, 2""",
    "call_pairs": f"""WITH {stored._CALLS}, kept AS (SELECT id, list_filter(calls, lambda c: c.tool_name IS NOT NULL) AS cs FROM parsed),
placed AS (SELECT id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM kept)
SELECT id, CAST(i - 1 AS INTEGER) AS place, c.tool_name AS tool_name, c.success AS success FROM placed""",
    "retryable_errors": f"""SELECT skel.level AS level, count(*) AS n,
count(*) FILTER (regexp_matches(coalesce(skel.msg, ''), '{"|".join(RETRYABLE)}') OR contains(lower(coalesce(skel.msg, '')), 'timeout')) AS n_again
FROM fault_f3_skeleton GROUP BY 1""",
    "volatility_classes": f"""WITH classed AS ({stored.ORACLE["volatility"]})
SELECT class, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM classed GROUP BY 1""",
    "profiles_without_pattern": """SELECT DISTINCT user_id FROM profile p WHERE user_id IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM profile_fault_patterns f WHERE f.user_id = p.user_id)""",
}
QUERIES = {name: globals()[name] for name in ORACLE}
