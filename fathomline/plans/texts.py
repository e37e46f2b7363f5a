"""Queries over references, headings, line ranges, tags and tool records."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import text
from fathomline.operators import memory
from fathomline.session import read

TAGS, CATEGORY = ("queue", "cert", "lease"), "runbooks"
LABELS = {"user": "Question", "assistant": "Answer", "system": "Setting", "tool": "Result"}


def citations(spark, sf_dir):
    """What each message refers to."""
    rows = read(spark, sf_dir, "episodic_turns").select("id", F.posexplode(text.references(F.col("content"))).alias("place", "ref"))
    return rows.select("id", "place", "ref")


def document_titles(spark, sf_dir):
    rows = read(spark, sf_dir, "documents")
    return rows.select("doc_id", text.heading(F.col("text"), F.col("doc_id").cast("string")).alias("heading"))


def source_ranges(spark, sf_dir):
    """The lines that the chunks of each document cover, from the ranges that can be read, and how many can't."""
    rows = read(spark, sf_dir, "kb_chunks").where(F.col("doc_id").isNotNull())
    ranged = rows.withColumn("r", text.line_range(F.col("source_lines")))
    return ranged.groupBy("doc_id").agg(
        F.min("r.first").alias("first"), F.max("r.last").alias("last"), F.count_if(F.col("r").isNull()).alias("n_unreadable")
    )


def chunk_versions(spark, sf_dir):
    """Chunks that were indexed again: the newest id of each place, and how many versions it has."""
    rows = read(spark, sf_dir, "kb_chunks").where(F.col("doc_id").isNotNull() & F.col("chunk_index").isNotNull())
    return rows.groupBy("doc_id", "chunk_index").agg(F.max("id").alias("id"), F.count("*").alias("versions"))


def tagged_cases(spark, sf_dir):
    """Chunks of a category whose document has one of some tags; the words of its name are its tags."""
    rows = read(spark, sf_dir, "kb_chunks").withColumn("tags", F.split("doc_id", "-"))
    wanted = F.arrays_overlap("tags", F.array(*map(F.lit, TAGS))) & (F.col("category") == CATEGORY)
    return rows.where(wanted).select("id", "doc_id", "category")


def role_labels(spark, sf_dir):
    """Messages by the label their role is shown with; other roles are shown as they are."""
    entries = [F.lit(x) for pair in LABELS.items() for x in pair]
    folded = F.lower(text.strip(F.col("role")))
    rows = read(spark, sf_dir, "episodic_turns").where(F.col("role").isNotNull())
    return rows.groupBy(F.coalesce(F.try_element_at(F.create_map(*entries), folded), folded).alias("label")).agg(F.count("*").alias("n"))


def call_records(spark, sf_dir):
    """Each tool call as the short record a prompt gets: its name, whether it succeeded, and its time if it failed."""
    calls = memory.tool_calls(read(spark, sf_dir, "episodic_turns")).where(F.col("tool_name").isNotNull() & F.col("success").isNotNull())
    record = F.to_json(F.struct("tool_name", "success", F.when(~F.col("success"), F.col("latency_ms")).alias("failed_after_ms")))
    return calls.select("id", "ord", record.alias("record"))


def call_lines(spark, sf_dir):
    """One line for each tool call."""
    calls = memory.tool_calls(read(spark, sf_dir, "episodic_turns")).where(F.col("tool_name").isNotNull())
    outcome = F.when(F.col("success"), "ok").when(~F.col("success"), "failed").otherwise("unknown")
    line = F.concat_ws(" ", "tool_name", outcome, F.concat(F.col("latency_ms").cast("string"), F.lit("ms")))
    return calls.select("id", "ord", line.alias("line"))


_REFS = "\n  UNION ALL ".join(
    f"SELECT id, {i} AS p, generate_subscripts(regexp_extract_all(coalesce(content, ''), '{p}'), 1) AS k, "
    f"unnest(regexp_extract_all(coalesce(content, ''), '{p}')) AS ref FROM episodic_turns"
    for i, p in enumerate(text.REFERENCES)
)
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
_CALLS = """parsed AS (
  SELECT id, from_json(tool_calls, '[{"tool_name":"VARCHAR","success":"BOOLEAN","latency_ms":"BIGINT"}]') AS calls
  FROM episodic_turns WHERE json_valid(tool_calls) AND json_type(tool_calls) = 'ARRAY'
),
calls AS (SELECT id, CAST(generate_subscripts(calls, 1) - 1 AS INTEGER) AS ord, unnest(calls) AS c FROM parsed)"""

ORACLE = {
    "citations": f"""WITH refs AS ({_REFS}),
firsts AS (SELECT id, ref, min(p * 100000 + k) AS spot FROM refs GROUP BY 1, 2)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY spot) - 1 AS INTEGER) AS place, ref FROM firsts""",
    "document_titles": r"""SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?m)^[ \t]*# ([^\r\n]+)', 1), ''), CAST(doc_id AS VARCHAR)) AS heading FROM documents""",
    "source_ranges": r"""WITH ranged AS (
  SELECT doc_id, try_cast(regexp_extract(source_lines, '^\s*(\d{1,9})\s*-\s*(\d{1,9})\s*$', 1) AS INTEGER) AS a,
         try_cast(regexp_extract(source_lines, '^\s*(\d{1,9})\s*-\s*(\d{1,9})\s*$', 2) AS INTEGER) AS b
  FROM kb_chunks WHERE doc_id IS NOT NULL)
SELECT doc_id, min(a) FILTER (a <= b) AS first, max(b) FILTER (a <= b) AS last, count(*) FILTER (NOT coalesce(a <= b, false)) AS n_unreadable FROM ranged GROUP BY 1""",
    "chunk_versions": """SELECT doc_id, chunk_index, max(id) AS id, count(*) AS versions FROM kb_chunks
WHERE doc_id IS NOT NULL AND chunk_index IS NOT NULL GROUP BY 1, 2""",
    "tagged_cases": f"""SELECT id, doc_id, category FROM kb_chunks
WHERE list_has_any(string_split(doc_id, '-'), {list(TAGS)}) AND category = '{CATEGORY}'""",
    "role_labels": f"""WITH folded AS (SELECT lower(regexp_replace(role, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')) AS r FROM episodic_turns WHERE role IS NOT NULL)
SELECT CASE r {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())} ELSE r END AS label, count(*) AS n FROM folded GROUP BY 1""",
    "call_records": f"""WITH {_CALLS}
SELECT id, ord, '{{"tool_name":"' || c.tool_name || '","success":' || c.success
  || CASE WHEN NOT c.success AND c.latency_ms IS NOT NULL THEN ',"failed_after_ms":' || c.latency_ms ELSE '' END || '}}' AS record
FROM calls WHERE c.tool_name IS NOT NULL AND c.success IS NOT NULL""",
    "call_lines": f"""WITH {_CALLS}
SELECT id, ord, concat_ws(' ', c.tool_name, CASE WHEN c.success THEN 'ok' WHEN NOT c.success THEN 'failed' ELSE 'unknown' END, c.latency_ms || 'ms') AS line
FROM calls WHERE c.tool_name IS NOT NULL""",
}
QUERIES = {name: globals()[name] for name in ORACLE}
