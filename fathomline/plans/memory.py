"""Queries over stored conversations and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions import text
from fathomline.operators import evaluation, memory
from fathomline.session import read, spread

KEEP, SPAN = 3, 4
NEWEST = 3
#: Tools that are expected, and what their arguments have to hold.
EXPECTED = ((("search_logs", "trace_lookup"), {}), (("kb_search", "search_sop"), {"minutes": "5"}))
KEYWORDS = ("error", "restart", "lease", "重启", "错误")
FORBIDDEN = ("without any warning", "没有任何征兆")


def _turns(spark, sf_dir) -> DataFrame:
    return memory.upserted(read(spark, sf_dir, "episodic_turns"))


def turn_upsert(spark, sf_dir):
    return _turns(spark, sf_dir).select("session_id", "turn", "role", "id", "content")


def recent_turns(spark, sf_dir):
    rows = memory.recent(_turns(spark, sf_dir), KEEP)
    return rows.select("session_id", "turn", memory.role_order(F.col("role")).alias("role_order"), "role", "id")


def turn_counts(spark, sf_dir):
    return memory.session_counts(read(spark, sf_dir, "episodic_turns").where(F.col("session_id").isNotNull()))


def token_estimate(spark, sf_dir):
    return memory.estimated_tokens(_turns(spark, sf_dir))


def compaction_ranges(spark, sf_dir):
    return memory.compaction(_turns(spark, sf_dir), KEEP)


def summaries(spark, sf_dir):
    return memory.summaries(_turns(spark, sf_dir), SPAN, KEEP)


def summaries_supersede(spark, sf_dir):
    return memory.superseded(memory.summaries(_turns(spark, sf_dir), SPAN, KEEP), 2)


def episodic_context(spark, sf_dir):
    return memory.context(_turns(spark, sf_dir), SPAN, KEEP)


def rendered_context(spark, sf_dir):
    return memory.rendered(memory.context(_turns(spark, sf_dir), SPAN, KEEP))


def whole_summaries(spark, sf_dir):
    """``summaries`` with the turns between the last whole span and the recent ones."""
    return memory.summaries(_turns(spark, sf_dir), SPAN, KEEP, tail=True)


def whole_summaries_supersede(spark, sf_dir):
    return memory.superseded(whole_summaries(spark, sf_dir), 2)


def whole_context(spark, sf_dir):
    """``episodic_context`` without a lost turn: every turn from number 1 on is in a summary or among the recent ones."""
    return memory.context(_turns(spark, sf_dir), SPAN, KEEP, tail=True)


def whole_rendered_context(spark, sf_dir):
    return memory.rendered(whole_context(spark, sf_dir))


def tool_stats(spark, sf_dir):
    calls = memory.tool_calls(read(spark, sf_dir, "episodic_turns")).where(F.col("tool_name").isNotNull())
    return calls.groupBy("tool_name").agg(
        F.count("*").alias("n"),
        F.count_if("success").alias("n_success"),
        F.round(F.avg("latency_ms"), 4).alias("mean_ms"),
        F.max("latency_ms").alias("most_ms"),
    )


def profile_latest(spark, sf_dir):
    keyed = _statements(spark, sf_dir)
    return memory.latest(keyed, ["user_id", "field"]).select("user_id", "field", "value", "id")


def profile_newest(spark, sf_dir):
    keyed = _statements(spark, sf_dir)
    return memory.newest(keyed, ["user_id", "field"], NEWEST).select("user_id", "field", "place", "value", "id")


def profile_versions(spark, sf_dir):
    """The whole history of each field, newest first; ``profile_newest`` is its top 3."""
    keyed = _statements(spark, sf_dir)
    return memory.all_versions(keyed, ["user_id", "field"]).select("user_id", "field", "place", "value", "id")


def _statements(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "profile").where(F.col("created_at").isNotNull())
    return rows.withColumns({"user_id": text.fold_key(F.col("user_id")), "field": text.fold_key(F.col("field"))})


def patterns_without_profile(spark, sf_dir):
    """Fault summaries of users about whom nothing was ever said."""
    users = read(spark, sf_dir, "profile").select("user_id").distinct()
    return read(spark, sf_dir, "profile_fault_patterns").join(users, "user_id", "left_anti").select("id", "user_id")


def sources_without_weight(spark, sf_dir):
    """Sources of documents that have no weight, and weights that have no documents."""
    docs = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    weights = read(spark, sf_dir, "source_weights").select("source")
    return (
        docs.join(weights, "source", "left_anti")
        .select("source", "n", F.lit("no weight").alias("problem"))
        .unionByName(
            weights.join(docs, "source", "left_anti").select("source", F.lit(0).cast("long").alias("n"), F.lit("no documents").alias("problem"))
        )
    )


def _scored(spark, sf_dir) -> DataFrame:
    """Every message with tool calls, scored by its calls, the services it cites and its words."""
    rows = read(spark, sf_dir, "episodic_turns").select(
        "id", "session_id", "turn", F.coalesce("content", F.lit("")).alias("answer"),
        F.filter(F.from_json("tool_calls", memory.TOOL_CALLS), lambda c: c["tool_name"].isNotNull()).alias("calls"),
    )
    # what the user of the same turn refers to counts as a citation as well
    asked = read(spark, sf_dir, "episodic_turns").where((F.col("role") == "user") & F.col("session_id").isNotNull() & F.col("turn").isNotNull())
    said = asked.groupBy("session_id", "turn").agg(F.max_by(F.coalesce("content", F.lit("")), "id").alias("asked"))
    rows = rows.where(F.size("calls") > 0).join(said, ["session_id", "turn"], "left")
    actual = F.transform("calls", lambda c: F.struct(c["tool_name"].alias("tool_name"), c["args"].alias("args")))
    args = lambda a: F.create_map(*[F.lit(x) for pair in a.items() for x in pair]).cast("map<string,string>")
    wanted = F.array(*[F.struct(F.array(*map(F.lit, t)).alias("tools"), args(a).alias("args")) for t, a in EXPECTED])
    services = F.array_distinct(
        F.array_compact(F.transform("calls", lambda c: F.try_element_at(c["args"], F.lit("service"))))
    )
    listed = lambda xs: F.array(*map(F.lit, xs))
    difficulty = F.element_at(listed(("easy", "medium", "hard")), (F.pmod(F.coalesce("turn", F.lit(0)), F.lit(3)) + 1).cast("int"))
    refs = text.references(F.col("asked"), (r"[a-z]+-[a-z]+(?:@\d+\.\d+\.\d+)?",))
    return rows.select(
        "id", "session_id", difficulty.alias("difficulty"),
        evaluation.tool_score(actual, wanted).alias("tool"),
        evaluation.citation_score(F.col("answer"), refs, services).alias("cite"),
        evaluation.conclusion_score(F.col("answer"), listed(KEYWORDS), F.lit(2)).alias("conclusion"),
        evaluation.forbidden_penalty(F.col("answer"), listed(FORBIDDEN)).alias("penalty"),
    ).withColumn(
        "total",
        evaluation.total_score(F.col("difficulty"), F.col("tool"), F.col("cite"), F.col("conclusion"), F.col("penalty")),
    )


def eval_scores(spark, sf_dir):
    rounded = {c: F.round(c, 4) for c in ("tool", "cite", "conclusion", "penalty")}
    parts = {c: F.col(c) for c in ("tool", "cite", "conclusion")}
    return _scored(spark, sf_dir).withColumn("reasons", evaluation.failure_reasons(F.col("total"), parts)).withColumns(rounded)


def report_by_group(spark, sf_dir):
    return evaluation.report_by_group(_scored(spark, sf_dir), "difficulty", "total", "id")


def forbidden_rate(spark, sf_dir):
    return evaluation.forbidden_rate(_scored(spark, sf_dir), "difficulty", "total", "penalty")


def score_matrix(spark, sf_dir):
    """Mean scores of sessions by difficulty."""
    rows = _scored(spark, sf_dir).where(F.col("session_id").isNotNull())
    return evaluation.score_matrix(rows, "session_id", "difficulty", "total", ["easy", "medium", "hard"])


def volatility(spark, sf_dir):
    return evaluation.volatility(_scored(spark, sf_dir).where(F.col("session_id").isNotNull()), "session_id", "total")


def fan_out_gather(spark, sf_dir):
    """The tools a session used, as hypotheses: fanned out, weighed by their calls, and gathered again."""
    calls = memory.tool_calls(read(spark, sf_dir, "episodic_turns"))
    calls = calls.where(F.col("session_id").isNotNull() & F.col("tool_name").isNotNull())
    used = calls.groupBy("session_id", "tool_name").agg(F.count("*").alias("confidence"))
    runs = used.groupBy(F.col("session_id").alias("run_id")).agg(F.array_sort(F.collect_list("tool_name")).alias("hypotheses"))
    out = evaluation.fanned_out(runs)
    results = out.join(
        used.select(F.col("session_id").alias("run_id"), F.col("tool_name").alias("hypothesis"), "confidence"), ["run_id", "hypothesis"]
    ).withColumn("summary", F.concat_ws("=", "hypothesis", F.col("confidence").cast("string")))
    return evaluation.gathered(results)


def ulid_decode(spark, sf_dir):
    """The moment in each time-ordered identifier that a message refers to."""
    found = F.array_distinct(F.regexp_extract_all("content", F.lit("01[0-9A-HJKMNP-TV-Z]{24}"), F.lit(0)))
    rows = read(spark, sf_dir, "episodic_turns").select("id", F.explode(found).alias("ulid"))
    return rows.withColumn("ms", text.ulid_millis(F.col("ulid")))


def mask_rules(spark, sf_dir):
    """Messages masked by ordered rules, as they are before they are shown."""
    rows = spread(read(spark, sf_dir, "episodic_turns").select("id", "content"))
    return rows.select("id", text.mask(F.col("content")).alias("masked"))


def mask_twice(spark, sf_dir):
    """How many messages change when they are masked again: none."""
    once = mask_rules(spark, sf_dir).where(F.col("masked").isNotNull())
    return once.agg(F.count("*").alias("n"), F.count_if(text.mask(F.col("masked")) != F.col("masked")).alias("changed"))


_UPSERT = """turns AS (
  SELECT session_id, turn, role, id, content FROM episodic_turns
  WHERE session_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY session_id, turn, role ORDER BY id DESC) = 1
)"""
_RECENT = f"""{_UPSERT},
recent AS (SELECT * FROM turns QUALIFY turn > max(turn) OVER (PARTITION BY session_id) - {KEEP})"""
_SUMMARIES = f"""{_UPSERT},
lasts AS (SELECT session_id, max(turn) AS last_turn FROM turns GROUP BY 1),
spans AS (
  SELECT session_id, (turn - 1) // {SPAN} AS part, concat_ws(':', turn, role, content) AS line, length(coalesce(content, '')) AS n_chars
  FROM turns JOIN lasts USING (session_id)
  WHERE turn >= 1 AND ((turn - 1) // {SPAN} + 1) * {SPAN} <= last_turn - {KEEP}
),
summary AS (
  SELECT session_id, 1 AS level, CAST(part * {SPAN} + 1 AS INTEGER) AS covers_start, CAST((part + 1) * {SPAN} AS INTEGER) AS covers_end,
         count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS n_chars, md5(string_agg(line, '|' ORDER BY line)) AS digest
  FROM spans GROUP BY session_id, part
),
per AS (SELECT session_id, count(*) AS n, min(covers_start) AS a, max(covers_end) AS b, CAST(sum(n_rows) AS BIGINT) AS r FROM summary GROUP BY 1)"""
_CONTEXT = f"""{_SUMMARIES},
lines AS (
  SELECT session_id, 0 AS block, covers_start AS place, 1 AS rank, '[' || covers_start || '-' || covers_end || ']' AS line
  FROM summary JOIN per USING (session_id) WHERE n < 4
  UNION ALL SELECT session_id, 0, a, 2, '[' || a || '-' || b || ']' FROM per WHERE n >= 4
  UNION ALL SELECT session_id, 1, turn, CASE WHEN role = 'user' THEN 0 ELSE 1 END, concat_ws(': ', role, coalesce(content, ''))
  FROM (SELECT * FROM turns QUALIFY turn > max(turn) OVER (PARTITION BY session_id) - {KEEP})
)"""
_TAILED = f"""{_UPSERT},
lasts AS (SELECT session_id, max(turn) - {KEEP} AS ends FROM turns GROUP BY 1),
summary AS (
  SELECT session_id, 1 AS level, CAST((turn - 1) // {SPAN} * {SPAN} + 1 AS INTEGER) AS covers_start,
         CAST(least(((turn - 1) // {SPAN} + 1) * {SPAN}, any_value(ends)) AS INTEGER) AS covers_end, count(*) AS n_rows,
         CAST(sum(length(coalesce(content, ''))) AS BIGINT) AS n_chars,
         md5(string_agg(concat_ws(':', turn, role, content), '|' ORDER BY concat_ws(':', turn, role, content))) AS digest
  FROM turns JOIN lasts USING (session_id) WHERE turn BETWEEN 1 AND ends GROUP BY session_id, (turn - 1) // {SPAN}
),
per AS (SELECT session_id, count(*) AS n, min(covers_start) AS a, max(covers_end) AS b, CAST(sum(n_rows) AS BIGINT) AS r FROM summary GROUP BY 1)"""
_TAILED_CONTEXT = f"""{_TAILED}, lines AS (
  SELECT session_id, 0 AS block, covers_start AS place, 1 AS rank, '[' || covers_start || '-' || covers_end || ']' AS line
  FROM summary JOIN per USING (session_id) WHERE n < 4
  UNION ALL SELECT session_id, 0, a, 2, '[' || a || '-' || b || ']' FROM per WHERE n >= 4
  UNION ALL SELECT session_id, 1, turn, CASE WHEN role = 'user' THEN 0 ELSE 1 END, concat_ws(': ', role, coalesce(content, ''))
  FROM turns JOIN lasts USING (session_id) WHERE turn > ends
)"""
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
_FOLD = (
    "lower(regexp_replace(regexp_replace({0}, '^[" + _SPACE + "]+|[" + _SPACE + "]+$', '', 'g'), '[" + _SPACE + "]+', ' ', 'g'))"
)
_STATED = f"stated AS (SELECT {_FOLD.replace('{0}', 'user_id')} AS user_id, {_FOLD.replace('{0}', 'field')} AS field, value, id, created_at FROM profile WHERE created_at IS NOT NULL)"
_CALLS = """parsed AS (
  SELECT id, session_id, turn, coalesce(content, '') AS answer,
         from_json(tool_calls, '[{"tool_name":"VARCHAR","args":{"service":"VARCHAR","minutes":"VARCHAR"},"success":"BOOLEAN","latency_ms":"BIGINT"}]') AS calls
  FROM episodic_turns WHERE json_valid(tool_calls) AND json_type(tool_calls) = 'ARRAY'
),
calls AS (SELECT id, session_id, unnest(calls, max_depth := 2) FROM parsed)"""
_KEYWORD_HITS = " + ".join(f"CAST(contains(lower(answer), '{k}') AS INTEGER)" for k in KEYWORDS)
_FORBIDDEN_HITS = " + ".join(f"CAST(contains(lower(answer), '{k}') AS INTEGER)" for k in FORBIDDEN)
_SCORED = f"""{_CALLS},
said AS (
  SELECT session_id, turn, arg_max(coalesce(content, ''), id) AS asked FROM episodic_turns
  WHERE role = 'user' AND session_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2
),
messages AS (
  SELECT id, session_id, turn, answer, list_filter(calls, lambda c: c.tool_name IS NOT NULL) AS calls,
         list_distinct(regexp_extract_all(coalesce(asked, ''), '[a-z]+-[a-z]+(?:@\\d+\\.\\d+\\.\\d+)?')) AS refs
  FROM parsed LEFT JOIN said USING (session_id, turn)
),
based AS (
  SELECT *, list_distinct(list_filter(list_transform(calls, lambda c: c.args.service), lambda s: s IS NOT NULL)) AS services,
         list_transform(calls, lambda c: c.tool_name) AS tools
  FROM messages WHERE len(calls) > 0
),
parts AS (
  SELECT id, session_id, ['easy', 'medium', 'hard'][((coalesce(turn, 0) % 3) + 3) % 3 + 1] AS difficulty,
         (CAST(list_has_any(tools, ['search_logs', 'trace_lookup']) AS INTEGER) + CAST(len(list_filter(calls, lambda c: c.tool_name IN ('kb_search', 'search_sop') AND contains(coalesce(c.args.minutes, ''), '5'))) > 0 AS INTEGER)) / 2 AS tool,
         CASE WHEN len(services) = 0 THEN 1.0 ELSE len(list_filter(services, lambda s: contains(lower(answer), lower(s)) OR len(list_filter(refs, lambda r: contains(lower(r), lower(s)))) > 0)) / len(services) END AS cite,
         CASE WHEN answer = '' THEN 0.0 ELSE least(({_KEYWORD_HITS}) / 2, 1.0) END AS conclusion,
         least(({_FORBIDDEN_HITS}) * CAST(0.1 AS DOUBLE), CAST(0.3 AS DOUBLE)) AS penalty
  FROM based
),
scored AS (
  SELECT *, round(greatest(CASE difficulty
    WHEN 'hard' THEN CAST(0.1 AS DOUBLE) * tool + CAST(0.4 AS DOUBLE) * cite + CAST(0.5 AS DOUBLE) * conclusion
    WHEN 'medium' THEN CAST(0.2 AS DOUBLE) * tool + CAST(0.4 AS DOUBLE) * cite + CAST(0.4 AS DOUBLE) * conclusion
    ELSE CAST(0.4 AS DOUBLE) * tool + CAST(0.3 AS DOUBLE) * cite + CAST(0.3 AS DOUBLE) * conclusion END - penalty, 0.0), 4) AS total
  FROM parts
)"""


def _mask_sql(column: str, times: int = 1) -> str:
    out = column
    for _ in range(times):
        out = rf"regexp_replace({out}, '\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', '<JWT>', 'g')"
        for pattern, by in text.MASK_RULES:
            for _ in range(2 if "<ID_CARD>" in by or "<PHONE>" in by else 1):
                out = f"regexp_replace({out}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return out


ORACLE = {
    "turn_upsert": f"WITH {_UPSERT} SELECT * FROM turns",
    "recent_turns": f"WITH {_RECENT} SELECT session_id, turn, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS role_order, role, id FROM recent",
    "turn_counts": """SELECT session_id, count(DISTINCT turn) AS n_turns, coalesce(max(turn), 0) AS last_turn, coalesce(max(turn), 0) + 1 AS next_turn
FROM episodic_turns WHERE session_id IS NOT NULL GROUP BY 1""",
    "token_estimate": f"WITH {_UPSERT} SELECT session_id, CAST(floor(coalesce(sum(length(content)), 0) / 2) AS BIGINT) AS tokens FROM turns GROUP BY 1",
    "compaction_ranges": f"""WITH {_UPSERT}, sized AS (
  SELECT session_id, count(DISTINCT turn) AS n_turns, max(turn) AS last_turn, CAST(floor(coalesce(sum(length(content)), 0) / 2) AS BIGINT) AS tokens
  FROM turns GROUP BY 1),
reasoned AS (SELECT *, CASE WHEN n_turns >= 8 THEN 'rounds' WHEN tokens >= 2800 THEN 'tokens' ELSE 'none' END AS reason FROM sized)
SELECT session_id, n_turns, tokens, reason, CASE WHEN reason <> 'none' AND last_turn - {KEEP} >= 1 THEN 1 END AS covers_start,
       CASE WHEN reason <> 'none' AND last_turn - {KEEP} >= 1 THEN last_turn - {KEEP} END AS covers_end FROM reasoned""",
    "summaries": f"WITH {_SUMMARIES} SELECT * FROM summary",
    "summaries_supersede": f"""WITH {_SUMMARIES}
SELECT session_id, level, covers_start, covers_end, n_rows, n >= 2 AS superseded FROM summary JOIN per USING (session_id)
UNION ALL SELECT session_id, 2, a, b, r, false FROM per WHERE n >= 2""",
    "episodic_context": f"WITH {_CONTEXT} SELECT * FROM lines",
    "rendered_context": f"WITH {_CONTEXT} SELECT session_id, string_agg(line, chr(10) ORDER BY block, place, rank, line) AS text FROM lines GROUP BY 1",
    "whole_summaries": f"WITH {_TAILED} SELECT * FROM summary",
    "whole_summaries_supersede": f"""WITH {_TAILED}
SELECT session_id, level, covers_start, covers_end, n_rows, n >= 2 AS superseded FROM summary JOIN per USING (session_id)
UNION ALL SELECT session_id, 2, a, b, r, false FROM per WHERE n >= 2""",
    "whole_context": f"WITH {_TAILED_CONTEXT} SELECT * FROM lines",
    "whole_rendered_context": f"WITH {_TAILED_CONTEXT} SELECT session_id, string_agg(line, chr(10) ORDER BY block, place, rank, line) AS text FROM lines GROUP BY 1",
    "tool_stats": f"""WITH {_CALLS}
SELECT tool_name, count(*) AS n, count(*) FILTER (success) AS n_success, round(avg(latency_ms), 4) AS mean_ms, max(latency_ms) AS most_ms
FROM calls WHERE tool_name IS NOT NULL GROUP BY 1""",
    "profile_latest": f"""WITH {_STATED} SELECT user_id, field, value, id FROM stated
QUALIFY row_number() OVER (PARTITION BY user_id, field ORDER BY created_at DESC, id DESC) = 1""",
    "profile_newest": f"""WITH {_STATED}, placed AS (
  SELECT user_id, field, CAST(row_number() OVER (PARTITION BY user_id, field ORDER BY created_at DESC, id DESC) AS INTEGER) AS place, value, id FROM stated)
SELECT * FROM placed WHERE place <= {NEWEST}""",
    "profile_versions": f"""WITH {_STATED}
SELECT user_id, field, row_number() OVER (PARTITION BY user_id, field ORDER BY created_at DESC, id DESC) AS place, value, id FROM stated""",
    "patterns_without_profile": """SELECT p.id, p.user_id FROM profile_fault_patterns p
WHERE NOT EXISTS (SELECT 1 FROM profile q WHERE q.user_id = p.user_id)""",
    "sources_without_weight": """WITH docs AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT source, n, 'no weight' AS problem FROM docs d WHERE NOT EXISTS (SELECT 1 FROM source_weights w WHERE w.source = d.source)
UNION ALL SELECT source, 0, 'no documents' FROM source_weights w WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE w.source = d.source)""",
    "eval_scores": f"""WITH {_SCORED}
SELECT id, session_id, difficulty, round(tool, 4) AS tool, round(cite, 4) AS cite, round(conclusion, 4) AS conclusion, round(penalty, 4) AS penalty, total,
       CASE WHEN total < 0.7 THEN concat_ws(', ', CASE WHEN tool < 0.5 THEN 'tool' END, CASE WHEN cite < 0.5 THEN 'cite' END,
         CASE WHEN conclusion < 0.5 THEN 'conclusion' END) END AS reasons FROM scored""",
    "report_by_group": f"""WITH {_SCORED}
SELECT difficulty, count(*) AS n, round(avg(total), 6) AS mean_score, round(avg(CAST(total >= 0.7 AS INTEGER)), 6) AS pass_rate,
       arg_min(id, (total, id)) AS worst_case FROM scored GROUP BY 1""",
    "forbidden_rate": f"""WITH {_SCORED}
SELECT difficulty, count(*) AS n, round(avg(CAST(penalty > 0 AS INTEGER)), 6) AS forbidden_rate FROM scored GROUP BY 1""",
    "score_matrix": f"""WITH {_SCORED}
SELECT session_id, {", ".join(f"round(avg(total) FILTER (difficulty = '{d}'), 6) AS {d}" for d in ("easy", "medium", "hard"))}
FROM scored WHERE session_id IS NOT NULL GROUP BY 1""",
    "volatility": f"""WITH {_SCORED}, spread AS (
  SELECT session_id, count(*) AS n_runs, count(total) AS n_scored, round(median(total), 6) AS median, round(max(total) - min(total), 6) AS range
  FROM scored WHERE session_id IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN n_scored = 0 THEN 'all errors' WHEN range = 0 THEN 'stable' WHEN range <= 0.2 THEN 'small' WHEN range <= 0.3 THEN 'medium' ELSE 'large' END AS class
FROM spread""",
    "fan_out_gather": f"""WITH {_CALLS}, used AS (
  SELECT session_id, tool_name, count(*) AS confidence FROM calls WHERE session_id IS NOT NULL AND tool_name IS NOT NULL GROUP BY 1, 2),
chosen AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tool_name) AS ord FROM used QUALIFY ord <= 3)
SELECT session_id AS run_id, count(*) AS n, string_agg(tool_name || '=' || confidence, ' | ' ORDER BY confidence DESC, ord) AS summary FROM chosen GROUP BY 1""",
    "ulid_decode": f"""WITH found AS (SELECT id, unnest(list_distinct(regexp_extract_all(content, '01[0-9A-HJKMNP-TV-Z]{{24}}'))) AS ulid FROM episodic_turns)
SELECT id, ulid, CAST(list_sum(list_transform(range(1, 11), lambda i: (instr('{text.CROCKFORD}', substr(ulid, CAST(i AS INTEGER), 1)) - 1) * pow(32, 10 - i))) AS BIGINT) AS ms
FROM found""",
    "mask_rules": f"SELECT id, {_mask_sql('content')} AS masked FROM episodic_turns",
    "mask_twice": f"""WITH once AS (SELECT {_mask_sql('content')} AS m FROM episodic_turns WHERE content IS NOT NULL)
SELECT count(*) AS n, count(*) FILTER ({_mask_sql('m')} <> m) AS changed FROM once""",
}
QUERIES = {name: globals()[name] for name in ORACLE}
