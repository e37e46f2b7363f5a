"""Queries of document retrieval: the reference sentences are asked, chunks and documents answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.text import words
from fathomline.operators import chunking, retrieval
from fathomline.session import once, read

TOP, POOL, RRF_K, MIN_SCORE, BEST = 10, 50, 30, 0.35, 5
#: Dimensions of the default embedder.
DIMS = 64
#: Rows whose id this divides are the queries of a vector search, against all rows.
EVERY = 20


def _queries(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lang_reference").where(F.col("text").isNotNull()).select(
        F.col("item_id").alias("qid"), F.col("text").alias("query")
    )


def _title_or_sentence(text: str) -> Column:
    """What a row asks for: its title, or else its first sentence."""
    sentence = F.regexp_extract(text, r"[^\s#][^.!?。！？\n]*", 0)
    return F.when(F.col("title") != "", F.col("title")).otherwise(sentence)


def _document_queries(spark, sf_dir) -> DataFrame:
    asked = read(spark, sf_dir, "documents").where(F.col("doc_id") % EVERY == 0)
    return asked.select(F.col("doc_id").alias("qid"), _title_or_sentence("text").alias("query"))


def _docs(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "title", "category", "text")


def _index(spark, sf_dir) -> DataFrame:
    """The words of the documents, stored and found again."""
    docs = _docs(spark, sf_dir)
    return once("words", docs, lambda: retrieval.word_index(docs, tuple(retrieval.KEYWORD_WEIGHTS)))


def term_stats(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return retrieval.term_stats(retrieval.postings(docs, "id", "text")).select("term", "df", "cf")


def corpus_stats(spark, sf_dir):
    index = retrieval.postings(_docs(spark, sf_dir), "id", "text")
    return retrieval.corpus_stats(index).withColumn("mean_terms", F.round("mean_terms", 6))


def bm25_topk(spark, sf_dir):
    return retrieval.bm25_lists(_index(spark, sf_dir), _queries(spark, sf_dir), TOP)


def keyword_search(spark, sf_dir):
    return retrieval.keyword(_docs(spark, sf_dir), _queries(spark, sf_dir), BEST, _index(spark, sf_dir))


def document_bm25(spark, sf_dir):
    """The best documents, by terms, for the title of every twentieth one."""
    return retrieval.bm25_lists(_index(spark, sf_dir), _document_queries(spark, sf_dir), TOP)


def document_keywords(spark, sf_dir):
    return retrieval.keyword(_docs(spark, sf_dir), _document_queries(spark, sf_dir), BEST, _index(spark, sf_dir))


def vector_topk(spark, sf_dir):
    rows, asked = _vectors(spark, sf_dir)
    return retrieval.nearest(rows, asked, TOP)


def pattern_neighbours(spark, sf_dir):
    """The nearest fault summaries of all users to every twentieth one."""
    rows = read(spark, sf_dir, "profile_fault_patterns").select("id", F.col("embedding").alias("v"))
    asked = rows.where(F.col("id") % EVERY == 0).withColumnRenamed("id", "qid")
    return retrieval.nearest(rows, asked, BEST)


def vector_topk_filtered(spark, sf_dir):
    """The nearest fault summaries of the same user to every twentieth one, with their distance."""
    rows = read(spark, sf_dir, "profile_fault_patterns").select("id", "user_id", F.col("embedding").alias("v"))
    asked = rows.where(F.col("id") % EVERY == 0).withColumnRenamed("id", "qid")
    return retrieval.nearest(rows, asked, BEST, group="user_id")


def rrf_fusion(spark, sf_dir):
    return retrieval.term_fusion(_index(spark, sf_dir), _queries(spark, sf_dir), RRF_K, POOL)


def document_fusion(spark, sf_dir):
    return retrieval.term_fusion(_index(spark, sf_dir), _document_queries(spark, sf_dir), RRF_K, POOL)


def _chunks(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "kb_chunks").select("id", F.col("doc_id").alias("group_id"), "content")


def _embedded_chunks(spark, sf_dir) -> DataFrame:
    """``id, v`` of every chunk with terms, embedded once."""
    docs = _chunks(spark, sf_dir)
    embed = retrieval.term_embedder(DIMS)
    return once("chunk-vectors", docs, lambda: embed(docs.select("id", F.col("content").alias("text"))))


def _hybrid(spark, sf_dir, queries: DataFrame) -> DataFrame:
    docs = _chunks(spark, sf_dir)
    index = once("chunk-postings", docs, lambda: retrieval.postings(docs, "id", "content"))
    vectors = retrieval.term_embedder(DIMS)(queries.select(F.col("qid").alias("id"), F.col("query").alias("text")))
    asked = queries.join(vectors.withColumnRenamed("id", "qid"), "qid", "left")
    chunks = _embedded_chunks(spark, sf_dir)
    return retrieval.hybrid(docs, index, retrieval.corpus_stats(index), chunks, asked, POOL, RRF_K, MIN_SCORE, BEST)


def hybrid_search(spark, sf_dir):
    """Chunks for each query by terms and by embedded texts, fused, reranked, one per document."""
    return _hybrid(spark, sf_dir, _queries(spark, sf_dir))


def chunk_hybrid(spark, sf_dir):
    """``hybrid_search`` for the title of every twentieth chunk."""
    chunks = read(spark, sf_dir, "kb_chunks").where(F.col("id") % EVERY == 0)
    return _hybrid(spark, sf_dir, chunks.select(F.col("id").alias("qid"), _title_or_sentence("content").alias("query")))


def hybrid_recalled(spark, sf_dir):
    """How many chunks each search of ``hybrid_search`` recalls for a query, and how many both do."""
    docs, asked = _chunks(spark, sf_dir), _queries(spark, sf_dir)
    index = once("chunk-postings", docs, lambda: retrieval.postings(docs, "id", "content"))
    vectors = retrieval.term_embedder(DIMS)(asked.select(F.col("qid").alias("id"), F.col("query").alias("text")))
    near = retrieval.nearest(_embedded_chunks(spark, sf_dir), vectors.withColumnRenamed("id", "qid"), POOL, with_self=True)
    return retrieval.recalled([retrieval.bm25(index, retrieval.corpus_stats(index), asked, POOL), near], ["terms", "vectors"])


def chunk_vectors(spark, sf_dir):
    """The embedded chunks: each bucket that isn't empty."""
    rows = _embedded_chunks(spark, sf_dir).select("id", F.posexplode("v").alias("bucket", "n"))
    return rows.where(F.col("n") > 0).withColumn("n", F.col("n").cast("long"))


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return rows, rows.where(F.col("id") % EVERY == 0).withColumnRenamed("id", "qid")


def vector_index_topk(spark, sf_dir):
    """``vector_topk`` by an index: the neighbours in each query's nearest cells."""
    rows, asked = _vectors(spark, sf_dir)
    return retrieval.search_index(retrieval.vector_index(rows), asked, TOP)


def vector_index_recall(spark, sf_dir):
    """The share of the exact neighbours that the index finds."""
    rows, asked = _vectors(spark, sf_dir)
    return retrieval.recall(vector_index_topk(spark, sf_dir), retrieval.nearest(rows, asked, TOP))


def _gold(spark, sf_dir) -> DataFrame:
    """A document is relevant to a query if its label is the query's language, twice so if it is short."""
    asked = read(spark, sf_dir, "lang_reference").select(F.col("item_id").alias("qid"), "lang")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    return asked.join(docs, "lang").select("qid", "id", F.when(F.col("n_chars") < 800, 2).otherwise(1).alias("rel"))


def ir_metrics(spark, sf_dir):
    return retrieval.ir_metrics(bm25_topk(spark, sf_dir), _gold(spark, sf_dir), BEST)


def ir_metrics_mean(spark, sf_dir):
    """The metrics of ``ir_metrics``, averaged over all queries."""
    return retrieval.averaged(ir_metrics(spark, sf_dir))


def document_ir_metrics(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where(F.col("lang").isNotNull())
    asked = docs.where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("qid"), F.col("lang").alias("label"))
    gold = docs.select(F.col("lang").alias("label"), F.col("doc_id").alias("id"), F.when(F.col("n_chars") < 800, 2).otherwise(1).alias("rel"))
    return retrieval.ir_metrics(document_bm25(spark, sf_dir), gold, BEST, asked)


def chunk_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "category", "text")
    return chunking.chunked(docs)


def chunk_symptoms(spark, sf_dir):
    """``chunk_documents`` with each document's stored title as the symptom that leads its chunks."""
    docs = read(spark, sf_dir, "documents")
    return chunking.chunked(docs.select("doc_id", "category", "text"), docs.select("doc_id", F.col("title").alias("symptom")))


def chunk_sizes(spark, sf_dir):
    """Chunks of each knowledge document as stored: number, gaps in their order, and characters."""
    rows = read(spark, sf_dir, "kb_chunks").where(F.col("doc_id").isNotNull())
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.count_distinct("chunk_index").alias("n_places"),
        (F.max("chunk_index") + 1 - F.count_distinct("chunk_index")).alias("n_gaps"),
        F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("n_chars"),
    )


def document_terms(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n_terms"), F.size(F.array_distinct("w")).alias("n_distinct"))


def _words(column: str) -> str:
    return rf"regexp_extract_all(regexp_replace(lower(coalesce({column}, '')), '(\p{{Han}})', ' \1 ', 'g'), '[\p{{L}}\p{{N}}_]+')"


_QUERIES = "queries AS (SELECT item_id AS qid, text AS query FROM lang_reference WHERE text IS NOT NULL)"
_DOCS = "docs AS (SELECT doc_id AS id, title, category, text FROM documents)"


def _bm25_sql(docs: str, content: str) -> str:
    return f"""
listed AS MATERIALIZED (SELECT id, {_words(content)} AS w FROM {docs}),
postings AS MATERIALIZED (SELECT id, term, count(*) AS tf, any_value(n) AS n_terms FROM (SELECT id, len(w) AS n, unnest(w) AS term FROM listed) GROUP BY 1, 2),
stats AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean_terms FROM listed WHERE len(w) > 0),
asked AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest({_words("query")}) AS term FROM queries)),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
scores AS (
  SELECT qid, id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * n_terms / mean_terms))), 6) AS score
  FROM asked JOIN postings USING (term) JOIN dfs USING (term), stats GROUP BY 1, 2
),
bm25 AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM scores)"""


def _embedded_sql(table: str, key: str, text: str) -> str:
    bucket = f"CAST(('0x' || substr(md5(term), 1, 6)) AS INTEGER) % {DIMS}"
    return f"""{table}_counted AS (
  SELECT id, CAST({bucket} AS INTEGER) AS bucket, count(*) AS n FROM (SELECT {key} AS id, unnest({_words(text)}) AS term FROM {table}) GROUP BY 1, 2
)"""


_HITS = "len(list_filter(terms, lambda w: contains({0}, w)))"
_KEYWORD = f"""
termed AS MATERIALIZED (SELECT qid, list_distinct({_words("query")}) AS terms, {_words("query")} AS said FROM queries),
low AS (SELECT id, text, lower(coalesce(title, '')) AS t, lower(coalesce(category, '')) AS c, lower(coalesce(text, '')) AS x FROM docs),
raw AS (
  SELECT qid, id, text, coalesce(list_filter(said, lambda w: contains(x, w))[1], '') AS term, 3 * {_HITS.format("t")} + {_HITS.format("x")} + CAST(0.5 AS DOUBLE) * {_HITS.format("c")} AS raw
  FROM low, termed
),
keyword AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank
  FROM (SELECT qid, id, text, term, round(raw / (raw + 3), 3) AS score FROM raw WHERE raw > 0)
)"""
_SNIPPET = r"""trim(regexp_replace(CASE WHEN term <> '' AND strpos(lower(text), term) > 0
  THEN substr(text, greatest(strpos(lower(text), term) - 80, 1), strpos(lower(text), term) - greatest(strpos(lower(text), term) - 80, 1) + length(term) + 80)
  ELSE substr(text, 1, 120) END, '\s+', ' ', 'g'))"""
_NEAR = """SELECT q.{0} AS qid, d.{0} AS id, abs(round(list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6)) AS distance
FROM {1} q, {1} d WHERE q.{0} % 20 = 0 AND q.{0} <> d.{0} AND q.embedding IS NOT NULL AND d.embedding IS NOT NULL"""


def _near_sql(key: str, table: str, n: int) -> str:
    return f"""WITH pairs AS ({_NEAR.format(key, table)}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INTEGER) AS rank FROM pairs)
SELECT * FROM ranked WHERE rank <= {n}"""


_WHITE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
_STRIP = "regexp_replace({0}, '^[" + _WHITE + "]+|[" + _WHITE + "]+$', '', 'g')"


def _chunk_sql(symptom: str) -> str:
    strip = lambda c: _STRIP.replace("{0}", c)
    return rf"""WITH RECURSIVE lined AS (
  SELECT doc_id, category, CASE WHEN coalesce({symptom}, '') <> '' THEN '{chunking.SYMPTOM}' || {symptom} || chr(10) || chr(10) ELSE '' END AS lead,
         string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n\z', ''), chr(10)) AS ls
  FROM documents WHERE regexp_matches(text, '[^{_WHITE}]')
),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM lined),
named AS (
  SELECT doc_id, {strip(r"regexp_extract(arg_min(line, n), '^[ \t]*# (.+)', 1)")} AS title FROM lines
  WHERE regexp_matches(line, '^[ \t]*# .') GROUP BY 1
),
placed AS (
  SELECT *, greatest(sum(CAST(regexp_matches(line, '^[ \t]*## ') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY n), 1) AS s FROM lines
),
section AS (
  SELECT doc_id, s, min(n) AS a, max(n) AS b, string_agg(line, chr(10) ORDER BY n) AS body,
         count(*) FILTER (regexp_matches(line, '[^{_WHITE}]')) >= {chunking.LEAST_LINES} AS is_full,
         coalesce({strip(r"regexp_extract(min(line) FILTER (regexp_matches(line, '^[ \t]*## ')), '^[ \t]*## (.*)', 1)")}, '{chunking.WHOLE}') AS name
  FROM placed GROUP BY 1, 2
),
owned AS (
  SELECT *, greatest(sum(CAST(is_full AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY s), 1) AS grp, bool_or(is_full) OVER (PARTITION BY doc_id) AS any_full
  FROM section
),
framed AS (SELECT *, CASE WHEN any_full THEN min(s) FILTER (is_full) OVER (PARTITION BY doc_id, grp) ELSE max(s) OVER (PARTITION BY doc_id) END AS main FROM owned),
whole AS (
  SELECT doc_id, grp, bool_or(any_full) AS any_full, any_value(name) FILTER (s = main) AS name,
         {strip("string_agg(body, chr(10) ORDER BY s) FILTER (s <= main)")} AS body,
         coalesce(string_agg(chr(10) || chr(10) || {strip("body")}, '' ORDER BY s) FILTER (s > main), '') AS behind,
         CASE WHEN bool_or(any_full) THEN any_value(a) FILTER (s = main) ELSE 1 END AS line_start, any_value(b) FILTER (s = main) AS own_end, max(b) AS line_end
  FROM framed GROUP BY 1, 2
),
split AS (SELECT doc_id, grp, string_split(body, chr(10) || chr(10)) AS ps FROM whole WHERE any_full AND length(body) > {chunking.MOST_CHARS}),
each AS (SELECT doc_id, grp, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM split),
paragraph AS (
  SELECT doc_id, grp, p, row_number() OVER (PARTITION BY doc_id, grp ORDER BY i) AS i FROM each WHERE regexp_matches(p, '[^{_WHITE}]')
),
packing AS (
  SELECT doc_id, grp, i, p, 1 AS piece, length(p) AS size FROM paragraph WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.grp, n.i, n.p, CASE WHEN q.size + 2 + length(n.p) <= {chunking.MOST_CHARS} THEN q.piece ELSE q.piece + 1 END,
         CASE WHEN q.size + 2 + length(n.p) <= {chunking.MOST_CHARS} THEN q.size + 2 + length(n.p) ELSE length(n.p) END
  FROM packing q JOIN paragraph n ON n.doc_id = q.doc_id AND n.grp = q.grp AND n.i = q.i + 1
),
piece AS (
  SELECT doc_id, grp, piece, string_agg(p, chr(10) || chr(10) ORDER BY i) AS text FROM packing GROUP BY 1, 2, 3
  UNION ALL SELECT doc_id, grp, 1, body FROM whole WHERE NOT (any_full AND length(body) > {chunking.MOST_CHARS})
),
ended AS (SELECT *, piece = max(piece) OVER (PARTITION BY doc_id, grp) AS is_last FROM piece)
SELECT doc_id, coalesce(title, CAST(doc_id AS VARCHAR)) AS title, category, CASE WHEN any_full THEN name ELSE '{chunking.WHOLE}' END AS section,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp, piece) - 1 AS INTEGER) AS chunk_index,
       lead || '[' || coalesce(title, CAST(doc_id AS VARCHAR)) || ']' || CASE WHEN any_full THEN ' ' || name ELSE '' END || chr(10) || chr(10) || text
         || CASE WHEN is_last THEN behind ELSE '' END AS content,
       CAST(line_start AS INTEGER) AS line_start, CAST(CASE WHEN is_last THEN line_end ELSE own_end END AS INTEGER) AS line_end
FROM ended JOIN whole USING (doc_id, grp) JOIN lined USING (doc_id) LEFT JOIN named USING (doc_id)"""


ORACLE = {
    "chunk_documents": _chunk_sql("NULL"),
    "chunk_symptoms": _chunk_sql("title"),
    "term_stats": f"""WITH {_DOCS}, listed AS (SELECT id, unnest({_words("text")}) AS term FROM docs),
postings AS (SELECT id, term, count(*) AS tf FROM listed GROUP BY 1, 2)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY 1""",
    "corpus_stats": f"""WITH {_DOCS}, sizes AS (SELECT len({_words("text")}) AS n FROM docs)
SELECT count(*) AS n_docs, round(avg(n), 6) AS mean_terms FROM sizes WHERE n > 0""",
    "bm25_topk": f"WITH {_QUERIES}, {_DOCS}, {_bm25_sql('docs', 'text')} SELECT * FROM bm25 WHERE rank <= {TOP}",
    "keyword_search": f"WITH {_QUERIES}, {_DOCS}, {_KEYWORD} SELECT qid, id, score, rank, {_SNIPPET} AS snippet FROM keyword WHERE rank <= {BEST}",
    "vector_topk": _near_sql("vec_id", "embeddings", TOP),
    "pattern_neighbours": _near_sql("id", "profile_fault_patterns", BEST),
    "vector_topk_filtered": f"""WITH pairs AS ({_NEAR.format("id", "profile_fault_patterns")} AND q.user_id = d.user_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INTEGER) AS rank FROM pairs)
SELECT qid, id, distance, rank FROM ranked WHERE rank <= {BEST}""",
    "rrf_fusion": f"""WITH {_QUERIES}, {_DOCS}, {_bm25_sql('docs', 'text')}, {_KEYWORD},
lists AS (
  SELECT qid, id, rank, 0 AS list FROM bm25 WHERE rank <= {POOL}
  UNION ALL SELECT qid, id, rank, 1 FROM keyword WHERE rank <= {POOL}
),
fused AS (SELECT qid, id, round(sum(1.0::DOUBLE / ({RRF_K} + rank)), 9) AS score, min(list * 1000 + rank) AS first FROM lists GROUP BY 1, 2)
SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) AS INTEGER) AS rank FROM fused QUALIFY rank <= {POOL}""",
    "chunk_vectors": f"""WITH chunks AS (SELECT id, content FROM kb_chunks), {_embedded_sql("chunks", "id", "content")}
SELECT id, bucket, n FROM chunks_counted""",
    "hybrid_search": f"""WITH {_QUERIES},
chunks AS (SELECT id, doc_id AS group_id, content FROM kb_chunks), {_bm25_sql('chunks', 'content')},
{_embedded_sql("chunks", "id", "content")}, {_embedded_sql("queries", "qid", "query")},
chunk_norm AS (SELECT id, sqrt(sum(n * n)) AS size FROM chunks_counted GROUP BY 1),
query_norm AS (SELECT id AS qid, sqrt(sum(n * n)) AS size FROM queries_counted GROUP BY 1),
dots AS (SELECT q.id AS qid, c.id, sum(q.n * c.n) AS dot FROM queries_counted q JOIN chunks_counted c USING (bucket) GROUP BY 1, 2),
near AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS INTEGER) AS rank FROM (
    SELECT q.qid, c.id, abs(round(1 - coalesce(dot, 0) / (q.size * c.size), 6)) AS distance
    FROM query_norm q CROSS JOIN chunk_norm c LEFT JOIN dots d ON d.qid = q.qid AND d.id = c.id)
),
lists AS (
  SELECT qid, id, rank, 0 AS list FROM bm25 WHERE rank <= {POOL} UNION ALL SELECT qid, id, rank, 1 FROM near WHERE rank <= {POOL}
),
fused AS (SELECT qid, id, round(sum(1.0::DOUBLE / ({RRF_K} + rank)), 9) AS score, min(list * 1000 + rank) AS first FROM lists GROUP BY 1, 2),
pool AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) AS rank FROM fused QUALIFY rank <= {POOL}),
judged AS (
  SELECT qid, id, group_id, rank, round(len(list_intersect(list_distinct({_words("query")}), list_distinct({_words("content")}))) / greatest(len(list_distinct({_words("query")})), 1), 6) AS score
  FROM pool JOIN chunks USING (id) JOIN queries USING (qid)
),
best AS (SELECT * FROM judged WHERE score >= {MIN_SCORE} QUALIFY row_number() OVER (PARTITION BY qid, group_id ORDER BY score DESC, rank) = 1)
SELECT qid, group_id, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS INTEGER) AS rank FROM best QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, best.rank) <= {BEST}""",
    "hybrid_recalled": "",
    "ir_metrics": f"""WITH {_QUERIES}, {_DOCS}, {_bm25_sql('docs', 'text')},
gold AS (
  SELECT l.item_id AS qid, d.doc_id AS id, CASE WHEN d.n_chars < 800 THEN 2 ELSE 1 END AS rel FROM lang_reference l JOIN documents d ON d.lang = l.lang
),
got AS (
  SELECT qid, count(*) AS hits, min(rank) AS first, sum((pow(2, rel) - 1) / log2(rank + 1)) AS dcg
  FROM bm25 JOIN gold USING (qid, id) WHERE rank <= {BEST} GROUP BY 1
),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, id) AS place FROM gold),
ideal AS (SELECT qid, sum((pow(2, rel) - 1) / log2(place + 1)) AS ideal FROM placed WHERE place <= {BEST} GROUP BY 1),
wanted AS (SELECT qid, count(*) AS n_gold FROM gold GROUP BY 1)
SELECT qid, round(coalesce(hits / n_gold, 0), 6) AS recall, round(coalesce(1 / first, 0), 6) AS rr, round(coalesce(dcg / ideal, 0), 6) AS ndcg
FROM wanted JOIN ideal USING (qid) LEFT JOIN got USING (qid)""",
    "chunk_sizes": """SELECT doc_id, count(*) AS n, count(DISTINCT chunk_index) AS n_places, max(chunk_index) + 1 - count(DISTINCT chunk_index) AS n_gaps,
CAST(coalesce(sum(length(content)), 0) AS BIGINT) AS n_chars FROM kb_chunks WHERE doc_id IS NOT NULL GROUP BY 1""",
    "document_terms": f"""WITH listed AS (SELECT doc_id, {_words("text")} AS w FROM documents)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_terms, CAST(len(list_distinct(w)) AS INTEGER) AS n_distinct FROM listed""",
}
#: The same statements, asked by every twentieth document or chunk.
_ASKED = r"coalesce(nullif(title, ''), regexp_extract({0}, '[^\s#][^.!?。！？\n]*')) AS query"
_DOCUMENT_QUERIES = f"queries AS (SELECT doc_id AS qid, {_ASKED.format('text')} FROM documents WHERE doc_id % {EVERY} = 0)"
for _new, _old in (("document_bm25", "bm25_topk"), ("document_keywords", "keyword_search"), ("document_fusion", "rrf_fusion"), ("document_ir_metrics", "ir_metrics")):
    ORACLE[_new] = ORACLE[_old].replace(_QUERIES, _DOCUMENT_QUERIES).replace(
        "SELECT l.item_id AS qid, d.doc_id AS id", "SELECT l.doc_id AS qid, d.doc_id AS id"
    ).replace("FROM lang_reference l JOIN documents d ON d.lang = l.lang", f"FROM documents l JOIN documents d ON d.lang = l.lang WHERE l.doc_id % {EVERY} = 0")
ORACLE["chunk_hybrid"] = ORACLE["hybrid_search"].replace(
    _QUERIES, f"queries AS (SELECT id AS qid, {_ASKED.format('content')} FROM kb_chunks WHERE id % {EVERY} = 0)"
)
_recalled, _, _ = ORACLE["hybrid_search"].partition(",\nfused AS (")
ORACLE["hybrid_recalled"] = f"""{_recalled}
SELECT qid, count(*) FILTER (list = 0) AS n_terms, count(*) FILTER (list = 1) AS n_vectors, count(*) - count(DISTINCT id) AS n_several FROM lists GROUP BY 1"""
ORACLE["ir_metrics_mean"] = f"""SELECT count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg
FROM ({ORACLE["ir_metrics"]})"""
QUERIES = {name: globals()[name] for name in [*ORACLE, "vector_index_topk", "vector_index_recall"]}
