import math

import numpy as np
import pytest

from fathomline.operators import chunking, retrieval


def ranked(spark, lists):
    return [spark.createDataFrame([(1, i, n + 1) for n, i in enumerate(ids)] or [], "qid int, id long, rank int") for ids in lists]


def test_fusion(spark):
    got = retrieval.fused_ranks(ranked(spark, [[1, 2, 3], [3, 1, 4]]), k=60).orderBy("rank").collect()
    ids = [r["id"] for r in got]
    assert ids[0] == 1 and set(ids) == {1, 2, 3, 4} and ids.index(3) < ids.index(2)
    assert retrieval.fused_ranks(ranked(spark, [[], []])).count() == 0
    turned = retrieval.fused(ranked(spark, [[3, 1, 4], [1, 2, 3]]), 60).collect()
    assert {r["id"]: r["score"] for r in turned} == {r["id"]: r["score"] for r in retrieval.fused(ranked(spark, [[1, 2, 3], [3, 1, 4]]), 60).collect()}


def test_bm25_equals_brute_force(spark):
    texts = ["dns lookup failed", "lookup of the lookup cache", "token expired", "", None, "DNS dns dns"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = spark.createDataFrame([(1, "DNS lookup"), (2, "absent"), (3, "")], "qid int, query string")
    index = retrieval.postings(docs, "id", "text")
    got = retrieval.bm25(index, retrieval.corpus_stats(index), asked, 3).collect()
    lists = {i: (t or "").lower().split() for i, t in enumerate(texts)}
    lists = {i: w for i, w in lists.items() if w}
    mean = np.mean([len(w) for w in lists.values()])
    want = {}
    for i, w in lists.items():
        s = 0.0
        for term in ("dns", "lookup"):
            df, tf = sum(term in x for x in lists.values()), w.count(term)
            s += math.log(1 + (len(lists) - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
        if s:
            want[i] = round(s, 6)
    assert {r["id"]: r["score"] for r in got} == want
    assert {r["qid"] for r in got} == {1}


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    rng = np.random.default_rng(1)
    data = rng.normal(size=(60, 8)).astype("float32")
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(100, None), (101, [])]
    vectors = spark.createDataFrame(rows, "id long, v array<float>")
    asked = vectors.where("id % 20 = 0").withColumnRenamed("id", "qid")
    got = {}
    for r in retrieval.nearest(vectors, asked, 5).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for q in (0, 20, 40):
        order = [int(i) for i in np.argsort(1 - unit @ unit[q]) if i != q][:5]
        assert got[q] == order


def test_keyword_scores(spark):
    docs = spark.createDataFrame([(1, "DNS guide", "net", "dns"), (2, "", "dns", "x"), (3, None, None, None)], "id long, title string, category string, text string")
    asked = spark.createDataFrame([(1, "dns")], "qid int, query string")
    got = {r["id"]: r["score"] for r in retrieval.keyword(docs, asked, 5).collect()}
    assert got == {1: round(4 / 7, 3), 2: round(0.5 / 3.5, 3)}


def test_metrics(spark):
    gold = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (2, 12, 1)], "qid int, id long, rel int")
    found = spark.createDataFrame([(1, 99, 1), (1, 10, 2), (1, 11, 3)], "qid int, id long, rank int")
    got = {r["qid"]: r for r in retrieval.ir_metrics(found, gold, 5).collect()}
    assert (got[1]["recall"], got[1]["rr"]) == (1.0, 0.5)
    dcg = 3 / math.log2(3) + 1 / math.log2(4)
    assert got[1]["ndcg"] == pytest.approx(dcg / (3 + 1 / math.log2(3)), abs=1e-6)
    assert (got[2]["recall"], got[2]["rr"], got[2]["ndcg"]) == (0.0, 0.0, 0.0)


def test_rewriting(spark):
    from pyspark.sql import functions as F

    asked = spark.createDataFrame([(1, "a")], "qid int, query string")
    assert retrieval.rewritten(asked).first()["query"] == "a"
    assert retrieval.rewritten(asked, lambda q: F.lit("b")).first()["query"] == "a b"
    assert retrieval.rewritten(asked, lambda q: F.repeat(F.lit("b"), 300)).first()["query"] == "a"


def chunks_of(spark, text, symptom=None):
    docs = spark.createDataFrame([("x", "c", text)], "doc_id string, category string, text string")
    signs = spark.createDataFrame([("x", symptom)], "doc_id string, symptom string")
    return chunking.chunked(docs, signs).orderBy("chunk_index").collect()


def test_chunking_rules(spark):
    long = "# T\n\n## A\nline\nline\nline\n\n## B\nshort\n\n## C\n" + "\n\n".join("p" * 500 for _ in range(5))
    chunks = chunks_of(spark, long)
    assert [c["section"] for c in chunks] == ["A", "C", "C", "C"] and [c["chunk_index"] for c in chunks] == [0, 1, 2, 3]
    assert "short" in chunks[0]["content"] and (chunks[0]["line_start"], chunks[0]["line_end"]) == (1, 10)
    assert {(c["line_start"], c["line_end"]) for c in chunks[1:]} == {(11, 20)}
    assert all(len(c["content"]) <= 1300 for c in chunks)
    assert chunks_of(spark, "just\ntext\nhere")[0]["section"] == chunking.WHOLE
    assert [tuple(c)[3:] for c in chunks_of(spark, "one line")] == [(chunking.WHOLE, 0, "[x]\n\none line", 1, 1)]
    assert chunks_of(spark, "") == chunks_of(spark, " \n") == chunks_of(spark, None) == []
    assert [len(c["content"]) for c in chunks_of(spark, "## A\nb\n" + "p" * 3000)] == [len("[x] A\n\n## A\nb\n") + 3000]
    assert chunks_of(spark, "a\nb\nc", "slow")[0]["content"] == f"【适用症状】slow\n\n[x] {chunking.WHOLE}\n\na\nb\nc"


def test_short_sections_before_the_first_full_one_lead_it(spark):
    got = chunks_of(spark, "intro\r\n## S\r\n## F\r\n1\r\n2\r\n3\r\n## E\r\n")
    assert [(c["section"], c["line_start"], c["line_end"]) for c in got] == [("F", 3, 7)]
    assert got[0]["content"] == "[x] F\n\nintro\n## S\n## F\n1\n2\n3\n\n## E"


def test_many_sections_and_repeated_rows(spark):
    text = "\n".join(f"## s{i}\na\nb" for i in range(2000))
    docs = spark.createDataFrame([(1, None, text)] * 2 + [(None, None, "a\nb\nc")], "doc_id long, category string, text string")
    got = chunking.chunked(docs).groupBy("doc_id").count().collect()
    assert {(r["doc_id"], r["count"]) for r in got} == {(1, 4000), (None, 1)}


def test_chunked_frame(spark):
    docs = spark.createDataFrame([(1, "c", "# T\n## A\na\nb\nc"), (2, None, None), (3, "c", "")], "doc_id long, category string, text string")
    got = chunking.chunked(docs).collect()
    assert [(r["doc_id"], r["title"], r["section"], r["chunk_index"], r["line_end"]) for r in got] == [(1, "T", "A", 0, 5)]
    assert chunking.chunked(docs.limit(0)).count() == 0


def test_every_twentieth_document_and_chunk_asks(spark, sf_dir):
    from fathomline.plans import retrieval as plans
    from fathomline.session import read

    docs = read(spark, sf_dir, "documents").where("doc_id % 20 = 0 and title is not null and text is not null")
    wanted = {r[0] for r in docs.select("doc_id").collect()}
    assert wanted and wanted <= {r["qid"] for r in plans.document_bm25(spark, sf_dir).collect()}
    assert wanted <= {r["qid"] for r in plans.document_fusion(spark, sf_dir).collect()}


def test_term_search_in_small_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "DOC_BLOCK", 7)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    parts = ["dns", "dn", "lookup", "look", "锁", "token_x", "x", "reef", "cache锁x"]
    text = lambda n: " ".join(parts[i] for i in rng.integers(0, len(parts), n))
    rows = [(i, text(i % 3), text(i % 5), text(1)) for i in range(60)]
    asked = {q: text(1 + q % 3) for q in range(10)}
    docs = spark.createDataFrame(rows, "id long, title string, text string, category string")
    queries = spark.createDataFrame(list(asked.items()), "qid long, query string")
    got = {(r["qid"], r["rank"]): (r["id"], r["score"]) for r in retrieval.keyword(docs, queries, 5).collect()}
    for q, query in asked.items():
        terms = set(query.replace("cache锁x", "cache 锁 x").split())
        count = lambda t: sum(term in t for term in terms)  # noqa: B023, E731
        raw = {i: 3 * count(a) + count(b) + 0.5 * count(c) for i, a, b, c in rows}
        want = sorted(((-math.floor(v / (v + 3) * 1000 + 0.5) / 1000, i) for i, v in raw.items() if v))[:5]
        assert [got[q, k + 1] for k in range(len(want))] == [(i, -s) for s, i in want]
        assert (q, len(want) + 1) not in got


def test_snippets_show_the_first_term_that_occurs(spark):
    docs = spark.createDataFrame([(1, "", "", "x" * 200 + " lookup " + "y" * 200)], "id long, title string, category string, text string")
    asked = spark.createDataFrame([(1, "dns lookup")], "qid int, query string")
    assert "lookup" in retrieval.keyword(docs, asked, 5).first()["snippet"]


def test_hot_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 5)
    monkeypatch.setattr(retrieval, "BLOCKS_AT_ONCE", 2)
    rng = np.random.default_rng(4)
    rows = [(i, "hot" if i % 3 else f"g{i % 5}", [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "id long, grp string, v array<float>")
    asked = vectors.where("id % 20 = 0").withColumnRenamed("id", "qid")
    got = {(r["qid"], r["rank"]): r["id"] for r in retrieval.nearest(vectors, asked, 3, group="grp").collect()}
    monkeypatch.setattr(retrieval, "BLOCKS_AT_ONCE", 1000)
    assert got == {(r["qid"], r["rank"]): r["id"] for r in retrieval.nearest(vectors, asked, 3, group="grp").collect()}
    assert len(got) == 45


def test_vector_index(spark):
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(40, 16))
    data = middles[rng.integers(0, 40, 2000)] + 0.6 * rng.normal(size=(2000, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(9000, None), (9001, []), (9002, [0.0] * 16)]
    vectors = spark.createDataFrame(rows, "id long, v array<float>")
    asked = vectors.where("id % 20 = 0").withColumnRenamed("id", "qid")
    index = retrieval.vector_index(vectors, cells=32, sample=500)
    assert index.rows.count() == 2001  # every row with a vector, whether it was in the sample or not
    exact = retrieval.nearest(vectors, asked, 10)
    assert retrieval.recall(retrieval.search_index(index, asked, 10, probes=8), exact).first()["recall"] >= 0.9
    assert retrieval.recall(retrieval.search_index(index, asked, 10, probes=32), exact).first()["recall"] == 1.0
    none = vectors.limit(0)
    assert retrieval.search_index(retrieval.vector_index(none), asked, 10).count() == 0


def test_index_of_the_given_vectors_finds_nine_of_ten(spark):
    from fathomline.plans import retrieval as plans

    assert plans.vector_index_recall(spark, "/root/testdata/sf0.01").first()["recall"] >= 0.9


def test_injected_embedder(spark):
    from pyspark.sql import functions as F

    chunks = spark.createDataFrame([(1, 1, "alpha"), (2, 2, "beta")], "id long, group_id long, content string")
    index = retrieval.postings(chunks, "id", "content")
    embed = lambda rows: rows.select("id", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("v"))
    asked = spark.createDataFrame([(7, "gamma")], "qid long, query string")
    vectors = embed(chunks.select("id", F.col("content").alias("text")))
    queries = asked.join(embed(asked.select(F.col("qid").alias("id"), F.col("query").alias("text"))).withColumnRenamed("id", "qid"), "qid")
    got = retrieval.hybrid(chunks, index, retrieval.corpus_stats(index), vectors, queries, scorer=None).collect()
    assert [(r["id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    words = retrieval.term_embedder(8)(chunks.select("id", F.col("content").alias("text"))).collect()
    assert {(r["id"], len(r["v"]), sum(r["v"])) for r in words} == {(1, 8, 1.0), (2, 8, 1.0)}


def _some_documents(spark):
    rng = np.random.default_rng(5)
    parts = ["dns", "dn", "lookup", "look", "锁", "token_x", "x", "reef", "cache锁x", "4", "1648"]
    text = lambda n: " ".join(parts[i] for i in rng.integers(0, len(parts), n))
    docs = spark.createDataFrame([(i, text(i % 3), text(i % 9) or None, text(1)) for i in range(90)], "id long, title string, text string, category string")
    asked = [text(1 + q % 4) for q in range(8)]
    return docs, spark.createDataFrame([(q, asked[q % 8]) for q in range(200)] + [(900, ""), (901, None)], "qid long, query string")


def test_equal_queries_are_searched_once_and_all_answered(spark):
    docs, queries = _some_documents(spark)
    asked = retrieval.distinct_queries(queries)
    assert len(asked.qids) <= 8 and asked.frame.count() == 200
    placed = retrieval.word_index(docs, tuple(retrieval.KEYWORD_WEIGHTS))
    assert retrieval._keyword_ranks(placed, asked, 5).select("qid").distinct().count() <= 8
    got = {}
    for r in retrieval.keyword(docs, queries, 5, placed).collect():
        got.setdefault(r["qid"], set()).add(tuple(r)[1:])
    assert set(got) == set(range(200)) and all(got[q] == got[q % 8] for q in got)


def test_ties_go_to_the_smaller_id_in_any_order_of_blocks():
    asked = retrieval.Asked(np.array([7]), np.array([1]), np.array([0]), ["a"], None)
    score, least = retrieval._BM25_SCORE[1:]
    winners = retrieval._Winners(asked, 2, np.float64, score, least)
    for ids, sums in (([50, 60], [1.0, 1.0]), ([10, 70], [1.0 - 1e-9, 1.0]), ([20, 30], [0.5, 2.0])):
        winners.add(np.array(ids), np.zeros(2, int), np.arange(2), np.array(sums))
    (got,) = winners.batches()
    assert got.to_pydict() == {"qid": [7, 7], "id": [30, 10], "score": [2.0, 1.0]}


def test_lists_of_words_answer_as_postings_do(spark, monkeypatch):
    docs, queries = _some_documents(spark)
    placed = retrieval.word_index(docs, tuple(retrieval.KEYWORD_WEIGHTS))
    index = retrieval.postings(docs, "id", "text")
    by_terms = retrieval.bm25(index, retrieval.corpus_stats(index), queries, 20)
    want = sorted(map(tuple, retrieval.fused_ranks([by_terms, retrieval.keyword(docs, queries, 20)], 30, 20).collect()))
    monkeypatch.setattr(retrieval, "DOC_BLOCK", 7)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "BLOCK_WEIGHTS", 11)
    assert sorted(map(tuple, by_terms.collect())) == sorted(map(tuple, retrieval.bm25_lists(placed, queries, 20).collect()))
    again = retrieval.bm25(index, retrieval.corpus_stats(index), queries, 20)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, by_terms.collect()))
    assert sorted(map(tuple, retrieval.term_fusion(placed, queries, 30, 20).collect())) == want and want
    assert retrieval.term_fusion(placed.limit(0), queries).count() == 0 == retrieval.term_fusion(placed, queries.limit(0)).count()


def test_snippets_look_for_a_term_once_in_a_text(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SNIPPET_TERMS", 3)
    text = "The " + "a" * 150 + " DNS Lookup failed at 4 and 44; 锁 " + "b" * 150
    docs = spark.createDataFrame([(1, "dns", text, None), (2, "dns lookup", None, None), (3, "dns", "x" * 130, None), (4, "", "", "dns")], "id long, title string, text string, category string")
    asked = ["absent dns", "lookup dns", "锁 4", "44 absent failed", "zzz dns", "at", "dns"]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid long, query string")
    rows = retrieval.keyword(docs, queries, 5)
    # the text in lower case is a column of its own, which the search for terms reads
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(text" in plan and not [line for line in plan.splitlines() if "lambdafunction" in line and "lower(text" in line]
    got = {(r["qid"], r["id"]): r["snippet"] for r in rows.collect()}
    around = lambda term: text[max(0, text.lower().index(term) - 80) : text.lower().index(term) + len(term) + 80].strip()
    first = ["dns", "lookup", "锁", "44", "dns", "at", "dns"]
    assert {q: s for (q, i), s in got.items() if i == 1} == {q: around(t) for q, t in enumerate(first)}
    assert {got[q, 2] for q in (0, 1, 4, 6)} == {None} and {got[q, 3] for q in (0, 1, 4, 6)} == {"x" * 120}
    assert {got[q, 4] for q in (0, 1, 4, 6)} == {""} and len(got) == 7 + 3 * 4


def test_keyword_sums_in_halves_equal_brute_force_over_many_blocks():
    rng = np.random.default_rng(3)
    n_terms, lists = 70, [rng.choice(70, int(k), replace=False) for k in rng.integers(1, 70, 40)]
    ends = np.cumsum([len(c) for c in lists])
    asked = retrieval.Asked(np.arange(40), ends, np.concatenate([np.sort(c) for c in lists]), [str(i) for i in range(n_terms)], None)
    winners = retrieval._Winners(asked, 4, np.uint8, retrieval._keyword_score, None)
    ids, everything = rng.permutation(300), np.zeros((n_terms, 300), int)
    for place in np.array_split(np.arange(300), 9):
        hits = [(half, *np.nonzero(rng.random((n_terms, len(place))) < 0.3)) for half in (np.uint8(6), np.uint8(2), np.uint8(1))]
        for half, codes, at in hits:
            everything[codes, place[at]] += int(half)
        block = retrieval._Hits(np.ones(n_terms, bool), len(place), 300, 10)
        block.put(ids[place], np.ones(n_terms, bool), [(half, np.repeat(codes, 2), np.repeat(at, 2)) for half, codes, at in hits])
        winners.meet(*block.lines())
    for query, codes in enumerate(lists):
        score = retrieval._keyword_score(everything[codes].sum(axis=0))
        want = sorted(zip(-score, ids, strict=True))[:4]
        found = winners.found[query]
        assert list(zip(-found[1], found[0], strict=True)) == [w for w in want if w[0] < 0]
