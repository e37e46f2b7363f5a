"""Document retrieval: inverted index, term and vector search, fusion and reranking.

All searches take a table of queries, ``qid`` and ``query``, and answer all of
them in one job. Ties are broken by id, so ranks are the same in every run.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.text import snippet_at, words
from fathomline.session import BROADCAST_ROWS, cut, spread, spread_rows

K1, B = 1.5, 0.75
#: Vectors in a block; a pair of blocks is compared by one matrix product.
BLOCK = 2048
#: Documents in a block of a term search, and distinct queries that are asked in one pass over the documents.
DOC_BLOCK, QUERY_BLOCK = 4096, 16_384
#: A block's documents by its terms at most, its terms' weights at most, and documents that share a partition.
BLOCK_CELLS, BLOCK_WEIGHTS, PART_DOCS = 1 << 26, 1 << 19, 65_536
#: Terms that are looked for in a text by one row.
SNIPPET_TERMS = 256
#: A term that one in so many of a block's documents has is added up as a whole line, others entry by entry.
DENSE = 16
#: Blocks of a group that are compared in one task.
BLOCKS_AT_ONCE = 16
#: Cells of a vector index, and rows that their centres are fitted on at most.
CELLS, INDEX_SAMPLE = 64, 20_000
#: The share of neighbours within the sample that the probed cells are to hold, and the queries and neighbours it is measured on.
TARGET, PROBE_QUERIES, PROBE_NEIGHBOURS = 0.95, 256, 10


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``term, id, tf, n_terms, first``: the inverted index. Write it once with ``cut`` or to a table, and search it often.

    ``first`` marks the term that a document begins with, one posting per document.
    """
    rows = spread(docs.select(F.col(key).alias("id"), F.col(text).alias("_t")))
    listed = rows.select("id", words(F.col("_t")).alias("_w"))
    terms = listed.select("id", F.size("_w").alias("n_terms"), F.posexplode("_w").alias("_place", "term"))
    return terms.groupBy("term", "id", "n_terms").agg(F.count("*").alias("tf"), (F.min("_place") == 0).alias("first"))


def term_stats(index: DataFrame) -> DataFrame:
    """``term, df, cf``: documents with a term, and its occurrences."""
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: ``n_docs`` with terms and their mean length, from the index alone."""
    return index.where("first").agg(F.count("*").alias("n_docs"), F.avg("n_terms").alias("mean_terms"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``qid, term``: the distinct terms of each query."""
    return queries.select("qid", F.explode(F.array_distinct(words(F.col("query")))).alias("term"))


def _ranked(scores: DataFrame, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id"))
    return scores.withColumn("rank", place).where(F.col("rank") <= n)


class Asked(NamedTuple):
    """Queries by their distinct lists of terms: each list is searched once, for the smallest ``qid`` that has it.

    ``terms`` are sorted; query i has ``codes[ends[i - 1]:ends[i]]``, ascending. ``frame`` has
    ``asked, qid, terms``: which list answers which query.
    """

    qids: np.ndarray
    ends: np.ndarray
    codes: np.ndarray
    terms: list[str]
    frame: DataFrame | None

    def block(self, start: int, stop: int) -> tuple[Asked, np.ndarray]:
        """Some of the queries, with codes of their own, and the codes that these had."""
        begin = self.ends[start - 1] if start else 0
        ends = self.ends[start:stop]
        used, codes = np.unique(self.codes[begin : ends[-1] if len(ends) else begin], return_inverse=True)
        return Asked(self.qids[start:stop], ends - begin, codes, [self.terms[i] for i in used], None), used


def distinct_queries(queries: DataFrame) -> Asked:
    """The distinct lists of terms pass through the driver; the queries themselves don't."""
    listed = queries.where(F.col("qid").isNotNull()).select(F.col("qid").cast("long").alias("qid"), words(F.col("query")).alias("_w"))
    terms = F.array_distinct(F.flatten(F.collect_list("_w")))
    listed = cut(listed.groupBy("qid").agg(terms.alias("terms")).where(F.size("terms") > 0))
    firsts = cut(listed.groupBy("terms").agg(F.min("qid").alias("asked")))
    table = firsts.toArrow()
    lists = table.column("terms").combine_chunks()
    flat = lists.flatten() if len(lists) else pa.array([], pa.string())
    names = sorted(pc.unique(flat).to_pylist())
    codes = pc.index_in(flat, value_set=pa.array(names, flat.type)).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = codes[np.lexsort((codes, np.repeat(np.arange(len(sizes)), sizes)))]
    return Asked(table.column("asked").to_numpy(), np.cumsum(sizes), codes, names, listed.join(firsts, "terms"))


def bm25(index: DataFrame, stats: DataFrame, queries: DataFrame, n: int = 50) -> DataFrame:
    """``qid, id, score, rank``: the n best documents of each query by BM25; documents without any of its terms aren't listed.

    Only postings of query terms leave the index. ``stats`` has one row, which passes through the driver,
    as do the query terms.
    """
    asked = distinct_queries(queries)
    spark, total = queries.sparkSession, stats.first()
    coded = pa.table({"term": pa.array(asked.terms, pa.string()), "code": pa.array(range(len(asked.terms)), pa.int32())})
    terms = spark.createDataFrame(coded)
    if len(asked.terms) <= BROADCAST_ROWS:
        terms = F.broadcast(terms)
    # the index has one row per term and document, so its rows of a term are the term's documents
    known = index.where(F.col("id").isNotNull()).join(terms, "term").select(F.col("id").cast("long").alias("id"), "code", "tf", "n_terms")
    n_docs, mean = total["n_docs"], float(total["mean_terms"] or 1.0)
    frequency = index.join(terms, "term").groupBy("code").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = frequency.select("code", idf.alias("weight")).toArrow()
    weights = np.zeros(len(asked.terms))
    weights[weighted.column("code").to_numpy()] = weighted.column("weight").to_numpy()
    parts = max(2 * spark.sparkContext.defaultParallelism, math.ceil(n_docs / PART_DOCS))
    rows = known.repartition(parts, "id").sortWithinPartitions("id")
    shared, most = spark.sparkContext.broadcast(weights), (DOC_BLOCK, BLOCK_WEIGHTS)

    def entries(batches: Iterator[pa.RecordBatch], asked: Asked, used: np.ndarray) -> Iterator[_Entries]:
        place = np.full(len(shared.value), -1)
        place[used] = np.arange(len(used))
        for ids, codes, tf, n_terms in _whole_documents(batches, most[1]):
            some = place[codes] >= 0
            ids, codes, tf, n_terms = ids[some], codes[some], tf[some], n_terms[some]
            size = K1 * (1 - B + B * n_terms / mean)
            values = shared.value[codes] * (tf / (tf + size))
            names, at = np.unique(ids, return_inverse=True)
            for part in np.array_split(np.arange(len(names)), max(1, math.ceil(len(names) / most[0]))):
                if len(part):
                    own = slice(*np.searchsorted(at, (part[0], part[-1] + 1)))
                    yield names[part], place[codes[own]], at[own] - part[0], values[own]

    return _for_all(_ranked(_best(rows, entries, asked, n, *_BM25_SCORE), n), asked).select("qid", "id", "score", "rank")


#: How sums of BM25 are held and rounded, and what a sum of a given score isn't less than.
_BM25_SCORE = (np.float64, lambda s: np.round(s, 6), lambda s: s - 1e-6)


def bm25_lists(placed: DataFrame, queries: DataFrame, n: int = 50, text: str = "text") -> DataFrame:
    """What ``bm25`` gives, from a ``word_index``, which has one row per id, instead of postings.

    Words are counted in the tasks that read their documents, so nothing of the documents is shuffled.
    The query terms pass through the driver, with the number of documents of each.
    """
    asked = distinct_queries(queries)
    return _for_all(_bm25_ranks(placed, asked, n, text), asked).select("qid", "id", "score", "rank")


def _bm25_ranks(placed: DataFrame, asked: Asked, n: int, text: str = "text") -> DataFrame:
    context, listed = placed.sparkSession.sparkContext, placed.select("id", F.col(text).alias("words"))
    everything, size = context.broadcast(asked.terms), DOC_BLOCK

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(everything.value, pa.string())
        # behind the terms' numbers of documents: documents with words, and all their words
        counts = np.zeros(len(terms) + 2, np.int64)
        for table in _tables(batches, size):
            _, codes, _, sizes = _counted(table, terms)
            counts[:-2] += np.bincount(codes, minlength=len(terms))
            counts[-2:] += (sizes > 0).sum(), sizes.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["code", "n"])

    summed = listed.mapInArrow(frequencies, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(asked.terms) + 2, np.int64)
    counts[summed.column("code").to_numpy()] = summed.column("n").to_numpy()
    n_docs, mean = int(counts[-2]), int(counts[-1]) / max(1, int(counts[-2]))
    weights = context.broadcast(np.array([math.log(1 + (n_docs - int(df) + 0.5) / (int(df) + 0.5)) for df in counts[:-2]]))

    def entries(batches: Iterator[pa.RecordBatch], asked: Asked, used: np.ndarray) -> Iterator[_Entries]:
        terms, own = pa.array(asked.terms, pa.string()), weights.value[used]
        for table in _tables(batches, size):
            at, codes, tf, sizes = _counted(table, terms)
            values = own[codes] * (tf / (tf + K1 * (1 - B + B * sizes[at] / mean)))
            yield table.column("id").to_numpy(), codes, at, values

    return _ranked(_best(listed, entries, asked, n, *_BM25_SCORE), n)


def _counted(table: pa.Table, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The place of a document, the code of a term and how often it has it, for the terms in ``words``; and the documents' sizes."""
    each, sizes = _split(table.column("words"))
    codes = pc.fill_null(pc.index_in(each, value_set=terms), -1).to_numpy().astype(np.int64)
    pairs, tf = np.unique((np.repeat(np.arange(len(sizes)), sizes) * len(terms) + codes)[codes >= 0], return_counts=True)
    return pairs // max(1, len(terms)), pairs % max(1, len(terms)), tf, sizes


def _whole_documents(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list[np.ndarray]]:
    """Columns of at least ``least`` rows, except for the last ones, that don't end within an id. Rows are sorted by id."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
        if n >= least:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            end = int(np.searchsorted(columns[0], columns[0][-1]))
            if end:
                yield [c[:end] for c in columns]
            held, n = [[c[end:] for c in columns]], n - end
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def word_index(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``id`` and the words of each of a document's columns in their order, with a space between two; null without any.

    Write it once and search it often.
    """
    rows = spread_rows(docs.where(F.col("id").isNotNull()).select("id", *columns), "id")
    return rows.select(F.col("id").cast("long").alias("id"), *[F.nullif(F.array_join(words(F.col(c)), " "), F.lit("")).alias(c) for c in columns])


def _split(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows of a ``word_index``, and how many each row has."""
    lists = pc.split_pattern(column.combine_chunks(), " ")
    return lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


def term_finder(terms: list[str]) -> Callable[[str], list[int]]:
    """A function that gives the places of all ``terms`` that a word contains: its pieces are looked up where a term's first two characters are."""
    whole = {t: i for i, t in enumerate(terms)}
    single = {t: i for t, i in whole.items() if len(t) == 1}
    heads: dict[str, set[int]] = {}
    for t in terms:
        if len(t) > 1:
            heads.setdefault(t[:2], set()).add(len(t))
    sizes = {head: tuple(lengths) for head, lengths in heads.items()}

    def find(word: str) -> list[int]:
        found = {single[c] for c in set(word) if c in single}
        for i in range(len(word) - 1):
            for size in sizes.get(word[i : i + 2], ()):
                code = whole.get(word[i : i + size])
                if code is not None:
                    found.add(code)
        return list(found)

    return find


#: What a hit in each column counts in a keyword search (fixed values).
KEYWORD_WEIGHTS = {"title": 3.0, "text": 1.0, "category": 0.5}


def _keyword_score(halves: np.ndarray) -> np.ndarray:
    """The score of sums in halves."""
    sums = halves / 2
    return np.floor(sums / (sums + 3) * 1000 + 0.5) / 1000


def _keyword_ranks(placed: DataFrame, asked: Asked, n: int) -> DataFrame:
    columns, halves = tuple(KEYWORD_WEIGHTS), [np.uint8(2 * weight) for weight in KEYWORD_WEIGHTS.values()]
    most = (DOC_BLOCK, BLOCK_CELLS)

    def entries(batches: Iterator[pa.RecordBatch], asked: Asked, used: np.ndarray) -> Iterator[_Lines]:
        find, n_terms = term_finder(asked.terms), len(asked.terms)
        known: dict[str, np.ndarray] = {}
        block: _Hits | None = None
        # documents whose hits would fit into one block even if they had all the terms
        for table in _tables(batches, max(1, min(most[0], most[1] // max(1, n_terms)))):
            if len(known) > 100_000:
                known.clear()
            n_docs, hits, seen = table.num_rows, [], np.zeros(n_terms, bool)
            for half, column in zip(halves, columns, strict=True):
                each, sizes = _split(table.column(column))
                coded = each.dictionary_encode()
                per_word = []
                for word in coded.dictionary.to_pylist():
                    if (codes := known.get(word)) is None:
                        codes = known[word] = np.array(find(word), np.int64)
                    per_word.append(codes)
                if not per_word:
                    continue
                lengths, flat = np.array([len(c) for c in per_word]), np.concatenate(per_word)
                seen[flat] = True
                at = coded.indices.to_numpy()
                held = lengths[at]
                doc = np.repeat(np.arange(n_docs), sizes)
                # the place in flat of each word's first term, less the number of entries before the word
                shift = (np.cumsum(lengths) - lengths)[at] - (np.cumsum(held) - held)
                codes = flat[np.repeat(shift, held) + np.arange(held.sum())]
                hits.append((half, codes, np.repeat(doc, held)))
            if block is not None and not block.fits(seen, n_docs):
                yield block.lines()
                block = None
            block = block or _Hits(seen, n_docs, 4 * most[0], most[1])
            block.put(table.column("id").to_numpy(), seen, hits)
        if block is not None:
            yield block.lines()

    found = _best(placed.select("id", *columns), entries, asked, n, np.uint8, _keyword_score, add=_Winners.meet)
    return _ranked(found, n)


class _Hits:
    """What each document of a block counts for each term, in halves: a line for each term that any of them has."""

    def __init__(self, seen: np.ndarray, n_docs: int, docs: int, cells: int):
        n = max(1, int(seen.sum()))
        # more documents bring more terms, about as many again
        width = max(n_docs, min(docs, cells // (2 * n)))
        self.counts = np.zeros((max(n, cells // width), width), np.uint8)
        self.row, self.n_rows, self.ids, self.n_docs = np.full(len(seen), -1), 0, [], 0

    def fits(self, seen: np.ndarray, n_docs: int) -> bool:
        new = int((seen & (self.row < 0)).sum())
        return self.n_docs + n_docs <= self.counts.shape[1] and self.n_rows + new <= self.counts.shape[0]

    def put(self, ids: np.ndarray, seen: np.ndarray, hits: list[tuple[np.uint8, np.ndarray, np.ndarray]]) -> None:
        """``hits`` has a column's weight, and the terms and documents of its words; a term counts once for a column."""
        new = np.flatnonzero(seen & (self.row < 0))
        self.row[new] = self.n_rows + np.arange(len(new))
        self.n_rows += len(new)
        cells = self.counts.reshape(-1)
        for half, codes, docs in hits:
            # places that are named several times are added to once
            cells[self.row[codes] * self.counts.shape[1] + (self.n_docs + docs)] += half
        self.ids.append(ids)
        self.n_docs += len(ids)

    def lines(self) -> _Lines:
        counts = self.counts[: self.n_rows, : self.n_docs]
        lines: list = [None] * len(self.row)
        for code in np.flatnonzero(self.row >= 0).tolist():
            lines[code] = counts[self.row[code]]
        most = np.zeros(len(self.row), np.int64)
        most[self.row >= 0] = counts.max(axis=1)[self.row[self.row >= 0]]
        return np.concatenate(self.ids), lines, most


def term_fusion(placed: DataFrame, queries: DataFrame, k: int = 30, n: int = 50) -> DataFrame:
    """``qid, id, score, rank``: ``bm25_lists`` and ``keyword`` of a ``word_index``, n of each, fused; equal queries are fused once."""
    asked = distinct_queries(queries)
    lists = [_bm25_ranks(placed, asked, n), _keyword_ranks(placed, asked, n)]
    return _for_all(fused_ranks(lists, k, n), asked).select("qid", "id", "score", "rank")


def keyword(docs: DataFrame, queries: DataFrame, n: int = 5, placed: DataFrame | None = None) -> DataFrame:
    """``qid, id, score, rank, snippet``: title hits count three, text hits one, category hits a half, s / (s + 3).

    A term also counts inside of words, once for a column. ``placed`` is the ``word_index`` of the three columns, if there is one already.
    """
    asked = distinct_queries(queries)
    placed = word_index(docs, tuple(KEYWORD_WEIGHTS)) if placed is None else placed
    best = cut(_keyword_ranks(placed, asked, n))
    lists = asked.frame.where(F.col("qid") == F.col("asked")).select("asked", "terms")
    shown = _with_snippets(docs, best.withColumnRenamed("qid", "asked").join(lists, "asked"))
    return _for_all(shown.withColumnRenamed("asked", "qid"), asked).select("qid", "id", "score", "rank", "snippet")


def _with_snippets(docs: DataFrame, best: DataFrame) -> DataFrame:
    """``asked, id, score, rank, snippet`` of ``asked, id, score, rank, terms``: the text around the first of the terms that it has, or its head.

    A text is read and put into lower case once for all lists of terms, and a term is looked for once in it.
    Tasks share the texts evenly, wherever they are stored.
    """
    terms = best.select("asked", "id", "score", "rank", F.posexplode(F.concat("terms", F.array(F.lit("")))).alias("place", "term"))
    held = terms.groupBy("id").agg(F.collect_set("term").alias("held"))
    starts = F.sequence(F.lit(1), F.size("held"), F.lit(SNIPPET_TERMS))
    wanted = cut(held.select("id", F.explode(F.transform(starts, lambda i: F.slice("held", i, SNIPPET_TERMS))).alias("terms")))
    texts = docs.select("id", "text").join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "id")
    parts = 2 * docs.sparkSession.sparkContext.defaultParallelism
    # lower case comes before the exchange, so that it isn't made again for each term
    spread_texts = texts.withColumn("low", F.lower("text")).repartition(parts, "id", F.get("terms", F.lit(0)))
    places = F.transform("terms", lambda t: F.struct(t.alias("term"), F.when(t == "", 0).otherwise(F.position(t, F.col("low"))).alias("at")))
    found = spread_texts.select("id", "text", F.inline(F.filter(places, lambda p: (p["term"] == "") | (p["at"] > 0))))
    snippets = found.select("id", "term", snippet_at(F.col("text"), F.col("term"), F.col("at")).alias("snippet"))
    first = F.min(F.struct("place", "snippet"))["snippet"].alias("snippet")
    return terms.join(snippets, ["id", "term"]).groupBy("asked", "id", "score", "rank").agg(first)


def _for_all(answers: DataFrame, asked: Asked) -> DataFrame:
    """The answers to each distinct list of terms for all queries that have it."""
    return answers.withColumnRenamed("qid", "asked").join(asked.frame.select("asked", "qid"), "asked").drop("asked")


#: Some documents' ids, and the code, the place among the ids and the weight of each of their terms.
_Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: Some documents' ids, each term's weights in them (all of them, or places and weights, or None), and the largest of these.
_Lines = tuple[np.ndarray, list, np.ndarray]


def _tables(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches put together or cut to ``size`` rows; the last table has fewer."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


class _Winners:
    """The n best documents so far of each query, over any number of blocks; ties go to the smaller id.

    Sums are of ``kind``: floats with ``least``, a sum below which a sum's score is lower than the given one, or
    small integers, whose scores don't fall.
    """

    def __init__(self, asked: Asked, n: int, kind: type, score: Callable, least: Callable | None):
        self.codes = [c.tolist() for c in np.split(asked.codes, asked.ends[:-1])] if len(asked.ends) else []
        self.flat, self.starts = asked.codes, asked.ends - np.diff(asked.ends, prepend=0)
        self.qids, self.n_terms, self.n, self.kind, self.score, self.least = asked.qids, len(asked.terms), n, kind, score, least
        self.found: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(self.codes)
        #: Sums below can't be among the best, nor those below ``above`` of documents behind the last one found.
        self.tiny = float(np.finfo(kind).tiny) if least else 1
        self.floor = np.full(len(self.codes), self.tiny, np.float64 if least else np.int64)
        self.above, self.last = self.floor.copy(), np.full(len(self.codes), np.iinfo(np.int64).max)
        self.scores = np.zeros(0)

    def add(self, ids: np.ndarray, codes: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(codes, kind="stable")
        codes, at, values = codes[order], at[order], values[order].astype(self.kind, copy=False)
        counts = np.bincount(codes, minlength=self.n_terms)
        ends = np.cumsum(counts)
        lines: list = [None] * self.n_terms
        most = np.zeros(self.n_terms, self.kind)
        np.maximum.at(most, codes, values)
        for code in np.flatnonzero(counts).tolist():
            own = slice(ends[code] - counts[code], ends[code])
            if counts[code] * DENSE >= len(ids):
                lines[code] = np.zeros(len(ids), self.kind)
                lines[code][at[own]] = values[own]
            else:
                lines[code] = (at[own], values[own])
        self.meet(ids, lines, most)

    def meet(self, ids: np.ndarray, lines: list, most: np.ndarray) -> None:
        if not self.codes or not len(ids):
            return
        # no sum is more than the largest weights together
        bound = np.add.reduceat(most[self.flat], self.starts)
        if not self.least and bound.max() >= len(self.scores):
            self.scores = self.score(np.arange(2 * int(bound.max()) + 1))
        floor = np.where(self.last < ids.min(), self.above, self.floor)
        # floats may be added up in another order
        some = np.flatnonzero(bound * (1 + 1e-9) >= floor)
        narrow, wide = np.empty(len(ids), self.kind), np.empty(len(ids), self.kind if self.least else np.int64)
        fits = np.ones(len(bound), bool) if self.least else bound <= np.iinfo(self.kind).max
        for query, lowest, is_narrow in zip(some.tolist(), floor[some].tolist(), fits[some].tolist(), strict=True):
            sums = narrow if is_narrow else wide
            sums.fill(0)
            # in the order of terms, so that equal sums are added up equally
            for code in self.codes[query]:
                line = lines[code]
                if line is None:
                    continue
                if type(line) is tuple:
                    sums[line[0]] += line[1]
                else:
                    np.add(sums, line, out=sums)
            if sums.max() >= lowest:
                hit = (sums >= lowest).nonzero()[0]
                self._merge(query, ids[hit], self.score(sums[hit]) if self.least else self.scores[sums[hit]])

    def _merge(self, query: int, ids: np.ndarray, got: np.ndarray) -> None:
        before = self.found[query]
        if before is not None:
            if len(before[0]) == self.n:
                last_id, last = before[0][-1], before[1][-1]
                better = (got > last) | ((got == last) & (ids < last_id))
                if not better.any():
                    return
                ids, got = ids[better], got[better]
            ids, got = np.concatenate((before[0], ids)), np.concatenate((before[1], got))
        if len(got) > 2 * self.n:
            most = got >= np.partition(got, len(got) - self.n)[len(got) - self.n]
            ids, got = ids[most], got[most]
        order = np.lexsort((ids, -got))[: self.n]
        self.found[query] = ids[order], got[order]
        if len(order) == self.n:
            last = got[order[-1]]
            self.last[query] = ids[order[-1]]
            if self.least:
                self.floor[query] = self.above[query] = max(self.tiny, float(self.least(last)))
            else:
                self.floor[query] = max(self.tiny, np.searchsorted(self.scores, last))
                self.above[query] = max(self.tiny, np.searchsorted(self.scores, last, side="right"))

    def batches(self) -> Iterator[pa.RecordBatch]:
        some = [(qid, *one) for qid, one in zip(self.qids, self.found, strict=True) if one is not None]
        for start in range(0, len(some), 1000):
            qids, ids, scores = zip(*some[start : start + 1000], strict=True)
            columns = np.repeat(np.array(qids, np.int64), [len(x) for x in ids]), np.concatenate(ids), np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["qid", "id", "score"])


def _best(
    rows: DataFrame,
    entries: Callable[[Iterator[pa.RecordBatch], Asked, np.ndarray], Iterator[_Entries | _Lines]],
    asked: Asked,
    n: int,
    kind: type,
    score: Callable[[np.ndarray], np.ndarray],
    least: Callable[[float], float] | None = None,
    add: Callable[..., None] = _Winners.add,
) -> DataFrame:
    """``qid, id, score`` of the n best documents of each distinct query in each partition of ``rows``; weights of its terms are added up.

    ``entries`` makes blocks of documents of a partition; a block of queries meets them one after
    another and keeps its best, so pairs of a query and a document are never rows. ``kind``, ``score`` and ``least`` are those
    of ``_Winners``, ``add`` its method that takes what ``entries`` makes.
    """
    context, found = rows.sparkSession.sparkContext, None
    for start in range(0, max(1, len(asked.qids)), QUERY_BLOCK):
        shared = context.broadcast(asked.block(start, start + QUERY_BLOCK))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            some, used = shared.value
            winners = _Winners(some, n, kind, score, least)
            for block in entries(batches, some, used):
                add(winners, *block)
            yield from winners.batches()

        part = rows.mapInArrow(search, "qid long, id long, score double")
        found = part if found is None else found.unionByName(part)
    return found


# --- vectors -----------------------------------------------------------------


def _packed(vectors: DataFrame, prefix: str, grouped: bool) -> DataFrame:
    """Rows of up to BLOCK vectors each: their group, ids, and one packed matrix of unit vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                rows = np.array(part.column("v").to_pylist(), np.float64)
                size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
                unit = np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)
                names, ids = part.column("grp").to_pylist(), part.column("id").to_pylist()
                edges = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
                spans = list(zip(edges, edges[1:], strict=False))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[a] for a, _ in spans], pa.string()),
                        pa.array([ids[a:b] for a, b in spans], pa.list_(pa.int64())),
                        pa.array([unit[a:b].tobytes() for a, b in spans], pa.binary()),
                    ],
                    names=["grp", f"{prefix}_ids", f"{prefix}_data"],
                )

    if grouped:  # salted, so that a large group fills blocks in many tasks
        vectors = vectors.repartition("grp", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("grp")
    return vectors.mapInArrow(pack, f"grp string, {prefix}_ids array<long>, {prefix}_data binary")


def nearest(vectors: DataFrame, queries: DataFrame, n: int = 10, with_self: bool = False, group: str | None = None) -> DataFrame:
    """``qid, id, distance, rank``: the n nearest vectors of each query by cosine distance, exactly.

    ``vectors`` has ``id, v`` and ``queries`` ``qid, v``; rows without a vector
    are left out. With ``group`` only vectors of the query's own group are
    compared. Blocks of vectors meet blocks of queries; only the n best of each
    pair of blocks go on to be ranked, pairs of vectors are never rows.
    """
    has = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())
    if group:
        has = has & F.col(group).isNotNull()
    name = F.col(group).cast("string") if group else F.lit("")
    data = _packed(vectors.where(has).select(name.alias("grp"), F.col("id").cast("long"), "v"), "d", bool(group))
    asked = _packed(queries.where(has).select(name.alias("grp"), F.col("qid").cast("long").alias("id"), "v"), "q", bool(group))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, qids = np.array(row["d_ids"]), np.array(row["q_ids"])
                d = np.frombuffer(row["d_data"]).reshape(len(ids), -1)
                q = np.frombuffer(row["q_data"]).reshape(len(qids), -1)
                distance = np.abs(np.round(1 - q @ d.T, 6))  # no negative zeros
                blank = ~d.any(axis=1)[None, :] | ~q.any(axis=1)[:, None]
                if not with_self:
                    blank = blank | (qids[:, None] == ids[None, :])
                distance[blank] = np.inf
                order = np.lexsort((np.broadcast_to(ids, distance.shape), distance), axis=1)[:, :n]
                best = np.take_along_axis(distance, order, axis=1)
                keep = np.isfinite(best)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.broadcast_to(qids[:, None], best.shape)[keep]),
                        pa.array(ids[order][keep]),
                        pa.array(best[keep]),
                    ],
                    names=["qid", "id", "distance"],
                )

    met = _met_in_groups(data, asked) if group else data.drop("grp").crossJoin(asked.drop("grp"))
    pairs = met.select("d_ids", "d_data", "q_ids", "q_data").mapInArrow(compare, "qid long, id long, distance double")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= n)


def _met_in_groups(data: DataFrame, asked: DataFrame) -> DataFrame:
    """Blocks of vectors with the blocks of queries of their group; a group of many blocks is split, and its queries repeated."""
    n_salts = F.ceil(F.sum(F.size("d_ids")) / F.lit(BLOCK * BLOCKS_AT_ONCE)).cast("int")
    sizes = data.groupBy("grp").agg(F.greatest(n_salts, F.lit(1)).alias("salts"))
    salted = data.join(sizes, "grp").withColumn("salt", F.pmod(F.xxhash64("d_ids"), F.col("salts")).cast("int")).drop("salts")
    repeated = asked.join(sizes, "grp").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return salted.join(repeated, ["grp", "salt"]).drop("salt")


# --- an index of vectors -----------------------------------------------------


class VectorIndex(NamedTuple):
    """Cells of vectors around centres: ``id, v, cell`` of every row, the centres, and the cells a query has to look into."""

    rows: DataFrame
    centres: np.ndarray
    probes: int


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _nearest_cells(vectors: DataFrame, centres: np.ndarray, n: int, name: str) -> DataFrame:
    """Rows with the ``n`` nearest cells of each, one row a cell."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    names = vectors.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(shared.value):
                near = _unit(np.array(batch.column("v").to_pylist(), np.float64)) @ shared.value.T
                cells = np.argsort(-near, axis=1, kind="stable")[:, :n]
                taken = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1])))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells.ravel().astype(np.int32))], names=[*names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(assign, f"{schema}, {name} int")


def vector_index(vectors: DataFrame, cells: int = CELLS, sample: int = INDEX_SAMPLE, rounds: int = 20) -> VectorIndex:
    """An index over every row with a vector of ``id, v``.

    The centres are fitted by k-means of directions on the driver, on at most ``sample`` rows, those
    of the smallest hashes; every row is then put into the cell of its nearest centre where it is read.
    The sample also says into how many cells a query has to look: those that hold ``TARGET`` of the nearest
    neighbours within the sample, which are farther off than those among all rows.
    """
    has = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())
    rows = vectors.where(has).select(F.col("id").cast("long").alias("id"), "v")
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    data = _unit(np.array(some.column("v").to_pylist(), np.float64)) if some.num_rows else np.zeros((0, 1))
    centres = data[:: max(1, len(data) // cells)][:cells].copy()
    for _ in range(rounds if len(data) else 0):
        at = (data @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, data)
        centres = np.where(np.bincount(at, minlength=len(centres))[:, None] > 0, _unit(sums), centres)
    return VectorIndex(cut(_nearest_cells(rows, centres, 1, "cell")), centres, _probes(data, centres))


def _probes(data: np.ndarray, centres: np.ndarray) -> int:
    if len(data) < 2:
        return 1
    own = np.arange(0, len(data), max(1, len(data) // PROBE_QUERIES))
    near = data[own] @ data.T
    near[np.arange(len(own)), own] = -np.inf
    n = min(PROBE_NEIGHBOURS, len(data) - 1)
    neighbours = np.argpartition(-near, n - 1, axis=1)[:, :n]
    cells = (data @ centres.T).argmax(axis=1)[neighbours]
    places = np.argsort(np.argsort(-(data[own] @ centres.T), axis=1, kind="stable"), axis=1)
    return int(np.quantile(np.take_along_axis(places, cells, axis=1), TARGET, method="higher")) + 1


def search_index(index: VectorIndex, queries: DataFrame, n: int = 10, probes: int | None = None, with_self: bool = False) -> DataFrame:
    """``nearest`` among the vectors of each query's ``probes`` nearest cells, the index's own number by default.

    Approximate, unless all cells are probed; ``nearest`` itself is the exact way.
    """
    has = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())
    asked = _nearest_cells(queries.where(has).select("qid", "v"), index.centres, probes or index.probes, "cell")
    return nearest(index.rows, asked, n, with_self, group="cell")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``n_queries, n_exact, recall``: the share of exact neighbours that a search found."""
    hit = exact.join(found.select("qid", "id").withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return hit.agg(
        F.count_distinct("qid").alias("n_queries"), F.count("*").alias("n_exact"), F.round(F.count("hit") / F.count("*"), 6).alias("recall")
    )


def term_embedder(dims: int = 64) -> Callable[[DataFrame], DataFrame]:
    """The default embedder: ``id, text`` to ``id, v``, the number of a text's terms in each of ``dims`` buckets.

    Any function of the same shape can be injected instead, such as one that runs a model in ``mapInArrow``.
    """

    def embed(rows: DataFrame) -> DataFrame:
        bucket = F.pmod(F.conv(F.substring(F.md5("term"), 1, 6), 16, 10).cast("int"), F.lit(dims))
        terms = rows.select("id", F.explode(words(F.col("text"))).alias("term"))
        counted = terms.groupBy("id", bucket.alias("bucket")).agg(F.count("*").alias("n"))
        held = F.map_from_entries(F.collect_list(F.struct("bucket", "n")))
        at = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.coalesce(F.try_element_at(F.col("held"), d), F.lit(0)).cast("float"))
        return counted.groupBy("id").agg(held.alias("held")).select("id", at.alias("v"))

    return embed


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


# --- fusion ------------------------------------------------------------------


def fused(lists: list[DataFrame], k: int = 30) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists: ``qid, id, score``; equal scores go by the earliest list and rank."""
    rows = None
    for number, one in enumerate(lists):
        part = one.select("qid", "id", "rank", F.lit(number).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("qid", "id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("first")
    )


def fused_ranks(lists: list[DataFrame], k: int = 30, n: int = 50) -> DataFrame:
    order = [F.col("score").desc(), F.col("first.list"), F.col("first.rank")]
    place = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    return fused(lists, k).withColumn("rank", place).where(F.col("rank") <= n).select("qid", "id", "score", "rank")


def or_else(search: Callable[[], DataFrame], other: Callable[[], DataFrame]) -> DataFrame:
    """What a search gives, or another one's rows if it fails, for example as its model can't be reached. Failures are logged."""
    try:
        return search()
    except Exception as failure:  # noqa: BLE001
        logging.getLogger(__name__).warning("search failed, falling back: %s", str(failure)[:200])
        return other()


def recalled(lists: list[DataFrame], names: list[str]) -> DataFrame:
    """``qid``, ``n_`` and the name of each list for what it recalls, and ``n_several`` for what more than one does."""
    rows = None
    for name, one in zip(names, lists, strict=True):
        part = one.select("qid", "id", F.lit(name).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    of = [F.count_if(F.array_contains("lists", name)).alias(f"n_{name}") for name in names]
    per_hit = rows.groupBy("qid", "id").agg(F.collect_set("list").alias("lists"))
    return per_hit.groupBy("qid").agg(*of, F.sum(F.size("lists") - 1).alias("n_several"))


def overlap_scorer(query: Column, content: Column) -> Column:
    """The default reranker: the share of a query's terms that a text has."""
    terms, have = F.array_distinct(words(query)), F.array_distinct(words(content))
    return F.round(F.size(F.array_intersect(terms, have)) / F.greatest(F.size(terms), F.lit(1)), 6)


def hybrid(
    docs: DataFrame,
    index: DataFrame,
    stats: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    n: int = 50,
    k: int = 30,
    min_score: float = 0.35,
    top_k: int = 5,
    scorer: Callable[[Column, Column], Column] | None = overlap_scorer,
) -> DataFrame:
    """Term and vector search, fused, reranked by ``scorer`` (or by place without one), best chunk per document, top k.

    ``docs`` has ``id, group_id, content``; ``queries`` has ``qid, query, v``.
    """
    lists = [bm25(index, stats, queries, n), nearest(vectors, queries, n, with_self=True)]
    candidates = fused_ranks(lists, k, n).drop("score")
    joined = candidates.join(docs, "id").join(queries.select("qid", "query"), "qid")
    score = scorer(F.col("query"), F.col("content")) if scorer else F.round(1.0 / F.col("rank"), 6)
    judged = joined.withColumn("score", score).where(F.col("score") >= (min_score if scorer else 0.0))
    by_group = Window.partitionBy("qid", "group_id").orderBy(F.col("score").desc(), "rank")
    best = judged.withColumn("_g", F.row_number().over(by_group)).where(F.col("_g") == 1)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "rank"))
    return (
        best.withColumn("place", place)
        .where(F.col("place") <= top_k)
        .select("qid", "group_id", "id", "score", F.col("place").alias("rank"))
    )


def rewritten(queries: DataFrame, rewrite: Callable[[Column], Column] = lambda q: q) -> DataFrame:
    """Queries with what an injected rewriter adds, if that is neither empty nor 200 characters and more."""
    new = rewrite(F.col("query"))
    good = (F.length(new) > 0) & (F.length(new) < 200) & (new != F.col("query"))
    return queries.withColumn("query", F.when(good, F.concat_ws(" ", "query", new)).otherwise(F.col("query")))


def ir_metrics(ranked: DataFrame, gold: DataFrame, k: int = 5, asked: DataFrame | None = None) -> DataFrame:
    """``qid, recall, rr, ndcg`` at k for each query of ``gold`` (``qid, id, rel`` > 0).

    With ``asked`` (``qid, label``), gold is ``label, id, rel`` and stands for
    all queries of a label, so it doesn't grow with their number.
    """
    gain = lambda rel: F.pow(F.lit(2.0), rel) - 1
    key = "qid" if asked is None else "label"
    top = ranked.where(F.col("rank") <= k)
    judged = (top if asked is None else top.join(asked, "qid")).join(gold, [key, "id"])
    got = judged.groupBy("qid").agg(
        F.count("*").alias("hits"),
        F.min("rank").alias("first"),
        F.sum(gain(F.col("rel")) / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    # places of equal relevance are counted, not sorted
    above = Window.partitionBy(key).orderBy(F.col("rel").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counted = gold.groupBy(key, "rel").agg(F.count("*").alias("n")).withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
    places = counted.where(F.col("above") < k).select(
        key, "rel", F.explode(F.sequence(F.col("above") + 1, F.least(F.col("above") + F.col("n"), F.lit(k)))).alias("place")
    )
    best = places.groupBy(key).agg(F.sum(gain(F.col("rel")) / F.log2(F.col("place") + 1)).alias("ideal"))
    wanted = counted.groupBy(key).agg(F.sum("n").alias("n_gold")).join(best, key)
    zero = F.lit(0.0)
    return (
        (wanted if asked is None else asked.join(wanted, "label"))
        .join(got, "qid", "left")
        .select(
            "qid",
            F.round(F.coalesce(F.col("hits") / F.col("n_gold"), zero), 6).alias("recall"),
            F.round(F.coalesce(1 / F.col("first"), zero), 6).alias("rr"),
            F.round(F.coalesce(F.col("dcg") / F.col("ideal"), zero), 6).alias("ndcg"),
        )
    )


def averaged(metrics: DataFrame) -> DataFrame:
    """One row: the number of queries and the means of their metrics."""
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return metrics.agg(F.count("*").alias("n_queries"), mean("recall", "recall"), mean("rr", "mrr"), mean("ndcg", "ndcg"))
