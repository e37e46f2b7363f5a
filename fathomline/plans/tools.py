"""Named queries with checked arguments, as an agent or a service calls them.

``run`` checks the arguments before anything is planned and gives a lazy
DataFrame. Time limits and retries are Spark's: job groups and task attempts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import times
from fathomline.functions.records import shortened_frame
from fathomline.operators import logs, retrieval
from fathomline.session import cut, read


def _between(name: str, value: int, low: int, high: int) -> None:
    if not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} must be a whole number from {low} to {high}, not {value!r}")


@dataclass(frozen=True)
class SearchLogs:
    service: str
    keyword: str = ""
    minutes: int = 10
    at: str = ""
    limit: int = 20

    def __post_init__(self) -> None:
        if not self.service.strip():
            raise ValueError("service must be given")
        _between("minutes", self.minutes, 1, 1440)
        _between("limit", self.limit, 1, 100)

    def plan(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = logs.normalised(read(spark, sf_dir, "fault_f3_skeleton"))
        if self.at:
            rows = logs.with_time(rows).where(times.centred(F.col("ts"), times.parsed(F.lit(self.at)), self.minutes)).drop("ts")
        return logs.search(rows, self.service, self.keyword, self.limit)


@dataclass(frozen=True)
class TraceQuery:
    trace_id: str = ""
    service: str = ""
    limit: int = 10

    def __post_init__(self) -> None:
        if not self.trace_id.strip() and not self.service.strip():
            raise ValueError("trace_id or service must be given")
        _between("limit", self.limit, 1, 100)

    def plan(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = logs.normalised(read(spark, sf_dir, "fault_f3_skeleton"))
        if self.trace_id.strip():
            return logs.trace_timeline(rows.where(F.col("trace_id") == self.trace_id.strip()))
        return logs.suspicious_traces(rows, self.service, self.limit)


@dataclass(frozen=True)
class SearchDocuments:
    query: str
    top_k: int = 5
    mode: str = "terms"
    embed: Callable[[DataFrame], DataFrame] = retrieval.term_embedder()

    def __post_init__(self) -> None:
        if not self.query.strip():
            raise ValueError("query must be given")
        _between("top_k", self.top_k, 1, 20)
        if self.mode not in ("hybrid", "terms", "keyword"):
            raise ValueError("mode must be 'hybrid', 'terms' or 'keyword'")

    def plan(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = read(spark, sf_dir, "kb_chunks").select("id", "title", "category", F.col("content").alias("text"))
        asked = spark.createDataFrame([(1, self.query)], "qid int, query string")
        if self.mode == "keyword":
            return retrieval.keyword(docs, asked, self.top_k)
        if self.mode == "hybrid":
            return retrieval.or_else(lambda: self._hybrid(docs, asked), lambda: retrieval.keyword(docs, asked, self.top_k))
        index = cut(retrieval.postings(docs, "id", "text"))
        found = retrieval.bm25(index, retrieval.corpus_stats(index), asked, self.top_k)
        return found.join(docs.select("id", "title", "text"), "id").orderBy("rank")


    def _hybrid(self, docs: DataFrame, asked: DataFrame) -> DataFrame:
        """By terms and by vectors of ``embed``; written, so that a failure shows here."""
        texts = docs.select("id", "text")
        index = cut(retrieval.postings(texts, "id", "text"))
        vectors = self.embed(asked.select(F.col("qid").alias("id"), F.col("query").alias("text"))).withColumnRenamed("id", "qid")
        chunks = texts.select("id", F.col("id").alias("group_id"), F.col("text").alias("content"))
        found = retrieval.hybrid(
            chunks, index, retrieval.corpus_stats(index), cut(self.embed(texts)), asked.join(vectors, "qid", "left"), top_k=self.top_k
        )
        return cut(found.select("qid", "id", "score", "rank").join(docs.select("id", "title", "text"), "id").orderBy("rank"))


@dataclass(frozen=True)
class ServiceMetrics:
    service: str
    metrics: tuple[str, ...] = ("n", "errors", "error_share", "mean_ms")

    def plan(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = logs.red_metrics(logs.normalised(read(spark, sf_dir, "fault_f3_skeleton")))
        known = [m for m in self.metrics if m in ("n", "errors", "error_share", "mean_ms")]
        chosen = known or ["n", "errors", "error_share", "mean_ms"]
        return rows.where(F.col("service") == self.service.strip()).select("service", "start_ms", *chosen).orderBy("start_ms")


TOOLS: dict[str, Callable] = {
    "search_logs": SearchLogs,
    "trace_query": TraceQuery,
    "search_documents": SearchDocuments,
    "service_metrics": ServiceMetrics,
}


def run(spark: SparkSession, sf_dir: str, name: str, **args) -> DataFrame:
    """The rows of a tool, long texts and lists shortened. Unknown tools and arguments, and values out of range, are refused."""
    if name not in TOOLS:
        raise ValueError(f"no tool named {name}")
    unknown = set(args) - {f.name for f in fields(TOOLS[name])}
    if unknown:
        raise ValueError(f"{name} has no argument {', '.join(sorted(unknown))}")
    return shortened_frame(TOOLS[name](**args).plan(spark, sf_dir))


def catalogue(spark: SparkSession) -> DataFrame:
    """Tables that the session's catalogue knows."""
    rows = [(t.database or "", t.name, t.tableType) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "database string, name string, kind string")
