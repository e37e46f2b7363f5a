"""Event-time windows, deduplication and upserts as streams.

Each stream runs to the end of what there is (``availableNow``), with its
checkpoint and result in the shared folder, and gives the same rows as the
batch query of the same name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.session import shared_dir


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New files of a Parquet table, a folder or a single file."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    files = spark.read.schema(schema).parquet(path).inputFiles()
    if [f.rsplit("/", 1)[-1] for f in files] == [name]:  # a single file is streamed from its folder
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(path.rstrip("/")[: -len(name)])
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)


def tumbling(events: DataFrame, at: str, length: str, keys: list[str]) -> DataFrame:
    return (
        events.groupBy(F.window(at, length).alias("w"), *keys)
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.unix_millis("w.start").alias("start_ms"), *keys, "n", F.round("total", 4).alias("total"))
    )


def sliding(events: DataFrame, at: str, length: str, slide: str, keys: list[str]) -> DataFrame:
    return (
        events.groupBy(F.window(at, length, slide).alias("w"), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.unix_millis("w.start").alias("start_ms"), *keys, "n")
    )


def sparse(events: DataFrame, at: str, seconds: int, every: int, keys: list[str]) -> DataFrame:
    """Counts in windows of some seconds at the start of each longer stretch; events between the windows are left out."""
    within = F.pmod(F.unix_millis(at), F.lit(every * 1000)) < seconds * 1000
    return (
        events.where(within)
        .groupBy(F.window(at, f"{every} seconds").alias("w"), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.unix_millis("w.start").alias("start_ms"), *keys, "n")
    )


def sessions(events: DataFrame, at: str, gap: str, keys: list[str]) -> DataFrame:
    return (
        events.groupBy(F.session_window(at, gap).alias("w"), *keys)
        .agg(F.count("*").alias("n"))
        .select(*keys, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")
    )


def scratch(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def in_arrivals(parts: list[DataFrame], start: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Let parts of a table arrive one after another; after each the stream goes on from its state.

    ``start`` runs a stream over what there is, with a place for state and result, and gives the rows so far.
    """
    spark = parts[0].sparkSession
    base = scratch(spark)
    rows = None
    for part in parts:
        part.write.mode("append").parquet(f"{base}/source")
        rows = start(event_stream(spark, f"{base}/source", part.schema), base)
    return rows


def run_to_end(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Run a stream over what there is, write its rows to the shared folder, and read them. With ``base`` it goes on from there."""
    spark = stream.sparkSession
    base = base or scratch(spark)
    if mode == "append":
        query = (
            stream.writeStream.format("parquet")
            .option("checkpointLocation", f"{base}/state")
            .option("path", f"{base}/rows")
            .trigger(availableNow=True)
            .start()
        )
    else:
        # each batch gives the whole result so far; the last one stays
        save: Callable[[DataFrame, int], None] = lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/rows")
        query = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(save)
            .option("checkpointLocation", f"{base}/state")
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def deduplicated(events: DataFrame, at: str, keys: list[str], lateness: str) -> DataFrame:
    """The first row of each key within a time; later copies are dropped."""
    return events.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> str | None:
    """Merge each batch into a stored table, written as its next version; gives the last version's folder.

    A batch that is repeated after a failure writes the same version again. The
    versions are listed in a table beside them, so a stream that is started
    anew finds the last one, also if nothing has arrived since.
    """
    spark = stream.sparkSession
    listed = f"{path.rstrip('/')}/listed"

    def last() -> int | None:
        try:
            return spark.read.schema("number long").parquet(listed).agg(F.max("number")).first()[0]
        except AnalysisException:  # no version yet
            return None

    def save(batch: DataFrame, number: int) -> None:
        before = None if number == 0 else spark.read.schema(batch.schema).parquet(f"{path.rstrip('/')}/v{number - 1}")
        merged = merge(batch.limit(0) if before is None else before, batch)
        merged.select(*batch.columns).write.mode("overwrite").parquet(f"{path.rstrip('/')}/v{number}")
        spark.createDataFrame([(number,)], "number long").write.mode("append").parquet(listed)

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    number = last()
    return None if number is None else f"{path.rstrip('/')}/v{number}"
