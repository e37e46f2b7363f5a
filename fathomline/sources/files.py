"""Readers and writers of files. Schemas are given, never inferred, so a scan is one pass."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.session import cut

RAW_LINE = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("time", T.StringType()),
            ("Level", T.StringType()),
            ("TraceId", T.StringType()),
            ("Prefix", T.StringType()),
            ("service", T.StringType()),
            ("msg", T.StringType()),
            ("path", T.StringType()),
            ("status_code", T.LongType()),
            ("method", T.StringType()),
            ("latency_ms", T.LongType()),
            ("CallerPath", T.StringType()),
            ("Content", T.StringType()),
        )
    ]
)


def json_lines(spark: SparkSession, path: str, glob: str = "*.jsonl", schema: T.StructType = RAW_LINE) -> DataFrame:
    """Lines of JSON below a path; blank and damaged lines are skipped."""
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", glob)
    return reader.option("recursiveFileLookup", True).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One line of JSON a row, as many files as there are partitions; nulls are written as such."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def dated_lines(spark: SparkSession, path: str, schema: T.StructType = RAW_LINE) -> DataFrame:
    """Lines below ``<env>/<source>/<topic>/<day>.jsonl``, with ``env``, ``topic`` and ``day`` from their paths; empty files give none."""
    place = r"([^/]+)/[^/]+/([^/]+)/(\d{4}-\d{2}-\d{2})\.jsonl$"
    rows = json_lines(spark, path, "*.jsonl", schema).withColumn("_path", F.col("_metadata.file_path"))
    parts = {"env": 1, "topic": 2}
    for name, group in parts.items():
        rows = rows.withColumn(name, F.regexp_extract("_path", place, group))
    return rows.withColumn("day", F.to_date(F.regexp_extract("_path", place, 3))).drop("_path")


def markdown(spark: SparkSession, path: str, skip: str = "README.md") -> DataFrame:
    """``doc_id, category, text`` of Markdown files: names of the file and of its folder."""
    reader = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    rows = reader.option("pathGlobFilter", "*.md").load(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    named = rows.select(
        F.regexp_replace(F.element_at(parts, -1), r"\.md$", "").alias("doc_id"),
        F.element_at(parts, -2).alias("category"),
        F.col("value").alias("text"),
        F.element_at(parts, -1).alias("_file"),
    )
    return named.where(F.col("_file") != skip).drop("_file")


def listing(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """``path, bytes, modified, first`` of the files below a path, changed in a time if one is given; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if since:
        reader = reader.option("modifiedAfter", since)
    if until:
        reader = reader.option("modifiedBefore", until)
    rows = reader.load(path)
    prefix = path if "://" in path else f"file:{path}"
    below = F.regexp_replace("path", "^" + prefix.rstrip("/") + "/+", "")
    return rows.select(
        "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.split(below, "/")[0].alias("first")
    )


def listing_report(files: DataFrame) -> DataFrame:
    """Files and bytes by first part of the path, largest first."""
    return files.groupBy("first").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).orderBy(F.col("bytes").desc(), "first")


def yaml_documents(spark: SparkSession, path: str) -> DataFrame:
    """``name, json``: each YAML file below a path as JSON text; empty files are skipped. Needs the yaml package."""
    import json
    from collections.abc import Iterator

    import pandas as pd

    rows = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.yaml").load(path)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            loaded = [yaml.safe_load(x) for x in batch["value"]]
            out = batch.assign(json=[None if d is None else json.dumps(d, ensure_ascii=False, default=str) for d in loaded])
            yield out.loc[out["json"].notna(), ["name", "json"]]

    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.yaml$", 1)
    return rows.select("value", name.alias("name")).mapInPandas(parse, "name string, json string")


def write_days(df: DataFrame, path: str, columns: tuple[str, ...] = ("env", "topic", "day"), only_new: bool = False) -> None:
    """Write by partition columns. Partitions in the data replace stored ones, or, with ``only_new``, stored ones are kept."""
    spark = df.sparkSession
    if only_new and (stored := _stored(spark, path)) is not None:
        df = df.join(stored.select(*columns).distinct(), list(columns), "left_anti")
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*columns).parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing there yet
        return None


def with_ids(df: DataFrame, order: list[str], name: str = "id", per_range: str = "_range") -> DataFrame:
    """Adds ids from 1 in an order, as a rebuilt table needs them, without sorting all rows in one task.

    Rows are range-partitioned by the order; counts of the ranges give where each starts.
    """
    ranged = df.repartitionByRange(*order).withColumn(per_range, F.spark_partition_id())
    ranged = cut(ranged)
    before = Window.partitionBy(F.lit(0)).orderBy(per_range).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(per_range).agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(per_range).orderBy(*order))
    return ranged.join(starts.drop("_n"), per_range).withColumn(name, F.col("_start") + place).drop(per_range, "_start")
