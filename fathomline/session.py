"""Session helpers: settings, reading tables, and cutting lineage.

Intermediate tables go to the folder that the session names in
``spark.checkpoint.dir``; outside a local session it has to be named.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from hashlib import sha1

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a helper table may be broadcast once it has been counted.
BROADCAST_ROWS = 50_000


def local_session(cores: int = 8, app: str = "fathomline", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.python.filterPushdown.enabled": "true",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables. Filters and columns chosen later reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer partitions than there are cores, spread over them; others as they are.

    For work that costs much per row over a table in few row groups. Larger
    tables have partitions enough and aren't shuffled. ``scan`` is to be a read
    table with columns chosen and rows filtered: counting the partitions of such
    a plan runs no job, whereas a join before it would be run for the count.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def spread_rows(scan: DataFrame, key: str) -> DataFrame:
    """``spread`` by rows: a scan of which one partition has more than 1.5 times a core's share of the rows, spread by ``key``.

    A file of few row groups is cut into partitions by its bytes, and a row group goes to one of them as a whole, so the
    others are empty. The rows are counted by one job that reads the key alone. A table with many more row groups than
    there are cores isn't shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    counts = [r["count"] for r in scan.select(key).groupBy(F.spark_partition_id()).count().collect()]
    return scan.repartition(2 * cores, key) if max(counts, default=0) * cores > 1.5 * sum(counts) else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from the session's ``spark.checkpoint.dir``.

    Only a local master, whose executors are this process, gets a folder of its own where none is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-fathomline-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame, *partition_keys: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it again.

    The result survives lost executors, has no lineage, and is stored in
    columns with statistics. With keys, rows are first spread by them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    (df.repartition(*partition_keys) if partition_keys else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(name: str, source: DataFrame, build: Callable[[], DataFrame]) -> DataFrame:
    """A table made from ``source``, written by the first caller in a session and read by the others.

    Its place in the shared folder comes from ``name`` and the files of the
    source, so a table that is written anew under the same files keeps what was made of it until the
    session ends. A source without files is built each time.
    """
    files = source.inputFiles()
    if not files:
        return cut(build())
    spark = source.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{sha1(repr(sorted(files)).encode()).hexdigest()}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # not there yet
        build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
