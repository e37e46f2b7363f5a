from types import SimpleNamespace

import pytest

from fathomline import session


def fake(master, folder=None):
    conf = {"spark.checkpoint.dir": folder} if folder else {}
    made = []
    context = SimpleNamespace(
        master=master,
        getConf=lambda: SimpleNamespace(get=conf.get),
        setCheckpointDir=made.append,
        getCheckpointDir=lambda: made[-1] if made else None,
    )
    return SimpleNamespace(sparkContext=context)


def test_a_cluster_has_to_name_its_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(fake("spark://host:7077"))
    assert session.shared_dir(fake("spark://host:7077", "/shared")) == "/shared"
    assert "fathomline" in session.shared_dir(fake("local[4]"))


def test_spreading_runs_no_job(spark, sf_dir):
    table = session.read(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    rows = session.spread(table)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_rows_of_few_row_groups_are_spread(spark, tmp_path):
    from fathomline.operators import retrieval

    # one row group, cut into many partitions by its bytes
    docs = spark.range(20_000).selectExpr("id", "sha2(cast(id as string), 512) as text")
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    docs.repartition(16).write.parquet(str(tmp_path / "many"))
    counted = lambda rows: rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        one, many = spark.read.parquet(str(tmp_path / "one")), spark.read.parquet(str(tmp_path / "many"))
        assert max(counted(one)) == 20_000 and one.rdd.getNumPartitions() >= 4
        assert max(counted(retrieval.word_index(one, ("text",)))) < 4000
        assert retrieval.word_index(one, ("text",)).count() == 20_000
        assert retrieval.word_index(many, ("text",)).rdd.getNumPartitions() == many.rdd.getNumPartitions()
        assert retrieval.word_index(one.limit(0), ("text",)).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
