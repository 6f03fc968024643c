"""A target whose batches count once: failed tasks leave nothing, repeated batches add nothing."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from eventflow.sources import custom, targets
from eventflow.streaming import sinks


@pytest.fixture(scope="module")
def target(spark):
    custom.register(spark, targets.ManifestTarget)
    return lambda df, path, **options: df.write.format("manifest").options(path=path, **options).mode("append").save()


def files(path):
    folder = os.path.join(path, "data")
    return os.listdir(folder) if os.path.isdir(folder) else []


def test_batches_add_up_and_repeats_do_not(spark, target, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(1000).withColumn("name", F.concat(F.lit("ü"), "id")).repartition(5)
    assert targets.committed(spark, path, df.schema).count() == 0
    target(df, path, batch="a")
    target(df, path, batch="a")
    rows = targets.committed(spark, path, df.schema)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, df.collect())) and len(files(path)) == 5
    target(df, path)
    target(df.limit(0), path)
    assert targets.committed(spark, path, df.schema).count() == 2000


def test_a_failed_task_leaves_nothing(spark, target, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(40_000).repartition(4)
    failing = df.withColumn("id", F.when(F.col("id") == 39_999, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="no"):
        target(failing, path, batch="a")
    assert targets.committed(spark, path, df.schema).count() == 0
    target(df, path, batch="a")
    assert targets.committed(spark, path, df.schema).count() == 40_000
    with pytest.raises(Exception, match="appends"):
        df.write.format("manifest").option("path", path).mode("overwrite").save()


def test_a_repeated_batch_of_a_stream_adds_nothing(spark, target, tmp_path):
    path, source, first, second = (str(tmp_path / n) for n in ("t", "in", "first", "second"))
    spark.range(100).write.parquet(source)

    def run(checkpoint):
        rows = spark.readStream.schema("id long").parquet(source)
        query = rows.writeStream.format("manifest").option("path", path).option("checkpointLocation", checkpoint)
        assert sinks.finish(query.trigger(availableNow=True).start(), 120)

    run(first)
    # As after a crash between the target's commit and Spark's own note of it.
    shutil.copytree(first, second, ignore=shutil.ignore_patterns("commits"))
    run(second)
    spark.range(100, 150).write.mode("append").parquet(source)
    run(second)
    got = sorted(r.id for r in targets.committed(spark, path, spark.range(1).schema).collect())
    assert got == list(range(150))
    listed = {os.path.basename(f) for f in targets._Folder(path).files()}
    assert {f for f in files(path) if f.endswith(".parquet")} == listed
