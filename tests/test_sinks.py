import os

import pytest
from pyspark.sql import functions as F

from pricetide.sources import sinks

OBS = "obs_id long, price long, observed_at timestamp"


def observations(spark, ids):
    return spark.createDataFrame([(i, i * 10) for i in ids], "obs_id long, price long").withColumn("observed_at", F.timestamp_seconds(F.col("obs_id") * 40_000))


def ids(spark, path):
    return sorted(r["obs_id"] for r in sinks.read_observations(spark, path, OBS).collect())


def test_a_run_appears_once_and_whole(spark, tmp_path):
    path = str(tmp_path / "history")
    assert ids(spark, path) == []
    assert sinks.append_observations(observations(spark, range(5)), path, 1, expected=5) == 5
    assert sinks.append_observations(observations(spark, range(5)), path, 1) == 5  # repeated
    with pytest.raises(ValueError):
        sinks.append_observations(observations(spark, [7, 8]), path, 2, expected=3)
    # A killed job: its files are there, its marker is not.
    observations(spark, [90]).withColumn("observed_date", F.to_date("observed_at")).write.partitionBy("observed_date").parquet(f"{path}/attempt=dead")
    assert ids(spark, path) == [0, 1, 2, 3, 4]
    assert sinks.append_observations(observations(spark, [7, 8]), path, 2, expected=2) == 2
    got = sinks.read_observations(spark, path, OBS)
    assert ids(spark, path) == [0, 1, 2, 3, 4, 7, 8] and got.where(F.col("observed_date") != F.to_date("observed_at")).count() == 0


def test_readers_see_a_snapshot_before_or_after(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    rows = lambda n: spark.range(n).withColumnRenamed("id", "k")
    assert sinks.read_snapshot(spark, path, "k long").count() == 0
    sinks.overwrite_snapshot(rows(5), path)
    before = sinks.read_snapshot(spark, path, "k long")
    sinks.overwrite_snapshot(rows(2), path)
    assert before.count() == 5 and sinks.read_snapshot(spark, path, "k long").count() == 2
    rows(9).write.parquet(f"{path}/data-unpublished")
    assert sinks.read_snapshot(spark, path, "k long").count() == 2
    for n in range(3, 6):
        sinks.overwrite_snapshot(rows(n), path)
    assert len([d for d in os.listdir(path) if d.startswith("data-") and d != "data-unpublished"]) == 2


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    path, schema = str(tmp_path / "state"), "k long, at long, v string"
    state = lambda: sorted(tuple(r) for r in sinks.read_buckets(spark, path, schema).collect())
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    first = [(k, 1, "a") for k in range(200)]
    assert sinks.upsert_buckets(batch(*first), path, ["k"], ["at"], 0, 16) == 16
    files = lambda: {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}
    before = files()
    assert sinks.upsert_buckets(batch((7, 2, "b"), (7, 0, "late")), path, ["k"], ["at"], 1, 16) == 1
    assert state() == sorted((k, 2, "b") if k == 7 else (k, 1, "a") for k in range(200))
    assert sum(f not in before for f in files()) == 1  # one new file, the others untouched
    assert sinks.upsert_buckets(batch((9, 5, "again")), path, ["k"], ["at"], 1, 16) == 0  # that version is published
    assert sinks.upsert_buckets(batch(), path, ["k"], ["at"], 2, 16) == 0
    assert sinks.upsert_buckets(batch((300, 1, "n"), (7, 1, "old")), path, ["k"], ["at"], 3, 16) in (1, 2)
    assert state() == sorted([(k, 2, "b") if k == 7 else (k, 1, "a") for k in range(200)] + [(300, 1, "n")])
    with pytest.raises(ValueError):
        sinks.upsert_buckets(batch((1, 9, "x")), path, ["k"], ["at"], 4, 8)
