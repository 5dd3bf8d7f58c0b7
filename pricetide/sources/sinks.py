"""Writing: history that is published run by run, snapshots and keyed state behind one pointer.

Data files are written first, under a name of their own; a manifest file that is renamed into place makes them visible. A
writer that dies leaves files that no manifest names, a repeated one finds its work published, and readers
see the state before or after, never a part of it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of keyed state: what a batch rewrites is the touched ones.
BUCKETS = 64


class Manifests:
    """Numbered small JSON files in a folder; the one with the largest number is current."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        found = self._files.globStatus(self._path(f"{self.folder}/*.json")) or []
        return sorted(f.getPath().getName().removesuffix(".json") for f in found)

    def read(self, name: str) -> dict:
        stream = self._files.open(self._path(f"{self.folder}/{name}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, name: str, content: dict) -> bool:
        """Make a manifest visible in one step; false if one of that name was there already."""
        final, draft = self._path(f"{self.folder}/{name}.json"), self._path(f"{self.folder}/.{name}-{uuid.uuid4().hex}")
        if self._files.exists(final):
            return False
        stream = self._files.create(draft, True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        if not self._files.rename(draft, final):
            self._files.delete(draft, False)
            return False
        return True

    def remove(self, path: str) -> None:
        self._files.delete(self._path(path), True)

    def children(self, path: str) -> list[str]:
        found = self._files.globStatus(self._path(f"{path}/*")) or []
        return [f.getPath().getName() for f in found]


def append_observations(observations: DataFrame, path: str, run: str | int, expected: int | None = None, time: str = "observed_at") -> int:
    """Append the rows of one run to the history, partitioned by day, and return how many the run has.

    The rows are staged, counted from what has been written, and published by the run's marker. A run that is published
    already stays as it is, so a repeated job changes nothing; with ``expected``, a different count is an error and nothing appears.
    """
    spark = observations.sparkSession
    runs = Manifests(spark, f"{path}/_runs")
    name = f"run-{run}"
    if name in runs.names():
        return runs.read(name)["rows"]
    staged = f"attempt={uuid.uuid4().hex}"
    dated = observations.withColumn("observed_date", F.to_date(time))
    # Rows of a day are brought together, spread over as many tasks as AQE finds useful: no small file per task and day.
    dated.hint("rebalance", "observed_date").write.partitionBy("observed_date").parquet(f"{path}/{staged}")
    rows = spark.read.schema(dated.schema).parquet(f"{path}/{staged}").count()
    if expected is not None and rows != expected:
        runs.remove(f"{path}/{staged}")
        raise ValueError(f"run {run}: {rows} rows written, {expected} expected")
    if not runs.publish(name, {"folder": staged, "rows": rows}):
        runs.remove(f"{path}/{staged}")
        return runs.read(name)["rows"]
    return rows


def read_observations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The published runs; ``schema`` without the partition column observed_date, which is added."""
    runs = Manifests(spark, f"{path}/_runs")
    folders = [runs.read(name)["folder"] for name in runs.names()]
    whole = f"{schema}, observed_date date"
    if not folders:
        return spark.createDataFrame([], whole)
    # The folders lie side by side: one scan finds the days of all of them.
    return spark.read.schema(f"{whole}, attempt string").option("basePath", path).parquet(*(f"{path}/{f}" for f in folders)).drop("attempt")


def overwrite_snapshot(snapshot: DataFrame, path: str) -> None:
    """Replace a snapshot table: rows missing from the new result disappear, all at once for readers."""
    versions = Manifests(snapshot.sparkSession, f"{path}/_versions")
    folder = f"data-{uuid.uuid4().hex}"
    snapshot.write.parquet(f"{path}/{folder}")
    names = versions.names()
    while not versions.publish(f"{int(names[-1]) + 1 if names else 0:012d}", {"folder": folder}):  # another writer was first: this one is later
        names = versions.names()
    _clean(versions, path, 2)


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    versions = Manifests(spark, f"{path}/_versions")
    names = versions.names()
    return spark.read.schema(schema).parquet(f"{path}/{versions.read(names[-1])['folder']}") if names else spark.createDataFrame([], schema)


def _clean(versions: Manifests, path: str, keep: int) -> None:
    """Remove manifests but the latest, and what only the removed ones name: readers of the version before stay served."""
    names = versions.names()
    for name in names[:-keep]:
        old = _folders(versions.read(name))
        kept = {f for n in versions.names() if n != name for f in _folders(versions.read(n))}
        for folder in old - kept:
            versions.remove(f"{path}/{folder}")
        versions.remove(f"{versions.folder}/{name}.json")


def _folders(content: dict) -> set[str]:
    return {content["folder"]} if "folder" in content else set(content["buckets"].values())


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def upsert_buckets(batch: DataFrame, path: str, keys: list[str], order: list[str], version: int, buckets: int = BUCKETS) -> int:
    """Merge a batch into keyed state, latest row per key, and return how many buckets were rewritten.

    State lies in buckets by the keys' hash; a batch rewrites the buckets it touches, and one manifest names for every bucket the
    folder that holds it. A version that is published already is left alone.
    """
    spark = batch.sparkSession
    versions = Manifests(spark, f"{path}/_versions")
    names = versions.names()
    if names and int(names[-1]) >= version:
        return 0
    before = versions.read(names[-1]) if names else {"buckets": {}, "n": buckets}
    if before["n"] != buckets:
        raise ValueError(f"the state has {before['n']} buckets")
    rest = [c for c in batch.columns if c not in keys]
    marked = batch.withColumn("bucket", bucket_of(keys, buckets))
    touched = sorted(r["bucket"] for r in marked.select("bucket").distinct().collect())  # at most `buckets` numbers
    if touched:
        held = [f"{path}/{before['buckets'][str(b)]}" for b in touched if str(b) in before["buckets"]]
        rows = marked
        if held:
            rows = rows.unionByName(spark.read.schema(marked.schema).parquet(*held).withColumn("bucket", bucket_of(keys, buckets)))
        latest = rows.groupBy("bucket", *keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*", "bucket").select(*marked.columns)
        folder = f"v{version}-{uuid.uuid4().hex}"
        latest.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
        before["buckets"] |= {str(b): f"{folder}/bucket={b}" for b in touched}
    versions.publish(f"{version:012d}", before)
    _clean(versions, path, 2)
    return len(touched)


def read_buckets(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of the state that is published last."""
    versions = Manifests(spark, f"{path}/_versions")
    names = versions.names()
    folders = sorted(set(versions.read(names[-1])["buckets"].values())) if names else []
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)
