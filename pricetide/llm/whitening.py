"""Whitening of embeddings by a covariance over distinct vectors and their multiplicities.

Every entry c of a vector becomes the whole number x = floor(scale * c) + shift. Equal x-vectors are grouped first (Spark counts them before
its shuffle, so a vector that a third of all rows share is a few rows there); everything after that works on distinct vectors, with their counts
or one as fit weights. Exact column sums come first, then a weighted product of the centred vectors: each task adds up blocks with
one matrix product, Spark adds the entries of the tasks. Only that matrix (dimension squared, whatever the rows) comes to the driver, for its
eigenvectors. Each distinct vector is whitened once, and rows get the result by a join on the vector itself. Vectors of at
least one row in 1 000 (at most 1 000 of them) are dealt over several salts there.

Defined results: rows whose vector is null, empty, holds null or non-finite entries, or has another length than most vectors (the smallest such
length on a tie) are left out. x is clipped to 2**52 in size. Equal eigenvalues (ties) come in the order of the solver. A vector of fewer
dimensions than components has as many components as dimensions. A component without variance (eigenvalue within rounding of zero) gets null in whitened
and is no part of identity_error. A deviation beyond a long is null; deviation_exact has it as text. Null ids and repeated rows are kept as rows; further columns of any
name are ignored; a table without usable vectors gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.session import materialize

from .registry import query

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: A vector with at least this share of the rows is dealt over salts in the join back.
HOT_SHARE = 1000
#: Rows of a block in a product.
BLOCK = 8192
LARGEST = 2**52


def pack(x: np.ndarray, shift: int) -> list[bytes]:
    """One byte string a vector: each entry less the shift in the fewest bytes (2, 4 or 8) that hold the whole vector, and that width in front."""
    rest = x - shift
    size = np.abs(rest).max(axis=1, initial=0)
    width = np.where(size < 2**15, 2, np.where(size < 2**31, 4, 8))
    out: list[bytes] = [b""] * len(x)
    for w in (2, 4, 8):
        rows = np.flatnonzero(width == w)
        raw = rest[rows].astype(f"<i{w}").tobytes()
        step = w * x.shape[1]
        for k, i in enumerate(rows.tolist()):
            out[i] = bytes((w,)) + raw[k * step : (k + 1) * step]
    return out


def unpack(packed: list[bytes], shift: int, dimension: int) -> np.ndarray:
    out = np.empty((len(packed), dimension), dtype=np.int64)
    for w in (2, 4, 8):
        rows = [i for i, p in enumerate(packed) if p[0] == w]
        if rows:
            out[rows] = np.frombuffer(b"".join(packed[i][1:] for i in rows), dtype=f"<i{w}").reshape(len(rows), dimension)
    return out + shift


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector of the rows that the fit list keeps, whatever their length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    odd = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    return rows.where((F.size("vector") > 0) & ~F.exists("vector", odd))


def _packed(rows: DataFrame, scale: int, shift: int) -> DataFrame:
    """vec_id and the packed x-vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, BLOCK) for i in range(0, whole.num_rows, BLOCK)):
                values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                x = np.clip(np.floor(scale * values), -LARGEST, LARGEST).astype(np.int64) + shift
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(pack(x, shift), pa.binary())], ["vec_id", "x"])

    return rows.mapInArrow(run, "vec_id long, x binary")


def _sums(distinct: DataFrame, add: Callable[[list[bytes], np.ndarray], dict[tuple[int, int], object]], kind: str) -> dict[tuple[int, int], object]:
    """Entries (i, j) that `add` finds in each block of distinct vectors, added up by Spark."""
    arrow = pa.decimal128(38, 0) if kind.startswith("decimal") else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], object] = {}
        for whole in batches:
            for batch in (whole.slice(k, BLOCK) for k in range(0, whole.num_rows, BLOCK)):
                for key, value in add(batch.column("x").to_pylist(), batch.column("weight").to_numpy()).items():
                    total[key] = total.get(key, 0) + value
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k] for k in keys], arrow)], ["i", "j", "value"])

    rows = distinct.select("x", "weight").mapInArrow(run, f"i int, j int, value {kind}")
    return {(r["i"], r["j"]): r["value"] for r in rows.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}


def exact_sums(x: np.ndarray, weight: np.ndarray) -> list[int]:
    """Weighted column sums in whole numbers of any size."""
    high, low = x >> 26, x & (2**26 - 1)
    return [(int(h) << 26) + int(s) for h, s in zip(weight @ high, weight @ low, strict=True)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n*x - S)**2 of each vector, exactly: with x = m + y and S = n*m + r that is n*n*yy - 2*n*yr + rr."""
    m = np.array([s // n for s in sums], dtype=np.int64)
    r = np.array([s % n for s in sums], dtype=object)
    y = x - m
    if np.abs(y).max(initial=0) >= 2**20 or n >= 2**36 or x.shape[1] > 128:  # beyond 64 bits
        y = y.astype(object)
    else:
        r = r.astype(np.int64)
    yy, yr, rr = (y * y).sum(axis=1), (y * r).sum(axis=1), sum(int(v) ** 2 for v in r)
    return [n * n * int(a) - 2 * n * int(b) + rr for a, b in zip(yy, yr, strict=True)]


@dataclass(frozen=True)
class Whitening:
    """A fit: rows and exact column sums of the fit list, eigenvectors as columns, their eigenvalues and shares, and the shift of packed vectors."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    shift: int

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN where a component has no variance."""
        base = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.where(self.values > 0, np.sqrt(np.maximum(self.values, 0)), np.nan)
        return ((x - base).astype(np.float64) - rest) @ self.vectors / root


def distinct_vectors(rows: DataFrame, scale: int, shift: int, weights: str) -> DataFrame:
    """x (packed), count (rows), weight (in the fit) of each distinct vector, written to the shared folder."""
    counted = _packed(rows, scale, shift).groupBy("x").agg(F.count("*").alias("count"))
    return materialize(counted.withColumn("weight", F.col("count") if weights == "count" else F.lit(1).cast("long")))


def fit(distinct: DataFrame, dimension: int, components: int = COMPONENTS, shift: int = SHIFT) -> Whitening:
    """Covariance of the distinct vectors by their weights, and its first components."""

    def first(packed: list[bytes], weight: np.ndarray) -> dict:
        return {(d, 0): s for d, s in enumerate(exact_sums(unpack(packed, shift, dimension), weight))} | {(-1, 0): int(weight.sum())}

    found = _sums(distinct, first, "decimal(38,0)")
    n, sums = int(found[-1, 0]), [int(found[d, 0]) for d in range(dimension)]
    base, rest = np.array([s // n for s in sums], dtype=np.int64), np.array([(s % n) / n for s in sums])

    def product(packed: list[bytes], weight: np.ndarray) -> dict:
        y = (unpack(packed, shift, dimension) - base).astype(np.float64) - rest
        square = y.T @ (y * weight[:, None])
        return {(i, j): float(square[i, j]) for i in range(dimension) for j in range(i, dimension)}

    entries = _sums(distinct, product, "double")
    covariance = np.zeros((dimension, dimension))
    for (i, j), value in entries.items():
        covariance[i, j] = covariance[j, i] = value / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[: min(components, dimension)]
    trace = float(np.trace(covariance))
    values, vectors = values[order], vectors[:, order]
    real = values > 1e-12 * max(trace, 0.0)
    return Whitening(n, sums, vectors, np.where(real, values, 0.0), np.where(trace > 0, np.maximum(values, 0) / (trace or 1), 0.0), shift)


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest entry, by size, of the whitened fit list's covariance less the identity, measured over all distinct vectors."""
    k, dimension = len(model.values), len(model.sums)
    live = np.flatnonzero(model.values > 0)

    def add(packed: list[bytes], weight: np.ndarray) -> dict:
        z = model.apply(unpack(packed, model.shift, dimension))[:, live]
        square, total = z.T @ (z * weight[:, None]), weight @ z
        out = {(int(live[i]), int(live[j])): float(square[i, j]) for i in range(len(live)) for j in range(i, len(live))}
        return out | {(k, int(live[i])): float(total[i]) for i in range(len(live))}

    found = _sums(distinct, add, "double")
    mean = {i: found[k, i] / model.n for i in live.tolist()}
    return max((abs(v / model.n - mean[i] * mean[j] - (i == j)) for (i, j), v in found.items() if i < k), default=0.0)


def whiten(vectors: DataFrame, components: int = COMPONENTS, weights: str = "count", scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error, deviation_exact."""
    if weights not in ("count", "one"):
        raise ValueError("weights is count or one")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    rows = _usable(vectors, id_col, vector_col)
    length = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if length is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dimension = length["length"]
    rows = rows.where(F.size("vector") == dimension)
    distinct = distinct_vectors(rows, scale, shift, weights)
    model = fit(distinct, dimension, components, shift)
    error = identity_error(distinct, model)
    total = distinct.agg(F.sum("count")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, BLOCK) for i in range(0, whole.num_rows, BLOCK)):
                x = unpack(batch.column("x").to_pylist(), shift, dimension)
                z, exact = model.apply(x), deviations(x, model.n, model.sums)
                flat = z.reshape(-1)
                bounds = np.arange(len(x) + 1, dtype=np.int32) * z.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, mask=np.isnan(flat)))
                yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("count"), lists, pa.array([d if d < 2**63 else None for d in exact], pa.int64()), pa.array([str(d) for d in exact])],
                                                 ["x", "count", "whitened", "deviation", "deviation_exact"])

    done = distinct.select("x", "count").mapInArrow(run, "x binary, count long, whitened array<double>, deviation long, deviation_exact string")
    # At most HOT_SHARE vectors can have so many rows; each is repeated once per salt, in all at most 2 * HOT_SHARE times.
    hot = distinct.where(F.col("count") * HOT_SHARE >= total).select("x", F.ceil(F.col("count") * HOT_SHARE / F.lit(total)).cast("int").alias("salts"))
    done = done.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("count") * HOT_SHARE >= total, F.ceil(F.col("count") * HOT_SHARE / F.lit(total)).cast("int") - 1).otherwise(0))))
    keyed = _packed(rows, scale, shift).join(F.broadcast(hot), "x", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int"), F.lit(0)))
    joined = keyed.join(done, ["x", "salt"])
    shares = F.array(*(F.lit(float(v)) for v in model.explained))
    return joined.select("vec_id", F.posexplode("whitened").alias("place", "whitened"), "deviation", "deviation_exact").select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("place")).alias("explained"), F.lit(float(error)).alias("identity_error"), "deviation_exact")


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
