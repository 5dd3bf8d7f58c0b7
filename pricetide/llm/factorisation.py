"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of the text.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairs are summed in linear time as
half of (sum_i v_i x_i)^2 - sum_i (v_i x_i)^2 in each of the `rank` dimensions. Features: hashed lower-case words
(log counts, scaled to length one), and standardised statistics of the text: shares of symbols, digits, capitals,
punctuation and non-ASCII bytes, mean word length, repeated lines and words, and as metadata its length and number of lines.

Labels are learnt from a bounded sample: the `sample_rows` training rows with the least hash of their id (documented bound; all rows if there are
fewer), each id, label and text once, however often the documents repeat it. Their features are made by Spark; the machine is fitted in NumPy by Adagrad and travels as a
few arrays of fixed size. Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts have no words and get the score of their statistics. Ids that repeat in the labels with different
labels give one training row each; null labels or ids are not used. Repeated documents get equal scores. Without training rows every score is
0.5. A null id is not held out. An empty table gives no rows. Further columns are ignored by `classify` and kept by `filter_documents`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query
from .words import BLANKS, Words, byte_class, chunks

BUCKETS = 1 << 14
RANK = 8
SAMPLE_ROWS = 8_000
THRESHOLD = 0.7
EPOCHS = 6
RATE = 0.1
DECAY = 1e-5
_KINDS = {"symbols": byte_class(b"#*$%&|<>@^_~=+{}[]\\/"), "digits": byte_class(b"0123456789"), "capitals": byte_class(bytes(range(65, 91))),
          "stops": byte_class(b".,;:?\"'()-"), "shouts": byte_class(b"!"), "high": byte_class(bytes(range(128, 256)))}
N_STATS = len(_KINDS) + 7


def held_out(id_column: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return (sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.float64)


def _repeats(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per text: how many values equal an earlier one of the same text."""
    order = np.lexsort((values, owner))
    same = (values[order][1:] == values[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return np.bincount(owner[order][1:][same], minlength=n).astype(np.float64)


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts: first row, statistics, and the words as (text bounds, buckets, values)."""
    for a, b, data, bounds in chunks(column):
        words = Words(data, bounds, BLANKS)
        hashes, n = words.hashes(), b - a
        size, count = np.maximum(np.diff(bounds), 1).astype(np.float64), np.maximum(words.counts, 1).astype(np.float64)
        lines = Words(data, bounds, byte_class(b"\n"), lower=False)
        n_lines = np.maximum(lines.counts, 1).astype(np.float64)
        per_word = _per_text(~BLANKS[data], bounds)
        pairs = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
        inner = words.text[1:] == words.text[:-1]
        stats = [_per_text(table[data], bounds) / size for table in _KINDS.values()]
        stats += [per_word / count / 10, _repeats(hashes, words.text, n) / count, _repeats(pairs[inner], words.text[1:][inner], n) / count,
                  _repeats(lines.hashes(), lines.text, n) / n_lines, np.log1p(np.diff(bounds)) / 10, np.log1p(lines.counts) / 10, np.log1p(words.counts) / 10]
        key = words.text.astype(np.int64) * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64)
        found, times = np.unique(key, return_counts=True)
        owner, values = found // BUCKETS, np.log1p(times)
        length = np.sqrt(np.bincount(owner, values * values, minlength=n))
        yield a, np.stack(stats, axis=1), np.searchsorted(owner, np.arange(n + 1)), (found % BUCKETS).astype(np.int32), (values / length[owner]).astype(np.float32)


@dataclass
class Machine:
    """Weights of words and statistics; the statistics are standardised by their training mean and deviation."""

    bias: float
    weights: np.ndarray  # BUCKETS + N_STATS
    factors: np.ndarray  # the same, by rank
    mean: np.ndarray
    deviation: np.ndarray

    def standardise(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.deviation, -4, 4)

    def margins(self, stats: np.ndarray, bounds: np.ndarray, buckets: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid: both sums of the pair term run over the non-zero features only."""
        x = self.standardise(stats)
        n = len(x)
        owner = np.repeat(np.arange(n), np.diff(bounds))
        dot = lambda a, b: (a * b).sum(axis=1)  # noqa: E731  unlike a matrix product, the same for a row in any batch
        linear = self.bias + dot(x, self.weights[BUCKETS:]) + np.bincount(owner, self.weights[buckets] * values, minlength=n)
        v = self.factors[BUCKETS:]
        pairs = np.zeros(n)
        for f in range(self.factors.shape[1]):
            each = self.factors[buckets, f] * values
            total = dot(x, v[:, f]) + np.bincount(owner, each, minlength=n)
            squares = dot(x * x, v[:, f] ** 2) + np.bincount(owner, each * each, minlength=n)
            pairs += total * total - squares
        return linear + 0.5 * pairs


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(stats: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, seed: int = 7) -> Machine:
    """Adagrad on the log loss, one row at a time; classes are not reweighted, so scores stay calibrated."""
    draw = np.random.default_rng(seed)
    size = BUCKETS + N_STATS
    mean, deviation = (stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)) if len(stats) else (np.zeros(N_STATS), np.ones(N_STATS))
    share = np.clip(labels.mean(), 0.01, 0.99) if len(labels) else 0.5
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(size), draw.normal(0, 0.02, (size, rank)), mean, deviation)
    square_bias, square_w, square_v = 1.0, np.full(size, 1.0), np.full((size, rank), 1.0)
    x_stats = machine.standardise(stats)
    tail = np.arange(BUCKETS, size)
    for _ in range(epochs):
        for i in draw.permutation(len(labels)):
            at = np.concatenate((words[i][0], tail))
            x = np.concatenate((words[i][1], x_stats[i]))
            w, v = machine.weights[at], machine.factors[at]
            vx = v * x[:, None]
            total = vx.sum(axis=0)
            margin = machine.bias + w @ x + 0.5 * float((total * total).sum() - (vx * vx).sum())
            slope = float(sigmoid(np.array(margin)) - labels[i])
            step_w = slope * x + decay * w
            step_v = slope * (x[:, None] * (total - vx)) + decay * v
            square_bias += slope * slope
            square_w[at] += step_w * step_w
            square_v[at] += step_v * step_v
            machine.bias -= rate * slope / np.sqrt(square_bias)
            machine.weights[at] = w - rate * step_w / np.sqrt(square_w[at])
            machine.factors[at] = v - rate * step_v / np.sqrt(square_v[at])
    return machine


def training_rows(documents: DataFrame, labels: DataFrame, sample_rows: int, folds: int, fold: int) -> DataFrame:
    """doc_id, label, key of the text and features of the training sample: at most `sample_rows` labels meet their texts, and at most as many rows are left."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("label")).where("label_id is not null and label in (0, 1)").where(~held_out(F.col("label_id"), folds, fold))
    chosen = chosen.distinct().orderBy(F.xxhash64("label_id"), "label_id", "label").limit(sample_rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "label", F.xxhash64("text").alias("key"), "text")  # at most sample_rows rows of 12 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, stats, bounds, buckets, values in features(batch.column("text")):
                n = len(stats)
                at = pa.array(bounds.astype(np.int32))
                flat = pa.array(np.arange(n + 1, dtype=np.int32) * N_STATS)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, n) for c in ("doc_id", "label", "key")), pa.ListArray.from_arrays(flat, pa.array(stats.ravel())), pa.ListArray.from_arrays(at, pa.array(buckets)), pa.ListArray.from_arrays(at, pa.array(values))],
                                                 ["doc_id", "label", "key", "stats", "buckets", "values"])

    made = rows.mapInArrow(run, "doc_id long, label int, key long, stats array<double>, buckets array<int>, values array<float>")
    once = made.groupBy("doc_id", "label", "key").agg(F.first(F.struct("stats", "buckets", "values")).alias("x"))  # copies of a text have equal features
    return once.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "key").limit(sample_rows).select("doc_id", "label", "key", "x.*")


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = 4, fold: int = 2, **parameters) -> Machine | None:
    """Fit on the sample; None without training rows."""
    table = training_rows(documents, labels, sample_rows, folds, fold).toArrow().combine_chunks()
    if not table.num_rows:
        return None
    lists = {c: table.column(c).combine_chunks() for c in ("stats", "buckets", "values")}
    bounds = lists["buckets"].offsets.to_numpy()
    buckets, values = lists["buckets"].values.to_numpy(), lists["values"].values.to_numpy()
    order = np.lexsort(tuple(table.column(c).to_numpy() for c in ("key", "label", "doc_id")))  # the same fit however the rows were dealt out
    words = [(buckets[bounds[i] : bounds[i + 1]], values[bounds[i] : bounds[i + 1]]) for i in order]
    return fit(lists["stats"].values.to_numpy().reshape(-1, N_STATS)[order], words, table.column("label").to_numpy()[order].astype(np.float64), **parameters)


def score(documents: DataFrame, machine: Machine | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The documents with a score between 0 and 1."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            if machine is None:
                yield pa.array(np.full(len(column), 0.5))
                continue
            parts = [sigmoid(machine.margins(stats, bounds, buckets, values)) for _, stats, bounds, buckets, values in features(column)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return documents.withColumn(score_col, scored(F.col(text_col).cast("string")))


def classify(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD, folds: int = 4, fold: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    machine = train(rows, labels, sample_rows, folds, fold)
    return score(rows, machine).select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filter_documents(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **parameters) -> DataFrame:
    """The documents that score at least `threshold`, with their own columns; all of them without a training row, as nothing is known then."""
    rows = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    machine = train(rows, labels, **parameters)
    if machine is None:
        return documents
    packed = documents.select(F.struct("*").alias("row"), F.col(f"`{text_col}`").alias("text"))
    return score(packed, machine).where(F.col("score") >= threshold).select("row.*")


@query("op3_factorisation")
def op3_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
