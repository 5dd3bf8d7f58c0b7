"""Language-model scores: a log-bilinear neural model trained in NumPy by noise-contrastive estimation.

Tokens are lower-cased words and one end per text. Words fall into at most 256 classes: the end, the most frequent words
by themselves, bands of equal mass of the next ones, and all rarer words together; within a class a word has its
smoothed share, so the probabilities of all words add up to one. The log-bilinear model gives the class after the two classes
before it: each position has its own table of context vectors, their sum is multiplied with the vectors of all classes, a bias is added,
and the softmax over the classes normalises it: one matrix product per batch of contexts.

Everything it learns from covers all training documents: word counts and counts of class trigrams are gathered by
Spark (at most 257 * 257 * 256 trigrams, however large the corpus). Training runs over the trigram table in parallel tasks, weighted by the counts, with
noise drawn from the class frequencies; after each round the tasks' parameters (about 50 kB each) are averaged.

Scoring is one pass with the `top_words` most frequent words (a fixed bound, 4 MB) at hand; the rarer words of a text leave as
(row, word, times) and meet their counts in a join, where no key is frequent.

Defined results: null and empty text is one end token. A null id is not held out. Repeated rows are scored alike. Without training
documents every token is unseen with probability 1, so scores are 0. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.session import materialize

from .registry import query
from .words import BLANKS, Words, chunks

TOP_WORDS = 1 << 18
SINGLE_WORDS, BANDS = 192, 62
END_CLASS, RARE_CLASS, START = 0, 1, 256
CLASSES = 256
DIMENSIONS = 16
ROUNDS, PARTS, BATCH, NOISE, RATE, INITIAL = 4, 8, 512, 32, 0.15, 0.1
END = np.int64(0x5E2D58D8B3BCDEE8)
FIRST = 0.01
_SLOTS = 22


def held_out(id_column: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts: rows, token hashes with an end behind each text, and bounds."""
    for a, b, data, bounds in chunks(column):
        words = Words(data, bounds, BLANKS)
        first = words.first + np.arange(b - a + 1)
        tokens = np.full(first[-1], END)
        inside = np.ones(first[-1], dtype=bool)
        inside[first[1:] - 1] = False
        tokens[inside] = words.hashes().view(np.int64)
        yield a, b, tokens, first


def count_words(texts: DataFrame) -> DataFrame:
    """word (hash), n: over all tokens of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(tokens, return_counts=True) for _, _, tokens, _ in _tokens(batch.column("text"))]
            if found:
                words, at = np.unique(np.concatenate([w for w, _ in found]), return_inverse=True)
                times = np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(times)], ["word", "n"])

    return texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The most frequent words with class and count; a table by the first bits of the hash finds them."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        self.words, self.counts, self.total, self.distinct = words, counts, total, distinct
        self.scale = total + 0.5 * (distinct + 1)
        smooth = counts + 0.5
        classes = np.full(len(words), RARE_CLASS, dtype=np.int16)
        is_end = words == END
        plain = np.flatnonzero(~is_end)  # most frequent first
        classes[is_end] = END_CLASS
        classes[plain[:SINGLE_WORDS]] = 2 + np.arange(len(plain[:SINGLE_WORDS]))
        rest = plain[SINGLE_WORDS:]
        if len(rest):
            mass = np.cumsum(smooth[rest])
            classes[rest] = 2 + SINGLE_WORDS + np.minimum((mass * BANDS / mass[-1]).astype(int), BANDS - 1)
        self.classes = classes
        mass = np.bincount(classes, smooth, minlength=CLASSES)
        mass[RARE_CLASS] += self.scale - smooth.sum()
        self.mass = mass
        #: log10 of a word's share in its class; for rare words the count is added later.
        self.within = np.log10(smooth) - np.log10(mass[classes]) if len(words) else np.zeros(0)
        self._slots()

    def _slots(self) -> None:
        slot = (self.words.view(np.uint64) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        self.slot = np.full(1 << _SLOTS, -1, dtype=np.int32)
        self.slot[slot[::-1]] = np.arange(len(slot))[::-1]  # the most frequent word of a slot
        self.shared = np.zeros(1 << _SLOTS, dtype=bool)
        self.shared[slot[self.slot[slot] != np.arange(len(slot))]] = True
        self.order = np.argsort(self.words)

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Place of each token among the words, -1 for others."""
        if not len(self.words):
            return np.full(len(tokens), -1)
        slot = (tokens.view(np.uint64) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        at = self.slot[slot]
        wrong = self.words[at] != tokens
        at = np.where(wrong, -1, at)
        again = np.flatnonzero(wrong & self.shared[slot])
        if len(again):
            k = self.order[np.minimum(np.searchsorted(self.words, tokens[again], sorter=self.order), len(self.order) - 1)]
            at[again] = np.where(self.words[k] == tokens[again], k, -1)
        return at

    def __getstate__(self):
        return self.words, self.counts, self.total, self.distinct

    def __setstate__(self, state):
        self.__init__(*state)


def _contexts(classes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two places before, START before the beginning of a text."""
    one = np.concatenate(([START], classes[:-1])).astype(np.int64)
    two = np.concatenate(([START, START], classes[:-2])).astype(np.int64)[: len(classes)]
    begins = bounds[:-1]
    one[begins] = START
    two[begins] = START
    second = (begins + 1)[begins + 1 < bounds[1:]]
    two[second] = START
    return one, two


def count_trigrams(texts: DataFrame, vocabulary) -> DataFrame:
    """key (of two classes and the next), n: over all tokens of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        for batch in batches:
            found = []
            for _, _, tokens, bounds in _tokens(batch.column("text")):
                at = words.find(tokens)
                classes = np.where(at < 0, RARE_CLASS, words.classes[at])
                one, two = _contexts(classes, bounds)
                found.append(np.unique((two * 257 + one) * CLASSES + classes, return_counts=True))
            if found:
                keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64))], ["key", "n"])

    return texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Context vectors of both positions, class vectors, class biases."""

    one: np.ndarray
    two: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(share: np.ndarray, seed: int = 5) -> Model:
        draw = np.random.default_rng(seed)
        small = lambda n: draw.normal(0, INITIAL, (n, DIMENSIONS)).astype(np.float32)
        return Model(small(257), small(257), small(CLASSES), np.log(share).astype(np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.one, self.two, self.target, self.bias]

    def log_probabilities(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of all classes after each context: one matrix product."""
        scores = (self.one[one] + self.two[two]) @ self.target.T + self.bias
        scores -= scores.max(axis=1, keepdims=True)
        return (scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))) / np.float32(math.log(10))


def contrast(model: Model, keys: np.ndarray, counts: np.ndarray, share: np.ndarray, seed: int) -> Model:
    """One pass of noise-contrastive estimation over weighted trigrams, by Adagrad.

    For a true class the model must say true rather than noise, for each class drawn from `share` noise; a batch shares its
    noise, which stands for `k` draws per true class."""
    draw = np.random.default_rng(seed)
    k = 8.0
    tables = [x.astype(np.float32).copy() for x in model.arrays()]
    squares = [np.full(x.shape, FIRST, dtype=np.float32) for x in tables]
    log_noise = np.log(k * share).astype(np.float32)
    order = draw.permutation(len(keys))
    mean = counts.mean() * BATCH if len(counts) else 1.0

    def move(i: int, at: np.ndarray | slice, step: np.ndarray) -> None:
        squares[i][at] += step * step
        tables[i][at] -= RATE * step / np.sqrt(squares[i][at])

    def summed(rows: np.ndarray, size: int, step: np.ndarray) -> np.ndarray:
        """Sum of the steps of each row."""
        order = np.argsort(rows, kind="stable")
        found, first = np.unique(rows[order], return_index=True)
        total = np.zeros((size, step.shape[1]), dtype=np.float32)
        total[found] = np.add.reduceat(step[order], first, axis=0)
        return total

    for a in range(0, len(order), BATCH):
        part = order[a : a + BATCH]
        key, weight = keys[part], (counts[part] / mean * BATCH / len(part)).astype(np.float32)
        true, one, two = key % CLASSES, key // CLASSES % 257, key // CLASSES // 257
        noise = draw.choice(CLASSES, size=NOISE, p=share)
        context = tables[0][one] + tables[1][two]
        up = (context * tables[2][true]).sum(axis=1) + tables[3][true] - log_noise[true]
        down = context @ tables[2][noise].T + tables[3][noise] - log_noise[noise]
        slope_true = -weight / (1 + np.exp(np.clip(up, -30, 30)))
        slope_noise = (k / NOISE) * weight[:, None] / (1 + np.exp(-np.clip(down, -30, 30)))
        to_context = slope_true[:, None] * tables[2][true] + slope_noise @ tables[2][noise]
        target = summed(np.concatenate((true, noise)), CLASSES, np.concatenate((slope_true[:, None] * context, slope_noise.T @ context)))
        bias = np.bincount(np.concatenate((true, noise)), np.concatenate((slope_true, slope_noise.sum(axis=0))), minlength=CLASSES).astype(np.float32)
        move(0, slice(None), summed(one, 257, to_context))
        move(1, slice(None), summed(two, 257, to_context))
        move(2, slice(None), target)
        move(3, slice(None), bias)
    return Model(*tables)


def train(trigrams: DataFrame, share: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Rounds of parallel passes over the trigram table, the parameters averaged by the tokens behind them."""
    model = Model.fresh(share)
    shapes = [x.shape for x in model.arrays()]
    context = trigrams.sparkSession.sparkContext
    for number in range(rounds):
        held = context.broadcast((model, share))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches]  # noqa: B023  at most a part of 16.9 million trigrams
            if parts:
                keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.float64)
                order = np.argsort(keys)
                start, noise = held.value  # noqa: B023
                found = contrast(start, keys[order], counts[order], noise, 1000 * number + int(keys.min() % 997))  # noqa: B023
                flat = np.concatenate([x.ravel() for x in found.arrays()]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary()), pa.array([counts.sum()])], ["parameters", "weight"])

        rows = trigrams.mapInArrow(run, "parameters binary, weight double").collect()  # a row of fixed size for each of the table's parts
        if not rows:
            break
        rows.sort(key=lambda r: (r["weight"], bytes(r["parameters"])))
        total = sum(r["weight"] for r in rows)
        mean = sum(np.frombuffer(r["parameters"], np.float32).astype(np.float64) * (r["weight"] / total) for r in rows)
        cuts = np.cumsum([math.prod(s) for s in shapes])[:-1]
        model = Model(*(x.reshape(s).astype(np.float32) for x, s in zip(np.split(mean, cuts), shapes, strict=True)))
        held.unpersist()
    return model


def _score_rows(rows: DataFrame, vocabulary, model) -> DataFrame:
    """Per row the sums over its frequent words, and its rarer words with their number of times."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_top long, base double, score double, rare array<long>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = vocabulary.value, model.value
        for batch in batches:
            for a, b, tokens, bounds in _tokens(batch.column("text")):
                at = words.find(tokens)
                top = at >= 0
                n = b - a
                owner = np.repeat(np.arange(n), np.diff(bounds))
                base = np.zeros(len(tokens))
                base[top] = np.log10(words.counts[at[top]] + 0.5)
                if words.total:
                    classes = np.where(top, words.classes[at], RARE_CLASS)
                    one, two = _contexts(classes, bounds)
                    distinct, where = np.unique(two * 257 + one, return_inverse=True)
                    # The softmax of all classes for some thousand contexts at a time.
                    found = np.empty(len(tokens), dtype=np.float64)
                    order = np.argsort(where, kind="stable")
                    edges = np.searchsorted(where[order], np.arange(0, len(distinct) + 4096, 4096))
                    for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                        part = distinct[k * 4096 : (k + 1) * 4096]
                        logs = net.log_probabilities(part % 257, part // 257)
                        found[order[x:y]] = logs[where[order[x:y]] - k * 4096, classes[order[x:y]]]
                    found += np.where(top, words.within[at], -math.log10(words.mass[RARE_CLASS]))
                else:
                    found = np.zeros(len(tokens))
                rare = np.flatnonzero(~top)
                place = np.lexsort((tokens[rare], owner[rare]))
                value, who = tokens[rare][place], owner[rare][place]
                new = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (who[1:] != who[:-1])))) if len(value) else np.zeros(0, int)
                times = np.diff(np.concatenate((new, [len(value)]))).astype(np.int32)
                cuts = pa.array(np.searchsorted(who[new], np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, n), batch.column("held_out").slice(a, n), pa.array(np.diff(bounds)), pa.array(np.bincount(owner[top], minlength=n).astype(np.int64)),
                    pa.array(np.bincount(owner, base, minlength=n)), pa.array(np.bincount(owner, found, minlength=n)), pa.ListArray.from_arrays(cuts, pa.array(value[new])), pa.ListArray.from_arrays(cuts, pa.array(times))],
                    ["doc_id", "held_out", "n_tokens", "n_top", "base", "score", "rare", "times"])

    return rows.mapInArrow(run, schema)


def score_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1, top_words: int = TOP_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
    training = rows.where(~F.col("held_out"))
    counts = materialize(count_words(training))
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(top_words).toArrow()
    context = documents.sparkSession.sparkContext
    words = Vocabulary(top.column("word").to_numpy(), top.column("n").to_numpy().astype(np.float64), int(totals["n"] or 0), int(totals["v"]))
    vocabulary = context.broadcast(words)
    share = np.maximum(words.mass / max(words.mass.sum(), 1.0), 1e-9)
    trigrams = materialize(count_trigrams(training, vocabulary).repartition(PARTS, "key"))
    model = context.broadcast(train(trigrams, share / share.sum(), rounds))

    scored = materialize(_score_rows(rows.select("doc_id", "held_out", "text"), vocabulary, model).withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    known = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_logs"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rare_known"))
    logs = F.coalesce("rare_logs", F.lit(0.0))
    return scored.select("row", "doc_id", "held_out", "n_tokens", "n_top", "base", "score").join(known, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_top") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * math.log10(words.scale)).alias("base_score"), (F.col("score") + (logs if words.total else F.lit(0.0))).alias("score"))


@query("op5_log_bilinear")
def op5_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
