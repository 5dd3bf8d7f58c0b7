"""Benchmark decontamination by spaced-seed hashing.

A mask names the positions of a token window that are hashed; the others are ignored, so a hit survives
substitutions there. The masks lose nothing: a run of at least 12 tokens with at least 80 % equal ones contains 12 tokens
with at most two substitutions, 15 with at most three or 20 with at most four (halve it as long as both parts have 12), and each placement of
these leaves some mask untouched somewhere. Test windows are hashed under every mask. From the test hashes a bit table of fixed
size is made; one pass over the corpus hashes every window under every mask and keeps the regions around
windows in the table. The kept hashes are joined with the test hashes (the join decides, the table only saves
shuffling), and each (region, item, diagonal) is verified: along the diagonal, tokens are compared and the best
run with at least `min_identity` equal tokens is taken; it counts if it has `min_overlap` tokens. The whole item with that share of equal
tokens counts as well, however short it is.

A test item shorter than the longest window has masks of its own, with four hashed positions: of 6 to 11 tokens with at most a fifth
substituted, some placement is left untouched. Below six tokens no substitution leaves enough, and an item is hashed whole and must occur
exactly; items of fewer than `min_item_tokens` tokens are no evidence and are left out.

Tokens are runs of letters and digits, in lower case.

Defined results: null and empty texts, in corpus or benchmark, never match. Corpus rows that repeat id and text are
reported once and all removed by `decontaminate`; repeated items are each reported. Rows with a null doc id are reported under null. An empty table gives no rows.
Further columns are ignored by the report and kept by `decontaminate`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.session import materialize

from .registry import query
from .words import Words, byte_class, chunks, windows

#: Windows of up to twelve tokens, seven of them hashed: together they meet every run that the verifier accepts at MIN_OVERLAP and MIN_IDENTITY.
MASKS = ("111010111", "110100100111", "1111111", "111010001101", "101111011", "11001110011")
#: For items of 6 to 11 tokens: together they meet every placement of the substitutions that MIN_IDENTITY allows there.
SHORT_MASKS = ("1111", "110011")
SHORT_TOKENS = 6
MIN_OVERLAP = 12
MIN_IDENTITY = 0.8
MIN_ITEM_TOKENS = 6
#: Bits of the table (2 MB), whatever the size of the benchmark.
TABLE_BITS = 1 << 24
_BETWEEN = byte_class(bytes(c for c in range(128) if not chr(c).isalnum()))
_SIGNS = re.compile("[\u0080-©«-±´¶-¸»¿×÷ -⁯₠-⃏←-⯿⸀-⹿　-〄〈-〠︰-﹏！-／]")


def _plain(column: pa.Array) -> pa.Array:
    """Lower-cased texts, signs outside ASCII blanked."""
    return pa.array([_SIGNS.sub(" ", t.lower()) if t and not t.isascii() else (t or "").lower() for t in column.to_pylist()], pa.string())


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    for a, b, data, bounds in chunks(_plain(column)):
        yield a, b, Words(data, bounds, _BETWEEN, lower=False)


def mask_offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _hash(hashes: np.ndarray, text: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes under a mask and the start of each; windows over the end of a text are left out."""
    span = len(mask)
    n = max(len(hashes) - span + 1, 0)
    starts = np.flatnonzero(text[:n] == text[span - 1 :][:n]) if n else np.zeros(0, np.int64)
    values = windows(hashes, mask_offsets(mask))[starts]
    return (values ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64), starts


def masks_of(n: int, masks: tuple[str, ...]) -> list[tuple[str, int]]:
    """The masks of an item of n tokens, each with the salt of its hashes."""
    if n >= max(map(len, masks)):
        return [(m, k) for k, m in enumerate(masks)]
    return [(m, 100 + k) for k, m in enumerate(SHORT_MASKS)] if n >= SHORT_TOKENS else [("1" * n, 200 + n)]


def item_windows(benchmark: DataFrame, masks: tuple[str, ...], min_item_tokens: int, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, tokens) and (hash, item, item_at, mask) of the items."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id())

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, _, words in _tokens(batch.column("text")):
                hashes = words.hashes()
                for k, (s, e) in enumerate(zip(words.first, words.first[1:], strict=False)):
                    if e - s >= min_item_tokens:
                        out.append((batch.column("item")[a + k].as_py(), batch.column("item_id")[a + k].as_py(), hashes[s:e].tobytes(), int(e - s)))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int32()), strict=True)], ["item", "item_id", "tokens", "n"])

    found = materialize(rows.mapInArrow(items, "item long, item_id long, tokens binary, n int"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, tokens, n in zip(*(batch.column(c).to_pylist() for c in ("item", "tokens", "n")), strict=True):
                values = np.frombuffer(tokens, dtype=np.uint64)
                for mask, salt in masks_of(n, masks):
                    keys, at = _hash(values, np.zeros(n, np.int64), mask, salt)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(at), item)), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), len(mask), np.int32))], ["hash", "item", "item_at", "span"])

    return found, materialize(found.select("item", "tokens", "n").mapInArrow(hashed, "hash long, item long, item_at int, span int"))


def bit_table(keys: DataFrame, bits: int) -> bytes:
    """Bits set for all hashes: at most bits / 64 rows reach the driver."""
    shift = 64 - (bits.bit_length() - 1)
    place = F.shiftrightunsigned("hash", shift)
    rows = keys.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {shift}) % 64 as int))").alias("bit"))
    table = np.zeros(bits // 64, dtype=np.int64)
    found = rows.groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table.tobytes()


def find_regions(documents: DataFrame, table: bytes, masks: tuple[str, ...], short_spans: tuple[int, ...], margin: int, bits: int) -> DataFrame:
    """Regions of the corpus around windows whose hash is in the table: doc_id, key (of the text), start, tokens, and the windows' places and hashes."""
    held = documents.sparkSession.sparkContext.broadcast(table)
    shift = np.uint64(64 - (bits.bit_length() - 1))
    kinds = list(dict.fromkeys(kind for n in (max(map(len, masks)), *short_spans) for kind in masks_of(n, masks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_table = np.frombuffer(held.value, dtype=np.uint64)
        for batch in batches:
            for a, _, words in _tokens(batch.column("text")):
                hashes = words.hashes()
                places, keys = [], []
                for mask, salt in kinds:
                    values, starts = _hash(hashes, words.text, mask, salt)
                    bit = values.view(np.uint64) >> shift
                    hit = (words_table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                    places.append(starts[hit])
                    keys.append(values[hit])
                at, key = np.concatenate(places), np.concatenate(keys)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, key = at[order], key[order]
                owner = words.text[at]
                new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (at[1:] - at[:-1] > 2 * margin)))
                first = np.flatnonzero(new)
                last = np.concatenate((first[1:], [len(at)])) - 1
                lo = np.maximum(at[first] - margin, words.first[owner[first]])
                hi = np.minimum(at[last] + margin, words.first[owner[first] + 1])
                rows = owner[first] + a
                bounds = np.concatenate((first, [len(at)])).astype(np.int32)
                relative = (at - np.repeat(lo, np.diff(bounds))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(rows)), batch.column("key").take(pa.array(rows)), pa.array((lo - words.first[owner[first]]).astype(np.int64)),
                    pa.array([hashes[x:y].tobytes() for x, y in zip(lo, hi, strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(relative)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(key))], ["doc_id", "key", "start", "tokens", "places", "hashes"])

    return documents.mapInArrow(run, "doc_id long, key string, start long, tokens binary, places array<int>, hashes array<long>")


def best_run(equal: np.ndarray, min_identity: float) -> tuple[int, int]:
    """The longest stretch [a, b) that begins and ends on an equal token and has at least that share of equal tokens."""
    hits = np.flatnonzero(equal)
    if not len(hits):
        return 0, 0
    # A stretch from a to b qualifies if the sum of (equal - share) over it is not negative.
    sums = np.concatenate(([0.0], np.cumsum(equal - min_identity)))
    best = (0, 0)
    lowest = np.minimum.accumulate(sums)
    for b in hits[::-1] + 1:
        if b - hits[0] <= best[1] - best[0]:
            break
        a = int(np.searchsorted(-lowest[: b], -(sums[b] + 1e-9)))  # the first start not above the sum at b
        if a < b and sums[a] <= sums[b] + 1e-9:
            a = int(hits[np.searchsorted(hits, a)])
            if b - a > best[1] - best[0]:
                best = (a, int(b))
    return best


def find_overlaps(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS,
                  min_overlap: int = MIN_OVERLAP, min_identity: float = MIN_IDENTITY, min_item_tokens: int = MIN_ITEM_TOKENS, bits: int = TABLE_BITS) -> DataFrame:
    """Verified overlaps: doc_id, key (md5 of the text), item_id, doc_start, item_start, n_tokens, n_equal; the longest one of each row and item."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").withColumn("key", F.md5("text"))
    items, keys = item_windows(benchmark, masks, min_item_tokens, item_col, item_text_col)
    span = max(map(len, masks))
    sizes = items.agg(F.max("n").alias("most"), F.collect_set(F.when(F.col("n") < span, F.col("n"))).alias("short")).first()
    margin = int(sizes["most"] or 0) + span
    regions = materialize(find_regions(rows.select("doc_id", "key", "text"), bit_table(keys, bits), masks, tuple(sorted(sizes["short"])), margin, bits).withColumn("region", F.monotonically_increasing_id()))
    hits = regions.select("region", F.explode(F.arrays_zip("places", "hashes")).alias("hit")).select("region", F.col("hit.places").alias("at"), F.col("hit.hashes").alias("hash"))
    near = hits.join(keys, "hash").select("region", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    both = near.join(regions.select("region", "doc_id", "key", "start", "tokens"), "region").join(items.select("item", "item_id", F.col("tokens").alias("item_tokens"), "n"), "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (diagonal, start, tokens, item_tokens, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("diagonal", "start", "tokens", "item_tokens", "n")), strict=True)):
                text, item = np.frombuffer(tokens, np.uint64), np.frombuffer(item_tokens, np.uint64)
                lo, hi = max(0, -diagonal), min(n, len(text) - diagonal)
                equal = text[lo + diagonal : hi + diagonal] == item[lo:hi]
                share = min_identity if n >= SHORT_TOKENS else 1.0
                a, b = best_run(equal, share)
                if b - a < min_overlap and hi - lo == n and equal.sum() >= share * n - 1e-9:
                    a, b = 0, n
                if b - a >= min(min_overlap, n):
                    out.append((i, start + lo + diagonal + a, lo + a, b - a, int(equal[a:b].sum())))
            rows = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("doc_id", "key", "item_id")), *(pa.array([o[k] for o in out], pa.int64()) for k in range(1, 5))], ["doc_id", "key", "item_id", "doc_start", "item_start", "n_tokens", "n_equal"])

    found = both.select("doc_id", "key", "item_id", "diagonal", "start", "tokens", "item_tokens", "n").mapInArrow(verify, "doc_id long, key string, item_id long, doc_start long, item_start long, n_tokens long, n_equal long")
    longest = F.max(F.struct("n_equal", "n_tokens", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"))).alias("best")
    return found.groupBy("doc_id", "key", "item_id").agg(longest).select(
        "doc_id", "key", "item_id", (-F.col("best.d")).alias("doc_start"), (-F.col("best.i")).alias("item_start"), F.col("best.n_tokens").alias("n_tokens"), F.col("best.n_equal").alias("n_equal"))


def contaminated_documents(documents: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """One row per contaminated document: doc_id, n_items, item_ids (sorted), n_tokens and n_equal of its longest overlap, and its place."""
    found = find_overlaps(documents, benchmark, **parameters)
    best = F.max(F.struct("n_equal", "n_tokens", (-F.col("doc_start")).alias("d"), (-F.col("item_id")).alias("i"))).alias("best")
    return found.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), best).select(
        "doc_id", F.size("item_ids").cast("long").alias("n_items"), "item_ids", (-F.col("best.i")).alias("best_item"), (-F.col("best.d")).alias("doc_start"), F.col("best.n_tokens").alias("n_tokens"), F.col("best.n_equal").alias("n_equal"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The documents without the contaminated ones, all columns kept."""
    bad = find_overlaps(documents, benchmark, id_col=id_col, text_col=text_col, **parameters).select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")).distinct()
    return documents.join(bad, F.md5(documents[text_col].cast("string")).eqNullSafe(bad["bad_key"]) & documents[id_col].cast("long").eqNullSafe(bad["bad_id"]), "left_anti")


@query("op1_spaced_seeds")
def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
