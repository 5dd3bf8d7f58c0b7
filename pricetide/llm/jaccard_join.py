"""Similarity self-join of documents on word n-grams by adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of n-grams reaches the threshold t. Sets are kept
in one global order, rare n-grams first. If a pair links, its sets share at least o = ceil(t * larger size)
n-grams, so the prefixes of lengths |r| - o + l and |s| - o + l share at least l of them, for every l. Each
document chooses its own l: a longer prefix reads more postings but asks for more shared n-grams, so fewer
pairs are verified; the l of least estimated cost is taken. A pair is a candidate if its prefixes share at
least the smaller l of the two, which holds for every link, because a prefix for a larger l contains the
one for a smaller l. Candidates are verified on their whole sets.

Order: n-grams whose hash falls into the lower band, by document frequency and hash, then all others by hash.
Frequencies are counted over all documents, for the lower band; a document whose prefix needs more adds
its first n-grams of the upper band. N-grams of one document only take a place in its prefix but are never joined.

Equal texts form a class first, so copies are one row. Then, before any pair within a posting list is formed, its
most typical set is compared with all others (a star); lists that are one component after that need no pair
among themselves. For the classes in other lists the prefixes are made anew, all their n-grams being ordered by frequency
among these classes, and only pairs of different components are formed, counted and verified, which leaves the
components as they would be with all pairs. In these pairs the smaller set needs a shorter prefix (its overlap with a set that is not smaller is at
least 2t / (1 + t) of it), and a sketch of each whole set (the parity of its n-grams in bands of the hash space, which bounds the difference of two sets
from below) rules out, within the join, pairs that cannot reach t.

Defined results: null text and text without words has an empty set and links with nothing: its component is its own
id. A text of fewer words than n has one n-gram, the whole sequence. Rows that repeat an id are each
compared by their text; a component's id is its smallest id, null only if all are null. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricetide.operators.matching import connected_components
from pricetide.session import materialize

from .registry import query
from .words import BLANKS, Words, chunks, mix, windows

NGRAM = 5
NUMERATOR, DENOMINATOR = 75, 100
#: Share of the hash space whose n-grams are ordered by frequency in the first pass.
LOWER_BAND = 0.4
#: Largest l tried.
MAX_MATCHES = 8
#: Longs of a class's sketch in the last join.
SKETCH_WORDS = 32
#: Cost of verifying a pair in postings read.
VERIFY_COST = 20.0


def _sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts behind each other, and the bounds of each text's."""
    hashes = words.hashes()
    counts = words.counts
    grams = windows(hashes, list(range(n)))
    owner = words.text[: len(grams)]
    whole = owner == words.text[n - 1 :][: len(grams)] if len(grams) else np.zeros(0, dtype=bool)
    values, owners = grams[whole], owner[whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.array([_sequence(hashes[words.first[i] : words.first[i + 1]]) for i in short], dtype=np.uint64)
        values, owners = np.concatenate((values, extra)), np.concatenate((owners, short))
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[new], owners[new]
    return values, np.searchsorted(owners, np.arange(len(counts) + 1))


def _sequence(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence and its length."""
    total = np.uint64(len(hashes))
    with np.errstate(over="ignore"):
        for h in hashes:
            total = total * np.uint64(0x9E3779B97F4A7C15) + h
    return mix(np.array([total], dtype=np.uint64))[0]


def _identities(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text's word sequence."""
    hashes = words.hashes()
    place = (np.arange(len(hashes)) - words.first[words.text]).astype(np.uint64)
    out = []
    for salt in (np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes + mix(place * salt + salt)), dtype=np.uint64)))
        out.append(mix(sums[words.first[1:]] - sums[words.first[:-1]] + words.counts.astype(np.uint64) * salt).view(np.int64))
    return out[0], out[1]


def _read_texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words]]:
    for a, b, data, bounds in chunks(batch.column("text")):
        yield a, b, Words(data, bounds, BLANKS)


def _identify(rows: DataFrame, n: int, packed: bool) -> DataFrame:
    """The other columns, two keys of the text, size of its set (or, packed, only the keys and the compressed plain text)."""
    carried = [c for c in rows.columns if c != "text"]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for a, b, words in _read_texts(batch):
                one, two = _identities(words)
                if not packed:
                    sizes = np.diff(_sets(words, n)[1])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in carried), pa.array(one), pa.array(two), pa.array(sizes.astype(np.int64))], [*carried, "one", "two", "n_shingles"])
                    continue
                raw = words.data.tobytes()
                texts = [press.compress(raw[s:e]) for s, e in zip(words.bounds, words.bounds[1:], strict=False)]
                keep = pa.array(words.counts > 0)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(texts, pa.binary())], ["one", "two", "packed"]).filter(keep)

    return rows.mapInArrow(run, "one long, two long, packed binary" if packed else ", ".join([*(f"{c} {kinds[c]}" for c in carried), "one long, two long, n_shingles long"]))


def _unpack(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """Runs of compressed texts as words."""
    open_ = zstandard.ZstdDecompressor()
    texts = pa.array([open_.decompress(t.as_py()) for t in column], pa.binary())
    for a, b, data, bounds in chunks(texts):
        yield a, b, Words(data, bounds, BLANKS)


def _least_overlap(size: np.ndarray | int, numerator: int, denominator: int):
    """Smallest possible overlap of a set of this size with one that links to it."""
    return -(-numerator * size // denominator)


def _limit(band: float) -> np.uint64:
    """Largest hash of the lower band."""
    return np.uint64(min(int(band * 2**64), 2**64 - 1))


def _postings(classes: DataFrame, n: int, numerator: int, denominator: int, max_matches: int, band: float) -> DataFrame:
    """token, cls, size, low (n-grams in the lower band): all n-grams of the lower band, those of the upper band as far as a prefix may reach."""
    limit = _limit(band)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, words in _unpack(batch.column("packed")):
                values, bounds = _sets(words, n)
                sizes = np.diff(bounds)
                # Sets are sorted by hash: the lower band comes first.
                low = np.add.reduceat(np.concatenate((values <= limit, [False])), bounds[:-1]) * (sizes > 0) if len(values) else np.zeros(len(sizes), int)
                reach = np.minimum(sizes, sizes - _least_overlap(sizes, numerator, denominator) + max_matches)
                take = np.maximum(low, reach)
                place = np.arange(len(values)) - np.repeat(bounds[:-1], sizes)
                chosen = place < np.repeat(take, sizes)
                ids = batch.column("cls").slice(a, len(sizes)).to_numpy()
                yield pa.RecordBatch.from_arrays([
                    pa.array(values[chosen].view(np.int64)), pa.array(np.repeat(ids, take)), pa.array(np.repeat(sizes, take).astype(np.int32)), pa.array(np.repeat(low, take).astype(np.int32))],
                    ["token", "cls", "size", "low"])

    return classes.select("cls", "packed").mapInArrow(run, "token long, cls long, size int, low int")


def choose_prefix(size: int, low: int, tokens: np.ndarray, frequency: np.ndarray, numerator: int, denominator: int, max_matches: int, verify_cost: float, limit: np.uint64) -> tuple[int, np.ndarray, int, int]:
    """The l of least estimated cost, the shared n-grams in order, how many of them are in that prefix, and how many in the shorter
    one that is enough against sets of at least this size.

    `tokens`: hashes of the n-grams that other documents have too, `frequency` their counts; the others come before them in the lower
    band. Postings read are the sum of the frequencies; each candidate takes at least l of them."""
    upper = tokens > limit
    order = np.lexsort((tokens, np.where(upper, 0, frequency), upper))
    tokens, frequency, upper = tokens[order], frequency[order], upper[order]
    alone = low - int((~upper).sum())  # n-grams of this document only
    # Place of each shared n-gram in the whole order. In the upper band they are ranked among all by hash: `tokens` has only the
    # shared ones, but counting from `low` on gives a place that is never too large, hence never a shorter prefix.
    place = np.where(upper, low, alone) + np.where(upper, np.cumsum(upper) - 1, np.arange(len(tokens)))
    base = size - int(_least_overlap(size, numerator, denominator))
    # With a set s of at least this size: the least overlap is n / (n + d) * (|r| + |s|), not below 2n / (n + d) * |r|.
    short_base = size + (-2 * numerator * size // (numerator + denominator))
    best, best_cost, best_taken = 1, math.inf, 0
    for matches in range(1, max_matches + 1):
        if base + matches > size and matches > 1:
            break
        taken = place < base + matches
        read = float(frequency[taken].sum() - taken.sum())
        cost = read + verify_cost * read / matches
        if cost < best_cost:
            best, best_cost, best_taken = matches, cost, int(taken.sum())
    return best, tokens, best_taken, min(best_taken, int((place < short_base + best).sum()))


def _prefixes(classes: DataFrame, n: int, numerator: int, denominator: int, max_matches: int, verify_cost: float, band: float) -> DataFrame:
    """token, cls, size, common, matches, short: the prefix of each class, without n-grams that no other class has.

    `short` marks the n-grams that are enough against classes of at least the same size. `common` bounds what the class can share with any other; classes for which that is too little to link are left out."""
    postings, limit = _postings(classes, n, numerator, denominator, max_matches, band), _limit(band)
    shared = postings.withColumn("frequency", F.count("*").over(Window.partitionBy("token")).cast("int")).where("frequency > 1")
    lists = shared.groupBy("cls").agg(F.first("size").alias("size"), F.first("low").alias("low"), F.collect_list("token").alias("tokens"), F.collect_list("frequency").alias("frequencies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            tokens = []
            flat_tokens, flat_counts = batch.column("tokens").flatten().to_numpy().view(np.uint64), batch.column("frequencies").flatten().to_numpy()
            at = np.concatenate(([0], np.cumsum(batch.column("tokens").value_lengths().to_numpy())))
            keep = []
            for k, (size, low) in enumerate(zip(batch.column("size").to_pylist(), batch.column("low").to_pylist(), strict=True)):
                part = slice(at[k], at[k + 1])
                common = size - low + int((flat_tokens[part] <= limit).sum())
                best, ordered, taken, short = choose_prefix(size, low, flat_tokens[part], flat_counts[part], numerator, denominator, max_matches, verify_cost, limit)
                if taken and denominator * common >= numerator * size:
                    keep.append(k)
                    tokens.append(ordered[:taken])
                    for column, value in zip(columns, (size, common, best, short), strict=True):
                        column.append(value)
            bounds = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int32)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("cls").take(pa.array(keep, pa.int64())), *(pa.array(c, pa.int32()) for c in columns), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.view(np.int64)))],
                                             ["cls", "size", "common", "matches", "n_short", "tokens"])

    rows = lists.mapInArrow(run, "cls long, size int, common int, matches int, n_short int, tokens array<long>")
    return rows.select("cls", "size", "common", "matches", "n_short", F.posexplode("tokens").alias("place", "token")).select("cls", "size", "common", "matches", (F.col("place") < F.col("n_short")).alias("short"), "token")


def _sketches(classes: DataFrame, n: int, words: int = SKETCH_WORDS) -> DataFrame:
    """cls and `words` longs: for each of 64 * words bands of the hash space, whether the class has an odd number of n-grams in it.

    Two sets differ in at least one n-gram for every band in which their sketches differ."""
    names = [f"sketch{k}_" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in _unpack(batch.column("packed")):
                values, bounds = _sets(texts, n)
                rows = len(bounds) - 1
                band = (mix(values) % np.uint64(64 * words)).astype(np.int64)
                odd = np.zeros(rows * 64 * words, dtype=np.uint8)
                np.bitwise_xor.at(odd, np.repeat(np.arange(rows), np.diff(bounds)) * (64 * words) + band, 1)
                longs = np.packbits(odd).view(np.int64).reshape(rows, words)
                yield pa.RecordBatch.from_arrays([batch.column("cls").slice(a, rows), *(pa.array(longs[:, k].copy()) for k in range(words))], ["cls", *names])

    return classes.select("cls", "packed").mapInArrow(run, ", ".join(["cls long", *(f"{c} long" for c in names)]))


def _may_link(left: str, right: str, numerator: int, denominator: int, words: int = SKETCH_WORDS) -> Column:
    """False only for pairs that cannot link: a link allows (d - n) / (d + n) of both sizes as difference, and the sketches bound it from below."""
    differ = functools.reduce(Column.__add__, (F.bit_count(F.col(f"sketch{k}_{left}").bitwiseXOR(F.col(f"sketch{k}_{right}"))) for k in range(words)))
    return (numerator + denominator) * differ <= (denominator - numerator) * (F.col(f"size{left}") + F.col(f"size{right}"))


def _verify(pairs: DataFrame, classes: DataFrame, n: int, numerator: int, denominator: int) -> DataFrame:
    """The pairs (left_id, right_id) whose whole sets reach the threshold."""
    texts = classes.select("cls", "packed")
    both = pairs.join(texts.select(F.col("cls").alias("left_id"), F.col("packed").alias("left")), "left_id").join(texts.select(F.col("cls").alias("right_id"), F.col("packed").alias("right")), "right_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            sides = []
            for name in ("left", "right"):
                distinct = batch.column(name).dictionary_encode()
                sets = []
                for _, _, words in _unpack(distinct.dictionary):
                    values, bounds = _sets(words, n)
                    sets += [values[s:e] for s, e in zip(bounds, bounds[1:], strict=False)]
                sides.append([sets[i] for i in distinct.indices.to_pylist()])
            keep = []
            for left, right in zip(*sides, strict=True):
                shared = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(denominator * shared >= numerator * (len(left) + len(right) - shared))
            yield batch.select(["left_id", "right_id"]).filter(pa.array(keep, pa.bool_()))

    return both.select("left_id", "right_id", "left", "right").mapInArrow(run, "left_id long, right_id long")


def _merge(joined: DataFrame, links: DataFrame) -> DataFrame:
    """cls, component_id after further links: only components that a link meets are joined anew, each as one vertex."""
    if links.isEmpty():
        return joined
    between = links
    for side in ("left_id", "right_id"):
        between = between.join(joined.select(F.col("cls").alias(side), F.col("component_id").alias("at")), side, "left").withColumn(side, F.coalesce("at", side)).drop("at")
    merged = materialize(connected_components(between).select(F.col("listing_id").alias("before"), F.col("component_id").alias("after")))
    # A component is named by its least class, so the least name is the name of what is merged.
    kept = joined.join(merged, F.col("component_id") == F.col("before"), "left").select("cls", F.coalesce("after", "component_id").alias("component_id"))
    fresh = merged.join(joined.select(F.col("cls").alias("before")), "before", "left_anti").select(F.col("before").alias("cls"), F.col("after").alias("component_id"))
    return materialize(kept.unionByName(fresh))


def link_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, numerator: int = NUMERATOR, denominator: int = DENOMINATOR,
                   max_matches: int = MAX_MATCHES, verify_cost: float = VERIFY_COST) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links), row_key (of id and text), and one, two (equal for equal word sequences)."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"))
    members = materialize(_identify(rows, n, packed=False))
    classes = _identify(rows.select("text"), n, packed=True).groupBy("one", "two").agg(F.first("packed").alias("packed"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()))
    options = (n, numerator, denominator, max_matches, verify_cost)
    prefixes = materialize(_prefixes(classes, *options, LOWER_BAND))
    # A pair links only if neither is too small, nor has too few n-grams that it shares with anyone.
    fits = lambda a, b: (
        (denominator * F.least(a["size"], b["size"]) >= numerator * F.greatest(a["size"], b["size"]))
        & ((numerator + denominator) * F.least(a["common"], b["common"]) >= numerator * (a["size"] + b["size"])))

    def with_components(rows: DataFrame, found: DataFrame) -> DataFrame:
        """Postings with their component, of lists that have more than one."""
        rows = rows.join(found, "cls", "left").withColumn("component_id", F.coalesce("component_id", "cls"))
        lists = rows.groupBy("token").agg(F.min("component_id").alias("least"), F.max("component_id").alias("most")).where("least < most").select("token")
        return rows.join(lists, "token")

    def compare_with_hub(rows: DataFrame, second: bool) -> DataFrame:
        """Pairs of each list's hub (or, `second`, the hub among the other components than its own) with those of other components.

        The hub is the set with the fewest n-grams of its own, the smallest of these: what edited copies or texts around a passage have in common."""
        smallest = F.min(F.struct((F.col("size") - F.col("common")).alias("alone"), "size", "cls", "common", "component_id"))
        hubs = rows.groupBy("token").agg(smallest.alias("hub"))
        if second:
            hubs = rows.join(hubs.select("token", F.col("hub.component_id").alias("not_id")), "token").where("component_id <> not_id").groupBy("token").agg(smallest.alias("hub"))
        near = rows.join(hubs, "token").where(F.col("component_id") != F.col("hub.component_id")).where(fits({c: F.col(c) for c in ("size", "common")}, F.col("hub")))
        return near.select(F.least("cls", "hub.cls").alias("left_id"), F.greatest("cls", "hub.cls").alias("right_id")).distinct()

    # First every posting list's hub with all others of the list: it links with most of what links within the list.
    tried = materialize(compare_with_hub(prefixes.withColumn("component_id", F.col("cls")), False))
    links = materialize(_verify(tried, classes, n, numerator, denominator))
    joined = materialize(connected_components(links).withColumnRenamed("listing_id", "cls"))

    # A further link joins two components within such a list. Only their classes are left: now all their n-grams are ordered by
    # their frequency among them, so a passage that many share comes last.
    rest = classes.join(with_components(prefixes, joined).select("cls").distinct(), "cls", "left_semi")
    prefixes = materialize(_prefixes(rest, *options, 1.0))
    for second in (False, True, True):
        more = materialize(compare_with_hub(with_components(prefixes, joined), second).join(tried, ["left_id", "right_id"], "left_anti"))
        tried = tried.unionByName(more)
        further = materialize(_verify(more, classes, n, numerator, denominator))
        if second and further.isEmpty():
            break  # the components and so the hubs stay as they are
        joined = _merge(joined, further)

    # Then all pairs that are left between the components of a list, counted before they are verified.
    # The smaller class of a pair meets the other with its shorter prefix only, and sketches of the whole sets rule out most pairs
    # whose similarity lies below the threshold before they leave the join.
    left = with_components(prefixes, joined)
    left = materialize(left.join(_sketches(rest, n), "cls"))
    right = left.select("token", *(F.col(c).alias(f"{c}2") for c in ("cls", "size", "common", "matches", "short", "component_id", *(f"sketch{k}_" for k in range(SKETCH_WORDS)))))
    smaller = (F.col("size") < F.col("size2")) | ((F.col("size") == F.col("size2")) & (F.col("cls") < F.col("cls2")))
    apart = (F.col("cls") < F.col("cls2")) & (F.col("component_id") != F.col("component_id2")) & F.when(smaller, F.col("short")).otherwise(F.col("short2")) & _may_link("", "2", numerator, denominator) & fits(*({c: F.col(c + k) for c in ("size", "common")} for k in ("", "2")))
    pairs = left.join(right, "token").where(apart).groupBy("cls", "cls2").agg(F.count("*").alias("shared"), F.first("matches").alias("matches"), F.first("matches2").alias("matches2"))
    pairs = pairs.where(F.col("shared") >= F.least("matches", "matches2")).select(F.col("cls").alias("left_id"), F.col("cls2").alias("right_id"))
    last = _verify(pairs.join(tried, ["left_id", "right_id"], "left_anti"), classes, n, numerator, denominator)
    components = _merge(joined, materialize(last))
    smallest = members.groupBy("one", "two").agg(F.min("doc_id").alias("least_id"))
    placed = classes.select("one", "two", "cls").join(smallest, ["one", "two"]).join(components, "cls", "left").withColumn("component", F.coalesce("component_id", "cls"))
    ids = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_text = placed.select("one", "two", "component").join(ids, "component").select("one", "two", "component", "component_id")
    return members.join(by_text, ["one", "two"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "row_key", "component", "one", "two")


def row_key(id_column: Column, text: Column) -> Column:
    """Equal for rows of equal id and text."""
    return F.md5(F.concat(F.coalesce(id_column.cast("string"), F.lit("")), F.lit("\n"), F.when(text.isNull(), "n").otherwise("t"), F.coalesce(text.cast("string"), F.lit(""))))


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One document of each component, that of the smallest id (null ids last), with all its columns; texts without words all stay, but rows that repeat id and text leave one."""
    linked = link_documents(documents, id_col, text_col, **parameters)
    group = F.when(F.col("n_shingles") > 0, F.struct("component", F.lit("").alias("own"))).otherwise(F.struct(F.lit(-1).cast("long").alias("component"), F.col("row_key").alias("own")))
    kept = linked.groupBy(group.alias("group")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("first")).select(F.col("first.row_key").alias("__row_key"))
    rows = documents.withColumn("__row_key", row_key(F.col(id_col), F.col(text_col))).join(kept, "__row_key")
    return rows.withColumn("__copy", F.row_number().over(Window.partitionBy("__row_key").orderBy("__row_key"))).where("__copy = 1").select(*(F.col(f"`{c}`") for c in documents.columns))


ORACLE = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM texts WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
often AS (SELECT gram FROM grams GROUP BY gram HAVING count(*) > 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN often USING (gram) JOIN grams b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM texts UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM texts t LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


@query("op10_jaccard_join", ORACLE)
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
