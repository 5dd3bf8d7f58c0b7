"""License scan: exact phrases, and a search for short notices that tolerates edits.

The text becomes lower-cased words with single blanks. Base labels come from phrases that stand word by word.
For the notices, k + 1 disjoint pieces of each are exact seeds (with at most k edits one piece is intact); one
Aho-Corasick automaton finds all phrases and seeds in a single pass. Around each seed the regex library matches
the whole notice with at most k edits, at word bounds. The spans of one notice do not overlap: those with fewest edits
are taken first, and what is left of a window beside them is searched again. Windows have the length of their notice, so the time
grows with the text, also where seeds stand close together.

Defined results: null and empty texts have no words, no labels and score 0. Very long texts are read whole.
Repeated rows are scanned alike; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query

#: Phrases whose places count as the base.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices and their labels.
NOTICES = {
    "this work is licensed under the gnu general public license version 3": "gpl",
    "licensed under the gnu general public license": "gpl",
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution 4 0 international": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 10
_BETWEEN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def plain_words(text: bytes) -> bytes:
    """Lower-cased words with one blank around each."""
    return b" " + b" ".join(text.translate(_BETWEEN).split()) + b" "


def edits_of(notice: str, chars_per_edit: int) -> int:
    return max(1, len(notice) // chars_per_edit)


def seeds_of(notice: str, k: int) -> list[tuple[int, str]]:
    """k + 1 disjoint pieces with their places: at most k edits leave one of them intact."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=4)
def _automaton(phrases: tuple, notices: tuple, chars_per_edit: int):
    table: dict[str, list] = {}
    for phrase, label in phrases:
        table.setdefault(f" {phrase} ", []).append((None, label))
    patterns = []
    for number, (notice, label) in enumerate(notices):
        k = edits_of(notice, chars_per_edit)
        patterns.append((regex.compile(rf"(?b)(?<= )(?:{regex.escape(notice)}){{e<={k}}}(?= )"), label, k, len(notice)))
        for at, seed in seeds_of(notice, k):
            table.setdefault(seed, []).append((number, at))
    automaton = ahocorasick.Automaton()
    for key, values in table.items():
        automaton.add_word(key, (len(key), values))
    automaton.make_automaton()
    return automaton, patterns


def notice_spans(pattern, line: str, windows: set[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:  # noqa: ANN001
    """(start, end, edits) of the matches in the windows that do not overlap, fewest edits first; `least` is the shortest length of a match."""
    heap: list[tuple[int, int, int, int, int]] = []

    def search(a: int, b: int) -> None:
        if b - a >= least and (match := pattern.search(line, a, b)):
            heapq.heappush(heap, (sum(match.fuzzy_counts), match.start(), match.end(), a, b))

    for a, b in windows:
        search(a, b)
    taken: list[tuple[int, int, int]] = []
    while heap:
        edits, start, end, a, b = heapq.heappop(heap)
        at = bisect_left(taken, (start, start, 0))
        over = next((t for t in taken[max(at - 1, 0) : at + 1] if t[0] < end and start < t[1]), None)
        if over is None:
            insort(taken, (start, end, edits))
        else:
            search(a, min(b, over[0]))
            search(max(a, over[1]), b)
    return taken


def scan_text(text: bytes, phrases: tuple, notices: tuple, chars_per_edit: int) -> tuple:
    """n_words, base places (word, label) in order, and verified notices (word, words, label, edits, similarity)."""
    plain = plain_words(text)
    n_words = plain.count(b" ") - 1 if len(plain) > 2 else 0
    line = plain.decode("utf-8", "replace")
    automaton, patterns = _automaton(phrases, notices, chars_per_edit)
    places, around = [], {}
    for end, (length, values) in automaton.iter(line):
        for number, what in values:
            start = end - length + 1
            if number is None:
                places.append((start, what))
            else:
                _, _, k, size = patterns[number]
                around.setdefault(number, set()).add((max(0, start - what - k - 1), min(start - what + size + k + 1, len(line))))
    found = {}
    for number, spans in around.items():
        pattern, label, k, size = patterns[number]
        for start, end, edits in notice_spans(pattern, line, spans, size - k):
            found[start, end, label] = min(edits, found.get((start, end, label), (edits,))[0]), max(0.0, 1 - edits / size)
    if not places and not found:
        return max(n_words, 0), [], []
    blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), dtype="<u4") == 32)
    word = lambda at: int(np.searchsorted(blanks, at, side="right")) - 1  # noqa: E731  of the character behind a blank
    base = [(word(s), label) for s, label in sorted(places)]
    notices_found = [(word(s - 1), word(e - 1) - word(s - 1) + 1, label, edits, similarity) for (s, e, label), (edits, similarity) in sorted(found.items())]
    return max(n_words, 0), base, notices_found


SCAN = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "notices array<struct<word:long,words:long,label:string,edits:long,similarity:double>>")


def scan_licenses(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES,
                  notices: Mapping[str, str] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Per row: id, counts and places of base phrases, labels, score (1 with a base phrase, else the best similarity of a notice) and the notices with spans and edits."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    phrase_items, notice_items = tuple(phrases.items()), tuple(notices.items())
    kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
             ("score", pa.float64()), ("notices", pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("edits", pa.int64()), ("similarity", pa.float64())])))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").cast(pa.binary()):
                n_words, base, found = scan_text(text.as_py() or b"", phrase_items, notice_items, chars_per_edit)
                labels = {label for _, label in base}
                score = 1.0 if base else max((f[4] for f in found), default=0.0)
                out.append((n_words, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | {f[2] for f in found})), score,
                            [dict(zip(("word", "words", "label", "edits", "similarity"), f, strict=True)) for f in found]))
            columns = list(zip(*out, strict=True)) or [[]] * (len(kinds) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, (_, t) in zip(columns, kinds[1:], strict=True))], [n for n, _ in kinds])

    return rows.mapInArrow(run, f"doc_id long, {SCAN}")


@query("op7_license_notices")
def op7_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
