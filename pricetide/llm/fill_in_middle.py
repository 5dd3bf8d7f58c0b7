"""Fill-in-middle transformation with a sparse index of multibyte characters.

A text is cut into units (runs of A-Z and a-z, every other character by itself; or single characters), two cuts drawn from a
hash of its id part it into prefix, middle and suffix, and the parts are written behind markers in one of two orders. Work goes on over
the UTF-8 bytes of a whole run of texts: only multibyte characters are recorded, with their position and excess bytes, and a
binary search among them turns byte cuts into code-point cuts and back; between two of them positions differ by a constant,
so ASCII spans are plain arithmetic.

Forms: plain (the text itself), psm (prefix, suffix, middle) and spm (suffix, prefix, middle). A text that contains a marker stays plain,
so the markers in an output are those written here and `restore` finds the parts again by them.

Defined results: null text is like an empty one and stays plain, with n = 0. Long texts are cut whole. A null id is written as nothing behind
the salt. Repeated rows give repeated, equal results; equal hashes (ties of the two cuts) give an empty middle; an empty
table gives no rows; further columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query
from .words import byte_class, chunks

LETTERS = byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Settings:
    """Markers, share of texts in hundredths that change form, share of these in the order suffix first, and what is hashed before the id."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    changed: int = 90
    suffix_first: int = 20
    salt: str = "1:"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or any(len(m) < 2 or m[0] in m[1:] or m[0] in other[1:] for m in marks for other in marks):
            raise ValueError("markers must differ, and no marker's first character may occur later in one")


class ExceptionIndex:
    """Positions of the multibyte characters of UTF-8 bytes and the bytes each has beyond one."""

    def __init__(self, data: np.ndarray):
        self.bytes = np.flatnonzero(data >= 0xC0)
        lead = data[self.bytes]
        self.excess = np.concatenate(([0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0).astype(np.int64))))
        self.characters = self.bytes - self.excess[:-1]

    def to_characters(self, at: np.ndarray) -> np.ndarray:
        """Code points before each byte position (a character's first byte, or the end)."""
        return at - self.excess[np.searchsorted(self.bytes, at)]

    def to_bytes(self, at: np.ndarray) -> np.ndarray:
        """Bytes before each code-point position."""
        return at + self.excess[np.searchsorted(self.characters, at)]


def unit_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First byte of every unit: a letter behind no letter of the same text, or the first byte of any other character."""
    letter = LETTERS[data]
    fresh = np.ones(len(data), dtype=bool)
    fresh[1:] = ~letter[:-1]
    fresh[bounds[:-1][bounds[:-1] < len(data)]] = True
    return np.flatnonzero((letter & fresh) | (~letter & ((data & 0xC0) != 0x80)))


def cut_texts(data: np.ndarray, bounds: np.ndarray, one: np.ndarray, two: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, its two byte cuts, and the code points of its prefix and middle, for two drawn numbers a text."""
    index = ExceptionIndex(data)
    begin = index.to_characters(bounds)
    if unit == "character":
        n = np.diff(begin)
        low, high = np.minimum(one % (n + 1), two % (n + 1)), np.maximum(one % (n + 1), two % (n + 1))
        return n, index.to_bytes(begin[:-1] + low), index.to_bytes(begin[:-1] + high), low, high - low
    starts = unit_starts(data, bounds)
    first = np.searchsorted(starts, bounds)
    n = np.diff(first)
    ends = np.concatenate((starts, [len(data)]))  # where a unit begins, the one before it ends
    cuts = [np.minimum(ends[first[:-1] + drawn], bounds[1:]) for drawn in (np.minimum(one % (n + 1), two % (n + 1)), np.maximum(one % (n + 1), two % (n + 1)))]
    low, high = (index.to_characters(c) for c in cuts)
    return n, *cuts, low - begin[:-1], high - low


def transform(documents: DataFrame, settings: Settings = Settings(), unit: str = "token", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output."""
    if unit not in ("token", "character"):
        raise ValueError("unit is token or character")
    digest = F.sha2(F.concat(F.lit(settings.salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *drawn)
    marks = [m.encode() for m in (settings.prefix, settings.suffix, settings.middle)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
            for a, b, data, bounds in chunks(batch.column("text")):
                n, low, high, before, between = cut_texts(data, bounds, h[0][a:b], h[1][a:b], unit)
                raw, forms, out = data.tobytes(), [], []
                moved, back = h[2][a:b] % 100 < settings.changed, h[3][a:b] % 100 < settings.suffix_first
                for i, (s, x, y, e) in enumerate(zip(bounds[:-1].tolist(), low.tolist(), high.tolist(), bounds[1:].tolist(), strict=True)):
                    text = raw[s:e]
                    if not text or not moved[i] or any(m in text for m in marks):
                        forms.append("plain")
                        out.append(text)
                        continue
                    prefix, middle, suffix = marks[0] + raw[s:x], marks[2] + raw[x:y], marks[1] + raw[y:e]
                    forms.append("spm" if back[i] else "psm")
                    out.append(suffix + prefix + middle if back[i] else prefix + suffix + middle)
                plain = np.array([f == "plain" for f in forms], dtype=bool)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(forms, pa.string()), pa.array(before.astype(np.int64), mask=plain), pa.array(between.astype(np.int64), mask=plain), pa.array(out, pa.binary()).view(pa.string())],
                                                 ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text an output was made of, from the output and its form alone."""
    p, s, m = settings.prefix, settings.suffix, settings.middle

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        tail = F.substr(rest, F.instr(rest, second) + len(second))
        return F.substring_index(rest, second, 1), F.substring_index(tail, m, 1), F.substr(tail, F.instr(tail, m) + len(m))

    prefix, suffix, middle = parts(p, s)
    suffix2, prefix2, middle2 = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def report(documents: DataFrame, settings: Settings = Settings(), unit: str = "token", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the outputs and of the texts rebuilt from them: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = transform(documents, settings, unit, id_col, text_col)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"), settings)).alias("restored_sha256"))


ORACLE = r"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
cut AS (SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(units[1 : least(a, b)], '') AS p, array_to_string(units[least(a, b) + 1 : greatest(a, b)], '') AS m, array_to_string(units[greatest(a, b) + 1 : n], '') AS s FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(p || m || s) AS restored_sha256
FROM parts
"""


@query("op13_fill_in_middle", ORACLE)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
