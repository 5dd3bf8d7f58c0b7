"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (base64 token, rank) becomes a BPE model of that library: every byte is written as one printable
character, and the merge that forms a token is found by merging its bytes with the earlier ranks. Token offsets
come from the byte lengths of the tokens, mapped from bytes to characters; a token that holds part of a
character gets the whole character's span. Decoding looks the bytes of each id up and reads them as UTF-8; a
character split over two pieces is held back until its last byte arrives.

Defined results: null text encodes like an empty one, to no tokens; nulls in ids decode to null. Long texts are
encoded whole. Repeated rows and null document ids stay as they are; further columns are ignored; an empty
table gives no rows. Ids outside the vocabulary raise an error. Bytes that are not UTF-8 become U+FFFD in decoded text, not in decoded bytes.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Characters given to the library at once: bounds the memory of its results.
SLICE_CHARS = 1 << 19


#: Words whose ids a worker keeps, and words that the library keeps besides.
KEPT_WORDS, LIBRARY_WORDS = 200_000, 20_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens whose merge gives this one, by merging its bytes with lower ranks only."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= limit:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class Codec:
    """Tokenizer and byte tables of one rank file."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        names = byte_characters()
        spelled = lambda token: "".join(names[b] for b in token)
        merges = [merge_of(t, ranks) for t in sorted(ranks, key=ranks.__getitem__) if len(t) > 1]
        self.tokenizer = Tokenizer(models.BPE({spelled(t): r for t, r in ranks.items()}, [(spelled(m[0]), spelled(m[1])) for m in merges if m], ignore_merges=True, cache_capacity=LIBRARY_WORDS))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        byte_of = {c: b for b, c in enumerate(names)}
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for spelling, rank in self.tokenizer.get_vocab().items():
            self.token_bytes[rank] = bytes(byte_of[c] for c in spelling)
        self.known: dict[str, bytes] = {}
        self.lengths = np.array([len(t) for t in self.token_bytes], dtype=np.int64)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. A match of the pattern begins at every single blank between two other signs, so what
        stands between such blanks is encoded by itself: each distinct word once, kept in a bounded table.
        A text with other runs of blanks goes to the library whole."""
        out, at = [], 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= SLICE_CHARS):
                chars += len(texts[to])
                to += 1
            words = [t.split(" ") for t in texts[at:to]]
            for parts in words:
                parts[0] = "".join((" ", parts[0]))  # the first one has no blank before it
            used = set().union(*words)
            if len(self.known) > KEPT_WORDS:
                self.known = {}
            new = [w for w in used if w not in self.known]
            plain = [w for w in new if w and not w[-1].isspace() and (w[0] == " " or not w[0].isspace()) or w == " "]
            odd = set(new).difference(plain)
            self.known.update(zip(plain, self._ids([w[1:] if w[0] == " " else " " + w for w in plain]), strict=True))
            get = self.known.__getitem__
            for text, parts in zip(texts[at:to], words, strict=True):
                raw = b"".join(map(get, parts)) if odd.isdisjoint(parts) else self._ids([text])[0]
                out.append(np.frombuffer(raw, dtype=np.int32))
            at = to
        return out

    def offsets(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character span of each token."""
        ends = np.cumsum(self.lengths[ids])
        character = np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80) - 1
        return character[ends - self.lengths[ids]].astype(np.int32), (character[ends - 1] + 1).astype(np.int32)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode_pieces(self, pieces: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of each piece of a stream of ids; bytes of a split character wait for the next piece."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in pieces:
            yield decoder.decode(self.decode(ids))
        yield decoder.decode(b"", final=True)


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    return Codec(path, pattern)


_IDS, _ENDS = pa.list_(pa.int32()), ("token_ids", "starts", "ends")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def _runs(batch: pa.RecordBatch, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text each."""
    sizes = pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
    whole = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(whole, (whole[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _source(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(documents: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, token_ids, and the character spans [starts, ends) of the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for rows in _runs(batch):
                texts = [t or "" for t in rows.column("text").to_pylist()]
                ids = bpe.encode(texts)
                spans = [bpe.offsets(t.encode(), i) for t, i in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), _lists(ids), _lists([s for s, _ in spans]), _lists([e for _, e in spans])], ["doc_id", *_ENDS])

    return _source(documents, id_col, text_col).mapInArrow(run, "doc_id long, token_ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id, decoded (bytes) and decoded_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            found = [None if ids is None else bpe.decode(ids) for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary()), pa.array([None if b is None else b.decode("utf-8", "replace") for b in found], pa.string())], ["doc_id", "decoded", "decoded_text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("token_ids")).mapInArrow(run, "doc_id long, decoded binary, decoded_text string")


def round_trip(documents: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode each text within one task and report digests: doc_id, n_tokens, ids_sha256, decoded_sha256,
    n_split (tokens that begin or end within a character), exact (decoded bytes equal the text); token_ids on request."""
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_split", pa.int64()), ("exact", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for rows in _runs(batch):
                texts = [t or "" for t in rows.column("text").to_pylist()]
                ids, out = bpe.encode(texts), []
                for text, tokens in zip(texts, ids, strict=True):
                    raw, got = text.encode(), bpe.decode(tokens.tolist())
                    split = 0
                    if len(raw) != len(text):
                        starts, ends = bpe.offsets(raw, tokens)
                        split = int((starts[1:] < ends[:-1]).sum())
                    out.append((len(tokens), hashlib.sha256(tokens.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(got).hexdigest(), split, got == raw))
                columns = [rows.column("doc_id"), *(pa.array(list(c), t) for c, (_, t) in zip(zip(*out, strict=True), kinds[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns + [_lists(ids)] * keep_ids, [n for n, _ in kinds] + ["token_ids"] * keep_ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long, exact boolean"
    return _source(documents, id_col, text_col).mapInArrow(run, schema + ", token_ids array<int>" * keep_ids)


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
