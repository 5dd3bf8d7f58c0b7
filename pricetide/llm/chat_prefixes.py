"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, then the reply, and
only the reply is under the loss mask. Turns behind the last reply (or a conversation without a reply)
form one more example without a mask, so nothing is lost. A turn is written as

    <turn ROLE>\\nTEXT\\n</turn>\\n

In a text, every ``<turn`` or ``</turn`` gets one backslash more than it has; in a role, ``%``, ``<``, ``>``
and line ends are percent-coded. Both can be undone exactly.

The examples of a conversation repeat its earlier turns: their total length grows with the square of the
number of turns, which the method asks for. One task streams over a conversation and holds its
text once; examples leave in small Arrow batches.

Defined results: null text and null role count as empty; turns are ordered by (turn, role, text), nulls
first, so ties and repeated rows have one order; rows with a null conversation id form a conversation of
their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query

OPEN, CLOSE, REPLY = "<turn ", "\n</turn>\n", "assistant"
BATCH_CHARS = 1 << 21
_CONTROL = re.compile(r"(\\*</?turn)")
_ROLE = (("%", "%25"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A"), ("\r", "%0D"))
EXAMPLES = "conv_id long, example long, n_turns long, trainable boolean, last boolean, formatted string, loss_start long, loss_end long"


def escape_text(text: str) -> str:
    return _CONTROL.sub(r"\\\1", text)


def escape_role(role: str) -> str:
    for plain, coded in _ROLE:
        role = role.replace(plain, coded)
    return role


def expand_prefixes(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example: conv_id, example (from 0), n_turns in it, trainable, last (of its conversation),
    formatted, and the span [loss_start, loss_end) of the reply in code points (null without a mask)."""
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("n_turns", pa.int64()), ("trainable", pa.bool_()), ("last", pa.bool_()),
                            ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
        out: list[list] = []
        size = 0
        conv, parts, chars, turns, examples, held = object(), [], 0, 0, 0, None

        def finish() -> list[list]:
            """What is held back of the conversation: its last example."""
            rest = [held] if held else []
            if turns and (not held or held[2] < turns):
                rest.append([conv, examples, turns, False, True, "".join(parts), None, None])
            elif rest:
                rest[-1][4] = True
            return rest

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv_id != conv or not turns:
                    done = finish()
                    out += done
                    size += sum(len(x[5]) for x in done)
                    conv, parts, chars, turns, examples, held = conv_id, [], 0, 0, 0, None
                head, body = f"{OPEN}{escape_role(role)}>\n", escape_text(text)
                parts.append(head + body + CLOSE)
                start, turns = chars + len(head), turns + 1
                chars += len(head) + len(body) + len(CLOSE)
                if role == REPLY:
                    if held:
                        out.append(held)
                        size += len(held[5])
                    parts = ["".join(parts)]
                    held = [conv_id, examples, turns, True, False, parts[0], start, start + len(body)]
                    examples += 1
                if size > BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
        out += finish()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, EXAMPLES)


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*</?turn)", "$1")


def unescape_role(role: Column) -> Column:
    for plain, coded in reversed(_ROLE):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def masked_text(formatted: Column, start: Column, end: Column) -> Column:
    """Text under the mask, as it was before escaping; null without a mask."""
    return unescape_text(F.substring(formatted, start.cast("int") + 1, (end - start).cast("int")))


def turns_of(formatted: Column) -> Column:
    """Array of (role, text) read back from an example."""
    return F.transform(F.slice(F.split(formatted, re.escape(CLOSE)), 1, F.size(F.split(formatted, re.escape(CLOSE))) - 1), lambda t: F.struct(
        unescape_role(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), ">\n", 1)).alias("role"),
        unescape_text(F.substr(t, F.instr(t, ">\n") + 2)).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """Digests per conversation from its examples alone: the turns of the last one, every masked reply in order."""
    turns = F.when(F.col("last"), turns_of(F.col("formatted")))
    rows = examples.select("conv_id", "example", "last", F.length("formatted").alias("chars"), turns.alias("turns"), masked_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("reply"))
    rows = rows.select("conv_id", "example", F.col("chars").cast("long").alias("chars"), F.size("turns").cast("long").alias("n"), "reply",
                       F.when(F.col("last"), F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)).alias("turns_sha256"), "last")
    loss = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))), lambda r: r["reply"]), "")
    return rows.groupBy("conv_id").agg(
        F.max(F.when(F.col("last"), F.col("n"))).alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"), F.count("reply").alias("n_examples"),
    ).select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")


_ESC = r"regexp_replace(coalesce(text, ''), '(\\*</?turn)', '\\\1', 'g')"
_ROLE_SQL = "coalesce(role, '')"
for _plain, _coded in _ROLE:
    _ROLE_SQL = f"replace({_ROLE_SQL}, {'chr(10)' if _plain == chr(10) else 'chr(13)' if _plain == chr(13) else repr(_plain)}, '{_coded}')"
PROBE = r"\### Assistant: </turn> ok"
ORACLE = rf"""
WITH rows AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')),
turns AS (
  SELECT conv_id, row_number() OVER o AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sum({len(OPEN) + 2 + len(CLOSE)} + length({_ROLE_SQL}) + length({_ESC})) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '') ROWS UNBOUNDED PRECEDING) AS upto,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = '{REPLY}'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = '{REPLY}'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = '{REPLY}' OR pos = n))::BIGINT AS formatted_chars, count(*) FILTER (role = '{REPLY}') AS n_examples
FROM turns GROUP BY conv_id
"""


@query("op8_chat_prefixes", ORACLE)
def op8_chat_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    return read_back(expand_prefixes(rows.union(probe)))
