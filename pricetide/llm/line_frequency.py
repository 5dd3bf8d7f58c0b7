"""Quality rules from the frequency of lines across the documents of a host, with DataFrame functions only.

Lines are normalised (A-Z in lower case, digits to 0, blanks joined) and hashed; per host and line the distinct
documents are counted, a document being a distinct text, so that copies of one document count once. A line
in more than `max_documents` documents is removed, whatever the size of its host. A document
fails its base rules by too few words or too many repeated words, and is rejected as depleted when removal leaves
less than `min_left` of its words.

The lines of a host are counted in two steps, first distinct (host, line, document), so neither a hot host nor a
hot line meets in one task; counts come back by a join on the line, which AQE splits where it is skewed.

Defined results: null text has no words and is not kept; null hosts form a host of their own; rows that
repeat are judged alike and each kept or rejected; null ids stay; lines without a word are never counted or
removed; an empty table gives no rows. Further columns, also ones named like the results, are ignored by the report and carried by `filter_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK, SYMBOLS = r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_DOCUMENTS = 5
MIN_LEFT = 0.3


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK + "+"), "")


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def line_hash(line: Column) -> Column:
    plain = F.translate(line, UPPER + "123456789", SMALL + "000000000")
    return F.xxhash64(F.trim(F.regexp_replace(plain, BLANK + "+", " ")))


def _base(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, host, text, ...) with counts, host and document key, and hash and words of each line: the text itself need not go on."""
    rows = documents.withColumn("words", words_of(F.coalesce("text", F.lit("")))).withColumn("lines", lines_of(F.coalesce("text", F.lit(""))))
    n = F.size("words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("windows", windows)
    rows = rows.withColumn("sorted", F.when(F.size("windows") == F.size(F.array_distinct("windows")), F.lit(None)).otherwise(
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    # After sorting, equal windows stand side by side: a window repeats if a neighbour has its hash.
    at = lambda k: F.get("sorted", k)
    repeated = F.filter(F.transform("sorted", lambda w, k: F.when((w["h"] == at(k - 1)["h"]) | (w["h"] == at(k + 1)["h"]), w["i"])), lambda i: i.isNotNull())
    rows = rows.withColumn("repeated", repeated)
    marked = F.size(F.array_distinct(F.flatten(F.array("repeated", F.transform("repeated", lambda i: i + 1), F.transform("repeated", lambda i: i + 2)))))
    return rows.withColumns({
        "n_words": n.cast("long"), "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.coalesce(F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, "")), F.lit(0)).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("repeated").isNull(), 0).otherwise(marked).cast("long"),
        "marks": F.transform("lines", lambda line: F.struct(line_hash(line).alias("line"), F.size(words_of(line)).alias("n"))),
        "key": F.md5(F.concat_ws("\n", F.when(F.col("host").isNull(), "n").otherwise(F.concat(F.lit("h"), F.col("host"))), F.col("text"))),
    }).drop("words", "lines", "windows", "sorted", "repeated")


def frequent_lines(documents: DataFrame, max_documents: int) -> DataFrame:
    """Per document key: the hashes of its lines above the limits and the words in them."""
    lines = documents.where("text is not null").withColumn("line", F.explode(lines_of(F.col("text"))))
    host = F.coalesce(F.concat(F.lit("h"), F.col("host")), F.lit("n"))
    key = F.md5(F.concat_ws("\n", host, F.col("text")))
    lines = lines.select(host.alias("host"), key.alias("key"), line_hash(F.col("line")).alias("line"), F.size(words_of(F.col("line"))).alias("n"))
    lines = lines.groupBy("host", "line", "key").agg(F.max("n").alias("n"), F.count("*").alias("times"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > max_documents)
    return lines.join(counts.select("host", "line"), ["host", "line"]).groupBy("key").agg(F.collect_list("line").alias("removed"))


def _judged(documents: DataFrame, id_col: str, text_col: str, host_col: str, extra: list[str], max_documents: int, min_left: float) -> DataFrame:
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host"), *(F.struct(*(F.col(f"`{c}`") for c in extra)).alias("carried") for _ in extra[:1]))
    found = frequent_lines(rows.select("host", "text"), max_documents)
    rows = _base(rows).join(found, "key", "left")
    gone = F.coalesce(F.aggregate(F.filter("marks", lambda mark: F.array_contains("removed", mark["line"])), F.lit(0), lambda a, mark: a + mark["n"]), F.lit(0)).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("n_removed_words", F.when(F.col("removed").isNull(), F.lit(0).cast("long")).otherwise(gone)).withColumn("base_failed", failed)
    # One condition that needs both join sides: as two, the first would be pushed below and repeat the work on windows.
    return rows.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(F.col("n_words") - F.col("n_removed_words") >= min_left * F.col("n_words")))


def quality_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                   max_documents: int = MAX_DOCUMENTS, min_left: float = MIN_LEFT) -> DataFrame:
    """Per row: id, counts, base_failed, kept, and the words in lines above the limits."""
    rows = _judged(documents, id_col, text_col, host_col, [], max_documents, min_left)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def filter_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str | None = "n_chars",
                     max_documents: int = MAX_DOCUMENTS, min_left: float = MIN_LEFT) -> DataFrame:
    """The kept documents with all their columns, the lines above the limits taken out of the text and its length put right."""
    rows = _judged(documents, id_col, text_col, host_col, [c for c in documents.columns if c != text_col], max_documents, min_left).where("kept")
    clean = F.when(F.col("removed").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(F.split("text", "\n", -1), lambda line: ~F.coalesce(F.array_contains("removed", line_hash(line)) & line.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))), "\n"))
    kinds = dict(documents.dtypes)
    out = {c: F.col("clean") if c == text_col else F.col(f"carried.`{c}`") for c in documents.columns}
    if chars_col in out:
        out[chars_col] = F.when(F.col("removed").isNull(), out[chars_col]).otherwise(F.length("clean").cast(kinds[chars_col]))
    return rows.withColumn("clean", clean).select(*(c.alias(name) for name, c in out.items()))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_NORMAL = rf"trim(regexp_replace(translate(line, '{UPPER}123456789', '{SMALL}000000000'), '{BLANK}+', ' ', 'g'), ' ')"
_RULES_SQL = rf"""
rule_rows AS (SELECT row_number() OVER () AS row, * FROM {{documents}}),
rule_words AS (SELECT row, doc_id, text, {_WORDS} AS words FROM rule_rows),
rule_windows AS (SELECT row, unnest(range(0, len(words) - 2)) AS i, words FROM rule_words WHERE len(words) >= 3),
rule_grams AS (SELECT row, i, count(*) OVER (PARTITION BY row, words[i + 1], words[i + 2], words[i + 3]) AS times FROM rule_windows),
rule_repeats AS (SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM rule_grams, (VALUES (0), (1), (2)) t(k) WHERE times > 1 GROUP BY row),
rule_lines AS (
  SELECT row, source AS host, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at FROM rule_rows WHERE text IS NOT NULL),
rule_real AS (SELECT *, {_NORMAL} AS plain, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM rule_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
rule_dups AS (SELECT row, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM rule_real GROUP BY row),
rule_above AS (SELECT coalesce('h' || host, 'n') AS host, plain FROM rule_real GROUP BY 1, 2 HAVING count(DISTINCT text) > {MAX_DOCUMENTS}),
rule_removed AS (SELECT row, sum(n)::BIGINT AS n_removed_words FROM rule_real r JOIN rule_above a ON coalesce('h' || r.host, 'n') = a.host AND r.plain = a.plain GROUP BY row),
rule_base AS (
  SELECT w.row, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(coalesce(text, ''), '{SYMBOLS}'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_removed_words, 0)::BIGINT AS n_removed_words
  FROM rule_words w LEFT JOIN rule_repeats USING (row) LEFT JOIN rule_dups USING (row) LEFT JOIN rule_removed USING (row)),
rule_judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND n_words - n_removed_words >= {MIN_LEFT} * n_words AS kept FROM rule_base)
"""
ORACLE = f"WITH {_RULES_SQL.format(documents='documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words FROM rule_judged"


@query("op4_line_frequency", ORACLE)
def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
