"""URL filter by a weighted vocabulary, behind host and path rules.

Every URL gets the verdict of its longest rule, else that of the vocabulary: an Aho-Corasick automaton
finds all terms in one pass over the address, a hit counts if no letter or digit touches it, and the
address is blocked by one strict term or by enough distinct soft terms (the weights add up).

Defined results: a null URL, and one without ``://``, has an empty host and path and meets no rule; the
vocabulary still reads an address without ``://``, and allows a null or empty one. Repeated rows are judged alike; an empty table
gives an empty result; further columns of the input are ignored. Null ids stay null.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: One strict term blocks.
STRICT = ("casino", "porn", "pornhub", "viagra", "xxx", "escort", "spam-farm", "malware", "warez")
#: Distinct soft terms add their weights.
SOFT = {"adult": 1.0, "bets": 1.0, "bet": 1.0, "cheap": 1.0, "pills": 1.0, "free": 0.5, "win": 0.5, "ads": 0.5, "track": 0.5, "spam": 1.0, "sex": 1.0, "poker": 1.0, "loan": 0.5, "crack": 1.0}
SOFT_LIMIT = 1.0
SOFT_DISTINCT = 2


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, SMALL)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text, verdict = F.when(fits, rule_host + rule_path).otherwise(text), F.when(fits, says).otherwise(verdict)
    return text, verdict


def vocabulary_hits(strict: tuple[str, ...], soft: Mapping[str, float]):
    """Pandas UDF from a lower-cased address to its distinct strict and soft terms and the weight of the soft ones."""
    terms = {**{t: (t, 0.0, True) for t in strict}, **{t: (t, w, False) for t, w in soft.items() if t not in strict}}

    @F.pandas_udf("n_strict int, n_soft int, soft_weight double")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for term, value in terms.items():
            automaton.add_word(term, value)
        automaton.make_automaton()

        def one(url: str | None) -> tuple[int, int, float]:
            if not url:
                return 0, 0, 0.0
            found = set()
            for end, (term, weight, is_strict) in automaton.iter(url):
                start = end - len(term) + 1
                free = lambda c: not (c.isascii() and c.isalnum())
                if (start == 0 or free(url[start - 1])) and (end + 1 == len(url) or free(url[end + 1])):
                    found.add((term, weight, is_strict))
            return sum(s for _, _, s in found), sum(not s for _, _, s in found), sum(w for _, w, s in sorted(found) if not s)

        for urls in batches:
            yield pd.DataFrame([one(u) for u in urls], columns=["n_strict", "n_soft", "soft_weight"])

    return hits


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, strict: tuple[str, ...] = STRICT,
               soft: Mapping[str, float] = SOFT, soft_distinct: int = SOFT_DISTINCT, soft_limit: float = SOFT_LIMIT) -> DataFrame:
    """Per row: id, host, path, rule, verdict, n_strict, n_soft and soft_weight."""
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    text, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), vocabulary_hits(strict, soft)(F.translate(url, UPPER, SMALL)).alias("hits"))
    bad = (F.col("hits.n_strict") > 0) | ((F.col("hits.n_soft") >= soft_distinct) & (F.col("hits.soft_weight") >= soft_limit))
    return rows.select("page_id", "host", "path", text.alias("rule"), F.coalesce(says, F.when(bad, "block").otherwise("allow")).alias("verdict"), "hits.*")


def _sql_terms(terms) -> str:
    """Each term as (term, weight) whose bounded occurrence is tested by a regular expression."""
    return ", ".join(f"('{t}', {w!r}::DOUBLE)" for t, w in terms)


_TEXT = f"translate(coalesce(url, ''), '{UPPER}', '{SMALL}')"
ORACLE = rf"""
WITH base AS (
  SELECT row_number() OVER () AS row, page_id, {_TEXT} AS low,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{SMALL}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
terms(term, weight, strict) AS (SELECT *, true FROM (VALUES {_sql_terms((t, 0.0) for t in STRICT)}) UNION ALL SELECT *, false FROM (VALUES {_sql_terms(SOFT.items())})),
hits AS (
  SELECT row, sum(strict::INT) AS n_strict, sum((NOT strict)::INT) AS n_soft, sum(CASE WHEN strict THEN 0 ELSE weight END) AS soft_weight
  FROM base JOIN terms ON regexp_matches(low, '(?:^|[^a-z0-9])' || term || '(?:[^a-z0-9]|$)') GROUP BY row),
rules(rule_host, rule_path, says) AS (VALUES {", ".join(str(r) for r in RULES)}),
ruled AS (
  SELECT row, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(says, length(rule_host || rule_path)) AS says
  FROM base JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY row)
SELECT page_id, host, path, rule,
       coalesce(says, CASE WHEN coalesce(n_strict, 0) > 0 OR (coalesce(n_soft, 0) >= {SOFT_DISTINCT} AND soft_weight >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(n_strict, 0)::INT AS n_strict, coalesce(n_soft, 0)::INT AS n_soft, coalesce(soft_weight, 0)::DOUBLE AS soft_weight
FROM base LEFT JOIN hits USING (row) LEFT JOIN ruled USING (row)
"""


@query("op6_url_vocabulary", ORACLE)
def op6_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
