"""The product signature: everything matching needs to know about a name.

The name is parsed in stages whose intermediate texts are bound once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X
from .money import fixed_text
from .text import bind

SIGNATURE_FIELDS = (
    "source_name", "normalized_text", "core_tokens", "core_key", "volume_ml", "pack_count",
    "is_pack", "brand", "variant_tokens", "abv_pct", "vintage_year",
)


def signature(name: Column) -> Column:
    """Signature struct of a product name."""
    source = F.coalesce(name, F.lit(""))

    def fields(text: Column, tokens: Column, volume: Column, pack: Column) -> Column:
        return F.struct(
            source.alias("source_name"),
            text.alias("normalized_text"),
            tokens.alias("core_tokens"),
            X.core_key(tokens).alias("core_key"),
            volume.alias("volume_ml"),
            pack.alias("pack_count"),
            pack.isNotNull().alias("is_pack"),
            X.infer_brand(tokens).alias("brand"),
            X.variant_tokens(tokens).alias("variant_tokens"),
            X.extract_abv_pct(source).alias("abv_pct"),
            X.extract_vintage_year(source).alias("vintage_year"),
        )

    def with_text(text: Column) -> Column:
        parsed = F.struct(
            X.core_tokens_of(text).alias("tokens"), X.extract_volume_ml(text).alias("volume")
        )
        return bind(
            parsed,
            lambda p: bind(
                X.pack_count_of(text, p["volume"]),
                lambda pack: fields(text, p["tokens"], p["volume"], pack),
            ),
        )

    return bind(X.apply_aliases(source), with_text)


def pack_signature(name: Column) -> Column:
    """``pack_count`` and ``is_pack`` of the signature, without its other fields."""
    pack = X.extract_pack_count(F.coalesce(name, F.lit("")))
    return bind(pack, lambda p: F.struct(p.alias("pack_count"), p.isNotNull().alias("is_pack")))


def with_signature(df: DataFrame, name: str = "name", out: str = "sig") -> DataFrame:
    """Append the signature struct of column ``name`` as ``out``."""
    return df.withColumn(out, signature(F.col(name)))


def comparison_key(sig: Column) -> Column:
    return F.concat_ws(
        "|", sig["core_key"], F.coalesce(sig["volume_ml"].cast("string"), F.lit("unknown"))
    )


def canonical_fingerprint(sig: Column) -> Column:
    variants = F.array_join(sig["variant_tokens"], "+")
    return F.concat_ws(
        "|",
        F.coalesce(sig["brand"], F.lit("unknown")),
        F.coalesce(F.nullif(sig["core_key"], F.lit("")), F.lit("unknown")),
        F.coalesce(sig["volume_ml"].cast("string"), F.lit("unknown")),
        F.coalesce(F.nullif(variants, F.lit("")), F.lit("base")),
        F.coalesce(sig["vintage_year"].cast("string"), F.lit("nv")),
        F.when(sig["abv_pct"].isNull(), F.lit("na")).otherwise(
            fixed_text(sig["abv_pct"])
        ),
        F.coalesce(sig["pack_count"], F.lit(1)).cast("string"),
    )


def with_search_query(df: DataFrame, query: str = "query") -> DataFrame:
    """Parse search text: normalized text, ordered distinct tokens, volume, pack, brand."""
    source = F.trim(F.coalesce(F.col(query), F.lit("")))
    parsed = with_signature(df.withColumn("_q", source), "_q", "_sig").withColumn(
        "_norm", X.search_normalize(F.col("_q"))
    )
    naked = F.filter(
        F.transform(
            F.regexp_extract_all(F.col("_norm"), F.lit(r"(?<!\d)(\d{2,4})(?!\d)"), F.lit(1)),
            lambda value: value.cast("int"),
        ),
        lambda value: value.between(50, 5000),
    )
    return parsed.select(
        *df.columns,
        F.col("_norm").alias("normalized"),
        F.array_distinct(F.filter(F.split("_norm", " "), lambda t: t != "")).alias("tokens"),
        F.coalesce(F.col("_sig.volume_ml"), F.try_element_at(naked, F.lit(-1))).alias("query_volume_ml"),
        F.col("_sig.pack_count").alias("query_pack"),
        F.col("_sig.brand").alias("query_brand"),
    )
