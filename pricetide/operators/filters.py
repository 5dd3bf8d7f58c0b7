"""Row predicates shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions import wordlists as W

PUBLIC_TYPES = ("PUBLIC", "SALE")


def public_quotes(quotes: DataFrame) -> DataFrame:
    """Quotes anybody may buy at."""
    return quotes.where(
        F.col("is_active")
        & ~F.col("eligibility_required")
        & F.upper("price_type").isin(*PUBLIC_TYPES)
        & (F.col("price") > 0)
    )


def with_public_quote_flag(listings: DataFrame, quotes: DataFrame) -> DataFrame:
    """Flag listings that have a public quote; one left join instead of EXISTS under OR."""
    flagged = public_quotes(quotes).select("listing_id").distinct().withColumn(
        "has_public_quote", F.lit(True)
    )
    return listings.join(flagged, "listing_id", "left").withColumn(
        "has_public_quote", F.coalesce("has_public_quote", F.lit(False))
    )


def public_market(listings: DataFrame, stores: DataFrame, quotes: DataFrame) -> DataFrame:
    """Listings of the public market, store flags attached.

    A store that also keeps member prices takes part only with listings that
    have a public quote.
    """
    eligible = stores.where("is_active and comparison_enabled").select(
        "store_id", F.col("name").alias("store_name"), "personal_comparison_enabled"
    )
    joined = with_public_quote_flag(listings, quotes).join(eligible, "store_id")
    return joined.where(~F.col("personal_comparison_enabled") | F.col("has_public_quote")).drop(
        "has_public_quote"
    )


def context_stores(stores: DataFrame) -> DataFrame:
    return stores.where("is_active and (comparison_enabled or personal_comparison_enabled)")


def personal_only(stores: DataFrame) -> DataFrame:
    return stores.where("personal_comparison_enabled and not comparison_enabled")


def comparable() -> Column:
    return F.col("is_available") & ~F.col("excluded_from_comparison") & (F.col("current_price") > 0)


def fresh(listings: DataFrame, stores: DataFrame, as_of: Column, max_age_hours: int = 72,
          mode: str = "public") -> DataFrame:
    """Comparable listings seen recently in stores of the chosen mode."""
    wanted = "comparison_enabled" if mode == "public" else "comparison_enabled or personal_comparison_enabled"
    allowed = stores.where(f"is_active and ({wanted})").select("store_id")
    cutoff = as_of - F.make_dt_interval(hours=F.lit(max_age_hours))
    return listings.where(comparable() & (F.col("last_seen_at") >= cutoff)).join(
        allowed, "store_id", "left_semi"
    )


def single_unit(df: DataFrame, sig: str = "sig") -> DataFrame:
    """Single bottles: by stored quantity and by the live name."""
    return df.where((F.coalesce("package_quantity", F.lit(1)) == 1) & ~F.col(f"{sig}.is_pack"))


def audience_set(audiences) -> list[str]:
    return sorted({str(a).strip().casefold() for a in audiences or () if str(a).strip()})


def quote_allowed(audiences=W.DEFAULT_AUDIENCES) -> Column:
    """Active quote the given audiences may use."""
    member = F.lower("audience_key").isin(*audience_set(audiences))
    return F.col("is_active") & (F.col("price") > 0) & (~F.col("eligibility_required") | member)


def observed_in_runs(listings: DataFrame, observations: DataFrame, runs: DataFrame) -> DataFrame:
    """Comparable listings with an observation in the given runs (column ``run_id``)."""
    seen = observations.join(runs.select("run_id"), "run_id", "left_semi").select("listing_id")
    return listings.where(~F.col("excluded_from_comparison")).join(seen, "listing_id", "left_semi")


def outside_runs(observations: DataFrame, runs: DataFrame) -> DataFrame:
    """Observations not made by the given runs; those without a run count as earlier."""
    return observations.join(runs.select("run_id"), "run_id", "left_anti")


def missing_from_run(listings: DataFrame, observations: DataFrame, runs: DataFrame) -> DataFrame:
    """Known listings of each run's store that the run did not observe; listings have an id.

    Ids are taken as bits, 64 to a word: words of the store meet words of the run, and only the bits
    that the run lacks become rows, which fetch their listings by id.
    """
    rows = runs.select("run_id", "store_id")
    known = listings.groupBy("store_id", *_id_word()).agg(_id_bits().alias("known"))
    seen = observations.join(rows.select("run_id").distinct(), "run_id", "left_semi").groupBy("run_id", *_id_word()).agg(_id_bits().alias("seen"))
    lacking = F.col("known").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("bigint"))))
    words = known.join(rows, "store_id").join(seen, ["run_id", "id_word"], "left").withColumn("lacking", lacking).where("lacking <> 0")
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("lacking", k) == 1)
    missing = words.select("run_id", "store_id", "id_word", F.explode(bits).alias("bit"))
    missing = missing.select("run_id", "store_id", (F.shiftleft("id_word", 6) + F.col("bit")).alias("listing_id"))
    return missing.join(listings, ["store_id", "listing_id"]).select("run_id", *listings.columns)


def _id_word() -> list[Column]:
    return [F.shiftright("listing_id", 6).alias("id_word")]


def _id_bits() -> Column:
    return F.bit_or(F.expr("shiftleft(1L, cast(listing_id & 63 as int))"))


def synchronize_active_stores(stores: DataFrame, registry: DataFrame) -> DataFrame:
    """``is_active`` becomes membership of the registry; ``changed`` marks flips."""
    known = registry.select("connector_key").distinct().withColumn("_known", F.lit(True))
    flagged = stores.join(known, "connector_key", "left")
    active = F.coalesce("_known", F.lit(False))
    return flagged.select(
        *[c for c in stores.columns if c != "is_active"],
        active.alias("is_active"),
        (active != F.col("is_active")).alias("changed"),
    )
