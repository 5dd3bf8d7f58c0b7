"""Reports over the opportunity snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.functions import scoring as K
from pricetide.functions.signature import signature
from pricetide.functions.text import safe_name

def _limit(limit: int) -> int:
    return max(1, int(limit))


def opportunity_views(snapshots: DataFrame, masters: DataFrame, listings: DataFrame, stores: DataFrame,
                      stats: DataFrame | None = None, guard_titles_of: str | None = None) -> DataFrame:
    """Snapshots with names and statistics that may still be shown.

    The winner must be available, single and in an active shop, and neither name
    may read like a pack. ``guard_titles_of`` names a shop whose titles must
    agree with their address.
    """
    shown = (
        snapshots.join(
            masters.where("package_quantity = 1").select("master_id", F.col("canonical_name").alias("display_name")), "master_id")
        .join(listings.where("is_available and not excluded_from_comparison and package_quantity = 1").select(
            F.col("listing_id").alias("winner_listing_id"), F.col("name").alias("winner_name"), "url"), "winner_listing_id")
        .join(stores.where("is_active").select(F.col("store_id").alias("winner_store_id"), F.col("name").alias("winner_store"),
                                               F.col("personal_comparison_enabled").alias("winner_store_personal")), "winner_store_id")
    )
    if stats is not None:
        own = [c for c in stats.columns if c != "master_id" and c in shown.columns]
        shown = shown.join(stats.drop(*own), "master_id", "left")
    shown = shown.where(~signature(F.col("display_name"))["is_pack"] & ~signature(F.col("winner_name"))["is_pack"])
    if guard_titles_of is not None:
        shown = shown.where((F.col("winner_store") != guard_titles_of) | (safe_name(F.col("winner_name"), F.col("url")) == F.col("winner_name")))
    return shown


def top_opportunities(views: DataFrame, limit: int = 20, minimum_score: float = 0.0, order: str = "score") -> DataFrame:
    first = ("saving_pct", "saving") if order == "saving" else ("score", "saving_pct")
    return views.where(F.col("score") >= minimum_score).orderBy(*[F.desc(c) for c in first], "display_name", "master_id").limit(_limit(limit))


def _strictest(views: DataFrame, tier, order, limit: int) -> DataFrame:
    """Rows of the lowest tier that has any row. The tier is decided for the whole table."""
    tiered = views.withColumn("tier", tier).where("tier is not null")
    best = tiered.agg(F.min("tier").alias("tier"))
    return tiered.join(best, "tier", "left_semi").orderBy(*order).limit(_limit(limit))


def commercial_radar(views: DataFrame, limit: int = 10, minimum_score: float = 70.0) -> DataFrame:
    """Strong signals; else any product with a useful score; else the best there are."""
    strict = F.col("price_event").isin(*K.SIGNALS) & (F.col("score") >= minimum_score)
    tier = F.when(strict, 1).when(F.col("score") >= 55.0, 2).when(F.col("score") >= 0.0, 3)
    return _strictest(views, tier, [F.desc("score"), F.desc("saving_pct"), F.asc("display_name"), F.asc("master_id")], limit)


def historical_floors(views: DataFrame, limit: int = 10) -> DataFrame:
    """Products at or near their historical floor; else the nearest to it."""
    strict = F.col("price_event").isin("NEW_HISTORICAL_MIN", "AT_HISTORICAL_MIN", "NEAR_HISTORICAL_MIN")
    near = F.col("winner_price").isNotNull() & (F.col("historical_min") > 0) & (F.col("observations_total") >= 2)
    distance = F.abs((F.col("winner_price") - F.col("historical_min")) / F.col("historical_min"))
    by_gap = F.when(strict, -F.col("historical_gap_pct")).otherwise(distance)
    tier = F.when(strict, 1).when(near, 2)
    return _strictest(views.withColumn("_gap", by_gap), tier, [F.asc("_gap"), F.desc("score"), F.asc("display_name"), F.asc("master_id")], limit).drop("_gap")


def top_personal_opportunities(views: DataFrame, limit: int = 20, minimum_score: float = 0.0) -> DataFrame:
    return views.where(F.col("score") >= minimum_score).orderBy(
        F.desc("score"), F.desc("personal_advantage_pct"), F.desc("saving_pct"), "master_id").limit(_limit(limit))
