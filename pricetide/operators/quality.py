"""Data quality of listings and availability of products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions import wordlists as W
from pricetide.functions.signature import signature
from pricetide.functions.urls import is_valid_url

STATUSES = ("CLEAN", "WARNING", "BLOCKED")


def _checks(name: Column, url: Column, price: Column, regular: Column, discount: Column, previous: Column, volume: Column):
    """(issue, penalty, critical, condition) in reporting order."""
    clean_name = F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))
    bad_name = clean_name.isin(*W.BAD_NAMES)
    cheap = F.coalesce(price, F.lit(0)) <= 0
    priced = F.coalesce(regular, F.lit(0)) > 0
    below = priced & (regular < price)
    calculated = (regular - price) / regular
    reported = F.coalesce(discount, F.lit(0.0))
    reported = F.when(reported > 1.5, reported / 100.0).otherwise(reported)
    known = (F.coalesce(previous, F.lit(0)) > 0) & (price > 0)
    ratio = price / previous
    extreme = known & ((ratio >= 8.0) | (ratio <= 0.125))
    large = known & ((ratio >= 4.0) | (ratio <= 0.25))
    return (
        ("invalid_name", 80, True, bad_name),
        ("name_too_short", 55, True, ~bad_name & (F.length(clean_name) < 3)),
        ("invalid_url", 35, False, ~is_valid_url(F.coalesce(url, F.lit("")))),
        ("non_positive_price", 100, True, cheap),
        ("implausibly_low_price", 35, False, ~cheap & (price < 500)),
        ("implausibly_high_price", 20, False, price > 2_000_000),
        ("regular_below_current", 18, False, below),
        ("discount_mismatch", 12, False, priced & ~below & (reported > 0) & (F.abs(calculated - reported) > 0.12)),
        ("extreme_discount", 20, False, priced & ~below & (calculated > 0.90)),
        ("extreme_price_jump", 50, True, extreme),
        ("large_price_jump", 25, False, ~extreme & large),
        ("unknown_volume", 8, False, volume.isNull()),
    )


def assess_quality(listings: DataFrame, previous_price: str | None = "previous_price") -> DataFrame:
    """Listings with score, status, ordered issues, exclusion and parsed name facts."""
    previous = F.col(previous_price) if previous_price else F.lit(None).cast("bigint")
    name = F.coalesce("name", F.lit(""))
    sig = F.col("_sig")
    checks = _checks(name, F.col("url"), F.col("current_price"), F.col("regular_price"), F.col("discount_pct"), previous, sig["volume_ml"])
    found = F.filter(
        F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(issue).alias("issue"), F.lit(penalty).alias("penalty"), F.lit(critical).alias("critical")))
                  for issue, penalty, critical, hit in checks]),
        lambda row: row.isNotNull(),
    )
    penalty = F.aggregate("_found", F.lit(0), lambda total, row: total + row["penalty"])
    blocked = F.exists("_found", lambda row: row["critical"]) | (F.col("data_quality_score") < 60)
    replaced = {"data_quality_score", "data_quality_status", "data_quality_issues", "excluded_from_comparison", "abv_pct", "vintage_year", "package_quantity"}
    keep = [c for c in listings.columns if c not in replaced]
    return (
        listings.select(*keep).withColumn("_sig", signature(name)).withColumn("_found", found)
        .withColumn("data_quality_score", F.greatest(F.lit(0), F.lit(100) - penalty))
        .select(
            *keep, "data_quality_score",
            F.when(blocked, "BLOCKED").when(F.col("data_quality_score") < 80, "WARNING").otherwise("CLEAN").alias("data_quality_status"),
            F.transform("_found", lambda row: row["issue"]).alias("data_quality_issues"),
            blocked.alias("excluded_from_comparison"),
            sig["abv_pct"].alias("abv_pct"), sig["vintage_year"].alias("vintage_year"),
            F.coalesce(sig["pack_count"], F.lit(1)).alias("package_quantity"),
        )
    )


def quality_events(assessed: DataFrame, as_of: Column) -> DataFrame:
    """Audit rows to append, one per assessment."""
    return assessed.select(
        "listing_id", F.col("last_confirmed_run_id").alias("run_id"), F.col("data_quality_score").alias("score"),
        F.col("data_quality_status").alias("status"), F.col("data_quality_issues").alias("issues"), as_of.alias("observed_at"))


def confirmed_in_runs(listings: DataFrame, runs: DataFrame) -> DataFrame:
    return listings.join(runs.select(F.col("run_id").alias("last_confirmed_run_id")), "last_confirmed_run_id", "left_semi")


def refresh_quality(listings: DataFrame, runs: DataFrame) -> DataFrame:
    """Re-assess the listings of the runs, without a previous price."""
    return assess_quality(confirmed_in_runs(listings, runs), None)


def quality_summary(listings: DataFrame, runs: DataFrame) -> DataFrame:
    status = F.coalesce("data_quality_status", F.lit("CLEAN"))
    return confirmed_in_runs(listings, runs).agg(
        F.count("*").alias("assessed"), F.count_if(status == "CLEAN").alias("clean"),
        F.count_if(status == "WARNING").alias("warnings"), F.count_if(status == "BLOCKED").alias("blocked"))


def quality_incidents(listings: DataFrame, stores: DataFrame, limit: int = 50) -> DataFrame:
    """Worst available listings of active shops."""
    shown = listings.where("is_available and data_quality_status in ('BLOCKED', 'WARNING')").join(
        stores.where("is_active").select("store_id"), "store_id", "left_semi")
    return shown.orderBy("data_quality_score", F.desc("last_seen_at"), "listing_id").limit(limit)


def quality_totals(listings: DataFrame, stores: DataFrame) -> DataFrame:
    active = listings.where("is_available").join(stores.where("is_active").select("store_id"), "store_id", "left_semi")
    return active.agg(F.count_if(F.col("data_quality_status") == "BLOCKED").alias("blocked"), F.count_if(F.col("data_quality_status") == "WARNING").alias("warnings"))


def reconcile_availability(listings: DataFrame, observations: DataFrame, runs: DataFrame, threshold: int = 2) -> DataFrame:
    """State of every listing after one run of its shop.

    ``runs``: run_id, store_id, is_healthy, finished_at. Only a healthy run counts
    an absence; an unhealthy one leaves absent listings alone.
    """
    seen = observations.join(runs.select("run_id"), "run_id", "left_semi").select("run_id", "listing_id").distinct().withColumn("observed", F.lit(True))
    state = listings.join(runs.select("run_id", "store_id", "is_healthy", F.col("finished_at").alias("run_at")), "store_id").join(seen, ["run_id", "listing_id"], "left")
    observed = F.coalesce("observed", F.lit(False))
    counted = ~observed & F.col("is_healthy")
    streak = F.when(observed, 0).when(counted, F.coalesce("missing_streak", F.lit(0)) + 1).otherwise(F.coalesce("missing_streak", F.lit(0)))
    gone = counted & F.col("is_available") & (streak >= max(1, threshold))
    back = observed & ~F.col("is_available")
    return state.select(
        "listing_id", "store_id", "run_id",
        F.when(observed, True).when(gone, False).otherwise(F.col("is_available")).alias("is_available"),
        streak.alias("missing_streak"), observed.alias("observed"), gone.alias("marked_unavailable"), back.alias("reactivated"),
        F.when(gone, F.col("run_at")).alias("unavailable_since"), F.when(back, F.col("run_at")).alias("reactivated_at"),
        F.when(observed, F.col("run_at")).alias("last_available_at"),
        F.when(observed, F.col("run_id")).otherwise(F.col("last_confirmed_run_id")).alias("last_confirmed_run_id"),
    )


def availability_summary(states: DataFrame) -> DataFrame:
    return states.groupBy("run_id").agg(
        F.count_if("observed").alias("observed"), F.count_if(~F.col("observed")).alias("missing"),
        F.count_if("marked_unavailable").alias("marked_unavailable"), F.count_if("reactivated").alias("reactivated"))


def replay_availability(presence: DataFrame, threshold: int = 2) -> DataFrame:
    """Availability after every run of a history, as gaps and islands.

    ``presence``: listing_id, run_seq, observed, is_healthy. A listing is gone once
    ``threshold`` healthy runs in a row have missed it since it was last seen.
    """
    order = Window.partitionBy("listing_id").orderBy("run_seq")
    island = F.sum(F.col("observed").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = presence.withColumn("island", island)
    inside = Window.partitionBy("listing_id", "island").orderBy("run_seq").rowsBetween(Window.unboundedPreceding, 0)
    missed = F.sum((~F.col("observed") & F.col("is_healthy")).cast("int")).over(inside)
    return rows.select("listing_id", "run_seq", missed.alias("missing_streak"), (missed < threshold).alias("is_available"))
