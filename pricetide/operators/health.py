"""Collection runs: health, schedule, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USABLE_STATES = ("UPDATED", "STALE", "DUE_SOON")

# Penalties and limits per health policy. ``broken`` is what a run
# below the plausible count scores; ``failed_limit`` how many failed sections a
# degraded run may have (a share of the sections where ``by_third``).
HEALTH_POLICIES = (
    # policy, per_failure, per_warning, minimum_products, failed_limit, by_third, broken_cap
    ("proportional", 70, 30, 1, 2, True, None),
    ("fixed_8_5", 8, 5, 180, 3, False, None),
    ("fixed_12_8", 12, 8, 1, 2, True, None),
    ("fixed_14_7", 14, 7, 60, 2, False, None),
    ("fixed_14_8", 14, 8, 1, 2, True, None),
    ("fixed_15_8", 15, 8, 150, 1, False, None),
    ("fixed_18_8", 18, 8, 1, 1, False, 35),
)


def collection_health(sections: DataFrame, runs: DataFrame, policies: DataFrame) -> DataFrame:
    """Status and score of each run from its sections.

    ``sections``: run_id, status, structural_warning. ``runs``: run_id, policy,
    products. ``policies``: the columns of ``HEALTH_POLICIES``. A run without
    sections counts as having none.
    """
    counts = sections.groupBy("run_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") != "success").alias("failed"), F.count_if("structural_warning").alias("warnings"))
    joined = runs.join(policies, "policy").join(counts, "run_id", "left").fillna(0, ["total", "failed", "warnings"])
    total, failed, warnings = F.col("total"), F.col("failed"), F.col("warnings")
    share = lambda n, weight: F.bround(n / F.nullif(total, F.lit(0)) * weight, 0)
    proportional = F.lit(100) - share(failed, F.col("per_failure")) - share(warnings, F.col("per_warning"))
    fixed = F.lit(100) - failed * F.col("per_failure") - warnings * F.col("per_warning")
    raw = F.when(F.col("policy") == "proportional", proportional).otherwise(fixed)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(raw, F.lit(0)))).cast("int")
    by_third = F.greatest(F.col("failed_limit"), F.floor(total / 3))
    strictly = F.col("policy") == "proportional"
    tolerable = F.when(
        F.col("by_third"), F.when(strictly, failed < by_third).otherwise(failed <= by_third)
    ).otherwise(failed <= F.col("failed_limit"))
    few = F.col("products") < F.col("minimum_products")
    empty = F.col("by_third") & (total == 0)
    status = (
        F.when(few | empty, "BROKEN").when((failed == 0) & (warnings == 0), "HEALTHY")
        .when(tolerable & (F.col("_score") >= 55), "DEGRADED").otherwise("BROKEN"))
    capped = F.when((F.col("health_status") == "BROKEN") & F.col("broken_cap").isNotNull(), F.least("_score", "broken_cap")).otherwise(F.col("_score"))
    few_score = F.when(empty | (F.col("products") <= 0), 0).when(F.col("by_third"), F.least("_score", F.lit(20))).otherwise(20)
    return joined.withColumn("_score", score).withColumn("health_status", status).select(
        "run_id", "policy", "products", "health_status", F.when(few | empty, few_score).otherwise(capped).cast("int").alias("health_score"))


def completeness_health(runs: DataFrame) -> DataFrame:
    """Policies that judge completeness instead of sections.

    ``runs``: run_id, products, minimum_products, complete, failed_pages, score_if_partial
    (null: 90 less 10 per failed page, at least 50).
    """
    few = F.col("products") < F.col("minimum_products")
    whole = F.col("complete") & (F.col("failed_pages") == 0)
    partial = F.coalesce("score_if_partial", F.greatest(F.lit(50), 90 - F.col("failed_pages") * 10))
    return runs.select(
        "run_id", "products", F.when(few, "BROKEN").when(whole, "HEALTHY").otherwise("DEGRADED").alias("health_status"),
        F.when(few, F.when(F.col("products") > 0, 20).otherwise(0)).when(whole, 100).otherwise(partial).cast("int").alias("health_score"))


def historical_health(runs: DataFrame) -> DataFrame:
    """Downgrade runs that found far fewer products than the run before them."""
    ratio = F.when(F.col("previous_count") > 0, F.col("products") / F.col("previous_count"))
    healthy, degraded = F.col("health_status") == "HEALTHY", F.col("health_status") == "DEGRADED"
    status = F.when((ratio < 0.40) & healthy, "BROKEN").when((ratio < 0.70) & healthy, "DEGRADED").otherwise(F.col("health_status"))
    score = (
        F.when((ratio < 0.40) & healthy, F.least("health_score", F.lit(25))).when((ratio < 0.40) & degraded, F.least("health_score", F.lit(45)))
        .when((ratio >= 0.40) & (ratio < 0.70) & healthy, F.least("health_score", F.lit(60))).otherwise(F.col("health_score")))
    return runs.select(*[c for c in runs.columns if c not in ("health_status", "health_score")], score.alias("health_score"), status.alias("health_status"))


def latest_runs(runs: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Per shop: latest finished run, latest healthy snapshot, last successful count, last health.

    One aggregation; every pick is the latest by finish time, then id.
    """
    known = runs if exclude is None else runs.join(exclude.select("run_id"), "run_id", "left_anti")
    done = F.col("finished_at").isNotNull()
    success = F.col("status") == "success"
    healthy = done & success & (F.col("health_status") == "HEALTHY") & (F.col("products_found") > 0)
    when_done = F.struct("finished_at", "run_id")
    row = F.struct("run_id", "finished_at", "products_found", "health_status", "source")
    return known.groupBy("store_id").agg(
        F.max_by(F.when(done, row), F.when(done, when_done)).alias("latest"),
        F.max_by(F.when(healthy, row), F.when(healthy, when_done)).alias("healthy"),
        F.max_by(F.when(success & done, F.col("products_found")), F.when(success & done, when_done)).alias("previous_successful_count"))


def due_runs(stores: DataFrame, latest: DataFrame, as_of: Column, grace_minutes: int = 15) -> DataFrame:
    """Shops to collect now. Others reuse their healthy snapshot until it is due.

    ``stores``: store_id, interval_hours (null: always due).
    """
    joined = stores.join(latest, "store_id", "left")
    due_at = F.col("latest.finished_at") + F.make_dt_interval(hours=F.col("interval_hours"))
    waiting = F.coalesce(
        (as_of + F.make_dt_interval(mins=F.lit(grace_minutes)) < due_at) & F.col("healthy").isNotNull(), F.lit(False))
    return joined.select(
        "store_id", due_at.alias("next_due_at"), (~waiting).alias("is_due"),
        F.when(waiting, "DUE_SOON").alias("execution_state"), F.when(waiting, F.col("healthy.run_id")).alias("reused_run_id"))


def accept_batches(runs: DataFrame, latest: DataFrame, replace_degraded: bool = False) -> DataFrame:
    """Which run stands for a shop after a collection.

    A broken run is not persisted and fails. A degraded one may be dropped in
    favour of the last healthy run (STALE).
    """
    joined = runs.join(latest.select("store_id", F.col("healthy.run_id").alias("healthy_run_id")), "store_id", "left")
    failed = F.col("health_status") == "BROKEN"
    stale = F.lit(replace_degraded) & (F.col("health_status") == "DEGRADED") & F.col("healthy_run_id").isNotNull()
    state = F.when(failed, "FAILED").when(stale, "STALE").otherwise("UPDATED")
    return joined.select(
        "run_id", "store_id", "health_status", state.alias("execution_state"),
        F.when(stale, F.col("healthy_run_id")).when(~failed, F.col("run_id")).alias("effective_run_id"), (~failed & ~stale).alias("is_persisted"))


def store_status(stores: DataFrame, latest: DataFrame) -> DataFrame:
    joined = stores.where("is_active").join(latest, "store_id", "left")
    return joined.select(
        "store_id", "name", F.col("latest.run_id").alias("last_run_id"), F.col("latest.finished_at").alias("last_finished_at"),
        F.col("latest.health_status").alias("last_health"), F.col("healthy.run_id").alias("healthy_run_id"),
        F.col("healthy.finished_at").alias("healthy_finished_at"), F.coalesce("healthy.source", "latest.source").alias("source"))


def coverage_complete(results: DataFrame) -> DataFrame:
    """One row: does every shop that takes part have usable current data?"""
    relevant = results.where("execution_state <> 'PAUSED' and not diagnostic_mode")
    fine = F.col("run_id").isNotNull() & (F.col("products_found") > 0) & (
        ((F.col("execution_state") == "UPDATED") & (F.col("health_status") == "HEALTHY")) | F.col("execution_state").isin("STALE", "DUE_SOON"))
    return relevant.agg(F.coalesce(F.bool_and(F.coalesce(fine, F.lit(False))), F.lit(False)).alias("complete"))


def cycle_outcome(results: DataFrame) -> DataFrame:
    good = ~F.col("diagnostic_mode") & F.col("success") & F.col("execution_state").isin(*USABLE_STATES)
    return results.agg(F.coalesce(F.bool_or(good), F.lit(False)).alias("success"))


def run_metrics(changes: DataFrame, missing: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run: created, updated, price changes, missing, duration."""
    counts = changes.groupBy("run_id").agg(
        F.count_if("is_new").alias("products_created"), F.count_if(~F.col("is_new")).alias("products_updated"), F.count_if("price_changed").alias("price_changes"))
    absent = missing.groupBy("run_id").agg(F.count("*").alias("missing_products"))
    duration = ((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000).cast("bigint")
    return runs.select("run_id", duration.alias("duration_ms")).join(counts, "run_id", "left").join(absent, "run_id", "left").fillna(0)


def shard_plausibility(listings: DataFrame, limits: DataFrame) -> DataFrame:
    """A shard with more listings than it can have means its filter was ignored."""
    counts = listings.select("shard", "listing_id").distinct().groupBy("shard").agg(F.count("*").alias("distinct_listings"))
    joined = limits.join(counts, "shard", "left").withColumn("distinct_listings", F.coalesce("distinct_listings", F.lit(0)))
    return joined.withColumn("plausible", F.col("distinct_listings") <= F.col("max_plausible"))


def collection_stats(sections: DataFrame, products: DataFrame) -> DataFrame:
    """Totals per run over its sections."""
    totals = sections.groupBy("run_id").agg(
        F.count("*").alias("sections_visited"), F.count_if(F.col("status") == "success").alias("sections_succeeded"),
        F.count_if(F.col("status") != "success").alias("sections_failed"), F.sum("pages").alias("pages_visited"),
        F.sum("cards").alias("cards_seen"), F.sum("duplicates").alias("duplicates_removed"), F.count_if("structural_warning").alias("structural_warnings"))
    unique = products.select("run_id", "listing_id").distinct().groupBy("run_id").agg(F.count("*").alias("unique_products"))
    return totals.join(unique, "run_id", "left").withColumn("unique_products", F.coalesce("unique_products", F.lit(0)))


def merge_phase_metrics(runs: DataFrame, column: str = "performance_ms") -> DataFrame:
    """Sum of timings by phase name."""
    return runs.select(F.explode(column).alias("phase", "ms")).groupBy("phase").agg(F.sum("ms").alias("ms"))


def weekly_health(runs: DataFrame, stores: DataFrame, as_of: Column, days: int = 7, timeout_minutes: int = 25) -> DataFrame:
    """Run health per active shop, with a grand total row (store_id null)."""
    recent = runs.where((F.col("started_at") >= as_of - F.make_dt_interval(days=F.lit(max(1, days)))) & F.col("finished_at").isNotNull())
    shops = stores.where("is_active").select("store_id")
    rows = shops.join(recent, "store_id", "left")
    ran = F.col("run_id").isNotNull()
    healthy = (F.col("health_status") == "HEALTHY") & (F.col("status") == "success")
    failed = (F.col("status") == "failed") | (F.col("health_status") == "BROKEN")
    near = F.coalesce("duration_ms", F.lit(0)) >= int(timeout_minutes * 60 * 1000 * 0.80)
    report = rows.rollup("store_id").agg(
        F.count("run_id").alias("runs"), F.count_if(healthy).alias("healthy"),
        F.count_if(F.col("health_status").isin("DEGRADED", "STALE")).alias("degraded"), F.count_if(failed).alias("failures"),
        F.count_if(F.col("error_message").rlike("429|430|403|RateLimit")).alias("rate_limits"),
        F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("average_duration_ms"),
        F.coalesce(F.bround(F.avg(F.when(F.col("products_found") > 0, F.col("products_found"))), 0), F.lit(0.0)).cast("bigint").alias("average_products"),
        F.count_if(ran & near).alias("near_timeout"),
        F.max_by("source", F.struct("started_at", "run_id")).alias("latest_source"))
    rate = F.when(F.col("runs") > 0, F.col("healthy") / F.col("runs") * 100).otherwise(0.0)
    light = F.when((F.col("success_rate") >= 90) & (F.col("failures") == 0), "green").when(F.col("healthy") > 0, "yellow").otherwise("red")
    return report.withColumn("success_rate", rate).withColumn("light", light)


def execution_state_summary(results: DataFrame) -> DataFrame:
    """Counts by state for the public shops, plus personal and diagnostic sources."""
    diagnostic = F.col("diagnostic_mode")
    public = F.col("comparison_enabled") & ~diagnostic
    personal = F.col("personal_comparison_enabled") & ~F.col("comparison_enabled") & ~diagnostic
    state, good = F.col("execution_state"), F.col("success")
    return results.agg(
        *[F.count_if(public & good & (state == s)).alias(s.lower()) for s in USABLE_STATES],
        F.count_if(public & (state == "PAUSED")).alias("paused"),
        F.count_if(public & ((state == "FAILED") | (~good & (state != "PAUSED")))).alias("failed"),
        F.count_if(personal).alias("personal_sources"), F.count_if(personal & good).alias("personal_ok"),
        F.count_if(diagnostic).alias("diagnostic_sources"), F.count_if(diagnostic & good).alias("diagnostic_ok"))


def catalog_pulse(listings: DataFrame, stores: DataFrame, as_of: Column, max_age_hours: int = 72, approximate: bool = False) -> DataFrame:
    """One row: public shops, personal sources, fresh offers, products with a fresh offer."""
    public = stores.where("is_active and comparison_enabled")
    counts = stores.agg(
        F.count_if(F.col("is_active") & F.col("comparison_enabled")).alias("public_stores"),
        F.count_if(F.col("is_active") & F.col("personal_comparison_enabled")).alias("personal_sources"))
    fresh = listings.where("is_available and not excluded_from_comparison and current_price > 0").where(
        F.col("last_seen_at") >= as_of - F.make_dt_interval(hours=F.lit(max_age_hours))).join(public.select("store_id"), "store_id", "left_semi")
    distinct = F.approx_count_distinct("master_id") if approximate else F.count_distinct("master_id")
    return counts.join(fresh.agg(F.count("*").alias("fresh_offers"), distinct.alias("comparable_products")), F.lit(True))
