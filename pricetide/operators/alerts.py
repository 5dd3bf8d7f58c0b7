"""Which changes are worth a message, and which were already sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ingest import rank_best_prices, rank_drops, rank_increases, rank_new


def payload_hash(*columns: str) -> Column:
    """Aggregate: SHA-256 of the JSON of ranked rows. The first column is the rank.

    Meant for reports of a fixed length; the rows are limited before.
    """
    return F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))), 256)


def _bundle(rows: DataFrame, alert_type: str, prefix: str, fields: tuple[str, ...], reason: str) -> DataFrame:
    """One alert per run from its ranked rows."""
    return rows.groupBy("store_id", "run_id").agg(
        payload_hash("position", *fields).alias("payload_hash"), F.count("*").alias("items"),
        F.min_by("listing_id", "position").alias("listing_id"), F.min_by("current_price", "position").alias("price"),
    ).select(
        "store_id", "run_id", F.lit(alert_type).alias("alert_type"),
        F.concat_ws(":", F.lit(prefix), "store_id", "run_id", F.col("payload_hash")).alias("deduplication_key"),
        "payload_hash", F.concat(F.col("items").cast("string"), F.lit(f" {reason}")).alias("reason"), "items", "listing_id", "price")


def ranking_fingerprint(changes: DataFrame, limit: int = 30, keys=("store_id", "run_id")) -> DataFrame:
    """Hash of what the ranking of a run shows."""
    ranked = rank_best_prices(changes, limit, keys)
    return ranked.withColumn("discount", F.bround("discount_pct", 6)).groupBy(*keys).agg(
        payload_hash("position", "listing_id", "current_price", "regular_price", "discount").alias("fingerprint"), F.count("*").alias("items"))


def digest_due(current: DataFrame, last: DataFrame, as_of: Column, interval_hours: int = 24, keys=("store_id",), fingerprint: str = "fingerprint") -> DataFrame:
    """Is a digest due: first, changed, or its interval is over. ``last``: keys, payload_hash, sent_at."""
    joined = current.join(last.select(*keys, F.col("payload_hash").alias("_last"), F.col("sent_at").alias("_sent"), F.lit(True).alias("_known")), list(keys), "left")
    overdue = F.coalesce(F.unix_micros(as_of) - F.unix_micros("_sent") >= max(1, interval_hours) * 3_600_000_000, F.lit(True))
    reason = F.when(F.col("_known").isNull(), "first").when(~F.col("_last").eqNullSafe(F.col(fingerprint)), "changed").when(overdue, "interval")
    return joined.withColumn("due_reason", reason).withColumn("is_due", F.col("due_reason").isNotNull()).drop("_last", "_sent", "_known")


def latest_sent_alert(log: DataFrame, keys=("store_id", "alert_type")) -> DataFrame:
    sent = log.where("status = 'sent'")
    row = F.struct("payload_hash", "sent_at")
    return sent.groupBy(*keys).agg(F.max_by(row, F.struct("sent_at", "deduplication_key")).alias("a")).select(*keys, "a.*")


def incidents(runs: DataFrame, last: DataFrame, as_of: Column, reminder_hours: int = 24) -> DataFrame:
    """Runs with problems worth reporting, and recoveries.

    ``runs``: store_id, run_id, health_status, previous_health_status,
    sections_failed, structural_warnings, problems (sorted array of text).
    """
    body = F.struct("health_status", "sections_failed", "structural_warnings", "problems")
    hashed = runs.withColumn("fingerprint", F.sha2(F.to_json(body), 256))
    bad = (F.col("health_status") != "HEALTHY") | (F.col("sections_failed") > 0) | (F.col("structural_warnings") > 0)
    checked = digest_due(hashed, last, as_of, reminder_hours)
    turned = (F.col("health_status") != "HEALTHY") & ~F.col("health_status").eqNullSafe(F.col("previous_health_status"))
    recovered = ~bad & (F.col("previous_health_status") != "HEALTHY")
    kind = F.when(bad & (turned | F.col("is_due")), "collector_incident").when(recovered, "collector_recovery")
    return checked.withColumn("alert_type", kind).where("alert_type is not null").select(
        "store_id", "run_id", "alert_type",
        F.when(F.col("alert_type") == "collector_incident", F.concat_ws(":", F.lit("collector-incident"), "store_id", "run_id", F.col("fingerprint")))
        .otherwise(F.concat_ws(":", F.lit("collector-recovery"), "store_id", "run_id")).alias("deduplication_key"),
        F.col("fingerprint").alias("payload_hash"),
        F.concat_ws(" ", "alert_type", F.when(F.col("alert_type") == "collector_incident", F.col("health_status")).otherwise(F.col("previous_health_status"))).alias("reason"),
        F.lit(1).cast("bigint").alias("items"), F.lit(None).cast("bigint").alias("listing_id"), F.lit(None).cast("bigint").alias("price"))


def store_alerts(
    changes: DataFrame, runs: DataFrame, last_ranking: DataFrame, last_incident: DataFrame, as_of: Column,
    min_drop_pct: float = 0.05, min_drop_amount: int = 1000, max_items: int = 10, ranking_limit: int = 30,
    digest_hours: int = 24, with_increases: bool = True, with_new: bool = True,
) -> DataFrame:
    """All alerts of a cycle, one row each, with a summary row per run that has any.

    ``changes`` carries store_id, run_id and the change columns; ``runs`` one row
    per run (see ``incidents``) with ``previous_product_count``.
    """
    keys = ("store_id", "run_id")
    fields = ("listing_id", "previous_price", "current_price")
    parts = [_bundle(rank_drops(changes, min_drop_pct, min_drop_amount, max_items, keys), "price_drop", "price-drop", fields, "relevant drops")]
    if with_increases:
        parts.append(_bundle(rank_increases(changes, max_items, keys), "price_increase", "price-increase", fields, "increases"))
    if with_new:
        known = runs.where("previous_product_count > 0").select(*keys)
        parts.append(_bundle(rank_new(changes.join(known, list(keys), "left_semi"), max_items, keys), "new_product", "new-products", ("listing_id",), "new products"))
    parts.append(incidents(runs, last_incident, as_of))
    ranking = digest_due(ranking_fingerprint(changes, ranking_limit, keys), last_ranking, as_of, digest_hours).where("is_due")
    parts.append(ranking.select(
        *keys, F.lit("ranking_digest").alias("alert_type"), F.concat_ws(":", F.lit("ranking-digest"), *keys, F.col("fingerprint")).alias("deduplication_key"),
        F.col("fingerprint").alias("payload_hash"), F.col("due_reason").alias("reason"), "items", F.lit(None).cast("bigint").alias("listing_id"), F.lit(None).cast("bigint").alias("price")))
    alerts = parts[0]
    for part in parts[1:]:
        alerts = alerts.unionByName(part)
    # At most one alert of each kind per run.
    reasons = F.transform(F.array_sort(F.collect_list(F.struct("alert_type", "reason"))), lambda r: r["reason"])
    summary = alerts.groupBy(*keys).agg(F.array_join(reasons, "; ").alias("reason"), F.count("*").alias("items")).select(
        *keys, F.lit("smart_summary").alias("alert_type"), F.concat_ws(":", F.lit("smart-summary"), *keys).alias("deduplication_key"),
        F.sha2(F.concat_ws("|", "run_id", "reason"), 256).alias("payload_hash"), "reason", "items",
        F.lit(None).cast("bigint").alias("listing_id"), F.lit(None).cast("bigint").alias("price"))
    return summary.unionByName(alerts)


def commercial_alerts(comparison: DataFrame, minimum_score: float = 85.0, rare_frequency: float = 0.15, minimum_observations: int = 6, limit: int = 8) -> DataFrame:
    """New floors, and rare offers the winner has just dropped into."""
    new_min = F.col("price_event") == "NEW_HISTORICAL_MIN"
    rare = (
        (F.col("price_event") == "RARE_OFFER") & (F.col("score") >= minimum_score) & (F.col("observations_90d") >= minimum_observations)
        & (F.col("rarity_frequency_90d") <= rare_frequency) & (F.col("winner_previous_price") > F.col("winner_price")))
    chosen = comparison.where(~F.col("is_tie") & (F.col("saving") > 0) & F.coalesce(new_min | rare, F.lit(False)))
    kind = F.when(new_min, "historical-min").otherwise("rare-offer")
    ordered = chosen.orderBy(F.desc(new_min), F.desc("score"), F.desc("historical_gap_pct"), F.desc("saving_pct"), "master_id").limit(max(1, limit))
    return ordered.select(
        "master_id", F.col("winner_store_id").alias("store_id"), F.col("winner_listing_id").alias("listing_id"), F.col("winner_price").alias("price"),
        F.when(new_min, "commercial_new_historical_min").otherwise("commercial_rare_offer").alias("alert_type"),
        F.concat_ws(":", F.lit("commercial"), kind, "master_id", "winner_price").alias("deduplication_key"))


def comparison_fingerprint(comparison: DataFrame, limit: int = 30) -> DataFrame:
    """One row: hash of the best opportunities a digest would show."""
    top = comparison.where("not is_tie and saving > 0").orderBy(
        F.desc("score"), F.desc("saving_pct"), F.desc("saving"), "master_id").limit(max(1, limit))
    # A report of at most ``limit`` rows: one group is the feature.
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("saving_pct"), F.desc("saving"), "master_id")))
    shown = ranked.withColumn("confidence", F.bround("confidence", 4))
    return shown.agg(
        payload_hash("rank", "master_id", "winner_store_id", "winner_price", "runner_store_id", "runner_price", "saving", "confidence", "score").alias("fingerprint"),
        F.count("*").alias("items"), F.min_by("winner_listing_id", "rank").alias("listing_id"), F.min_by("winner_price", "rank").alias("price"))


def comparison_alerts(comparison: DataFrame, last_digest: DataFrame, as_of: Column, run_key: str, limit: int = 30, change_limit: int = 10, digest_hours: int = 24) -> DataFrame:
    """Alert rows for winner changes and for the comparison digest."""
    changed = comparison.where("not is_tie and saving > 0 and winner_changed").orderBy(
        F.desc("saving_pct"), F.desc("saving"), "master_id").limit(change_limit)
    ranked = changed.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("saving_pct"), F.desc("saving"), "master_id")))
    winners = ranked.agg(
        payload_hash("rank", "master_id", "previous_winner_store_id", "winner_store_id", "winner_price").alias("payload_hash"), F.count("*").alias("items"),
        F.min_by("winner_listing_id", "rank").alias("listing_id"), F.min_by("winner_price", "rank").alias("price")).where("items > 0").select(
        F.lit("cross_store_winner_change").alias("alert_type"), F.concat_ws(":", F.lit("cross-store-winner"), F.lit(run_key), F.col("payload_hash")).alias("deduplication_key"),
        "payload_hash", F.lit("winner_change").alias("reason"), "items", "listing_id", "price")
    current = comparison_fingerprint(comparison, limit).withColumn("alert_type", F.lit("cross_store_digest"))
    digest = digest_due(current, last_digest, as_of, digest_hours, ("alert_type",)).where("is_due").select(
        "alert_type", F.concat_ws(":", F.lit("cross-store-digest"), F.lit(run_key), F.col("fingerprint")).alias("deduplication_key"),
        F.col("fingerprint").alias("payload_hash"), F.col("due_reason").alias("reason"), "items", "listing_id", "price")
    return winners.unionByName(digest)


def member_price_alerts(drops: DataFrame, listings: DataFrame, stores: DataFrame, min_drop_pct: float = 0.05, min_drop_amount: int = 1000, limit: int = 10) -> DataFrame:
    """Largest recent drops of member prices in shops with member prices."""
    shops = stores.where("is_active and personal_comparison_enabled").select("store_id")
    offered = listings.where("is_available").join(shops, "store_id", "left_semi").select("listing_id", "store_id", "name")
    size = (F.col("drop_pct") >= min_drop_pct) | (F.col("saving") >= min_drop_amount)
    print_key = F.sha2(F.concat_ws(":", "listing_id", "audience_key", "previous_price", "current_price"), 256)
    return (
        drops.where(size).join(offered, "listing_id").orderBy(F.desc("drop_pct"), F.desc("saving"), F.lower("name"), "listing_id")
        .limit(max(1, limit)).withColumn("payload_hash", print_key)
        .select("listing_id", "store_id", F.lit("personal_member_price_drop").alias("alert_type"),
                F.concat(F.lit("personal-member-drop:"), F.col("payload_hash")).alias("deduplication_key"),
                "payload_hash", F.col("current_price").alias("price"), "previous_price", "saving", "drop_pct"))


def member_advantages(personal: DataFrame, listings: DataFrame, stores: DataFrame, min_advantage: int = 1000, limit: int = 10) -> DataFrame:
    """Products where a member price beats the public market most."""
    shops = stores.where("is_active and personal_comparison_enabled").select(F.col("store_id").alias("winner_store_id"))
    offered = listings.where("is_available").select(F.col("listing_id").alias("winner_listing_id"))
    return (
        personal.where((F.col("winner_price_type") == "MEMBER") & (F.col("personal_advantage") >= min_advantage))
        .join(shops, "winner_store_id", "left_semi").join(offered, "winner_listing_id", "left_semi")
        .orderBy(F.desc("personal_advantage_pct"), F.desc("personal_advantage"), "master_id").limit(max(1, limit)))


def personal_store_ranking(member_changes: DataFrame, limit: int = 30) -> DataFrame:
    """Ranking alert of a members-only shop, once per run."""
    ranked = ranking_fingerprint(member_changes, max(1, limit))
    return ranked.select(
        "store_id", "run_id", F.lit("personal_store_ranking").alias("alert_type"),
        F.concat_ws(":", F.lit("personal-store-ranking"), "store_id", "run_id", F.col("fingerprint")).alias("deduplication_key"),
        F.col("fingerprint").alias("payload_hash"), "items")


def dedup_alerts(new: DataFrame, log: DataFrame, as_of: Column, retry_after_minutes: int = 30) -> DataFrame:
    """Alerts to send: not sent before, not reserved a moment ago, once per key."""
    age = F.unix_micros(as_of) - F.unix_micros("created_at")
    fresh = (F.col("status") == "pending") & (age < retry_after_minutes * 60_000_000)
    blocked = log.where((F.col("status") == "sent") | fresh).select("deduplication_key")
    return new.join(blocked, "deduplication_key", "left_anti").dropDuplicates(["deduplication_key"])


def mark_alerts(log: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Log after delivery; ``results``: deduplication_key, delivered, error."""
    joined = log.join(results, "deduplication_key", "left")
    return joined.select(
        *[c for c in log.columns if c not in ("status", "sent_at")],
        F.when(F.col("delivered"), "sent").when(~F.col("delivered"), "failed").otherwise(F.col("status")).alias("status"),
        F.when(F.col("delivered"), as_of).otherwise(F.col("sent_at")).alias("sent_at"), F.col("error").alias("error_message"))


def failure_alerts(failures: DataFrame, last: DataFrame, as_of: Column, repeat_hours: int = 24) -> DataFrame:
    """Failed collections whose error was not reported within the window.

    ``failures``: store_id, run_id, error.
    """
    hashed = failures.withColumn("payload_hash", F.sha2("error", 256))
    recent = last.where(F.unix_micros(as_of) - F.unix_micros("sent_at") < repeat_hours * 3_600_000_000).select("store_id", "payload_hash")
    return hashed.join(recent, ["store_id", "payload_hash"], "left_anti").select(
        "store_id", "run_id", F.lit("collector_failure").alias("alert_type"),
        F.concat_ws(":", F.lit("collector-failure"), "store_id", "run_id", F.col("payload_hash")).alias("deduplication_key"), "payload_hash", "error")

