"""Watched products: what changed for their watchers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .comparison import cheapest_per_store

EVENTS = ("back_in_stock", "price_drop", "target_reached", "new_store", "winner_change")


def watchlist_snapshot(listings: DataFrame, stores: DataFrame, seen: DataFrame | None = None, as_of: Column | None = None, max_age_hours: int = 72) -> DataFrame:
    """Current offers per product: winner and the shops that carry it, cheapest first.

    Restricted to listings in ``seen`` (a run's observations), or else to fresh ones.
    """
    rows = listings.where("current_price > 0 and is_available and not excluded_from_comparison and master_id is not null")
    if seen is not None:
        rows = rows.join(seen.where("price > 0").select("listing_id"), "listing_id", "left_semi")
    elif as_of is not None:
        rows = rows.where(F.col("last_seen_at") >= as_of - F.make_dt_interval(hours=F.lit(max_age_hours)))
    shops = stores.where("is_active").select("store_id", F.col("name").alias("store_name"))
    offers = cheapest_per_store(rows.join(shops, "store_id").select("master_id", "store_name", "listing_id", F.col("current_price").alias("price")), keys=("master_id", "store_name"))
    # One entry per shop that carries the product.
    ordered = F.array_sort(F.collect_list(F.struct("price", F.lower("store_name").alias("k"), "store_name")))
    return offers.groupBy("master_id").agg(ordered.alias("o")).select(
        "master_id", F.col("o")[0]["price"].alias("best_price"), F.col("o")[0]["store_name"].alias("winner_store"),
        F.transform("o", lambda x: x["store_name"]).alias("store_names"))


def evaluate_watchlist(favorites: DataFrame, snapshot: DataFrame, as_of: Column, run_key: str = "", coverage_complete: bool = True, minimum_drop: int = 1) -> DataFrame:
    """Events and new state of every active favorite.

    A favorite without offers changes only when coverage was complete. Notify
    flags default to on.
    """
    defaults = {f"notify_{e}": F.lit(True) for e in ("back_in_stock", "price_drop", "new_store", "winner_change")}
    flagged = favorites.where("is_active").withColumns({n: c for n, c in defaults.items() if n not in favorites.columns})
    rows = flagged.join(snapshot, "master_id", "left")
    here = F.col("best_price").isNotNull()
    price, before, target = F.col("best_price"), F.col("last_best_price"), F.col("target_price")
    known = F.coalesce("last_store_names", F.array().cast("array<string>"))
    added = F.array_except("store_names", known)
    tests = {
        "back_in_stock": F.col("notify_back_in_stock") & F.col("last_evaluated_at").isNotNull() & ~F.col("was_available"),
        "price_drop": F.col("notify_price_drop") & (before - price >= max(1, minimum_drop)),
        "target_reached": (price <= target) & (before.isNull() | (before > target)),
        "new_store": F.col("notify_new_store") & (F.size(known) > 0) & (F.size(added) > 0),
        "winner_change": F.col("notify_winner_change") & (F.col("last_winner_store") != "") & (F.col("winner_store") != F.col("last_winner_store")),
    }
    events = F.filter(F.array(*[F.when(here & test, F.lit(name)) for name, test in tests.items()]), lambda e: e.isNotNull())
    evaluated = here | F.lit(coverage_complete)
    gone = ~here & F.lit(coverage_complete)
    sorted_names = F.transform(
        F.array_sort(F.transform("store_names", lambda s: F.struct(F.lower(s).alias("k"), s.alias("s")))), lambda x: x["s"])
    raw = F.concat_ws(
        "|", "favorite_id", F.lit(run_key), F.array_join("events", ","), price.cast("string"), "winner_store", F.array_join("store_names", ","))
    return rows.withColumn("events", events).select(
        "favorite_id", "watcher_id", "master_id", "events",
        F.when(here, price).otherwise(before).alias("last_best_price"),
        F.when(here, F.col("winner_store")).when(gone, F.lit(None)).otherwise(F.col("last_winner_store")).alias("last_winner_store"),
        F.when(here, sorted_names).when(gone, F.array().cast("array<string>")).otherwise(known).alias("last_store_names"),
        F.when(here, True).when(gone, False).otherwise(F.col("was_available")).alias("was_available"),
        F.when(evaluated, as_of).otherwise(F.col("last_evaluated_at")).alias("last_evaluated_at"),
        evaluated.alias("evaluated"), F.when(F.size("events") > 0, F.sha2(raw, 256)).alias("payload_hash"),
    ).withColumn("deduplication_key", F.when(F.col("payload_hash").isNotNull(), F.concat_ws(":", F.lit("favorite"), "favorite_id", F.col("payload_hash"))))


def upsert_watchlist(state: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Favorites by (watcher, product); a missing winner keeps the old values.

    ``requests``: watcher_id, master_id, target_price, best_price, winner_store, store_names.
    """
    key = ["watcher_id", "master_id"]
    old = state.select(*key, F.struct(*[c for c in state.columns if c not in key]).alias("o"))
    new = requests.select(*key, F.struct("target_price", "best_price", "winner_store", "store_names").alias("n"))
    joined = old.join(new, key, "full")
    asked = F.col("n").isNotNull()
    names = F.when(F.size("n.store_names") > 0, F.col("n.store_names"))
    return joined.select(
        F.coalesce("o.favorite_id", F.xxhash64(*key).bitwiseAND(0x7FFFFFFFFFFFFFFF)).alias("favorite_id"), *key,
        F.coalesce("n.target_price", "o.target_price").alias("target_price"),
        F.coalesce("n.best_price", "o.last_best_price").alias("last_best_price"),
        F.coalesce("n.winner_store", "o.last_winner_store").alias("last_winner_store"),
        F.coalesce(names, "o.last_store_names").alias("last_store_names"),
        F.when(asked, F.coalesce(F.size("n.store_names") > 0, F.lit(False))).otherwise(F.col("o.was_available")).alias("was_available"),
        F.when(asked, as_of).otherwise(F.col("o.last_evaluated_at")).alias("last_evaluated_at"),
        (asked | F.col("o.is_active")).alias("is_active"), F.col("o").isNull().alias("created"))


def deactivate(state: DataFrame, requests: DataFrame) -> DataFrame:
    """Favorites with those asked for by their own watcher switched off."""
    off = requests.select("watcher_id", "favorite_id").distinct().withColumn("_off", F.lit(True))
    return state.join(off, ["watcher_id", "favorite_id"], "left").withColumn(
        "is_active", F.col("is_active") & F.col("_off").isNull()).drop("_off")


def list_watchlist(state: DataFrame, masters: DataFrame, snapshot: DataFrame) -> DataFrame:
    return state.where("is_active").join(masters.select("master_id", "canonical_name", "volume_ml"), "master_id").join(snapshot, "master_id", "left").select(
        "favorite_id", "watcher_id", "master_id", "canonical_name", "volume_ml", "target_price", "best_price", "winner_store", "store_names")
