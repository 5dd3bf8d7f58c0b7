"""Batches of collected listings: de-duplication, upserts, changes, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.money import change_columns


def dedup_listings(cards: DataFrame, policy: str = "cheapest", keys=("store", "url")) -> DataFrame:
    """One row per address in a run; sections are united and copies counted.

    ``cards`` has ``seq``, the reading order. ``latest``: last read wins;
    ``cheapest``: lowest price, the later read on ties; ``first_cheapest``: the
    earlier read on ties.
    """
    order = {
        "latest": F.struct(F.col("seq")),
        "cheapest": F.struct((-F.col("current_price")).alias("p"), F.col("seq")),
        "first_cheapest": F.struct((-F.col("current_price")).alias("p"), (-F.col("seq")).alias("s")),
    }[policy]
    rest = [c for c in cards.columns if c not in (*keys, "source_sections")]
    best = cards.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("c"), F.count("*").alias("copies"))
    # Sections are de-duplicated before they are collected: names of a shop's own sections only.
    sections = cards.select(*keys, F.explode("source_sections").alias("section")).distinct().groupBy(*keys).agg(
        F.array_sort(F.collect_list("section")).alias("source_sections"))
    return best.join(sections, list(keys), "left").select(
        *keys, "c.*", F.coalesce("source_sections", F.array().cast("array<string>")).alias("source_sections"), (F.col("copies") - 1).alias("duplicates_removed"))


def upsert_listings(state: DataFrame, batch: DataFrame, as_of: Column) -> DataFrame:
    """State after a batch, keyed by (store_id, url); carries the previous price."""
    key = ["store_id", "url"]
    old = state.select(*key, F.struct(*[c for c in state.columns if c not in key]).alias("o"))
    new = batch.select(*key, F.struct("name", "current_price", "regular_price", "discount_pct", "sku", "ean", "run_id").alias("n"))
    joined = old.join(new, key, "full")
    seen, created = F.col("n").isNotNull(), F.col("o").isNull()

    def take(name: str) -> Column:
        return F.when(seen, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))

    def merge(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"n.{name}"), F.lit("")), F.col(f"o.{name}"))

    fresh_id = F.xxhash64(*key).bitwiseAND(0x7FFFFFFFFFFFFFFF)
    return joined.select(
        *key, F.coalesce("o.listing_id", fresh_id).alias("listing_id"),
        *[take(c).alias(c) for c in ("name", "current_price", "regular_price", "discount_pct")],
        merge("sku").alias("sku"), merge("ean").alias("ean"),
        F.when(created, F.col("n.run_id")).otherwise(F.col("o.last_confirmed_run_id")).alias("last_confirmed_run_id"),
        F.when(created, as_of).otherwise(F.col("o.first_seen_at")).alias("first_seen_at"),
        F.when(seen, as_of).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"),
        F.when(seen, F.col("o.current_price")).alias("previous_price"),
        (created & seen).alias("is_new"), seen.alias("is_observed"),
    )


def changes_of(upserted: DataFrame) -> DataFrame:
    """Observed rows with the columns that describe the price change."""
    return upserted.where("is_observed").withColumns(change_columns(F.col("previous_price"), F.col("current_price")))


QUOTE_KEY = ["listing_id", "price_type", "audience_key"]


def explode_quotes(batch: DataFrame) -> DataFrame:
    """Normalised quotes of a batch; a listing without quotes has a public one."""
    default = F.array(F.struct(
        F.col("current_price").alias("price"), "regular_price", F.lit("PUBLIC").alias("price_type"),
        F.lit("public").alias("audience_key"), F.lit(False).alias("eligibility_required")))
    shaped = F.transform("price_quotes", lambda q: F.struct(
        q["price"].alias("price"), q["regular_price"].alias("regular_price"), q["price_type"].alias("price_type"),
        q["audience_key"].alias("audience_key"), q["eligibility_required"].alias("eligibility_required")))
    quotes = F.when(F.coalesce(F.size("price_quotes"), F.lit(0)) > 0, shaped).otherwise(default)
    rows = batch.select("listing_id", F.posexplode(quotes).alias("pos", "q"))
    named = rows.select(
        "listing_id", "pos", "q.price", "q.regular_price",
        F.upper(F.trim(F.coalesce(F.nullif("q.price_type", F.lit("")), F.lit("PUBLIC")))).alias("price_type"),
        F.lower(F.trim(F.coalesce(F.nullif("q.audience_key", F.lit("")), F.lit("public")))).alias("audience_key"),
        F.coalesce("q.eligibility_required", F.lit(False)).alias("eligibility_required"))
    return named.where("price > 0")


def upsert_quotes(state: DataFrame, batch: DataFrame, as_of: Column) -> DataFrame:
    """Current quotes after a batch; contexts an observed listing no longer has go inactive."""
    new = explode_quotes(batch).groupBy(*QUOTE_KEY).agg(
        F.max_by(F.struct("price", "regular_price", "eligibility_required"), "pos").alias("n"))
    listed = new.select("listing_id").distinct().withColumn("touched", F.lit(True))
    old = state.select(*QUOTE_KEY, F.struct("price", "regular_price", "eligibility_required", "is_active", "observed_at").alias("o"))
    joined = old.join(new, QUOTE_KEY, "full").join(listed, "listing_id", "left")
    seen = F.col("n").isNotNull()
    return joined.select(
        *QUOTE_KEY,
        *[F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("price", "regular_price", "eligibility_required")],
        F.when(seen, True).when(F.coalesce("touched", F.lit(False)), False).otherwise(F.col("o.is_active")).alias("is_active"),
        F.when(seen, as_of).otherwise(F.col("o.observed_at")).alias("observed_at"))


def backfill_public_quotes(listings: DataFrame) -> DataFrame:
    sale = F.coalesce(F.col("regular_price") > F.col("current_price"), F.lit(False))
    return listings.select(
        "listing_id", F.col("current_price").alias("price"), "regular_price", F.when(sale, "SALE").otherwise("PUBLIC").alias("price_type"),
        F.lit("public").alias("audience_key"), F.lit(False).alias("eligibility_required"), F.lit(True).alias("is_active"))


def upsert_stores(state: DataFrame, registry: DataFrame) -> DataFrame:
    """Shop metadata from the registry; shops not in it stay as they are."""
    fields = [c for c in registry.columns if c != "connector_key"]
    old = state.select("connector_key", F.struct(*[c for c in state.columns if c != "connector_key"]).alias("o"))
    new = registry.select("connector_key", F.struct(*fields).alias("n"))
    joined = old.join(new, "connector_key", "full")
    fresh_id = F.xxhash64("connector_key").bitwiseAND(0x7FFFFFFF).cast("int")
    return joined.select(
        "connector_key", F.coalesce("o.store_id", fresh_id).alias("store_id"),
        *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in fields],
        (F.col("n").isNotNull() | F.col("o.is_active")).alias("is_active"), F.col("o").isNull().alias("created"))


def catalog_change_summary(changes: DataFrame, missing: DataFrame | None = None, keys=("store_id",)) -> DataFrame:
    """Counts per shop: total, reported discounts, drops, increases, unchanged, new, missing."""
    counts = changes.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("regular_price").isNotNull() & (F.col("discount_pct") > 0)).alias("reported_discounts"),
        F.count_if("price_dropped").alias("price_drops"), F.count_if("price_increased").alias("price_increases"),
        F.count_if(~F.col("is_new") & ~F.col("price_changed")).alias("unchanged"), F.count_if("is_new").alias("new_products"))
    if missing is None:
        return counts.withColumn("missing_products", F.lit(0).cast("bigint"))
    absent = missing.groupBy(*keys).agg(F.count("*").alias("missing_products"))
    return counts.join(absent, list(keys), "left").withColumn("missing_products", F.coalesce("missing_products", F.lit(0)))


def ranking_columns() -> dict[str, Column]:
    regular, current, discount = F.col("regular_price"), F.col("current_price"), F.col("discount_pct")
    reported = F.coalesce((regular > current) & (discount > 0), F.lit(False))
    dropped = F.col("price_dropped")
    drop_pct = F.when(dropped, F.abs("price_change_pct")).otherwise(0.0)
    reported_pct = F.when(reported, discount).otherwise(0.0)
    saving = F.greatest(F.when(dropped, -F.col("price_change_amount")).otherwise(0), F.when(reported, regular - current).otherwise(0))
    reason = (
        F.when((drop_pct > 0) & (drop_pct >= reported_pct), "real_drop").when(reported_pct > 0, "reported_discount")
        .when(F.col("is_new"), "new_listing").otherwise("price_only"))
    return {"effective_pct": F.greatest(drop_pct, reported_pct), "saving": saving, "signal": dropped | reported, "ranking_reason": reason}


def rank_best_prices(changes: DataFrame, limit: int = 30, keys=("store_id",)) -> DataFrame:
    """Best offers of a shop: verifiable signal, larger percentage, real drop, saving, price, name."""
    order = Window.partitionBy(*keys).orderBy(
        F.desc("signal"), F.desc("effective_pct"), F.desc("price_dropped"), F.desc("saving"), "current_price", F.lower("name"), "listing_id")
    eligible = changes.where(~F.coalesce("excluded_from_comparison", F.lit(False))).withColumns(ranking_columns())
    return eligible.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def _top(rows: DataFrame, keys, limit: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order, F.lower("name"), "listing_id")
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def rank_drops(changes: DataFrame, min_pct: float = 0.05, min_amount: int = 1000, limit: int = 10, keys=("store_id",)) -> DataFrame:
    size = F.abs("price_change_pct")
    rows = changes.where(F.col("price_dropped") & ((size >= min_pct) | (-F.col("price_change_amount") >= min_amount)))
    return _top(rows, keys, limit, F.desc(size), F.asc("price_change_amount"))


def rank_increases(changes: DataFrame, limit: int = 10, keys=("store_id",)) -> DataFrame:
    return _top(changes.where("price_increased"), keys, limit, F.desc("price_change_pct"), F.desc("price_change_amount"))


def rank_new(changes: DataFrame, limit: int = 10, keys=("store_id",)) -> DataFrame:
    return _top(changes.where("is_new"), keys, limit)


def paginate(ranked: DataFrame, size: int = 10, position: str = "position") -> DataFrame:
    return ranked.withColumns({
        "page": F.ceil(F.col(position) / size).cast("int"), "position_in_page": ((F.col(position) - 1) % size + 1).cast("int")})


def page_novelty(pages: DataFrame) -> DataFrame:
    """Per page of a landed catalog: repeated signature, new addresses, and catalog end.

    ``pages``: catalog, page_no, url (one row per product card).
    """
    cards = pages.select("catalog", "page_no", "url").distinct()
    first = cards.groupBy("catalog", "url").agg(F.min("page_no").alias("first_page"))
    per_page = cards.join(first, ["catalog", "url"]).groupBy("catalog", "page_no").agg(
        F.count("*").alias("urls"), F.count_if(F.col("page_no") == F.col("first_page")).alias("new_urls"),
        F.concat_ws(":", F.count("*").cast("string"), F.bit_xor(F.xxhash64("url")).cast("string"), F.sum(F.xxhash64("url").cast("decimal(38,0)")).cast("string")).alias("signature"))
    order = Window.partitionBy("catalog").orderBy("page_no")
    same = F.coalesce(F.lag("signature").over(order) == F.col("signature"), F.lit(False))
    begin = F.min("page_no").over(Window.partitionBy("catalog"))
    return per_page.select("catalog", "page_no", "urls", "new_urls", same.alias("same_as_previous"),
                           ((F.col("page_no") > begin) & (F.col("new_urls") == 0)).alias("ends_catalog"))
