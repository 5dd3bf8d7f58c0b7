"""Prices a person with memberships can buy at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions import scoring as K
from pricetide.functions import wordlists as W
from pricetide.functions.money import discount_pct

from .comparison import best_public_quote, winner_and_runner_up
from .filters import audience_set, context_stores, public_quotes, quote_allowed


def context_priority() -> Column:
    rank = F
    for name, value in W.CONTEXT_PRIORITY.items():
        rank = rank.when(F.col("price_type") == name, value)
    return rank.otherwise(9)


def best_quote(quotes: DataFrame, audiences=W.DEFAULT_AUDIENCES) -> DataFrame:
    """Cheapest allowed quote per listing; member prices win ties."""
    order = F.struct("price", context_priority().alias("p"), F.lower("audience_key").alias("a"))
    return quotes.where(quote_allowed(audiences)).groupBy("listing_id").agg(
        F.min_by(F.struct("price", "regular_price", "price_type", "audience_key", "eligibility_required"), order).alias("quote")
    )


def personal_opportunities(
    listings: DataFrame, stores: DataFrame, quotes: DataFrame, matches: DataFrame, context_stats: DataFrame,
    as_of: Column, audiences=W.DEFAULT_AUDIENCES,
) -> DataFrame:
    """Best personal price per product against the second best and the public market.

    Offers are per listing, not per shop, and a tie keeps its winner.
    """
    shops = context_stores(stores).select("store_id", F.col("name").alias("store_name"), "comparison_enabled", "personal_comparison_enabled")
    active = quotes.where("is_active")
    base = (
        listings.where("is_available and not excluded_from_comparison and package_quantity = 1 and master_id is not null")
        .select("listing_id", "store_id", "master_id", "current_price", "last_seen_at")
        .join(shops, "store_id")
        .join(active.select("listing_id").distinct(), "listing_id", "left_semi")
    )
    offers = (
        base.join(best_quote(active, audiences), "listing_id")
        .join(matches.select("listing_id", "confidence"), "listing_id", "left")
        .withColumns({"price": F.col("quote.price"), "confidence": F.coalesce("confidence", F.lit(1.0)),
                      "seen": K.freshness(as_of, F.col("last_seen_at"), K.PERSONAL_FRESHNESS, K.PERSONAL_STALE)})
    )
    ranked = winner_and_runner_up(offers, ties_have_winner=True).where("offer_count >= 2")
    open_price = public_quotes(active).groupBy("listing_id").agg(F.min("price").alias("open_price"))
    reference = (
        base.where("comparison_enabled").join(open_price, "listing_id", "left")
        .withColumn("public_price", F.coalesce("open_price", F.when(~F.col("personal_comparison_enabled") & (F.col("current_price") > 0), F.col("current_price"))))
        .groupBy("master_id").agg(F.min("public_price").alias("public_reference_price"))
    )
    facts = offers.select("listing_id", "confidence", "seen", "quote.price_type", "quote.audience_key")
    winner = facts.select(F.col("listing_id").alias("winner_id"), F.struct("confidence", "seen", "price_type", "audience_key").alias("wf"))
    runner = facts.select(F.col("listing_id").alias("runner_id"), F.struct("confidence", "seen").alias("rf"))
    stats = context_stats.select(
        F.col("listing_id").alias("winner_id"), F.col("price_type").alias("st"), F.col("audience_key").alias("sa"), "avg_90d", "min_90d"
    )
    joined = (
        ranked.withColumns({"winner_id": F.col("winner.listing_id"), "runner_id": F.col("runner_up.listing_id")})
        .join(winner, "winner_id").join(runner, "runner_id").join(reference, "master_id", "left")
    )
    joined = joined.join(
        stats, (joined["winner_id"] == stats["winner_id"]) & (F.col("wf.price_type") == F.col("st")) & (F.col("wf.audience_key") == F.col("sa")), "left"
    ).drop(stats["winner_id"])
    price, public = F.col("winner.price"), F.col("public_reference_price")
    rated = joined.withColumns({
        "history_position": K.personal_history_position(price, F.col("avg_90d"), F.col("min_90d")),
        "match_confidence": F.least("wf.confidence", "rf.confidence"),
        "freshness": F.least("wf.seen", "rf.seen"),
        "scarcity": K.scarcity(F.col("offer_count")),
        "personal_advantage": F.coalesce(F.when(public != 0, F.greatest(public - price, F.lit(0))), F.lit(0)).cast("bigint"),
    }).withColumn("score", K.opportunity_score_v1(
        market_saving=K.market_saving(F.col("saving_pct")), history_position=F.col("history_position"),
        match_confidence=F.col("match_confidence"), freshness=F.col("freshness"), scarcity=F.col("scarcity")))
    return rated.select(
        "master_id", "score", K.classify_opportunity(F.col("score")).alias("classification"),
        F.col("winner.listing_id").alias("winner_listing_id"), F.col("winner.store_id").alias("winner_store_id"),
        F.col("winner.price").alias("winner_price"), F.col("wf.price_type").alias("winner_price_type"),
        F.col("wf.audience_key").alias("winner_audience_key"), "saving", "saving_pct", "public_reference_price", "personal_advantage",
        F.when(public != 0, F.col("personal_advantage") / public).otherwise(0.0).alias("personal_advantage_pct"),
        "history_position", "match_confidence", "freshness", "scarcity",
    )


def member_projection(changes: DataFrame, audiences=W.DEFAULT_AUDIENCES) -> DataFrame:
    """Changes re-priced at the cheapest member quote the audiences may use."""
    allowed = audience_set(audiences)
    members = F.array_sort(F.transform(
        F.filter("price_quotes", lambda q: (F.upper(F.trim(q["price_type"])) == "MEMBER")
                 & F.lower(F.trim(q["audience_key"])).isin(*allowed) & (q["price"] > 0)),
        lambda q: F.struct(q["price"].alias("price"), q["regular_price"].alias("regular_price"))))
    public = F.array_min(F.transform(
        F.filter("price_quotes", lambda q: (F.upper(F.trim(q["price_type"])) == "PUBLIC") & (q["price"] > 0)), lambda q: q["price"]))
    projected = changes.withColumn("_m", F.get(members, F.lit(0))).where("_m is not null").withColumn(
        "_r", F.coalesce(F.nullif(F.col("_m.regular_price"), F.lit(0)), public)
    )
    current, regular = F.col("_m.price"), F.col("_r")
    return projected.select(
        *[c for c in changes.columns if c not in ("current_price", "regular_price", "discount_pct", "previous_price")],
        current.alias("current_price"), F.when(regular > current, regular).alias("regular_price"),
        discount_pct(regular, current).alias("discount_pct"), F.lit(None).cast("bigint").alias("previous_price"),
    )


def shop_offers(listings: DataFrame, stores: DataFrame, quotes: DataFrame, mode: str = "public", audiences=W.DEFAULT_AUDIENCES) -> DataFrame:
    """The price shown for every listing in the public or personal view.

    A personal offer falls back to the public one; a shop with member prices and
    no public quote shows nothing to the public.
    """
    shops = stores.select("store_id", F.col("name").alias("store_name"), "comparison_enabled", "personal_comparison_enabled")
    public = best_public_quote(quotes).select("listing_id", F.struct(
        "quote.price", "quote.regular_price", F.upper("quote.price_type").alias("price_type"), "quote.audience_key",
        F.lit(False).alias("eligibility_required"), F.lit(False).alias("own")).alias("public_quote"))
    rows = listings.join(shops, "store_id").join(public, "listing_id", "left")
    regular, current = F.col("regular_price"), F.col("current_price")
    plain = F.when(~F.col("personal_comparison_enabled"), F.struct(
        current.alias("price"), regular.alias("regular_price"),
        F.when(regular > current, "SALE").otherwise("PUBLIC").alias("price_type"), F.lit("public").alias("audience_key"),
        F.lit(False).alias("eligibility_required"), F.lit(True).alias("own")))
    offer = F.coalesce("public_quote", plain)
    if mode == "personal":
        own = best_quote(quotes, audiences).select("listing_id", F.struct("quote.*", F.lit(False).alias("own")).alias("personal_quote"))
        rows = rows.join(own, "listing_id", "left")
        offer = F.coalesce("personal_quote", "public_quote", plain)
    shown = rows.withColumn("offer", offer).where("offer is not null")
    discount = F.when(F.col("offer.own"), F.coalesce("discount_pct", F.lit(0.0))).otherwise(
        discount_pct(F.col("offer.regular_price"), F.col("offer.price")))
    return shown.select(
        "listing_id", "master_id", "store_id", "store_name", F.col("name").alias("product_name"), "url", "last_seen_at",
        "offer.price", "offer.regular_price", discount.alias("discount_pct"), "offer.price_type", "offer.audience_key",
        "offer.eligibility_required",
        F.when(F.lit(mode == "personal") & ~F.col("offer.own"), F.col("comparison_enabled") & ~F.col("offer.eligibility_required"))
        .otherwise(F.lit(True)).alias("is_public_market"),
    )


def personal_history_view(personal: DataFrame, context_stats: DataFrame) -> DataFrame:
    """A member price against its own history, the public reference and the advantage."""
    stats = context_stats.select(
        F.col("listing_id").alias("winner_listing_id"), F.col("price_type").alias("winner_price_type"),
        F.col("audience_key").alias("winner_audience_key"), "min_30d", "avg_30d", "min_90d", "avg_90d", "historical_min", "days_at_current_price")
    joined = personal.join(stats, ["winner_listing_id", "winner_price_type", "winner_audience_key"], "left")
    gap = F.when(F.col("avg_90d") > 0, (F.col("winner_price") - F.col("avg_90d")) / F.col("avg_90d"))
    return joined.select(
        "master_id", "winner_price", "winner_price_type", "min_30d", "avg_30d", "min_90d", "avg_90d", "historical_min",
        "days_at_current_price", "public_reference_price", "personal_advantage", "personal_advantage_pct", gap.alias("vs_avg_90d"))
