"""Cross-shop price comparison of the public market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions import scoring as K
from pricetide.functions import wordlists as W
from pricetide.functions.money import discount_pct
from pricetide.functions.signature import signature
from pricetide.functions.text import apply_aliases, is_pack_text
from pricetide.session import materialize

from .filters import observed_in_runs, outside_runs, public_quotes
from .history import previous_prices
from .matching import vetoed, with_pair_score

ECONOMIC_RATIO = 4.0


def _name_order(store_name: str = "store_name") -> Column:
    return F.lower(store_name)


def best_public_quote(quotes: DataFrame) -> DataFrame:
    """Cheapest quote anybody may use, per listing."""
    order = F.struct("price", F.when(F.upper("price_type") == "SALE", 0).otherwise(1).alias("p"), "audience_key")
    return public_quotes(quotes).groupBy("listing_id").agg(
        F.min_by(F.struct("price", "regular_price", "price_type", "audience_key"), order).alias("quote")
    )


def cheapest_per_store(offers: DataFrame, price: str = "price", keys=("master_id", "store_id")) -> DataFrame:
    """One offer per product and shop: lowest price, then lowest listing id.

    An aggregate, not a window: it combines on the map side.
    """
    rest = [c for c in offers.columns if c not in keys]
    best = offers.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(price, "listing_id")).alias("o"))
    return best.select(*keys, "o.*")


def winner_and_runner_up(offers: DataFrame, ties_have_winner: bool = False, price: str = "price", group: str = "master_id") -> DataFrame:
    """Cheapest and second cheapest offer per product, saving and tie flag."""
    order = Window.partitionBy(group).orderBy(price, _name_order(), "listing_id")
    top = offers.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    fields = F.struct("listing_id", "store_id", "store_name", F.col(price).alias("price"))
    pair = top.groupBy(group).agg(
        F.min_by(fields, "rank").alias("winner"),
        F.max_by(F.when(F.col("rank") == 2, fields), "rank").alias("runner_up"),
    )
    counts = offers.groupBy(group).agg(F.count("*").alias("offer_count"))
    tie = F.coalesce(F.col("winner.price") == F.col("runner_up.price"), F.lit(False))
    shown = F.lit(True) if ties_have_winner else ~F.col("is_tie")
    saving = F.when(shown, F.greatest(F.col("runner_up.price") - F.col("winner.price"), F.lit(0)))
    return (
        pair.join(counts, group).withColumn("is_tie", tie)
        .withColumn("saving", F.coalesce(saving, F.lit(0)).cast("bigint"))
        .withColumn("saving_pct", F.when(F.col("runner_up.price") > 0, F.col("saving") / F.col("runner_up.price")).otherwise(0.0))
        .withColumns({c: F.when(shown, F.col(c)) for c in ("winner", "runner_up")})
    )


def previous_winner(offers: DataFrame, previous: DataFrame) -> DataFrame:
    """Shop that was cheapest before, among the offers compared now; null on a tie."""
    priced = offers.select("master_id", "listing_id", "store_id", "store_name").join(previous, "listing_id")
    order = Window.partitionBy("master_id").orderBy("previous_price", _name_order(), "listing_id")
    top = priced.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    first, second = F.col("rank") == 1, F.col("rank") == 2
    pair = top.groupBy("master_id").agg(
        F.max(F.when(first, F.col("previous_price"))).alias("low"),
        F.max(F.when(second, F.col("previous_price"))).alias("next"),
        F.max(F.when(first, F.col("store_id"))).alias("previous_winner_store_id"),
        F.max(F.when(first, F.col("store_name"))).alias("previous_winner_store_name"),
    )
    return pair.where("low < next").drop("low", "next")


def verify_offers(offers: DataFrame, matches: DataFrame, minimum_confidence: float = 0.86, similarity: str = "sequence") -> DataFrame:
    """Are all offers of a product the same product, and how sure is that?

    Offers that verification cannot tell apart are one group with a count, so
    the pairs compared are pairs of different spellings.
    """
    matched = matches.select(
        "listing_id", F.col("master_id").alias("match_master"), "confidence",
        F.col("matching_method").isin(*W.TRUSTED_METHODS).alias("trusted"),
    )
    facts = F.struct(*[F.col(f"sig.{c}").alias(c) for c in (
        "core_tokens", "core_key", "volume_ml", "is_pack", "brand", "variant_tokens", "abv_pct", "vintage_year")]).alias("sig")
    keys = ["master_id", "sig", "match_master", "trusted"]
    groups = (
        offers.join(matched, "listing_id", "left").select("master_id", "listing_id", facts, "match_master", "trusted", "confidence")
        .groupBy(*keys).agg(F.min("listing_id").alias("group_id"), F.count("*").alias("copies"), F.min("confidence").alias("stored"))
    )
    a, b = groups.alias("a"), groups.alias("b")
    met = a.join(
        b,
        (F.col("a.master_id") == F.col("b.master_id"))
        & ((F.col("a.group_id") < F.col("b.group_id"))
           | ((F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.copies") > 1))),
    )
    trusted = F.coalesce(
        (F.col("a.match_master") == F.col("b.match_master")) & (F.col("a.trusted") | F.col("b.trusted")), F.lit(False)
    )
    pairs = met.select(
        F.col("a.master_id").alias("master_id"), F.col("a.sig").alias("l"), F.col("b.sig").alias("r"),
        F.col("a.stored").alias("ls"), F.col("b.stored").alias("rs"), trusted.alias("trusted"),
        vetoed(F.col("a.sig"), F.col("b.sig")).alias("veto"),
    )
    sure = pairs.where("trusted or veto").select(
        "master_id", (~F.col("veto")).alias("ok"), F.least("ls", "rs").alias("confidence")
    )
    scored = with_pair_score(pairs.where("not trusted and not veto"), minimum_confidence, similarity)
    score = F.col("confidence")
    unsure = scored.select(
        "master_id", F.col("accepted").alias("ok"),
        F.least(score, F.coalesce("ls", score), F.coalesce("rs", score)).alias("confidence"),
    )
    return sure.unionByName(unsure).groupBy("master_id").agg(
        F.min("ok").alias("verified"), F.min("confidence").alias("confidence")
    )


class PriceComparison:
    """One comparison pass over the listings observed in ``runs``."""

    def __init__(
        self, listings: DataFrame, stores: DataFrame, quotes: DataFrame, obs: DataFrame, matches: DataFrame,
        masters: DataFrame, stats: DataFrame, runs: DataFrame, as_of: Column, current_runs: DataFrame | None = None,
        minimum_confidence: float = 0.86, similarity: str = "sequence", minimum_observations: int = 6,
        rare_frequency: float = 0.15, near_pct: float = 0.03,
    ):
        current_runs = runs if current_runs is None else current_runs
        public = stores.where("is_active and comparison_enabled").select(
            "store_id", F.col("name").alias("store_name"), "personal_comparison_enabled"
        )
        seen = observed_in_runs(listings, obs, runs).where(F.coalesce("package_quantity", F.lit(1)) == 1)
        priced = (
            seen.join(public, "store_id")
            .join(best_public_quote(quotes), "listing_id", "left")
            .where("not personal_comparison_enabled or quote is not null")
            .withColumns({
                "price": F.coalesce("quote.price", "current_price"),
                "regular": F.when(F.col("quote").isNotNull(), F.col("quote.regular_price")).otherwise(F.col("regular_price")),
                "sig": signature(F.col("name")),
            })
        )
        # Written out once: the signature is the costly column and every step reads it.
        self.products = materialize(priced.select(
            "listing_id", "store_id", "master_id", "store_name", "name", "url", "ean", "last_seen_at", "price",
            F.col("regular").alias("regular_price"), discount_pct(F.col("regular"), F.col("price")).alias("discount_pct"), "sig",
        )).where("not sig.is_pack")
        pack_name = is_pack_text(apply_aliases(F.coalesce("canonical_name", F.lit(""))))
        guarded = masters.select(
            "master_id", "canonical_name", "volume_ml",
            (pack_name | (F.coalesce("package_quantity", F.lit(1)) > 1)).alias("pack_master"),
        )
        named = self.products.where("master_id is not null").join(guarded, "master_id", "left")
        offers = cheapest_per_store(named.where(~F.coalesce("pack_master", F.lit(False))).drop("pack_master"))
        several = offers.groupBy("master_id").agg(
            F.count("*").alias("stores"), F.count(F.nullif(F.trim("ean"), F.lit(""))).alias("eans"),
            F.min(F.trim("ean")).alias("low_ean"), F.max(F.trim("ean")).alias("high_ean"),
        ).where("stores >= 2")
        self.offers = materialize(offers.join(several.select("master_id"), "master_id", "left_semi"))
        verified = verify_offers(self.offers, matches, minimum_confidence, similarity)
        ranked = winner_and_runner_up(self.offers, ties_have_winner=True)
        ratio = F.col("runner_up.price") / F.col("winner.price")
        one_ean = (F.col("eans") == F.col("stores")) & (F.col("low_ean") == F.col("high_ean"))
        checked = several.join(verified, "master_id").join(ranked, "master_id").withColumn(
            "verified",
            F.col("verified") & ~F.coalesce((F.col("winner.price") > 0) & (ratio >= ECONOMIC_RATIO) & ~F.coalesce(one_ean, F.lit(False)), F.lit(False)),
        )
        self.groups = named.groupBy("master_id").agg(F.max(F.coalesce("pack_master", F.lit(False))).alias("pack_master")).join(
            checked.select("master_id", "verified", "is_tie"), "master_id", "left"
        )
        previous = previous_prices(obs.join(self.offers, "listing_id", "left_semi"), current_runs)
        earlier_min = outside_runs(
            obs.where("price > 0").select("listing_id", "run_id", "price").join(self._history_listings(listings, public, quotes), "listing_id"), current_runs
        ).groupBy("master_id").agg(F.min("price").alias("previous_historical_min"))
        winner_facts = self.offers.select(
            F.col("listing_id").alias("winner_id"), "last_seen_at", "canonical_name", "volume_ml"
        )
        base = (
            checked.where("verified")
            .withColumn("winner_id", F.col("winner.listing_id"))
            .join(winner_facts, "winner_id")
            .join(previous_winner(self.offers, previous), "master_id", "left")
            .join(previous.select(F.col("listing_id").alias("winner_id"), F.col("previous_price").alias("winner_previous_price")), "winner_id", "left")
            .join(stats, "master_id", "left").join(earlier_min, "master_id", "left")
            .withColumn("low_frequency", F.when(F.coalesce("observations_90d", F.lit(0)) > 0, F.coalesce("low_price_frequency_90d", F.lit(0.0))))
            .withColumn("observations_90d", F.coalesce("observations_90d", F.lit(0)))
        )
        price, shown = F.col("winner.price"), ~F.col("is_tie")

        def when_winner(value: Column, other) -> Column:
            return F.when(shown, value).otherwise(other)

        scored = (
            base.withColumn("saving", when_winner(F.col("saving"), 0).cast("bigint"))
            .withColumn("saving_pct", when_winner(F.col("saving_pct"), 0.0))
            .withColumn("history_position", when_winner(K.history_position(price, F.col("avg_90d"), F.col("min_90d")), 0.0))
            .withColumn("freshness", when_winner(K.freshness(as_of, F.col("last_seen_at")), 0.0))
            .withColumn("scarcity", when_winner(K.scarcity(F.col("offer_count")), 0.0))
            .withColumn("rarity", when_winner(K.rarity(F.col("low_frequency"), F.col("history_position"), F.col("observations_90d"), minimum_observations), 0.0))
            .withColumn("score", when_winner(K.opportunity_score_v2(
                market_saving=K.market_saving(F.col("saving_pct")), history_position=F.col("history_position"), rarity=F.col("rarity"),
                match_confidence=F.col("confidence"), freshness=F.col("freshness"), scarcity=F.col("scarcity")), 0.0))
        )
        signal = K.commercial_signal(
            price, F.col("previous_historical_min"), F.col("historical_min"), F.col("observations_90d"), F.col("low_frequency"),
            F.col("rarity"), F.col("saving_pct"), minimum_observations, rare_frequency, near_pct,
        )
        neutral = {"price_event": "NORMAL", "historical_gap": 0, "historical_gap_pct": 0.0, "intelligence_reason": "sin señal comercial excepcional"}
        changed = shown & F.coalesce(F.col("winner.store_id") != F.col("previous_winner_store_id"), F.lit(False))
        self.result = scored.withColumns({
            **{name: when_winner(column, F.lit(neutral[name])) for name, column in signal.items()},
            "winner_changed": changed,
        }).select(
            "master_id", "canonical_name", "volume_ml", "offer_count", "is_tie",
            *[F.when(shown, F.col(f"winner.{c}")).alias(f"winner_{c}") for c in ("listing_id", "store_id", "store_name", "price")],
            *[F.when(shown, F.col(f"runner_up.{c}")).alias(f"runner_{c}") for c in ("store_id", "price")],
            "saving", "saving_pct", "confidence", "previous_winner_store_id", "previous_winner_store_name", "winner_changed",
            F.when(shown, F.col("winner_previous_price")).alias("winner_previous_price"),
            "min_90d", "avg_90d", "median_90d", "historical_min", "previous_historical_min", "observations_90d",
            F.coalesce("days_at_current_price", F.lit(0)).alias("days_at_current_price"), "score",
            F.when(shown, K.classify_opportunity(F.col("score"))).otherwise("No destacada").alias("classification"),
            F.lit("v2").alias("score_version"), "history_position", "freshness", "scarcity", "rarity",
            F.col("low_frequency").alias("rarity_frequency_90d"), "price_event", "historical_gap", "historical_gap_pct", "intelligence_reason",
        )

    @staticmethod
    def _history_listings(listings: DataFrame, public: DataFrame, quotes: DataFrame) -> DataFrame:
        quoted = public_quotes(quotes).select("listing_id").distinct().withColumn("quoted", F.lit(True))
        return (
            listings.where("package_quantity = 1 and not excluded_from_comparison and master_id is not null")
            .select("listing_id", "store_id", "master_id").join(public.drop("store_name"), "store_id")
            .join(quoted, "listing_id", "left").where("not personal_comparison_enabled or quoted")
            .select("listing_id", "master_id")
        )

    def opportunities(self) -> DataFrame:
        """Verified groups with a real saving, best first."""
        return self.result.where("not is_tie and saving > 0").orderBy(
            F.desc("score"), F.desc("saving_pct"), F.desc("saving"), F.lower("canonical_name"), "master_id"
        )

    def winner_changes(self) -> DataFrame:
        return self.result.where("not is_tie and saving > 0 and winner_changed").orderBy(
            F.desc("saving_pct"), F.desc("saving"), F.desc("score"), "master_id"
        )

    def summary(self) -> DataFrame:
        """One row of counters."""
        listed = self.products.agg(F.count("*").alias("current_products"))
        groups = self.groups.agg(
            F.count("*").alias("master_groups"), F.count_if("verified").alias("verified_matches"),
            F.count_if(F.col("verified") & F.col("is_tie")).alias("ties"),
            F.count_if(F.col("pack_master") | ~F.col("verified")).alias("unverified_groups"),
        )
        chances = self.result.agg(
            F.count_if(~F.col("is_tie") & (F.col("saving") > 0)).alias("opportunities"),
            F.count_if(~F.col("is_tie") & (F.col("saving") > 0) & F.col("winner_changed")).alias("winner_changes"),
        )
        return listed.join(groups, F.lit(True)).join(chances, F.lit(True))
