"""Price history statistics.

All statistics of a product come from one scan. Observations are first counted
per (product, price): that step combines on the map side and spreads even a
product that owns a third of the rows, and what remains per product is bounded
by the number of different prices, not by the number of observations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import context_stores, outside_runs, public_market


def _since(as_of: Column, days: int) -> Column:
    return F.col("observed_at") >= as_of - F.make_dt_interval(days=F.lit(days))


def _days(as_of: Column, since: Column) -> Column:
    """Whole days since a time, 0 when unknown or in the future."""
    seconds = F.unix_micros(as_of) - F.unix_micros(since)
    return F.greatest(
        F.coalesce(F.floor(seconds / 86_400_000_000), F.lit(0)), F.lit(0)
    ).cast("int")


def public_observations(obs: DataFrame, listings: DataFrame, stores: DataFrame, quotes: DataFrame) -> DataFrame:
    """Positive observations of single-unit public listings, with listing facts."""
    facts = public_market(listings, stores, quotes).where(
        "package_quantity = 1 and master_id is not null"
    ).select("listing_id", "master_id", "excluded_from_comparison", "is_available", "current_price")
    return obs.where("price > 0").select(
        "listing_id", "run_id", "price", "discount_pct", "observed_at"
    ).join(facts, "listing_id")


def _count_when(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def _per_price(observations: DataFrame, as_of: Column, short: int, long: int) -> DataFrame:
    in_short, in_long = _since(as_of, short), _since(as_of, long)
    return observations.groupBy("master_id", "price").agg(
        F.count("*").alias("n_all"),
        _count_when(in_short).alias("n_short"),
        _count_when(in_long).alias("n_long"),
        _count_when(in_long & (F.col("discount_pct") > 0)).alias("n_discount"),
        _count_when(in_long & ~F.col("excluded_from_comparison")).alias("n_clean"),
        F.min(
            F.when(in_long & F.col("is_available") & (F.col("price") == F.col("current_price")), F.col("observed_at"))
        ).alias("since"),
    )


def _period(count: str, suffix: str) -> list[Column]:
    """Minimum, mean, exact median and count over prices weighted by ``count``."""
    weight = F.col(count)
    priced = F.when(weight > 0, F.col("price"))
    return [
        F.min(priced).alias(f"min_{suffix}"),
        (F.sum(F.col("price") * weight) / F.nullif(F.sum(weight), F.lit(0))).alias(f"avg_{suffix}"),
        F.percentile(priced, F.lit(0.5), weight).alias(f"median_{suffix}"),
        F.sum(weight).alias(f"observations_{suffix}"),
    ]


def period_stats(observations: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Minimum, mean, median, count and discount frequency per product in a period."""
    counts = observations.where(_since(as_of, days)).groupBy("master_id", "price").agg(
        F.count("*").alias("n"), _count_when(F.col("discount_pct") > 0).alias("n_discount")
    )
    minimum, average, median, count = _period("n", "period")
    return counts.groupBy("master_id").agg(
        minimum, average, median, count,
        (F.sum("n_discount") / F.sum("n")).alias("discount_frequency"),
    )


def low_price_frequency(observations: DataFrame, as_of: Column, days: int = 90, band: float = 0.05) -> DataFrame:
    """Share of observations within ``band`` of the product's floor; no self-join."""
    counts = (
        observations.where(_since(as_of, days) & ~F.col("excluded_from_comparison"))
        .groupBy("master_id", "price").agg(F.count("*").alias("n"))
        .withColumn("floor_price", F.min("price").over(Window.partitionBy("master_id")))
    )
    near = F.when(F.col("price") <= F.col("floor_price") * (1 + band), F.col("n")).otherwise(0)
    return counts.groupBy("master_id").agg((F.sum(near) / F.sum("n")).alias("frequency"))


def historical_min_total(observations: DataFrame) -> DataFrame:
    return observations.groupBy("master_id").agg(
        F.min("price").alias("historical_min"), F.count("*").alias("observations_total")
    )


def current_best_price(listings: DataFrame, stores: DataFrame, quotes: DataFrame) -> DataFrame:
    """Cheapest comparable single-unit public listing per product."""
    return (
        public_market(listings, stores, quotes)
        .where("package_quantity = 1 and master_id is not null and is_available "
               "and not excluded_from_comparison and current_price > 0")
        .groupBy("master_id").agg(F.min("current_price").alias("current_best_price"))
    )


def days_at_current_price(observations: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Days since any available listing was first seen at its own current price."""
    same = observations.where(
        _since(as_of, days) & F.col("is_available") & (F.col("price") == F.col("current_price"))
    )
    return same.groupBy("master_id").agg(F.min("observed_at").alias("since")).select(
        "master_id", _days(as_of, F.col("since")).alias("days_at_current_price")
    )


def master_price_stats(
    obs: DataFrame, listings: DataFrame, stores: DataFrame, quotes: DataFrame, as_of: Column,
    short_days: int = 30, long_days: int = 90, band: float = 0.05,
) -> DataFrame:
    """The statistics row of every product that has history or a current price."""
    counts = _per_price(public_observations(obs, listings, stores, quotes), as_of, short_days, long_days)
    counts = counts.withColumn(
        "floor_price",
        F.min(F.when(F.col("n_clean") > 0, F.col("price"))).over(Window.partitionBy("master_id")),
    )
    near = F.when(F.col("price") <= F.col("floor_price") * (1 + band), F.col("n_clean")).otherwise(0)
    stats = counts.groupBy("master_id").agg(
        *_period("n_short", "30d"),
        *_period("n_long", "90d"),
        F.min("price").alias("historical_min"),
        F.sum("n_all").alias("observations_total"),
        (F.sum("n_discount") / F.nullif(F.sum("n_long"), F.lit(0))).alias("discount_frequency_90d"),
        (F.sum(near) / F.nullif(F.sum("n_clean"), F.lit(0))).alias("low_price_frequency_90d"),
        F.min("since").alias("since"),
    )
    joined = stats.join(current_best_price(listings, stores, quotes), "master_id", "full")
    zero, none = F.lit(0), F.lit(0.0)
    return joined.select(
        "master_id", "current_best_price", "min_30d", "avg_30d", "median_30d", "min_90d", "avg_90d",
        "median_90d", "historical_min",
        *[F.coalesce(c, zero).alias(c) for c in ("observations_30d", "observations_90d", "observations_total")],
        *[F.coalesce(c, none).alias(c) for c in ("discount_frequency_90d", "low_price_frequency_90d")],
        _days(as_of, F.col("since")).alias("days_at_current_price"),
    )


CONTEXT = ["listing_id", "price_type", "audience_key"]


def context_price_stats(
    quote_obs: DataFrame, listings: DataFrame, stores: DataFrame, quotes: DataFrame, as_of: Column,
    short_days: int = 30, long_days: int = 90,
) -> DataFrame:
    """The same statistics per listing and price context, without medians.

    Observations and current quotes are unioned before one aggregation, which
    replaces the four-key join between them.
    """
    allowed = context_stores(stores).select("store_id")
    facts = listings.join(allowed, "store_id", "left_semi").select(
        "listing_id", "is_available", "excluded_from_comparison"
    )
    observed = quote_obs.join(facts, "listing_id").select(*CONTEXT, "price", "observed_at", "is_available", "excluded_from_comparison")
    in_short, in_long, positive = _since(as_of, short_days), _since(as_of, long_days), F.col("price") > 0
    comparable = F.col("is_available") & ~F.col("excluded_from_comparison")
    per_price = observed.groupBy(*CONTEXT, "price").agg(
        _count_when(positive & in_short).alias("n_short"),
        _count_when(positive & in_long).alias("n_long"),
        _count_when(positive).alias("n_all"),
        F.min(F.when(comparable & in_long, F.col("observed_at"))).alias("since"),
    ).withColumn("current_price", F.lit(None).cast("bigint")).withColumn("active_price", F.lit(None).cast("bigint"))
    active = quotes.where("is_active").join(facts, "listing_id")
    current = active.select(
        *CONTEXT, "price",
        *[F.lit(0).cast("bigint").alias(c) for c in ("n_short", "n_long", "n_all")],
        F.lit(None).cast("timestamp").alias("since"),
        F.when(comparable & positive, F.col("price")).alias("current_price"),
        F.col("price").alias("active_price"),
    )
    quoted = F.max("active_price").over(Window.partitionBy(*CONTEXT))
    rows = per_price.unionByName(current).withColumn("quoted", quoted)

    def period(count: str, suffix: str) -> list[Column]:
        minimum, average, _, number = _period(count, suffix)
        return [minimum, average, number]

    stats = rows.groupBy(*CONTEXT).agg(
        F.max("current_price").alias("current_price"),
        *period("n_short", "30d"), *period("n_long", "90d"),
        F.min(F.when(F.col("n_all") > 0, F.col("price"))).alias("historical_min"),
        F.sum("n_all").alias("observations_total"),
        F.min(F.when(F.col("price") == F.col("quoted"), F.col("since"))).alias("since"),
    ).where("observations_total > 0 or current_price is not null")
    return stats.withColumn("days_at_current_price", _days(as_of, F.col("since"))).drop("since")


def previous_historical_min(observations: DataFrame, current_runs: DataFrame) -> DataFrame:
    """Floor per product before the current runs, quality-excluded listings aside."""
    earlier = outside_runs(observations.where(~F.col("excluded_from_comparison")), current_runs)
    return earlier.groupBy("master_id").agg(F.min("price").alias("previous_historical_min"))


def previous_prices(obs: DataFrame, current_runs: DataFrame) -> DataFrame:
    """Latest price per listing before the current runs."""
    return outside_runs(obs, current_runs).groupBy("listing_id").agg(
        F.max_by("price", F.struct("observed_at", "obs_id")).alias("previous_price")
    )


def latest_two_drop(quote_obs: DataFrame, as_of: Column, audiences, days: int = 90) -> DataFrame:
    """Listings whose last member price is below the one before."""
    newest = Window.partitionBy("listing_id").orderBy(F.desc("observed_at"), F.desc("obs_id"))
    recent = quote_obs.where(
        (F.col("price_type") == "MEMBER") & F.col("audience_key").isin(*audiences)
        & (F.col("price") > 0) & _since(as_of, days)
    )
    # The rank filter limits every group on the map side, before the shuffle.
    last_two = recent.withColumn("rank", F.row_number().over(newest)).where("rank <= 2")
    pairs = last_two.groupBy("listing_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("price"))).alias("current_price"),
        F.max(F.when(F.col("rank") == 2, F.col("price"))).alias("previous_price"),
        F.max(F.when(F.col("rank") == 1, F.col("audience_key"))).alias("audience_key"),
    )
    saving = F.col("previous_price") - F.col("current_price")
    return pairs.where("current_price < previous_price").withColumns(
        {"saving": saving, "drop_pct": saving / F.col("previous_price")}
    )


def price_rarity(observations: DataFrame, current: DataFrame, minimum_observations: int = 6) -> DataFrame:
    """Share of a product's observations at or below its current price, and 1 - share."""
    joined = current.join(observations.select("master_id", "price"), "master_id", "left")
    grouped = joined.groupBy("master_id").agg(
        F.count("price").alias("observations"),
        _count_when(F.col("price") <= F.col("current_best_price")).alias("at_or_below"),
    )
    frequency = F.col("at_or_below") / F.nullif(F.col("observations"), F.lit(0))
    return grouped.withColumn("frequency", frequency).withColumn(
        "rarity",
        F.when(F.col("observations") < max(1, minimum_observations), 0.0)
        .otherwise(F.bround(1.0 - F.col("frequency"), 4)),
    )


def rolling_price_stats(obs: DataFrame, days: int = 30) -> DataFrame:
    """Minimum and count per observation over the preceding days of its listing."""
    frame = (
        Window.partitionBy("listing_id").orderBy(F.unix_micros("observed_at"))
        .rangeBetween(-days * 86_400_000_000, 0)
    )
    return obs.select(
        "obs_id", "listing_id", F.min("price").over(frame).alias("rolling_min"),
        F.count("*").over(frame).alias("rolling_count"),
    )


def price_history_view(stats: DataFrame, offers: DataFrame) -> DataFrame:
    """Current price against the 30 and 90 day statistics of a product."""
    price = F.col("price")

    def gap(column: str) -> Column:
        return F.when(F.col(column) > 0, (price - F.col(column)) / F.col(column))

    return offers.join(stats, "master_id").select(
        "master_id", "price", "min_30d", "avg_30d", "min_90d", "avg_90d", "historical_min",
        "days_at_current_price",
        *[gap(c).alias(f"vs_{c}") for c in ("min_30d", "avg_30d", "min_90d", "avg_90d", "historical_min")],
    )
