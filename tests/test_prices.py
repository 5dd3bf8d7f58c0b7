from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pricetide.functions import money as M
from pricetide.functions import scoring as K
from pricetide.operators import comparison as C
from pricetide.operators import history as H
from pricetide.operators import personal as R
from pricetide.operators import quality as Q

NOW = datetime(2024, 6, 1)
STORES = "store_id int, name string, is_active boolean, comparison_enabled boolean, personal_comparison_enabled boolean"
LISTINGS = ("listing_id bigint, store_id int, master_id bigint, name string, url string, current_price bigint, regular_price bigint, discount_pct double, ean string, "
            "package_quantity int, excluded_from_comparison boolean, is_available boolean, last_seen_at timestamp")
OBS = "obs_id bigint, listing_id bigint, run_id bigint, price bigint, discount_pct double, observed_at timestamp"
QUOTES = "listing_id bigint, price bigint, regular_price bigint, price_type string, audience_key string, eligibility_required boolean, is_active boolean"


def listing(i, store, master, name, price, ean=None, pack=1):
    return (i, store, master, name, f"https://x/{i}", price, None, 0.0, ean, pack, False, True, NOW)


def obs(days, prices, listing_id=1, run=1):
    return [(100 * listing_id + n, listing_id, run, p, 0.0, NOW - timedelta(days=d)) for n, (d, p) in enumerate(zip(days, prices))]


def shops(spark, *rows):
    return spark.createDataFrame(list(rows) or [(1, "A", True, True, False), (2, "B", True, True, False)], STORES)


def stats(spark, listings, observations, stores=None, quotes=()):
    return H.master_price_stats(
        spark.createDataFrame(observations, OBS), spark.createDataFrame(listings, LISTINGS), stores or shops(spark), spark.createDataFrame(list(quotes), QUOTES), F.lit(NOW))


def test_history(spark):
    row = stats(spark, [listing(1, 1, 1, "Gin 700 ml", 8000)], obs([80, 20, 1, 120], [10000, 9000, 8000, 7000])).first()
    assert (row["min_30d"], row["avg_30d"], row["min_90d"], row["historical_min"], row["current_best_price"]) == (8000, 8500.0, 8000, 7000, 8000)
    assert row["median_90d"] == 9000.0 and row["observations_total"] == 4 and row["days_at_current_price"] == 1


def test_floor_frequency(spark):
    row = stats(spark, [listing(1, 1, 1, "Gin 700 ml", 10000)], obs([1, 2, 3, 4], [10000, 10400, 12000, 13000])).first()
    assert row["min_90d"] == 10000 and row["low_price_frequency_90d"] == 0.5


def test_pack_and_member_prices_stay_out(spark):
    rows = [listing(1, 1, 1, "Gin 700 ml", 9000), listing(2, 2, 1, "Gin 700 ml x6", 1000, pack=6), listing(3, 3, 1, "Gin 700 ml", 500)]
    stores = shops(spark, (1, "A", True, True, False), (2, "B", True, True, False), (3, "C", True, True, True))
    quotes = [(3, 500, None, "MEMBER", "cav_member", True, True)]
    row = stats(spark, rows, obs([1], [9000]) + obs([1], [1000], 2) + obs([1], [500], 3), stores, quotes).first()
    assert row["historical_min"] == 9000 and row["current_best_price"] == 9000


def compare(spark, listings, observations, matches, run=2):
    masters = spark.createDataFrame([(1, "Gin Norte Azul 700 ml", 700, 1)], "master_id bigint, canonical_name string, volume_ml int, package_quantity int")
    ls, ob, none = spark.createDataFrame(listings, LISTINGS), spark.createDataFrame(observations, OBS), spark.createDataFrame([], QUOTES)
    st = H.master_price_stats(ob, ls, shops(spark), none, F.lit(NOW))
    runs = spark.createDataFrame([(run, 1)], "run_id bigint, store_id int")
    return C.PriceComparison(ls, shops(spark), none, ob, spark.createDataFrame(matches, "listing_id bigint, master_id bigint, confidence double, matching_method string"), masters, st, runs, F.lit(NOW))


def test_new_historical_min(spark):
    rows = [listing(1, 1, 1, "Gin Norte Azul 700 ml", 8000), listing(2, 2, 1, "Gin Norte Azul 70 cl", 10000)]
    seen = obs([3], [9000], 1, 1) + obs([3], [11000], 2, 1) + [(901, 1, 2, 8000, 0.0, NOW), (902, 2, 2, 10000, 0.0, NOW)]
    matches = [(1, 1, 1.0, "manual_equivalence"), (2, 1, 1.0, "manual_equivalence")]
    row = compare(spark, rows, seen, matches).result.first()
    assert row["price_event"] == "NEW_HISTORICAL_MIN" and row["previous_historical_min"] == 9000 and row["historical_gap"] == 1000
    assert row["winner_price"] == 8000 and row["saving"] == 2000 and row["winner_previous_price"] == 9000
    assert row["intelligence_reason"].startswith("nuevo mínimo histórico: $8.000 queda $1.000 (11.1%)")


@pytest.mark.parametrize("ean,verified", [(None, 0), ("780", 1)])
def test_economic_guard(spark, ean, verified):
    rows = [listing(1, 1, 1, "Gin Norte Azul 700 ml", 6990, ean), listing(2, 2, 1, "Gin Norte Azul 70 cl", 39990, ean)]
    seen = [(901, 1, 2, 6990, 0.0, NOW), (902, 2, 2, 39990, 0.0, NOW)]
    got = compare(spark, rows, seen, [])
    assert got.result.count() == verified
    assert got.summary().first()["unverified_groups"] == 1 - verified


def test_tie_has_no_winner(spark):
    rows = [listing(1, 1, 1, "Gin Norte Azul 700 ml", 9000), listing(2, 2, 1, "Gin Norte Azul 70 cl", 9000)]
    seen = [(901, 1, 2, 9000, 0.0, NOW), (902, 2, 2, 9000, 0.0, NOW)]
    row = compare(spark, rows, seen, []).result.first()
    assert row["is_tie"] and row["winner_listing_id"] is None and row["score"] == 0.0


def test_personal(spark):
    stores = shops(spark, (1, "A", True, True, False), (3, "C", True, True, True))
    ls = spark.createDataFrame([listing(1, 1, 1, "Gin 700 ml", 24000), listing(3, 3, 1, "Gin 700 ml", 26000)], LISTINGS)
    quotes = spark.createDataFrame([(1, 24000, None, "PUBLIC", "public", False, True), (3, 26000, None, "PUBLIC", "public", False, True), (3, 21000, 26000, "MEMBER", "cav_member", True, True)], QUOTES)
    none = spark.createDataFrame([], "listing_id bigint, master_id bigint, confidence double, matching_method string")
    context = spark.createDataFrame([], "listing_id bigint, price_type string, audience_key string, avg_90d double, min_90d bigint")
    row = R.personal_opportunities(ls, stores, quotes, none, context, F.lit(NOW)).first()
    assert (row["winner_price"], row["winner_price_type"], row["public_reference_price"], row["personal_advantage"], row["personal_advantage_pct"]) == (21000, "MEMBER", 24000, 3000, 0.125)


def test_scores(spark):
    one = F.lit(1.0)
    row = spark.range(1).select(
        K.opportunity_score_v1(market_saving=one, history_position=one, match_confidence=one, freshness=one, scarcity=one).alias("v1"),
        K.opportunity_score_v2(market_saving=one, history_position=one, rarity=one, match_confidence=one, freshness=one, scarcity=one).alias("v2"),
        *[K.classify_opportunity(F.lit(s)).alias(f"c{int(s)}") for s in (100.0, 84.9, 72.0)]).first()
    assert tuple(row) == (100.0, 100.0, "Excelente", "Muy buena", "Buena")


def test_quality(spark):
    rows = [(1, "Null", "https://x/1", 2600, 9990, 0.74, None), (2, "Vino 750 ml", "https://x/2", 2990, 39990, 0.92, 29990), (3, "Vino 750 ml", "https://x/3", 5000, None, 0.0, 5000)]
    df = spark.createDataFrame(rows, "listing_id bigint, name string, url string, current_price bigint, regular_price bigint, discount_pct double, previous_price bigint")
    got = {r["listing_id"]: (r["data_quality_status"], r["data_quality_issues"]) for r in Q.assess_quality(df).collect()}
    assert got[1][0] == "BLOCKED" and "invalid_name" in got[1][1]
    assert got[2][0] == "BLOCKED" and "extreme_price_jump" in got[2][1]
    assert got[3] == ("CLEAN", [])


def test_availability_needs_two_healthy_misses(spark):
    rows = [(1, seq, seen, healthy) for seq, seen, healthy in ((1, True, True), (2, False, True), (3, False, False), (4, False, True), (5, True, True))]
    got = Q.replay_availability(spark.createDataFrame(rows, "listing_id bigint, run_seq int, observed boolean, is_healthy boolean")).orderBy("run_seq").collect()
    assert [r["is_available"] for r in got] == [True, True, True, False, True]
    assert [r["missing_streak"] for r in got] == [0, 1, 1, 2, 0]


def test_percentages_round_as_printed_floats(spark):
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 12.35, 12.25, 12.5, 13.5, 14.499999999999998, 0.5, 99.95, 1.45, 2.675] + [i / 40 * 100 for i in range(41)] + [i / 800 * 100 for i in range(0, 801, 7)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", M.fixed_text(F.col("v")).alias("tenths"), M.fixed_text(F.col("v"), 0).alias("whole")).collect()
    assert [(r["tenths"], r["whole"]) for r in rows] == [(f"{r['v']:.1f}", f"{r['v']:.0f}") for r in rows]
    row = spark.range(1).select(K.commercial_signal(*(F.lit(v) for v in (479, 479, 400, 16, 0.125, 0.9, 0.5)))["intelligence_reason"].alias("r")).first()
    assert "sólo 12% de 16" in row["r"]
