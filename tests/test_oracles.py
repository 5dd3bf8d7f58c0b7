"""A cross-section of the registered queries against DuckDB on the smallest tables.

``tools/check_oracle.py`` runs all of them.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import norm

NAMES = [
    "signature", "master_price_stats", "context_price_stats", "low_price_frequency", "latest_two_drop", "match_plan", "review_pairs", "augment_candidates", "price_comparison",
    "personal_opportunities", "commercial_radar", "refresh_canonical", "repair_pack_identity", "collection_health", "weekly_health", "dedup_listings_cheapest",
    "store_alerts", "evaluate_watchlist", "search_score", "extract_graphql_products", "extract_cards", "extract_json_ld", "stream_tumbling_price_stats", "stream_price_changes", "foreach_upsert",
]


@pytest.fixture(scope="module")
def duck(folder):
    db = duckdb.connect()
    for file in os.listdir(folder):
        db.execute(f"create view {file.split('.')[0]} as select * from '{folder}/{file}'")
    return db


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, folder, duck, name):
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    found = [d[0] for d in cursor.description]
    want = sorted(repr(tuple(norm(r[found.index(c)]) for c in sorted(found))) for r in cursor.fetchall())
    assert sorted(found) == columns
    assert got == want


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    corpus = [n for n in entry.queries() if n == "pipeline" or n.startswith("op") and n[2:3].isdigit()]
    assert bool(corpus) == entry.WITH_LLM


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_result_ignores_partitioning(spark, folder):
    from pricetide.plans import q_history as q
    from pricetide.plans.views import Tables

    from pricetide.operators.history import period_stats

    rows = q.pobs(Tables(spark, folder))
    a = period_stats(rows, q.as_of(), 14).orderBy("master_id").collect()
    b = period_stats(rows.repartition(13, "price"), q.as_of(), 14).orderBy("master_id").collect()
    assert a == b
