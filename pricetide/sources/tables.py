"""Reading the tables, always with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Schemas of the driver's tables.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# Schemas of the domain tables.
DOMAIN_SCHEMAS = {
    "stores": "store_id int, name string, connector_key string, is_active boolean, "
              "comparison_enabled boolean, personal_comparison_enabled boolean, diagnostic_mode boolean",
    "masters": "master_id bigint, canonical_name string, normalized_key string, brand string, "
               "variant string, volume_ml int, package_quantity int, canonical_fingerprint string, "
               "abv_pct double, vintage_year int, ean string, identity_confidence double, "
               "aliases array<string>, search_text string, status string",
    "listings": "listing_id bigint, store_id int, master_id bigint, name string, url string, "
                "current_price bigint, regular_price bigint, discount_pct double, sku string, "
                "ean string, abv_pct double, vintage_year int, package_quantity int, "
                "data_quality_score int, data_quality_status string, data_quality_issues array<string>, "
                "excluded_from_comparison boolean, is_available boolean, missing_streak int, "
                "last_available_at timestamp, unavailable_since timestamp, reactivated_at timestamp, "
                "last_confirmed_run_id bigint, first_seen_at timestamp, last_seen_at timestamp",
    "matches": "listing_id bigint, master_id bigint, confidence double, matching_method string, "
               "review_status string, evidence string",
    "runs": "run_id bigint, store_id int, status string, started_at timestamp, finished_at timestamp, "
            "duration_ms bigint, products_found int, products_created int, products_updated int, "
            "price_changes int, health_status string, health_score int, error_message string, source string",
    "price_observations": "obs_id bigint, listing_id bigint, run_id bigint, price bigint, "
                          "regular_price bigint, discount_pct double, observed_at timestamp",
    "price_quotes": "listing_id bigint, price bigint, regular_price bigint, price_type string, "
                    "audience_key string, eligibility_required boolean, is_active boolean, observed_at timestamp",
    "quote_observations": "obs_id bigint, listing_id bigint, run_id bigint, price bigint, "
                          "regular_price bigint, price_type string, audience_key string, "
                          "eligibility_required boolean, observed_at timestamp",
    "aliases": "master_id bigint, alias_text string, alias_key string, source string, is_confirmed boolean",
    "match_rules": "rule_type string, left_key string, right_key string, is_active boolean, notes string",
    "match_reviews": "left_id bigint, right_id bigint, confidence double, proposed_method string, "
                     "reason string, status string",
    "quality_events": "listing_id bigint, run_id bigint, score int, status string, "
                      "issues array<string>, observed_at timestamp",
    "alerts": "deduplication_key string, alert_type string, store_id int, status string, price bigint, "
              "payload_hash string, created_at timestamp, sent_at timestamp",
    "favorites": "favorite_id bigint, watcher_id bigint, master_id bigint, target_price bigint, "
                 "last_best_price bigint, last_winner_store string, last_store_names array<string>, "
                 "was_available boolean, last_evaluated_at timestamp, is_active boolean",
    "raw_payloads": "store string, url string, kind string, body string, fetched_at timestamp",
}

SCHEMAS = {**TABLE_SCHEMAS, **DOMAIN_SCHEMAS}


def read_table(spark: SparkSession, folder: str, name: str, fmt: str = "parquet", **options) -> DataFrame:
    """One table; ``fmt`` may be any Spark source, ``jdbc`` takes the table name from ``name``."""
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(dbtable=name, **options).load()
    path = f"{folder.rstrip('/')}/{name}.{fmt}"
    return spark.read.format(fmt).options(**options).schema(SCHEMAS[name]).load(path)


def read_tables(spark: SparkSession, folder: str, names=tuple(TABLE_SCHEMAS)) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name) for name in names}
