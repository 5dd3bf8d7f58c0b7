"""Domain tables derived from the driver's star schema.

Each view is one SQL text in the dialect Spark and DuckDB share, so a query and
its oracle start from the same rows. Views cover the whole source tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-02 00:00:00"


def _name_sql(key: str) -> str:
    """A shop's spelling of a part: the shops agree on the product, not on the text."""
    brand = (
        f"case when {key} % 10 = 7 then case sid when 1 then 'JW' when 2 then 'Johnnie Walker' "
        "else 'Johnny Walker' end else replace(p_brand, '#', '') end"
    )
    return f"""concat(
      case sid when 2 then 'Whisky ' when 5 then 'Botella ' else '' end,
      case when sid = 2 then upper({brand}) else {brand} end, ' ',
      case when sid = 5 and {key} % 3 = 0
           then concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1)) else p_name end,
      ' k', cast({key} % 1000 as string),
      case when sid = 3 and {key} % 6 = 3 then ' zz'
           else concat(' m', cast(cast(floor({key} / 1000) as bigint) as string)) end,
      case when {key} % 4 = 1 then case when sid = 5 and {key} % 8 = 1 then ' Reserva 2020'
           else ' Reserva 2019' end else '' end,
      case when sid = 5 and {key} % 9 = 0 then ' Edición' else '' end,
      case when {key} % 5 = 0 then case when sid = 4 and {key} % 15 = 0 then ' 47°'
           when sid = 2 then ' 40%' else ' 40° alc.' end else '' end,
      case when sid = 1 and {key} % 23 = 0 then ''
           when sid = 2 then concat(' ', cast(20 + p_size as string), ' cl')
           when sid = 3 then concat(' ', cast(200 + p_size * 10 as string), 'cc')
           else concat(' ', cast(200 + p_size * 10 as string), ' ml') end,
      case when sid = 4 and {key} % 7 = 0 then ' X6'
           when sid = 3 and {key} % 31 = 0 then ' pack de 4'
           when sid = 1 and {key} % 37 = 0 then ' + copa' else '' end,
      case when sid = 4 then ' Oferta $9.990 -10%' else '' end)"""


def _url_sql(key: str) -> str:
    return (
        f"concat('https://shop', cast(sid as string), '.example.com/product/', "
        f"replace(p_name, ' ', '-'), '-k', cast({key} as string), "
        "case when sid = 3 then '/?utm=x#top' else '/' end)"
    )


VIEWS: dict[str, str] = {
    # One row per price observation; five event types stand for five shops.
    "v_obs": """
      select event_id as obs_id, user_id * 10 + sid as listing_id, user_id as master_id,
        sid as store_id,
        case when event_id % 97 = 0 then null else sid * 1000 + day(ts) end as run_id,
        price, case when k >= 50 then price + k * 10 else null end as regular_price,
        case when k >= 50 then k / 1000.0e0 else 0.0e0 end as discount_pct,
        ts as observed_at,
        case event_id % 4 when 0 then 'PUBLIC' when 1 then 'SALE' when 2 then 'MEMBER' else 'COUPON' end as price_type,
        case event_id % 4 when 0 then 'public' when 1 then 'public_offer' when 2 then 'cav_member' else 'club' end as audience_key,
        event_id % 4 >= 2 as eligibility_required
      from (select event_id, user_id, ts,
              case event_type when 'view' then 1 when 'click' then 2 when 'error' then 3
                when 'signup' then 4 else 5 end as sid,
              cast(round(value * 100) as bigint) as price,
              cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k
            from events) e""",
    "v_stores": """
      select cast(r_regionkey + 1 as int) as store_id, concat('Shop ', r_name) as name,
        lower(r_name) as connector_key, r_regionkey >= 0 as is_active,
        r_regionkey <> 3 as comparison_enabled,
        r_regionkey in (2, 3) as personal_comparison_enabled,
        r_regionkey < 0 as diagnostic_mode
      from region""",
    "v_last": """
      select * from (select o.*, row_number() over (partition by listing_id
          order by observed_at desc, obs_id desc) as rn,
          min(observed_at) over (partition by listing_id) as first_seen_at from v_obs o) x
      where rn = 1""",
    "v_listings": f"""
      select listing_id, store_id, master_id, {_name_sql('master_id')} as name,
        {_url_sql('master_id')} as url, price as current_price, regular_price, discount_pct,
        concat('SKU-', cast(master_id % 500 as string)) as sku,
        case when master_id % 3 = 0 then concat('78', cast(1000000 + master_id as string)) else null end as ean,
        case when sid = 4 and master_id % 7 = 0 then 6 when sid = 3 and master_id % 31 = 0 then 4
          when sid = 1 and master_id % 37 = 0 then 2 else 1 end as package_quantity,
        case when listing_id % 19 = 0 then 40 when listing_id % 7 = 0 then 75 else 100 end as data_quality_score,
        case when listing_id % 19 = 0 then 'BLOCKED' when listing_id % 7 = 0 then 'WARNING'
          when listing_id % 5 = 0 then null else 'CLEAN' end as data_quality_status,
        listing_id % 19 = 0 as excluded_from_comparison, listing_id % 13 <> 0 as is_available,
        case when listing_id % 13 = 0 then 3 else cast(listing_id % 2 as int) end as missing_streak,
        run_id as last_confirmed_run_id, first_seen_at, observed_at as last_seen_at
      from (select l.*, store_id as sid, p_name, p_brand, p_size
            from v_last l join part on p_partkey = master_id) j""",
    "v_masters": """
      select user_id as master_id, concat('Master ', cast(user_id as string), ' 750 ml') as canonical_name,
        concat('master ', cast(user_id as string), '|750') as normalized_key,
        concat('brand', cast(user_id % 25 as string)) as brand, 750 as volume_ml,
        case when user_id % 41 = 0 then 6 else 1 end as package_quantity,
        case when user_id % 50 = 49 then 'merged' else 'active' end as status
      from (select distinct user_id from events) u""",
    "v_matches": """
      select listing_id, master_id, 0.9e0 + (listing_id % 10) / 100.0e0 as confidence,
        case listing_id % 3 when 0 then 'ean_exact' when 1 then 'manual_equivalence'
          else 'sku_secondary_verified' end as matching_method
      from (select distinct listing_id, master_id from v_obs) d where listing_id % 29 <> 0""",
    "v_quotes": """
      select listing_id, price, regular_price, price_type, audience_key, eligibility_required,
        obs_id % 10 <> 9 as is_active, observed_at
      from (select o.*, row_number() over (partition by listing_id, price_type, audience_key
          order by observed_at desc, obs_id desc) as rn from v_obs o) x where rn = 1""",
    # Listing texts of the whole catalog, one per part and shop (five shops).
    "v_names": f"""
      select l_partkey * 10 + sid as listing_id, sid as store_id, l_partkey as part_id,
        {_name_sql('l_partkey')} as name, {_url_sql('l_partkey')} as url,
        p_type as product_type, price, regular_price
      from (select l_partkey, cast(l_suppkey % 5 + 1 as int) as sid,
              cast(round(min(l_extendedprice)) as bigint) as price,
              cast(round(max(l_extendedprice)) as bigint) as regular_price
            from lineitem group by 1, 2) s
      join part on p_partkey = l_partkey""",
    "v_catalog": """
      select listing_id, store_id, part_id * 2 + case when store_id > 3 then 1 else 0 end as master_id,
        name, url, price as current_price, regular_price,
        case when regular_price > price then (regular_price - price) / cast(regular_price as double) else 0.0e0 end as discount_pct,
        case when part_id % 4 = 2 then concat('A-', cast(part_id as string)) else null end as sku,
        case when part_id % 6 = 0 then concat(' 78', cast(1000000 + part_id as string)) else null end as ean,
        100 - cast(listing_id % 4 as int) * 10 as data_quality_score,
        1 as package_quantity, listing_id % 43 = 0 as excluded_from_comparison,
        cast(null as double) as abv_pct, cast(null as int) as vintage_year
      from v_names""",
    # Collection runs, one per order.
    "v_runs": """
      select o_orderkey as run_id, cast(o_custkey % 5 + 1 as int) as store_id,
        case when o_orderstatus = 'P' then 'failed' else 'success' end as status,
        case when o_orderstatus = 'P' then 'BROKEN' when o_orderpriority = '1-URGENT' then 'DEGRADED'
          when o_orderpriority = '5-LOW' then 'STALE' else 'HEALTHY' end as health_status,
        cast(floor(o_totalprice / 1000) as int) as products_found,
        cast(floor(o_totalprice * 4) as bigint) as duration_ms,
        o_orderdate as started_at,
        case when o_orderkey % 31 = 0 then null else o_orderdate + interval '1' hour end as finished_at,
        case when o_orderstatus = 'P' and o_orderkey % 3 = 0 then 'HTTP 429 RateLimit'
          when o_orderstatus = 'P' then 'timeout' else null end as error_message,
        concat('src', cast(o_orderkey % 3 as string)) as source
      from orders""",
    # Watched products, ten watchers per product.
    "v_watch": """
      select c_custkey as favorite_id, c_custkey % 100 as watcher_id,
        cast(floor(c_custkey / 10) as bigint) as master_id,
        case when c_custkey % 3 = 0 then cast(floor(abs(c_acctbal)) as bigint) else null end as target_price,
        case when c_custkey % 5 = 0 then null else cast(floor(abs(c_acctbal) * 2) as bigint) end as last_best_price,
        case when c_custkey % 7 = 0 then null else concat('Shop ', case c_custkey % 3 when 0 then 'ASIA'
          when 1 then 'AFRICA' else 'AMERICA' end) end as last_winner_store,
        c_custkey % 4 <> 0 as was_available,
        case when c_custkey % 11 = 0 then null else timestamp '2024-01-29 00:00:00' end as last_evaluated_at,
        c_custkey % 13 <> 0 as is_active
      from customer""",
}

_WORD = re.compile(r"\b(v_[a-z_]+|" + "|".join(BASE_TABLES) + r")\b")


class Tables:
    """Lazily built DataFrames of one data folder: base tables and domain views."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            if name in VIEWS:
                self._built[name] = self.sql(VIEWS[name])
            elif name in BASE_TABLES:
                from pricetide.sources.tables import read_table

                self._built[name] = read_table(self.spark, self.folder, name)
            else:
                raise AttributeError(name)
        return self._built[name]

    def sql(self, text: str) -> DataFrame:
        used = sorted({m for m in _WORD.findall(text) if m in VIEWS or m in BASE_TABLES})
        marked = _WORD.sub(lambda m: "{" + m.group(1) + "}" if m.group(1) in used else m.group(1), text)
        return self.spark.sql(marked, **{name: getattr(self, name) for name in used})


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix oracle SQL with the views it uses, directly or through other views."""
    available = {**VIEWS, **(extra or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_[a-z_0-9]+\b", text):
            if name in available and name not in ordered:
                visit(available[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    ctes = [f"{name} as ({available[name]})" for name in ordered]
    stripped = body.strip()
    if not ctes:
        return stripped
    if stripped.lower().startswith("with "):
        return "with " + ",\n".join(ctes) + ",\n" + stripped[5:]
    return "with " + ",\n".join(ctes) + "\n" + stripped
