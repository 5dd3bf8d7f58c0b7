"""Filters, joins and history statistics over the observation table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pricetide.functions import signature as S
from pricetide.operators import filters as P
from pricetide.operators import history as H
from pricetide.sources.tables import TABLE_SCHEMAS, read_tables as read_tables_of

from .registry import ORACLE_VIEWS, query
from .views import AS_OF


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def recent_runs(t, day=29):
    """Runs of the last days of the observation table."""
    return t.v_obs.where(f"run_id % 1000 >= {day}").select("run_id", "store_id").distinct()


ORACLE_VIEWS.update(
    v_public_quote="select * from v_quotes where is_active and not eligibility_required and price_type in ('PUBLIC','SALE') and price > 0",
    v_public="""select l.*, s.name as store_name, s.personal_comparison_enabled from v_listings l join v_stores s using (store_id)
      where s.is_active and s.comparison_enabled and (not s.personal_comparison_enabled
        or exists (select 1 from v_public_quote q where q.listing_id = l.listing_id))""",
    v_pobs="""select o.obs_id, o.run_id, o.price, o.discount_pct, o.observed_at, l.* exclude (discount_pct)
      from v_obs o join v_public l using (listing_id) where o.price > 0 and l.package_quantity = 1""",
    v_recent_runs="select distinct run_id, store_id from v_obs where run_id % 1000 >= 29",
    v_current_best="""select master_id, min(current_price) as current_best_price from v_public
      where package_quantity = 1 and is_available and not excluded_from_comparison and current_price > 0 group by 1""",
)


def pobs(t):
    return H.public_observations(t.v_obs, t.v_listings, t.v_stores, t.v_quotes)


@query("public_market_filter", "P1", "select listing_id, store_name from v_public")
def public_market_filter(t):
    return P.public_market(t.v_listings, t.v_stores, t.v_quotes).select("listing_id", "store_name")


@query("single_unit_filter", "P2", "select l.listing_id from v_listings l join v_sig_listings s using (listing_id) where package_quantity = 1 and not is_pack")
def single_unit_filter(t):
    return P.single_unit(S.with_signature(t.v_listings)).select("listing_id")


@query("comparable_filter", "P3", "select listing_id from v_listings where is_available and not excluded_from_comparison and current_price > 0")
def comparable_filter(t):
    return t.v_listings.where(P.comparable()).select("listing_id")


@query("fresh_filter", "P4", f"""select listing_id from v_listings join v_stores using (store_id)
  where is_active and (comparison_enabled or personal_comparison_enabled) and is_available and not excluded_from_comparison
    and current_price > 0 and last_seen_at >= timestamp '{AS_OF}' - interval 72 hour""")
def fresh_filter(t):
    return P.fresh(t.v_listings, t.v_stores, as_of(), 72, "personal").select("listing_id")


@query("quote_allowed", "P5", "select listing_id, price_type from v_quotes where is_active and price > 0 and (not eligibility_required or audience_key in ('cav_member'))")
def quote_allowed(t):
    return t.v_quotes.where(P.quote_allowed([" CAV_Member "])).select("listing_id", "price_type")


@query("context_store_filter", "P6", "select listing_id from v_listings join v_stores using (store_id) where is_active and (comparison_enabled or personal_comparison_enabled)")
def context_store_filter(t):
    return t.v_listings.join(P.context_stores(t.v_stores).select("store_id"), "store_id", "left_semi").select("listing_id")


@query("personal_only", "P7", "select listing_id from v_listings join v_stores using (store_id) where personal_comparison_enabled and not comparison_enabled")
def personal_only(t):
    return t.v_listings.join(P.personal_only(t.v_stores).select("store_id"), "store_id", "left_semi").select("listing_id")


@query("active_store_sync", "P8", """
  select s_suppkey as store_id, s_acctbal > 5000 as is_active, (s_acctbal > 5000) <> (s_nationkey % 2 = 0) as changed from supplier""")
def active_store_sync(t):
    stores = t.supplier.select(F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("connector_key"), (F.col("s_nationkey") % 2 == 0).alias("is_active"))
    registry = t.supplier.where("s_acctbal > 5000").select(F.col("s_name").alias("connector_key"))
    return P.synchronize_active_stores(stores, registry).select("store_id", "is_active", "changed")


@query("read_tables", "S1", "select l_orderkey, l_linenumber, l_extendedprice, l_shipdate from lineitem where l_shipdate >= timestamp '2000-01-01 00:00:00'")
def read_tables(t):
    return t.lineitem.where("l_shipdate >= timestamp '2000-01-01 00:00:00'").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")


_CELLS = " union all ".join(f"select '{name}' as table_name, count(*) as n_rows, {' + '.join(f'count({c.split()[0]})' for c in schema.split(', '))} as n_cells from {name}" for name, schema in TABLE_SCHEMAS.items())


@query("read_all_tables", "S1", _CELLS)
def read_all_tables(t):
    """Rows and filled cells of every table: all columns of all tables are read."""
    counts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), sum((F.count(c) for c in df.columns[1:]), F.count(df.columns[0])).alias("n_cells"))
              for name, df in read_tables_of(t.spark, t.folder).items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("listing_observation_store_join", "J1", "select obs_id, master_id, price, excluded_from_comparison from v_pobs")
def j1(t):
    joined = H.public_observations(t.v_obs.withColumn("run_id", F.col("obs_id")), t.v_listings, t.v_stores, t.v_quotes)
    return joined.select(F.col("run_id").alias("obs_id"), "master_id", "price", "excluded_from_comparison")


@query("listing_match_left_join", "J3", "select l.listing_id, coalesce(m.confidence, 1.0) as confidence, m.matching_method from v_listings l left join v_matches m using (listing_id)")
def j3(t):
    return t.v_listings.join(t.v_matches.drop("master_id"), "listing_id", "left").select(
        "listing_id", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "matching_method")


@query("observation_quote_join", "J4", """select o.listing_id, o.price_type, o.audience_key, min(o.observed_at) as since from v_obs o
  join v_quotes q on q.listing_id = o.listing_id and q.price_type = o.price_type and q.audience_key = o.audience_key and q.price = o.price
  where q.is_active group by all""")
def j4(t):
    keys = ["listing_id", "price_type", "audience_key", "price"]
    return t.v_obs.join(t.v_quotes.where("is_active").select(keys), keys).groupBy(keys[:3]).agg(F.min("observed_at").alias("since"))


@query("missing_from_run", "J6", """select r.run_id, count(*) as missing from v_recent_runs r join v_listings l using (store_id)
  where not exists (select 1 from v_obs o where o.run_id = r.run_id and o.listing_id = l.listing_id) group by 1""")
def j6(t):
    return P.missing_from_run(t.v_listings, t.v_obs, recent_runs(t)).groupBy("run_id").agg(F.count("*").alias("missing"))


@query("has_public_quote", "J7", "select listing_id, listing_id in (select listing_id from v_public_quote) as has_public_quote from v_listings")
def j7(t):
    return P.with_public_quote_flag(t.v_listings, t.v_quotes).select("listing_id", "has_public_quote")


@query("observed_in_runs", "J8", """select distinct l.listing_id from v_listings l join v_obs o using (listing_id) join v_recent_runs r on r.run_id = o.run_id
  where not l.excluded_from_comparison""")
def j8(t):
    return P.observed_in_runs(t.v_listings, t.v_obs, recent_runs(t)).select("listing_id")


_PREVIOUS = """select listing_id, price as previous_price from v_obs where run_id is null or run_id not in (select run_id from v_recent_runs)
  qualify row_number() over (partition by listing_id order by observed_at desc, obs_id desc) = 1"""
ORACLE_VIEWS["v_previous"] = _PREVIOUS


@query("previous_price", "J16 W4", "select * from v_previous")
def previous_price(t):
    return H.previous_prices(t.v_obs, recent_runs(t))


@query("period_stats", "A1", f"""select master_id, min(price) as min_period, avg(price) as avg_period, median(price) as median_period,
  count(*) as observations_period, avg(case when discount_pct > 0 then 1.0::double else 0.0 end) as discount_frequency
  from v_pobs where observed_at >= timestamp '{AS_OF}' - interval 14 day group by 1""")
def period_stats(t):
    return H.period_stats(pobs(t), as_of(), 14)


_LOW = f"""select master_id, avg(case when price <= floor_price * 1.05::double then 1.0::double else 0.0 end) as frequency from
  (select *, min(price) over (partition by master_id) as floor_price from v_pobs
   where observed_at >= timestamp '{AS_OF}' - interval 14 day and not excluded_from_comparison) group by 1"""


@query("low_price_frequency", "A2 J5", _LOW)
def low_price_frequency(t):
    return H.low_price_frequency(pobs(t), as_of(), 14)


@query("historical_min_total", "A3", "select master_id, min(price) as historical_min, count(*) as observations_total from v_pobs group by 1")
def historical_min_total(t):
    return H.historical_min_total(pobs(t))


@query("current_best_price", "A4", "select * from v_current_best")
def current_best_price(t):
    return H.current_best_price(t.v_listings, t.v_stores, t.v_quotes)


_DAYS = f"greatest(0, floor(epoch(timestamp '{AS_OF}' - since) / 86400))::int"


@query("days_at_current_price", "A5", f"""select master_id, {_DAYS} as days_at_current_price from
  (select master_id, min(observed_at) as since from v_pobs where is_available and price = current_price
   and observed_at >= timestamp '{AS_OF}' - interval 14 day group by 1)""")
def days_at_current_price(t):
    return H.days_at_current_price(pobs(t), as_of(), 14)


ORACLE_VIEWS["v_stats"] = f"""
  select coalesce(h.master_id, c.master_id) as master_id, current_best_price, min_30d, avg_30d, median_30d, min_90d, avg_90d, median_90d, historical_min,
    coalesce(n_30, 0) as observations_30d, coalesce(n_90, 0) as observations_90d, coalesce(total, 0) as observations_total,
    coalesce(disc, 0.0) as discount_frequency_90d, coalesce(low.frequency, 0.0) as low_price_frequency_90d,
    coalesce({_DAYS}, 0) as days_at_current_price
  from (select master_id, min(price) as historical_min, count(*) as total,
      min(price) filter (w7) as min_30d, avg(price) filter (w7) as avg_30d, median(price) filter (w7) as median_30d, count(*) filter (w7) as n_30,
      min(price) filter (w14) as min_90d, avg(price) filter (w14) as avg_90d, median(price) filter (w14) as median_90d, count(*) filter (w14) as n_90,
      avg(case when discount_pct > 0 then 1.0::double else 0.0 end) filter (w14) as disc,
      min(observed_at) filter (w14 and is_available and price = current_price) as since
    from (select *, observed_at >= timestamp '{AS_OF}' - interval 7 day as w7, observed_at >= timestamp '{AS_OF}' - interval 14 day as w14 from v_pobs)
    group by 1) h
  full join v_current_best c on c.master_id = h.master_id left join ({_LOW}) low on low.master_id = h.master_id"""


def master_stats(t):
    return H.master_price_stats(t.v_obs, t.v_listings, t.v_stores, t.v_quotes, as_of(), 7, 14)


@query("master_price_stats", "A6 U1", "select * from v_stats")
def master_price_stats(t):
    return master_stats(t)


@query("master_price_stats_lineitem", "A6", """
  select l_partkey as master_id, min(price) as min_90d, avg(price) as avg_90d, median(price) as median_90d, count(*) as observations_90d,
    avg(case when price <= floor_price * 1.05::double then 1.0::double else 0.0 end) as low_price_frequency_90d
  from (select l_partkey, cast(round(l_extendedprice * 100) as bigint) as price,
      min(cast(round(l_extendedprice * 100) as bigint)) over (partition by l_partkey) as floor_price
    from lineitem where l_shipdate >= timestamp '2001-08-02' - interval 730 day) group by 1""")
def master_price_stats_lineitem(t):
    """The statistics kernel on the largest table: part as product, supplier as shop."""
    obs = t.lineitem.select(
        F.col("l_partkey").alias("master_id"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price"),
        F.col("l_discount").alias("discount_pct"), F.col("l_shipdate").alias("observed_at"),
        F.lit(False).alias("excluded_from_comparison"))
    now = F.lit("2001-08-02").cast("timestamp")
    stats = H.period_stats(obs, now, 730)
    low = H.low_price_frequency(obs, now, 730).withColumnRenamed("frequency", "low_price_frequency_90d")
    return stats.join(low, "master_id").select(
        "master_id", F.col("min_period").alias("min_90d"), F.col("avg_period").alias("avg_90d"),
        F.col("median_period").alias("median_90d"), F.col("observations_period").alias("observations_90d"),
        "low_price_frequency_90d")


ORACLE_VIEWS["v_ctx"] = "select l.listing_id, l.is_available, l.excluded_from_comparison from v_listings l join v_stores s using (store_id) where s.is_active and (comparison_enabled or personal_comparison_enabled)"
ORACLE_VIEWS["v_context_stats"] = f"""
  with h as (select listing_id, price_type, audience_key, min(price) as historical_min, count(*) as total,
      min(price) filter (w7) as min_30d, avg(price) filter (w7) as avg_30d, count(*) filter (w7) as n_30,
      min(price) filter (w14) as min_90d, avg(price) filter (w14) as avg_90d, count(*) filter (w14) as n_90
    from (select o.*, observed_at >= timestamp '{AS_OF}' - interval 7 day as w7, observed_at >= timestamp '{AS_OF}' - interval 14 day as w14
      from v_obs o join v_ctx using (listing_id) where price > 0) group by all),
  c as (select q.listing_id, price_type, audience_key, price as current_price from v_quotes q join v_ctx x using (listing_id)
    where is_active and price > 0 and is_available and not excluded_from_comparison),
  s as (select o.listing_id, o.price_type, o.audience_key, min(o.observed_at) as since from v_obs o join v_quotes q using (listing_id, price_type, audience_key, price)
    join v_ctx x on x.listing_id = o.listing_id where q.is_active and x.is_available and not x.excluded_from_comparison
      and o.observed_at >= timestamp '{AS_OF}' - interval 14 day group by all)
  select listing_id, price_type, audience_key, current_price, min_30d, avg_30d, coalesce(n_30, 0) as observations_30d, min_90d, avg_90d,
    coalesce(n_90, 0) as observations_90d, historical_min, coalesce(total, 0) as observations_total, coalesce({_DAYS}, 0) as days_at_current_price
  from h full join c using (listing_id, price_type, audience_key) left join s using (listing_id, price_type, audience_key)"""


def context_stats(t):
    return H.context_price_stats(t.v_obs, t.v_listings, t.v_stores, t.v_quotes, as_of(), 7, 14)


@query("context_price_stats", "A7", "select * from v_context_stats")
def context_price_stats(t):
    return context_stats(t)


ORACLE_VIEWS["v_previous_min"] = """select master_id, min(price) as previous_historical_min from v_pobs
  where not excluded_from_comparison and (run_id is null or run_id not in (select run_id from v_recent_runs)) group by 1"""


@query("previous_historical_min", "A8", "select * from v_previous_min")
def previous_historical_min(t):
    return H.previous_historical_min(pobs(t), recent_runs(t))


@query("price_rarity", "A15", """select master_id, count(price) as observations, count(price) filter (price <= current_best_price) as at_or_below,
    count(price) filter (price <= current_best_price) / nullif(count(price), 0)::double as frequency,
    case when count(price) < 6 then 0.0 else round_even(1.0::double - count(price) filter (price <= current_best_price) / count(price)::double, 4) end as rarity
  from v_current_best c left join (select master_id, price from v_pobs where run_id is null or run_id not in (select run_id from v_recent_runs)) using (master_id) group by 1""")
def price_rarity(t):
    prior = P.outside_runs(pobs(t), recent_runs(t))
    return H.price_rarity(prior, H.current_best_price(t.v_listings, t.v_stores, t.v_quotes))


@query("latest_two_drop", "W6", f"""select listing_id, current_price, previous_price, audience_key, previous_price - current_price as saving,
    (previous_price - current_price) / previous_price::double as drop_pct
  from (select listing_id, price as current_price, audience_key, rn, lead(price) over (partition by listing_id order by rn) as previous_price
    from (select *, row_number() over (partition by listing_id order by observed_at desc, obs_id desc) as rn from v_obs
      where price_type = 'MEMBER' and audience_key = 'cav_member' and price > 0 and observed_at >= timestamp '{AS_OF}' - interval 14 day))
  where rn = 1 and current_price < previous_price""")
def latest_two_drop(t):
    return H.latest_two_drop(t.v_obs, as_of(), ["cav_member"], 14)


@query("rolling_price_stats", "A1", """select obs_id, listing_id, min(price) over w as rolling_min, count(*) over w as rolling_count from v_obs
  window w as (partition by listing_id order by observed_at range between interval 7 day preceding and current row)""")
def rolling_price_stats(t):
    return H.rolling_price_stats(t.v_obs, 7)


def _gap(c):
    return f"case when {c} > 0 then (price - {c}) / {c}::double end as vs_{c}"


@query("price_history_view", "Q5", f"""select master_id, price, min_30d, avg_30d, min_90d, avg_90d, historical_min, days_at_current_price,
  {', '.join(_gap(c) for c in ('min_30d', 'avg_30d', 'min_90d', 'avg_90d', 'historical_min'))}
  from (select *, current_best_price as price from v_stats) where price is not null""")
def price_history_view(t):
    stats = master_stats(t)
    offers = stats.where("current_best_price is not null").select("master_id", F.col("current_best_price").alias("price"))
    return H.price_history_view(stats, offers)
