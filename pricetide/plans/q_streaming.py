"""Streaming jobs over the event table, each run to completion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pricetide.session import ensure_checkpoint_dir
from pricetide.streaming import jobs as S

from .q_runs import presence
from .registry import ORACLE_VIEWS, query
from .views import VIEWS


def folder(t, name):
    return f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def obs_stream(t):
    return t.spark.sql(VIEWS["v_obs"].replace("from events", "from {events}"), events=S.read_stream(t.spark, t.folder, "events"))


def done(t, job, name):
    base = folder(t, name)
    return S.run_available(job, f"{base}/out", f"{base}/checkpoint")


@query("stream_observations", "T1", "select obs_id, listing_id, price from v_obs")
def stream_observations(t):
    twice = obs_stream(t).unionByName(obs_stream(t))
    return done(t, S.stream_observations(twice), "observations").select("obs_id", "listing_id", "price")


_CLOSED = "(select max(ts) - interval 1 hour from events where round(value * 100) > 0)"


@query("stream_tumbling_price_stats", "T2", f"""select master_id, time_bucket(interval 1 day, observed_at) as window_start, min(price) as min_price, avg(price) as avg_price, count(*) as observations from v_obs where price > 0
  group by 1, 2 having time_bucket(interval 1 day, min(observed_at)) + interval 1 day <= {_CLOSED}""")
def stream_tumbling_price_stats(t):
    return done(t, S.stream_price_stats(obs_stream(t)), "tumbling").drop("window_end")


@query("stream_sliding_price_stats", "T2", f"""select master_id, s as window_start, min(price) as min_price, avg(price) as avg_price, count(*) as observations
  from (select v.*, time_bucket(interval 1 day, observed_at) - k * interval 1 day as s from v_obs v, (select unnest(range(0, 7)) as k) where price > 0) group by 1, 2 having s + interval 7 day <= {_CLOSED}""")
def stream_sliding_price_stats(t):
    return done(t, S.stream_price_stats(obs_stream(t), "7 days", "1 day"), "sliding").drop("window_end")


@query("stream_session_activity", "T3", """select store_id, min(observed_at) as session_start, count(*) as observations, min(price) as min_price from (
    select *, sum(case when observed_at - prev < interval 2 hour then 0 else 1 end) over (partition by store_id order by observed_at, obs_id) as sid from (select *, lag(observed_at) over (partition by store_id order by observed_at, obs_id) as prev from v_obs))
  group by store_id, sid having max(observed_at) + interval 2 hour <= (select max(ts) - interval 1 hour from events)""")
def stream_session_activity(t):
    return done(t, S.stream_session_activity(obs_stream(t)), "sessions").drop("session_end")


@query("stream_price_changes", "T4", """select obs_id, listing_id, previous_price, price from (select *, lag(price) over (partition by listing_id order by observed_at, obs_id) as previous_price from v_obs) where previous_price <> price""")
def stream_price_changes(t):
    return done(t, S.stream_price_changes(obs_stream(t)), "changes")


@query("stream_availability", "T5", """select listing_id, run_seq, count(*) filter (not observed and is_healthy) over (partition by listing_id, island order by run_seq) as missing_streak,
    count(*) filter (not observed and is_healthy) over (partition by listing_id, island order by run_seq) < 2 as is_available
  from (select *, count(*) filter (observed) over (partition by listing_id order by run_seq) as island from v_presence)""")
def stream_availability(t):
    landed = folder(t, "presence")
    table = presence(t)
    table.write.parquet(landed)
    return done(t, S.stream_availability(t.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", S.FILES_PER_BATCH).parquet(landed)), "availability")


@query("stream_silence", "T5", """with g as (select listing_id, observed_at, lag(observed_at) over w as before, lead(observed_at) over w as after from v_obs window w as (partition by listing_id order by observed_at))
  select listing_id, observed_at as changed_at, true as is_available from g where before is null or observed_at - before > interval 7 day
  union all select listing_id, observed_at + interval 7 day, false from g where after - observed_at > interval 7 day
    or (after is null and observed_at + interval 7 day < (select max(observed_at) - interval 1 hour from v_obs))""")
def stream_silence(t):
    return done(t, S.stream_silence(obs_stream(t)), "silence")


# Every offer of a watched product with the prices that its five shops have after it (0: not available).
_SHOPS = "Shop AFRICA", "Shop AMERICA", "Shop ASIA", "Shop EUROPE", "Shop MIDDLE EAST"
_SHOP_PRICES = ", ".join(f"last_value(case when store_id = {k} then case when obs_id % 11 <> 0 and price > 0 then price else 0 end end ignore nulls) over (w rows between unbounded preceding and current row) as p{k}" for k in range(1, 6))
ORACLE_VIEWS["v_watch_steps"] = f"""with steps as (select favorite_id, obs_id, observed_at, target_price, last_best_price, last_winner_store, was_available, last_evaluated_at,
      row_number() over w as step, {_SHOP_PRICES} from v_obs join v_watch using (master_id) where is_active window w as (partition by favorite_id order by observed_at, obs_id)),
    seen as (select *, least({", ".join(f"nullif(p{k}, 0)" for k in range(1, 6))}) as best, list_filter([{", ".join(f"case when p{k} > 0 then '{s}' end" for k, s in enumerate(_SHOPS, 1))}], lambda s: s is not null) as shops from steps),
    led as (select *, case {" ".join(f"when p{k} = best then '{s}'" for k, s in enumerate(_SHOPS, 1))} end as winner from seen)
  select *, coalesce(last_value(best ignore nulls) over (w rows between unbounded preceding and 1 preceding), last_best_price) as before_price,
    case when step = 1 then last_winner_store else lag(winner) over w end as before_winner, case when step = 1 then was_available else lag(best) over w is not null end as before_available,
    case when step = 1 then case when last_winner_store is null then [] else ['Shop ASIA'] end else lag(shops) over w end as before_shops
  from led window w as (partition by favorite_id order by step)"""
ORACLE_VIEWS["v_watch_told"] = """select favorite_id, obs_id as offer_id, best as best_price, winner as winner_store, concat_ws(',',
    case when favorite_id % 3 <> 1 and (step > 1 or last_evaluated_at is not null) and not before_available then 'back_in_stock' end,
    case when favorite_id % 4 <> 1 and before_price - best >= 1 then 'price_drop' end,
    case when best <= target_price and (before_price is null or before_price > target_price) then 'target_reached' end,
    case when favorite_id % 5 <> 1 and len(before_shops) > 0 and len(list_filter(shops, lambda s: not list_contains(before_shops, s))) > 0 then 'new_store' end,
    case when favorite_id % 7 <> 1 and winner <> before_winner then 'winner_change' end) as events from v_watch_steps where best is not null"""


@query("stream_watchlist", "T6", "select favorite_id, offer_id, events, best_price, winner_store from v_watch_told where events <> ''")
def stream_watchlist(t):
    favorite = F.col("favorite_id")
    flags = {"notify_back_in_stock": favorite % 3 != 1, "notify_price_drop": favorite % 4 != 1, "notify_new_store": favorite % 5 != 1, "notify_winner_change": favorite % 7 != 1}
    known = F.when(F.col("last_winner_store").isNotNull(), F.array(F.lit("Shop ASIA"))).otherwise(F.array().cast("array<string>"))
    offers = obs_stream(t).join(t.v_stores.select("store_id", F.col("name").alias("store_name")), "store_id").withColumnRenamed("obs_id", "offer_id").withColumn("is_available", F.col("offer_id") % 11 != 0)
    return done(t, S.stream_watchlist(offers, t.v_watch.withColumn("last_store_names", known).withColumns(flags)), "watchlist")


@query("stream_alert_dedup", "T7", "select distinct concat('a:', master_id, ':', price) as deduplication_key from v_obs")
def stream_alert_dedup(t):
    alerts = obs_stream(t).select(F.concat_ws(":", F.lit("a"), "master_id", "price").alias("deduplication_key"), F.col("observed_at").alias("created_at"))
    return done(t, S.stream_alert_dedup(alerts), "alerts").select("deduplication_key")


@query("stream_running_min", "T8", """select obs_id, master_id, previous_min, price from (select *, min(price) over (partition by master_id order by observed_at, obs_id rows between unbounded preceding and 1 preceding) as previous_min
  from v_obs where price > 0) where price < previous_min""")
def stream_running_min(t):
    return done(t, S.stream_running_min(obs_stream(t)), "minimum")


@query("stream_interval_join", "T9", """select c.obs_id, e.obs_id as previous_obs_id, c.price, e.price as previous_price from v_obs c join v_obs e on c.listing_id = e.listing_id and c.observed_at > e.observed_at
  and c.observed_at <= e.observed_at + interval 6 hour""")
def stream_interval_join(t):
    return done(t, S.stream_interval_join(obs_stream(t), obs_stream(t), "6 hours"), "interval")


@query("foreach_upsert", "T10", "select listing_id, obs_id, price from v_last")
def foreach_upsert(t):
    landed, base = folder(t, "landed"), folder(t, "upsert")
    rows = t.v_obs.select("listing_id", "obs_id", "price", "observed_at")
    rows.repartition(4, "obs_id").write.parquet(landed)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    return S.foreach_upsert(stream, f"{base}/out", f"{base}/checkpoint", ["listing_id"], ["observed_at", "obs_id"]).drop("observed_at")
