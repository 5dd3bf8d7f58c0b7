"""Alerts, watchlists and search."""

from __future__ import annotations

from pyspark.sql import functions as F


from pricetide.operators import alerts as A
from pricetide.operators import personal as R
from pricetide.operators import search as E
from pricetide.operators import watchlist as N
from pricetide.operators.history import latest_two_drop
from pricetide.session import materialize

from . import duck_text as D
from .q_history import as_of, recent_runs
from .q_identity import search_catalog
from .q_prices import personal
from .q_runs import changes
from .registry import ORACLE_VIEWS, query
from .views import AS_OF


def run_changes(t):
    """Changes of the batch with the run they belong to."""
    return changes(t).withColumns({"run_id": F.col("store_id") * 1000 + 30, "listing_id": F.col("url"), "excluded_from_comparison": F.lit(False)})


def alert_runs(t):
    s = F.col("store_id")
    return t.v_stores.select(
        "store_id", (s * 1000 + 30).alias("run_id"), F.when(s == 2, "DEGRADED").otherwise("HEALTHY").alias("health_status"),
        F.when(s == 3, "BROKEN").otherwise("HEALTHY").alias("previous_health_status"), F.when(s == 2, 1).otherwise(0).alias("sections_failed"),
        F.lit(0).alias("structural_warnings"), F.array(F.lit("menu")).alias("problems"), F.when(s != 5, 100).alias("previous_product_count"))


def no_alerts(t):
    return t.spark.createDataFrame([], "store_id int, payload_hash string, sent_at timestamp")


def cycle_alerts(t):
    return A.store_alerts(run_changes(t), alert_runs(t), no_alerts(t), no_alerts(t), as_of())


_COUNTS = {
    "price_drop": "select store_id, least(count(*), 10) as items from v_changes where price_dropped and (abs(pct) >= 0.05 or -amount >= 1000) group by 1",
    "price_increase": "select store_id, least(count(*), 10) as items from v_changes where price_increased group by 1",
    "new_product": "select store_id, least(count(*), 10) as items from v_changes where is_new and store_id <> 5 group by 1",
    "collector_incident": "select 2 as store_id, 1 as items", "collector_recovery": "select 3 as store_id, 1 as items",
    "ranking_digest": "select store_id, least(count(*), 30) as items from v_changes group by 1",
}
_ALERTS = " union all ".join(f"select '{k}' as alert_type, * from ({v})" for k, v in _COUNTS.items())


@query("store_alerts", "N4", f"with a as ({_ALERTS}) select alert_type, store_id, items from a union all select 'smart_summary', store_id, count(*) from a group by store_id")
def store_alerts(t):
    return cycle_alerts(t).select("alert_type", "store_id", "items")


ORACLE_VIEWS["v_ranking"] = """select *, row_number() over (partition by store_id order by sig desc, greatest(drop_pct, rep_pct) desc, price_dropped desc, saving desc, current_price, lower(name), url) as position from v_rank qualify position <= 30"""


@query("ranking_fingerprint", "N6", """select store_id, count(*) as items, sha256('[' || string_agg('{"position":' || position || ',"url":"' || url || '","current_price":' || current_price || '}', ',' order by position) || ']') as fingerprint
  from v_ranking group by 1""")
def ranking_fingerprint(t):
    ranked = A.rank_best_prices(run_changes(t), 30)
    return ranked.groupBy("store_id").agg(F.count("*").alias("items"), A.payload_hash("position", "url", "current_price").alias("fingerprint"))


_LOG = f"""select obs_id, listing_id % 50 as store_id, concat('h', price % 3) as payload_hash, observed_at as sent_at from v_obs"""


@query("digest_due", "N5", f"""
  with last as (select store_id, arg_max(payload_hash, epoch_us(sent_at)::hugeint * 1000000000 + obs_id) as payload_hash, max(sent_at) as sent_at from ({_LOG}) where store_id % 5 <> 0 group by 1),
  cur as (select store_id, concat('h', min(obs_id) % 3) as fingerprint from ({_LOG}) group by 1)
  select store_id, case when l.store_id is null then 'first' when l.payload_hash <> fingerprint then 'changed' when timestamp '{AS_OF}' - sent_at >= interval 6 hour then 'interval' end as due_reason from cur left join last l using (store_id)""")
def digest_due(t):
    log = t.v_obs.select("obs_id", (F.col("listing_id") % 50).alias("store_id"), F.concat(F.lit("h"), (F.col("price") % 3).cast("string")).alias("payload_hash"),
                         F.col("observed_at").alias("sent_at"), F.lit("sent").alias("status"), F.lpad(F.col("obs_id").cast("string"), 20, "0").alias("deduplication_key"))
    current = log.groupBy("store_id").agg(F.concat(F.lit("h"), (F.min("obs_id") % 3).cast("string")).alias("fingerprint"))
    last = A.latest_sent_alert(log.where("store_id % 5 <> 0"), ("store_id",))
    return A.digest_due(current, last, as_of(), 6).select("store_id", "due_reason")


# Snapshots of every product as a finished comparison.
ORACLE_VIEWS["v_finished"] = """select *, false as is_tie, 7 as observations_90d, 0.1::double as rarity_frequency_90d, winner_price + 1 as winner_previous_price, saving % 2 = 0 as winner_changed from v_snapshots"""


def finished(t):
    from .q_prices import snapshots

    return snapshots(t).withColumns({
        "is_tie": F.lit(False), "observations_90d": F.lit(7), "rarity_frequency_90d": F.lit(0.1), "winner_previous_price": F.col("winner_price") + 1, "winner_changed": F.col("saving") % 2 == 0,
        "runner_store_id": F.lit(9), "runner_price": F.col("winner_price") + F.col("saving"), "confidence": F.lit(0.9), "previous_winner_store_id": F.lit(8)})


@query("commercial_alerts", "N7", """select master_id, concat('commercial:', case when price_event = 'NEW_HISTORICAL_MIN' then 'historical-min' else 'rare-offer' end, ':', master_id, ':', winner_price) as deduplication_key from v_finished
  where saving > 0 and (price_event = 'NEW_HISTORICAL_MIN' or (price_event = 'RARE_OFFER' and score >= 50)) order by price_event = 'NEW_HISTORICAL_MIN' desc, score desc, historical_gap_pct desc, saving_pct desc, master_id limit 8""")
def commercial_alerts(t):
    return A.commercial_alerts(finished(t), 50.0).select("master_id", "deduplication_key")


@query("comparison_fingerprint", "N6", """select count(*) as items, sha256('[' || string_agg('{"rank":' || rank || ',"master_id":' || master_id || ',"winner_store_id":' || winner_store_id || ',"winner_price":' || winner_price || ',"runner_store_id":9,"runner_price":' || (winner_price + saving) || ',"saving":' || saving || ',"confidence":0.9,"score":' || score::varchar || '}', ',' order by rank) || ']') as fingerprint
  from (select *, row_number() over (order by score desc, saving_pct desc, saving desc, master_id) as rank from v_finished where saving > 0 qualify rank <= 30)""")
def comparison_fingerprint(t):
    return A.comparison_fingerprint(finished(t), 30).select("items", "fingerprint")


@query("comparison_alerts", "N8", """select 'cross_store_winner_change' as alert_type, least(count(*), 10) as items, 'winner_change' as reason from v_finished where saving > 0 and winner_changed having count(*) > 0
  union all select 'cross_store_digest', least(count(*), 30), 'first' from v_finished where saving > 0""")
def comparison_alerts(t):
    last = t.spark.createDataFrame([], "alert_type string, payload_hash string, sent_at timestamp")
    return A.comparison_alerts(finished(t), last, as_of(), "1-2").select("alert_type", "items", "reason")


ORACLE_VIEWS["v_member_drops"] = f"""select listing_id, current_price, previous_price, previous_price - current_price as saving, (previous_price - current_price) / previous_price::double as drop_pct
  from (select listing_id, price as current_price, rn, lead(price) over (partition by listing_id order by rn) as previous_price from (select *, row_number() over (partition by listing_id order by observed_at desc, obs_id desc) as rn from v_obs
      where price_type = 'MEMBER' and audience_key = 'cav_member' and price > 0 and observed_at >= timestamp '{AS_OF}' - interval 90 day)) where rn = 1 and current_price < previous_price"""


@query("member_price_alerts", "N9", """select listing_id, d.current_price as price, saving from v_member_drops d join v_listings l using (listing_id) join v_stores s using (store_id) where s.is_active and s.personal_comparison_enabled and l.is_available
  and (drop_pct >= 0.05 or saving >= 1000) order by drop_pct desc, saving desc, lower(l.name), listing_id limit 10""")
def member_price_alerts(t):
    drops = latest_two_drop(t.v_obs, as_of(), ["cav_member"])
    return A.member_price_alerts(drops, t.v_listings, t.v_stores).select("listing_id", "price", "saving")


@query("member_advantages", "N9", """select p.master_id, personal_advantage from v_personal p join v_listings l on l.listing_id = p.winner_listing_id join v_stores s on s.store_id = p.winner_store_id where s.personal_comparison_enabled and l.is_available
  and winner_price_type = 'MEMBER' and personal_advantage >= 10 order by personal_advantage_pct desc, personal_advantage desc, p.master_id limit 10""")
def member_advantages(t):
    return A.member_advantages(personal(t), t.v_listings, t.v_stores, 10).select("master_id", "personal_advantage")


ORACLE_VIEWS["v_alert_log"] = f"""select concat('k', price) as deduplication_key, arg_max(case obs_id % 3 when 0 then 'sent' when 1 then 'pending' else 'failed' end, obs_id) as status, arg_max(case when obs_id % 2 = 0 then timestamp '{AS_OF}' - interval 10 minute else timestamp '{AS_OF}' - interval 2 hour end, obs_id) as created_at
  from v_obs where obs_id % 5 <> 0 group by 1"""


@query("dedup_alerts", "N10", f"""select distinct concat('k', price) as deduplication_key from v_obs o where not exists (select 1 from v_alert_log l where l.deduplication_key = concat('k', o.price)
  and (l.status = 'sent' or (l.status = 'pending' and timestamp '{AS_OF}' - l.created_at < interval 30 minute)))""")
def dedup_alerts(t):
    i, key = F.col("obs_id"), F.concat(F.lit("k"), F.col("price").cast("string")).alias("deduplication_key")
    age = F.when(i % 2 == 0, F.expr("interval 10 minute")).otherwise(F.expr("interval 2 hour"))
    status = F.when(i % 3 == 0, "sent").when(i % 3 == 1, "pending").otherwise("failed")
    log = t.v_obs.where("obs_id % 5 <> 0").select(key, "obs_id", status.alias("status"), (as_of() - age).alias("created_at")).groupBy("deduplication_key").agg(
        F.max_by(F.struct("status", "created_at"), "obs_id").alias("l")).select("deduplication_key", "l.*")
    return A.dedup_alerts(t.v_obs.select(key), log, as_of())


@query("failure_alerts", "N11", f"""select run_id, store_id from v_runs r where error_message is not null and not exists (select 1 from (select store_id, 'timeout' as e, timestamp '{AS_OF}' - store_id * interval 10 hour as sent_at from v_stores) s
  where s.store_id = r.store_id and s.e = r.error_message and timestamp '{AS_OF}' - s.sent_at < interval 24 hour)""")
def failure_alerts(t):
    last = t.v_stores.select("store_id", F.sha2(F.lit("timeout"), 256).alias("payload_hash"), (as_of() - F.make_dt_interval(hours=F.col("store_id") * 10)).alias("sent_at"))
    failures = t.v_runs.where("error_message is not null").select("store_id", "run_id", F.col("error_message").alias("error"))
    return A.failure_alerts(failures, last, as_of()).select("run_id", "store_id")


@query("personal_store_ranking", "N12", """select s.store_id, least(count(distinct q.listing_id), 30) as items from v_quotes q join v_listings s using (listing_id) where q.price_type = 'MEMBER' and audience_key = 'cav_member' and price > 0 and not excluded_from_comparison group by 1""")
def personal_store_ranking(t):
    from .q_prices import collected
    from pricetide.functions.money import change_columns

    rows = collected(t).withColumns({"previous_price": F.lit(1).cast("bigint"), "run_id": F.lit(1), "is_new": F.lit(False)})
    members = R.member_projection(rows)
    members = members.withColumns(change_columns(F.col("previous_price"), F.col("current_price")))
    return A.personal_store_ranking(members).select("store_id", "items")


ORACLE_VIEWS["v_watch_offers"] = """select l.master_id, s.name as store_name, min(l.current_price) as price from v_listings l join v_stores s using (store_id) where l.current_price > 0 and is_available and not excluded_from_comparison and s.is_active
  and listing_id in (select listing_id from v_obs where price > 0 and run_id in (select run_id from v_recent_runs)) group by 1, 2"""
ORACLE_VIEWS["v_snapshot"] = "select master_id, arg_min(price, (price::hugeint * 1000 + length(store_name))::hugeint) as best_price, list(store_name order by price, lower(store_name)) as store_names, list(store_name order by price, lower(store_name))[1] as winner_store from v_watch_offers group by 1"


def snapshot(t):
    seen = t.v_obs.join(recent_runs(t).select("run_id"), "run_id", "left_semi")
    return N.watchlist_snapshot(t.v_listings, t.v_stores, seen)


@query("watchlist_snapshot", "N2", "select master_id, best_price, winner_store, array_to_string(store_names, ',') as store_names from v_snapshot")
def watchlist_snapshot(t):
    return snapshot(t).withColumn("store_names", F.array_join("store_names", ","))


ORACLE_VIEWS["v_watch_events"] = """select favorite_id, watcher_id, master_id, list_filter([case when best_price is not null and last_evaluated_at is not null and not was_available then 'back_in_stock' end,
      case when last_best_price - best_price >= 1 then 'price_drop' end, case when best_price <= target_price and (last_best_price is null or last_best_price > target_price) then 'target_reached' end,
      case when len(list_filter(store_names, lambda x: x <> 'Shop ASIA')) > 0 and last_winner_store is not null then 'new_store' end, case when winner_store <> last_winner_store then 'winner_change' end], lambda x: x is not null) as events,
    coalesce(best_price, last_best_price) as last_best_price, winner_store as last_winner_store, best_price is not null as was_available
  from v_watch left join v_snapshot using (master_id) where is_active"""


def favorites(t):
    return t.v_watch.withColumn("last_store_names", F.when(F.col("last_winner_store").isNotNull(), F.array(F.lit("Shop ASIA"))).otherwise(F.array().cast("array<string>")))


@query("evaluate_watchlist", "N1", "select favorite_id, array_to_string(events, ',') as events, last_best_price, last_winner_store, was_available from v_watch_events")
def evaluate_watchlist(t):
    got = N.evaluate_watchlist(favorites(t), snapshot(t), as_of(), "1,2")
    return got.select("favorite_id", F.array_join("events", ",").alias("events"), "last_best_price", "last_winner_store", "was_available")


@query("upsert_watchlist", "N3", """select coalesce(o.watcher_id, n.watcher_id) as watcher_id, coalesce(o.master_id, n.master_id) as master_id, coalesce(n.target_price, o.target_price) as target_price,
    coalesce(n.best_price, o.last_best_price) as last_best_price, coalesce(n.winner_store, o.last_winner_store) as last_winner_store, n.master_id is not null or o.is_active as is_active, o.favorite_id is null as created
  from v_watch o full join (select c_custkey % 100 + 3 as watcher_id, c_custkey // 10 as master_id, case when c_custkey % 4 = 0 then 500 end as target_price, best_price, winner_store from customer left join v_snapshot on master_id = c_custkey // 10 where c_custkey % 2 = 0) n
    on n.watcher_id = o.watcher_id and n.master_id = o.master_id""")
def upsert_watchlist(t):
    asked = t.customer.where("c_custkey % 2 = 0").select((F.col("c_custkey") % 100 + 3).alias("watcher_id"), F.floor(F.col("c_custkey") / 10).alias("master_id"),
                                                        F.when(F.col("c_custkey") % 4 == 0, 500).cast("bigint").alias("target_price"))
    requests = asked.join(snapshot(t), "master_id", "left")
    return N.upsert_watchlist(favorites(t), requests, as_of()).select("watcher_id", "master_id", "target_price", "last_best_price", "last_winner_store", "is_active", "created")


@query("list_watchlist", "N3", """select favorite_id, canonical_name, target_price, best_price from v_watch w join v_masters using (master_id) left join v_snapshot using (master_id) where is_active and favorite_id % 17 <> 0""")
def list_watchlist(t):
    off = t.v_watch.where("favorite_id % 17 = 0").select("watcher_id", "favorite_id")
    return N.list_watchlist(N.deactivate(favorites(t), off), t.v_masters, snapshot(t)).select("favorite_id", "canonical_name", "target_price", "best_price")


# Every product is searched for by words of its own listings, some misspelt or cut.
ORACLE_VIEWS["v_asked"] = """select master_id as query_id, case master_id % 5 when 0 then min(name) when 1 then 'mastre ' || master_id when 2 then 'master ' || master_id || ' 750' when 3 then 'aster ' || (master_id % 10) else 'mastr ' || master_id || ' 75 cl' end as query from v_listings group by 1"""


def asked(t):
    m, text = F.col("master_id"), F.col("master_id").cast("string")
    query_text = (F.when(m % 5 == 0, F.col("n")).when(m % 5 == 1, F.concat(F.lit("mastre "), text)).when(m % 5 == 2, F.concat(F.lit("master "), text, F.lit(" 750")))
                  .when(m % 5 == 3, F.concat(F.lit("aster "), (m % 10).cast("string"))).otherwise(F.concat(F.lit("mastr "), text, F.lit(" 75 cl"))))
    return materialize(t.v_listings.groupBy("master_id").agg(F.min("name").alias("n")).select(F.col("master_id").alias("query_id"), query_text.alias("query")))


ORACLE_VIEWS["v_sig_asked"] = D.sig_view("v_asked", "query_id", "trim(query)")
_LEV = "(1.0::double - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::double)"
ORACLE_VIEWS["v_parsed"] = f"""select query_id, norm, list_distinct(list_filter(string_split(norm, ' '), lambda w: w <> '')) as toks, pack_count as qpack, {D.search_norm("brand")} as qbrand,
    coalesce(volume_ml, list_filter(list_transform(regexp_extract_all(replace(norm, ' ', '  '), '(?:^|[^0-9])([0-9]{{2,4}})(?:[^0-9]|$)', 1), lambda x: x::int), lambda x: x between 50 and 5000)[-1]) as qvol
  from (select *, {D.search_norm('source_name')} as norm from v_sig_asked) where length(norm) >= 2"""
# Queries against all products whose volume and pack agree, each with the texts that are compared.
ORACLE_VIEWS["v_search_pairs"] = f"""select p.*, c.*, len(list_intersect(p.toks, string_split(c.doc, ' '))) / len(p.toks)::double as cov
  from v_parsed p join (select master_id, canonical_name, volume_ml, package_quantity, search_text as doc, {D.search_norm('brand')} as mbrand,
      list_concat([search_text], list_transform(list_filter(coalesce(aliases, []), lambda a: a <> ''), lambda a: {D.search_norm('a')})) as texts from v_search_catalog) c
    on (p.qvol is null or c.volume_ml is null or abs(p.qvol - c.volume_ml) <= greatest(5, round_even(p.qvol * 0.01, 0))) and (p.qpack is null or p.qpack = c.package_quantity)"""


def _search_score(likeness):
    """Score of ``v_search_pairs`` rows joined with the best similarity of their texts."""
    return f"""select query_id, master_id, canonical_name, greatest(0.0::double, least(1.0::double, cov * 0.58::double + lik * 0.32::double + case when contains(doc, norm) then 0.12::double else 0.0::double end
      + case when cov = 1.0 then 0.08::double else 0.0::double end + case when qvol = volume_ml then 0.08::double else 0.0::double end
      + case when qbrand <> '' and mbrand <> '' and qbrand = mbrand then 0.08::double when qbrand <> '' and mbrand <> '' and not contains(doc, qbrand) then -0.12::double else 0.0::double end)) as score
  from ({likeness})"""


ORACLE_VIEWS["v_search"] = _search_score(f"select *, list_max(list_transform(texts, lambda x: {_LEV.format(a='norm', b='x')})) as lik from v_search_pairs")
ORACLE_VIEWS["v_search_ratio"] = D.sequence_ratios("select norm as a, unnest(texts) as b from v_search_pairs")
ORACLE_VIEWS["v_seq_search"] = _search_score("""select p.*, lik from v_search_pairs p join (select query_id, master_id, max(ratio) as lik from (select query_id, master_id, norm, unnest(texts) as text from v_search_pairs) x
      join v_search_ratio r on r.a = x.norm and r.b = x.text group by 1, 2) using (query_id, master_id)""")


def found(t, similarity="levenshtein", minimum=0.34):
    catalog = materialize(search_catalog(t))
    return catalog, E.search_matches(asked(t), catalog, minimum, similarity)


@query("search_score", "Q1 J15", "select query_id, master_id, score from v_search where score >= 0.34")
def search_score(t):
    return found(t)[1].select("query_id", "master_id", "score")


@query("search_score_sequence", "Q1 J15", "select query_id, master_id, score from v_seq_search where score >= 0.34")
def search_score_sequence(t):
    return found(t, "sequence")[1].select("query_id", "master_id", "score")


@query("search_score_low", "Q1 J15", "select query_id, master_id, score from v_seq_search where score >= 0.12")
def search_score_low(t):
    return found(t, "sequence", 0.12)[1].select("query_id", "master_id", "score")


@query("search_score_high", "Q1 J15", "select query_id, master_id, score from v_seq_search where score >= 0.6")
def search_score_high(t):
    return found(t, "sequence", 0.6)[1].select("query_id", "master_id", "score")


ORACLE_VIEWS["v_fresh_public"] = f"""select l.* from v_listings l join v_stores s using (store_id) where s.is_active and comparison_enabled and is_available and not excluded_from_comparison and current_price > 0
  and last_seen_at >= timestamp '{AS_OF}' - interval 240 hour"""
ORACLE_VIEWS["v_page"] = """select *, row_number() over (partition by query_id order by score desc, lowest, lower(canonical_name), master_id) as position from v_search join (select master_id, min(current_price) as lowest from v_fresh_public group by 1) using (master_id)
  where score >= {minimum} qualify position <= 8""".replace("{minimum}", "0.34")
_BEST = """select master_id, count(*) as offer_count, min(price) as winner_price from (select master_id, store_id, min(price) as price from v_shop_offers where listing_id in (select listing_id from v_fresh_public) group by 1, 2) group by 1"""


def run_search(t, similarity="levenshtein"):
    catalog = materialize(search_catalog(t))
    offers = R.shop_offers(t.v_listings, t.v_stores, t.v_quotes)
    return E.search(asked(t), catalog, t.v_listings, t.v_stores, offers, as_of(), max_age_hours=240, similarity=similarity), offers


@query("search", "Q2", f"select query_id, position, master_id, score, offer_count, winner_price from v_page join ({_BEST}) using (master_id)")
def search(t):
    return run_search(t)[0].select("query_id", "position", "master_id", "score", "offer_count", F.col("winner.price").alias("winner_price"))


ORACLE_VIEWS["v_seq_page"] = ORACLE_VIEWS["v_page"].replace("v_search", "v_seq_search")


@query("search_sequence", "Q2", f"select query_id, position, master_id, canonical_name, score, offer_count, winner_price from v_seq_page join ({_BEST}) using (master_id)")
def search_sequence(t):
    return run_search(t, "sequence")[0].select("query_id", "position", "master_id", "canonical_name", "score", "offer_count", F.col("winner.price").alias("winner_price"))


@query("resolve_query", "Q4", f"""select query_id, case when s1 is null then 'not_found' when s1 < 0.5 or coalesce(s1 - s2 < 0.07, false) then 'ambiguous' else 'resolved' end as status from v_asked left join (
    select query_id, max(score) filter (rn = 1) as s1, max(score) filter (rn = 2) as s2 from (select query_id, score, row_number() over (partition by query_id order by score desc, position) as rn from v_page join ({_BEST}) using (master_id)) group by 1) using (query_id)""")
def resolve_query(t):
    results, _ = run_search(t)
    return E.resolve_queries(asked(t), results).select("query_id", "status")


@query("search_result_documents", "Q6", f"select query_id, master_id, offer_count as offers, winner_price from v_page join ({_BEST}) using (master_id)")
def search_result_documents(t):
    results, offers = run_search(t)
    from pricetide.operators.filters import fresh

    shown = offers.join(fresh(t.v_listings, t.v_stores, as_of(), 240).select("listing_id"), "listing_id", "left_semi")
    docs = E.search_result_documents(results, shown)
    body = F.from_json("document", "offers array<struct<price:bigint>>")
    return docs.select("query_id", "master_id", body.alias("b")).select("query_id", "master_id", F.size("b.offers").alias("offers"), F.col("b.offers")[0]["price"].alias("winner_price"))
