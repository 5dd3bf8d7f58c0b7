"""Ingest, quality, availability and run health."""

from __future__ import annotations

from pyspark.sql import functions as F


from pricetide.operators import health as H
from pricetide.operators import ingest as G
from pricetide.operators import quality as Q


from .q_history import as_of, recent_runs
from .registry import ORACLE_VIEWS, query
from .views import AS_OF, ORDERS_AS_OF

# Listings with deliberate defects, and the price before.
ORACLE_VIEWS["v_dirty"] = """select listing_id, last_confirmed_run_id, case listing_id % 23 when 0 then 'Null' when 1 then ' X ' else name end as name,
    case when listing_id % 11 = 0 then 'ftp://x' else url end as url, case when listing_id % 17 = 0 then 0 else current_price end as current_price,
    case when listing_id % 6 = 0 then current_price - 5 else regular_price end as regular_price, case when listing_id % 5 = 0 then 40.0::double else discount_pct end as discount_pct,
    case listing_id % 4 when 0 then current_price * 9 when 1 then current_price // 5 when 2 then current_price else null end as previous_price from v_listings"""


def dirty(t):
    i, p = F.col("listing_id"), F.col("current_price")
    return t.v_listings.select(
        "listing_id", "last_confirmed_run_id", F.when(i % 23 == 0, "Null").when(i % 23 == 1, " X ").otherwise(F.col("name")).alias("name"),
        F.when(i % 11 == 0, "ftp://x").otherwise(F.col("url")).alias("url"), F.when(i % 17 == 0, 0).otherwise(p).alias("current_price"),
        F.when(i % 6 == 0, p - 5).otherwise(F.col("regular_price")).alias("regular_price"), F.when(i % 5 == 0, 40.0).otherwise(F.col("discount_pct")).alias("discount_pct"),
        F.when(i % 4 == 0, p * 9).when(i % 4 == 1, F.floor(p / 5)).when(i % 4 == 2, p).alias("previous_price"))


def _quality(prev):
    known = f"coalesce({prev}, 0) > 0 and price > 0"
    checks = [
        ("invalid_name", 80, "nm in ('', 'null', 'none', 'n/a', 'na', 'producto', 'product', 'sin nombre', 'undefined')"),
        ("name_too_short", 55, "nm not in ('', 'na') and length(nm) < 3"), ("invalid_url", 35, "not regexp_matches(url, '^https?://[^/]')"),
        ("non_positive_price", 100, "price <= 0"), ("implausibly_low_price", 35, "price > 0 and price < 500"), ("implausibly_high_price", 20, "price > 2000000"),
        ("regular_below_current", 18, "regular > 0 and regular < price"),
        ("discount_mismatch", 12, "regular > 0 and regular >= price and rep > 0 and abs((regular - price) / regular::double - rep) > 0.12"),
        ("extreme_discount", 20, "regular > 0 and regular >= price and (regular - price) / regular::double > 0.9"),
        ("extreme_price_jump", 50, f"{known} and (price / {prev}::double >= 8 or price / {prev}::double <= 0.125)"),
        ("large_price_jump", 25, f"{known} and not (price / {prev}::double >= 8 or price / {prev}::double <= 0.125) and (price / {prev}::double >= 4 or price / {prev}::double <= 0.25)"),
        ("unknown_volume", 8, "vol is null")]
    issues = ", ".join(f"case when coalesce({c}, false) then '{n}' end" for n, _, c in checks)
    penalty = " + ".join(f"case when coalesce({c}, false) then {p} else 0 end" for _, p, c in checks)
    critical = " or ".join(f"coalesce({c}, false)" for n, _, c in checks if n in ("invalid_name", "name_too_short", "non_positive_price", "extreme_price_jump"))
    return f"""select listing_id, run_id, score as data_quality_score, case when crit or score < 60 then 'BLOCKED' when score < 80 then 'WARNING' else 'CLEAN' end as data_quality_status,
      array_to_string(issues, ',') as issues, crit or score < 60 as excluded_from_comparison
    from (select listing_id, run_id, greatest(0, 100 - ({penalty})) as score, list_filter([{issues}], lambda x: x is not null) as issues, {critical} as crit
      from (select d.listing_id, d.last_confirmed_run_id as run_id, lower(regexp_replace(trim(d.name), '\\s+', ' ', 'g')) as nm, d.url, d.current_price as price, coalesce(d.regular_price, 0) as regular, d.previous_price,
          case when coalesce(d.discount_pct, 0) > 1.5 then d.discount_pct / 100.0::double else coalesce(d.discount_pct, 0) end as rep,
          case when d.listing_id % 23 in (0, 1) then null else g.volume_ml end as vol from v_dirty d join v_sig_listings g using (listing_id)))"""


_QUALITY_COLUMNS = ("listing_id", "data_quality_score", "data_quality_status", "issues", "excluded_from_comparison")


def flat(df):
    return df.withColumn("issues", F.array_join("data_quality_issues", ",")).select(*_QUALITY_COLUMNS)


@query("assess_quality", "I5", "select * exclude (run_id) from (" + _quality("previous_price") + ")")
def assess_quality(t):
    return flat(Q.assess_quality(dirty(t)))


@query("refresh_quality", "I6", "select * exclude (run_id) from (" + _quality("null::bigint") + ") where run_id in (select run_id from v_recent_runs)")
def refresh_quality(t):
    return flat(Q.refresh_quality(dirty(t), recent_runs(t)))


@query("quality_events", "I6", f"select listing_id, run_id, data_quality_score as score, data_quality_status as status, timestamp '{AS_OF}' as observed_at from (" + _quality("previous_price") + ")")
def quality_events(t):
    return Q.quality_events(Q.assess_quality(dirty(t)), as_of()).drop("issues")


@query("quality_summary", "A10", """select count(*) as assessed, count(*) filter (coalesce(data_quality_status, 'CLEAN') = 'CLEAN') as clean, count(*) filter (data_quality_status = 'WARNING') as warnings,
    count(*) filter (data_quality_status = 'BLOCKED') as blocked from v_listings where last_confirmed_run_id in (select run_id from v_recent_runs)""")
def quality_summary(t):
    return Q.quality_summary(t.v_listings, recent_runs(t))


@query("quality_incidents", "I7", """select listing_id, data_quality_status from v_listings join v_stores using (store_id) where is_available and is_active and data_quality_status in ('BLOCKED', 'WARNING')
  order by data_quality_score, last_seen_at desc, listing_id limit 50""")
def quality_incidents(t):
    return Q.quality_incidents(t.v_listings, t.v_stores).select("listing_id", "data_quality_status")


@query("quality_totals", "I7 A10", """select count(*) filter (data_quality_status = 'BLOCKED') as blocked, count(*) filter (data_quality_status = 'WARNING') as warnings
  from v_listings join v_stores using (store_id) where is_available and is_active""")
def quality_totals(t):
    return Q.quality_totals(t.v_listings, t.v_stores)


ORACLE_VIEWS["v_last_run"] = "select store_id, max(run_id) as run_id, store_id % 2 = 1 as is_healthy from v_obs where run_id is not null group by 1"
ORACLE_VIEWS["v_availability"] = """select listing_id, run_id, observed, case when observed then true when healthy_miss and streak >= 2 and is_available then false else is_available end as is_available, streak as missing_streak,
    healthy_miss and is_available and streak >= 2 as marked_unavailable, observed and not is_available as reactivated
  from (select l.listing_id, r.run_id, l.is_available, o.listing_id is not null as observed, o.listing_id is null and r.is_healthy as healthy_miss,
      case when o.listing_id is not null then 0 when r.is_healthy then l.missing_streak + 1 else l.missing_streak end as streak
    from v_listings l join v_last_run r using (store_id) left join (select distinct run_id, listing_id from v_obs) o on o.run_id = r.run_id and o.listing_id = l.listing_id)"""


def availability(t):
    runs = t.v_obs.where("run_id is not null").groupBy("store_id").agg(F.max("run_id").alias("run_id")).withColumns(
        {"is_healthy": F.col("store_id") % 2 == 1, "finished_at": as_of()})
    return Q.reconcile_availability(t.v_listings, t.v_obs, runs)


@query("reconcile_availability", "I4", "select * from v_availability")
def reconcile_availability(t):
    return availability(t).select("listing_id", "run_id", "observed", "is_available", "missing_streak", "marked_unavailable", "reactivated")


@query("availability_summary", "I4", """select run_id, count(*) filter (observed) as observed, count(*) filter (not observed) as missing, count(*) filter (marked_unavailable) as marked_unavailable,
    count(*) filter (reactivated) as reactivated from v_availability group by 1""")
def availability_summary(t):
    return Q.availability_summary(availability(t))


ORACLE_VIEWS["v_presence"] = """select l.listing_id, d.day as run_seq, o.listing_id is not null as observed, (l.store_id + d.day) % 5 <> 0 as is_healthy from v_listings l join (select distinct day(ts) as day from events) d on true
  left join (select distinct listing_id, day(observed_at) as day from v_obs) o on o.listing_id = l.listing_id and o.day = d.day"""


def presence(t):
    days = F.explode(F.sequence(F.lit(1), F.lit(30))).alias("run_seq")
    seen = t.v_obs.select("listing_id", F.dayofmonth("observed_at").alias("run_seq")).distinct().withColumn("observed", F.lit(True))
    return t.v_listings.select("listing_id", "store_id", days).join(seen, ["listing_id", "run_seq"], "left").select(
        "listing_id", "run_seq", F.coalesce("observed", F.lit(False)).alias("observed"), ((F.col("store_id") + F.col("run_seq")) % 5 != 0).alias("is_healthy"))


@query("replay_availability", "I4", """select listing_id, run_seq, count(*) filter (not observed and is_healthy) over (partition by listing_id, island order by run_seq) as missing_streak,
    count(*) filter (not observed and is_healthy) over (partition by listing_id, island order by run_seq) < 2 as is_available
  from (select *, count(*) filter (observed) over (partition by listing_id order by run_seq) as island from v_presence)""")
def replay_availability(t):
    return Q.replay_availability(presence(t))


# The latest observations as a batch on top of the state before them.
ORACLE_VIEWS["v_state"] = "select listing_id, store_id, url, name, current_price + listing_id % 3 * 100 - 100 as current_price, regular_price, discount_pct, sku, ean, last_confirmed_run_id, first_seen_at, last_seen_at from v_listings where listing_id % 7 <> 0"
ORACLE_VIEWS["v_batch"] = "select store_id, url, upper(name) as name, current_price, regular_price, discount_pct, case when listing_id % 2 = 0 then '' else sku end as sku, null::varchar as ean, 9999 as run_id from v_listings where listing_id % 5 <> 0"


def state(t):
    return t.v_listings.where("listing_id % 7 <> 0").select(
        "listing_id", "store_id", "url", "name", (F.col("current_price") + F.col("listing_id") % 3 * 100 - 100).alias("current_price"), "regular_price", "discount_pct",
        "sku", "ean", "last_confirmed_run_id", "first_seen_at", "last_seen_at")


def batch(t):
    return t.v_listings.where("listing_id % 5 <> 0").select(
        "store_id", "url", F.upper("name").alias("name"), "current_price", "regular_price", "discount_pct",
        F.when(F.col("listing_id") % 2 == 0, "").otherwise(F.col("sku")).alias("sku"), F.lit(None).cast("string").alias("ean"), F.lit(9999).cast("bigint").alias("run_id"))


ORACLE_VIEWS["v_upserted"] = """select coalesce(s.store_id, b.store_id) as store_id, coalesce(s.url, b.url) as url, coalesce(b.name, s.name) as name, case when b.url is not null then b.current_price else s.current_price end as current_price,
    case when b.url is not null then b.regular_price else s.regular_price end as regular_price, case when b.url is not null then b.discount_pct else s.discount_pct end as discount_pct,
    coalesce(nullif(b.sku, ''), s.sku) as sku, s.ean, case when b.url is not null then s.current_price end as previous_price, s.url is null as is_new, b.url is not null as is_observed, s.listing_id as known_id
  from v_state s full join v_batch b on s.store_id = b.store_id and s.url = b.url"""


def upserted(t):
    return G.upsert_listings(state(t), batch(t), as_of())


@query("upsert_listings", "I1", "select store_id, url, name, current_price, sku, ean, previous_price, is_new, is_observed from v_upserted")
def upsert_listings(t):
    return upserted(t).select("store_id", "url", "name", "current_price", "sku", "ean", "previous_price", "is_new", "is_observed")


ORACLE_VIEWS["v_changes"] = """select *, coalesce(current_price < previous_price, false) as price_dropped, coalesce(current_price > previous_price, false) as price_increased, coalesce(current_price - previous_price, 0) as amount,
    case when coalesce(previous_price, 0) = 0 then 0.0::double else (current_price - previous_price) / previous_price::double end as pct from v_upserted where is_observed"""


def changes(t):
    return G.changes_of(upserted(t))


@query("catalog_change_summary", "A9", """select store_id, count(*) as total, count(*) filter (regular_price is not null and discount_pct > 0) as reported_discounts, count(*) filter (price_dropped) as price_drops,
    count(*) filter (price_increased) as price_increases, count(*) filter (not is_new and not price_dropped and not price_increased) as unchanged, count(*) filter (is_new) as new_products,
    (select count(*) from v_upserted u where u.store_id = c.store_id and not u.is_observed) as missing_products from v_changes c group by 1""")
def catalog_change_summary(t):
    return G.catalog_change_summary(changes(t), upserted(t).where("not is_observed"))


ORACLE_VIEWS["v_rank"] = """select *, case when price_dropped then abs(pct) else 0.0::double end as drop_pct, case when regular_price > current_price and discount_pct > 0 then discount_pct else 0.0::double end as rep_pct,
    greatest(case when price_dropped then -amount else 0 end, case when regular_price > current_price and discount_pct > 0 then regular_price - current_price else 0 end) as saving,
    price_dropped or coalesce(regular_price > current_price and discount_pct > 0, false) as sig from v_changes"""


@query("rank_best_prices", "W9", """select store_id, url, position, ranking_reason from (select store_id, url, case when drop_pct > 0 and drop_pct >= rep_pct then 'real_drop' when rep_pct > 0 then 'reported_discount' when is_new then 'new_listing' else 'price_only' end as ranking_reason,
    row_number() over (partition by store_id order by sig desc, greatest(drop_pct, rep_pct) desc, price_dropped desc, saving desc, current_price, lower(name), url) as position from v_rank) where position <= 30""")
def rank_best_prices(t):
    ranked = G.rank_best_prices(changes(t).withColumns({"excluded_from_comparison": F.lit(False), "listing_id": F.col("url")}))
    return ranked.select("store_id", "url", "position", "ranking_reason")


@query("rank_drops", "W10", """select store_id, url, position from (select *, row_number() over (partition by store_id order by abs(pct) desc, amount, lower(name), url) as position from v_changes
    where price_dropped and (abs(pct) >= 0.05 or -amount >= 1000)) where position <= 10""")
def rank_drops(t):
    return G.rank_drops(changes(t).withColumn("listing_id", F.col("url"))).select("store_id", "url", "position")


@query("rank_increases", "W10", """select store_id, url, position from (select *, row_number() over (partition by store_id order by pct desc, amount desc, lower(name), url) as position from v_changes where price_increased) where position <= 10""")
def rank_increases(t):
    return G.rank_increases(changes(t).withColumn("listing_id", F.col("url"))).select("store_id", "url", "position")


@query("rank_new", "W10", "select store_id, url, position from (select *, row_number() over (partition by store_id order by lower(name), url) as position from v_changes where is_new) where position <= 10")
def rank_new(t):
    return G.rank_new(changes(t).withColumn("listing_id", F.col("url"))).select("store_id", "url", "position")


@query("paginate", "W11", """select store_id, url, position, ceil(position / 10.0)::int as page, ((position - 1) % 10 + 1)::int as position_in_page from (
    select *, row_number() over (partition by store_id order by lower(name), url) as position from v_changes where is_new) where position <= 25""")
def paginate(t):
    return G.paginate(G.rank_new(changes(t).withColumn("listing_id", F.col("url")), 25)).select("store_id", "url", "position", "page", "position_in_page")


_NEW_QUOTE = "select listing_id, case when obs_id % 3 = 0 then 'MEMBER' else price_type end as price_type, audience_key, arg_max(price, obs_id) as price from v_obs where listing_id % 4 <> 0 and price > 0 and day(observed_at) >= 15 group by 1, 2, 3"


@query("upsert_quotes", "I2", f"""select listing_id, price_type, audience_key, coalesce(n.price, o.price) as price,
    case when n.price is not null then true when listing_id in (select listing_id from ({_NEW_QUOTE})) then false else o.is_active end as is_active
  from v_quotes o full join ({_NEW_QUOTE}) n using (listing_id, price_type, audience_key)""")
def upsert_quotes(t):
    kind = F.when(F.col("obs_id") % 3 == 0, "member ").otherwise(F.lower("price_type"))
    audience = F.concat(F.lit(" "), F.upper("audience_key"))
    rows = t.v_obs.where("listing_id % 4 <> 0 and day(observed_at) >= 15 and price > 0").groupBy("listing_id", kind.alias("price_type"), audience.alias("audience_key")).agg(
        F.max_by(F.struct("obs_id", "price", "regular_price", "eligibility_required"), "obs_id").alias("q")).select("listing_id", "price_type", "audience_key", "q.*")
    quotes = rows.groupBy("listing_id").agg(F.max("price").alias("current_price"), F.max("regular_price").alias("regular_price"), F.transform(F.array_sort(F.collect_list(
        F.struct("obs_id", "price", "regular_price", "price_type", "audience_key", "eligibility_required"))), lambda q: q.dropFields("obs_id")).alias("price_quotes"))
    return G.upsert_quotes(t.v_quotes, quotes, as_of()).select("listing_id", "price_type", "audience_key", "price", "is_active")


@query("backfill_public_quotes", "I3", "select listing_id, current_price as price, case when regular_price > current_price then 'SALE' else 'PUBLIC' end as price_type from v_listings")
def backfill_public_quotes(t):
    return G.backfill_public_quotes(t.v_listings).select("listing_id", "price", "price_type")


# Cards: every observation of a day is a card of the run; categories by row number.
ORACLE_VIEWS["v_cards"] = "select store_id, listing_id as url, run_id, obs_id as seq, price as current_price, concat('section ', obs_id % 3) as section from v_obs where run_id is not null"


def cards(t):
    return t.v_obs.where("run_id is not null").select("store_id", F.col("listing_id").alias("url"), "run_id", F.col("obs_id").alias("seq"), F.col("price").alias("current_price"),
                                                      F.array(F.concat(F.lit("section "), (F.col("obs_id") % 3).cast("string"))).alias("source_sections"))


def _dedup(order):
    return f"""select run_id, url, arg_max(current_price, {order}) as current_price, count(*) - 1 as duplicates_removed, array_to_string(list_sort(list_distinct(list(section))), ',') as sections from v_cards group by 1, 2"""


for _policy, _order in (("latest", "seq"), ("cheapest", "-current_price * 1000000000000 + seq"), ("first_cheapest", "-current_price * 1000000000000 - seq")):
    @query(f"dedup_listings_{_policy}", "W13", _dedup(_order))
    def dedup(t, policy=_policy):
        return G.dedup_listings(cards(t), policy, ("run_id", "url")).select("run_id", "url", "current_price", "duplicates_removed", F.array_join("source_sections", ",").alias("sections"))


@query("page_novelty", "W16", """
  with c as (select distinct store_id as catalog, day(observed_at) as page_no, listing_id as url from v_obs), f as (select catalog, url, min(page_no) as fp from c group by 1, 2),
  p as (select catalog, page_no, count(*) as urls, count(*) filter (page_no = fp) as new_urls, list_sort(list(url)) as s from c join f using (catalog, url) group by 1, 2)
  select catalog, page_no, urls, new_urls, coalesce(lag(s) over w = s, false) as same_as_previous, page_no > min(page_no) over (partition by catalog) and new_urls = 0 as ends_catalog from p window w as (partition by catalog order by page_no)""")
def page_novelty(t):
    pages = t.v_obs.select(F.col("store_id").alias("catalog"), F.dayofmonth("observed_at").alias("page_no"), F.col("listing_id").alias("url"))
    return G.page_novelty(pages)


@query("upsert_stores", "I15", """select connector_key, coalesce(n.name, o.name) as name, coalesce(n.region, o.region) as region, n.name is not null or o.is_active as is_active, o.name is null as created
  from (select s_name as connector_key, 'old' as name, s_nationkey as region, s_suppkey % 2 = 0 as is_active from supplier where s_suppkey % 3 <> 0) o
  full join (select s_name as connector_key, upper(s_name) as name, s_nationkey + 100 as region from supplier where s_suppkey % 4 <> 0) n using (connector_key)""")
def upsert_stores(t):
    old = t.supplier.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").cast("int").alias("store_id"), F.col("s_name").alias("connector_key"), F.lit("old").alias("name"), F.col("s_nationkey").alias("region"), (F.col("s_suppkey") % 2 == 0).alias("is_active"))
    new = t.supplier.where("s_suppkey % 4 <> 0").select(F.col("s_name").alias("connector_key"), F.upper("s_name").alias("name"), (F.col("s_nationkey") + 100).alias("region"))
    return G.upsert_stores(old, new).drop("store_id")


def orders_as_of():
    return F.lit(ORDERS_AS_OF).cast("timestamp")


# Sections of a collection run are the line items of an order.
ORACLE_VIEWS["v_sections"] = "select l_orderkey as run_id, case when l_returnflag = 'R' and l_linenumber % 3 = 0 then 'failed' else 'success' end as status, l_linestatus = 'F' and l_linenumber % 4 = 1 as structural_warning, cast(l_quantity as bigint) as pages, l_partkey as listing_id from lineitem"
ORACLE_VIEWS["v_run_policy"] = """select o_orderkey as run_id, cast(floor(o_totalprice / 1000) as int) as products, case o_orderkey % 7 when 0 then 'proportional' when 1 then 'fixed_8_5' when 2 then 'fixed_12_8' when 3 then 'fixed_14_7'
    when 4 then 'fixed_14_8' when 5 then 'fixed_15_8' else 'fixed_18_8' end as policy from orders"""


def sections(t):
    return t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 3 == 0), "failed").otherwise("success").alias("status"),
                             ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 4 == 1)).alias("structural_warning"), F.col("l_quantity").cast("bigint").alias("pages"), F.col("l_partkey").alias("listing_id"))


def policies(t):
    return t.spark.createDataFrame(list(H.HEALTH_POLICIES), "policy string, per_failure int, per_warning int, minimum_products int, failed_limit int, by_third boolean, broken_cap int")


def run_policy(t):
    name = F.element_at(F.array(*[F.lit(p[0]) for p in H.HEALTH_POLICIES]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return t.orders.select(F.col("o_orderkey").alias("run_id"), F.floor(F.col("o_totalprice") / 1000).cast("int").alias("products"), name.alias("policy"))


_POLICY_ROWS = ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() for v in row) + ")" for row in H.HEALTH_POLICIES)
ORACLE_VIEWS["v_health"] = f"""
  with p(policy, pf, pw, minp, lim, third, cap) as (values {_POLICY_ROWS}),
  c as (select run_id, count(*) as total, count(*) filter (status <> 'success') as failed, count(*) filter (structural_warning) as warnings from v_sections group by 1),
  j as (select r.run_id, r.policy, r.products, p.*, coalesce(c.total, 0) as total, coalesce(c.failed, 0) as failed, coalesce(c.warnings, 0) as warnings from v_run_policy r join p on p.policy = r.policy left join c using (run_id)),
  s as (select *, greatest(0, least(100, case when policy = 'proportional' then 100 - round_even(failed / total::double * 70, 0) - round_even(warnings / total::double * 30, 0) else 100 - failed * pf - warnings * pw end)) as raw,
      third and total = 0 as none, products < minp as few from j),
  h as (select *, coalesce(raw, 0)::int as score, case when few or none then 'BROKEN' when failed = 0 and warnings = 0 then 'HEALTHY'
      when coalesce(raw, 0) >= 55 and (case when policy = 'proportional' then failed < greatest(2, total // 3) when third then failed <= greatest(2, total // 3) else failed <= lim end) then 'DEGRADED' else 'BROKEN' end as st from s)
  select run_id, policy, products, st as health_status, (case when few or none then (case when none or products <= 0 then 0 when third then least(score, 20) else 20 end)
    when st = 'BROKEN' and cap is not null then least(score, cap) else score end)::int as health_score from h"""


@query("collection_health", "I8", "select * from v_health")
def collection_health(t):
    return H.collection_health(sections(t), run_policy(t), policies(t))


@query("completeness_health", "I8", """select run_id, products, case when products < 50 then 'BROKEN' when run_id % 3 <> 0 and run_id % 5 = 0 then 'HEALTHY' else 'DEGRADED' end as health_status,
    (case when products < 50 then case when products > 0 then 20 else 0 end when run_id % 3 <> 0 and run_id % 5 = 0 then 100 when run_id % 2 = 0 then 72 else greatest(50, 90 - run_id % 5 * 10) end)::int as health_score from v_run_policy""")
def completeness_health(t):
    i = F.col("run_id")
    runs = run_policy(t).select("run_id", "products", F.lit(50).alias("minimum_products"), (i % 3 != 0).alias("complete"), (i % 5).alias("failed_pages"), F.when(i % 2 == 0, 72).alias("score_if_partial"))
    return H.completeness_health(runs)


@query("historical_health", "I9", """select run_id, case when ratio < 0.4 and health_status = 'HEALTHY' then 'BROKEN' when ratio < 0.7 and health_status = 'HEALTHY' then 'DEGRADED' else health_status end as health_status,
    case when ratio < 0.4 and health_status = 'HEALTHY' then least(health_score, 25) when ratio < 0.4 and health_status = 'DEGRADED' then least(health_score, 45)
      when ratio < 0.7 and health_status = 'HEALTHY' then least(health_score, 60) else health_score end as health_score
  from (select *, case when run_id % 400 > 0 then products / (run_id % 400)::double end as ratio from v_health)""")
def historical_health(t):
    runs = H.collection_health(sections(t), run_policy(t), policies(t)).withColumn("previous_count", F.col("run_id") % 400)
    return H.historical_health(runs).select("run_id", "health_status", "health_score")


ORACLE_VIEWS["v_latest"] = """select store_id, arg_max(run_id, rk) filter (finished_at is not null) as latest_run_id, arg_max(health_status, rk) filter (finished_at is not null) as latest_health, arg_max(finished_at, rk) filter (finished_at is not null) as latest_at,
    arg_max(run_id, rk) filter (ok) as healthy_run_id, arg_max(finished_at, rk) filter (ok) as healthy_at, arg_max(products_found, rk) filter (status = 'success' and finished_at is not null) as previous_successful_count,
    arg_max(source, rk) filter (ok) as source
  from (select *, row_number() over (order by finished_at nulls first, run_id) as rk, finished_at is not null and status = 'success' and health_status = 'HEALTHY' and products_found > 0 as ok from v_runs) group by 1"""


@query("latest_runs", "W12", "select store_id, latest_run_id, latest_health, healthy_run_id, previous_successful_count from v_latest")
def latest_runs(t):
    return H.latest_runs(t.v_runs).select("store_id", F.col("latest.run_id").alias("latest_run_id"), F.col("latest.health_status").alias("latest_health"),
                                          F.col("healthy.run_id").alias("healthy_run_id"), "previous_successful_count")


@query("accept_batches", "I10", """select run_id, case when health_status = 'BROKEN' then 'FAILED' when health_status = 'DEGRADED' then 'STALE' else 'UPDATED' end as execution_state,
    case when health_status = 'BROKEN' then null when health_status = 'DEGRADED' then healthy_run_id else run_id end as effective_run_id, health_status not in ('BROKEN', 'DEGRADED') as is_persisted
  from v_runs join v_latest using (store_id)""")
def accept_batches(t):
    return H.accept_batches(t.v_runs, H.latest_runs(t.v_runs), True).select("run_id", "execution_state", "effective_run_id", "is_persisted")


# One shop per order priority and customer group gives a schedule to decide on.
ORACLE_VIEWS["v_many_runs"] = "select run_id, run_id % 997 as store_id, status, health_status, products_found, finished_at, source from v_runs"


@query("due_runs", "I11", f"""
  with l as (select store_id, max(finished_at) as latest_at, arg_max(run_id, epoch_us(finished_at)::hugeint * 1000000000 + run_id) filter (status = 'success' and health_status = 'HEALTHY' and products_found > 0 and finished_at is not null) as healthy_run_id from v_many_runs group by 1),
  d as (select store_id, healthy_run_id, case when store_id % 4 <> 0 then latest_at + (store_id * 3) * interval 1 hour end as due_at from l)
  select store_id, due_at as next_due_at, not coalesce(timestamp '{ORDERS_AS_OF}' + interval 15 minute < due_at and healthy_run_id is not null, false) as is_due,
    case when timestamp '{ORDERS_AS_OF}' + interval 15 minute < due_at and healthy_run_id is not null then healthy_run_id end as reused_run_id from d""")
def due_runs(t):
    runs = t.v_runs.withColumn("store_id", F.col("run_id") % 997)
    shops = runs.select("store_id").distinct().withColumn("interval_hours", F.when(F.col("store_id") % 4 != 0, F.col("store_id") * 3).cast("int"))
    return H.due_runs(shops, H.latest_runs(runs), orders_as_of()).drop("execution_state")


@query("store_status", "I12", "select store_id, name, latest_run_id as last_run_id, latest_at as last_finished_at, latest_health as last_health, healthy_run_id, healthy_at as healthy_finished_at, source from v_stores left join v_latest using (store_id) where is_active")
def store_status(t):
    return H.store_status(t.v_stores, H.latest_runs(t.v_runs))


ORACLE_VIEWS["v_results"] = """select run_id, products_found, health_status, status = 'success' as success, case when run_id % 9 = 0 then 'PAUSED' when status <> 'success' then 'FAILED' when health_status = 'STALE' then 'STALE' when run_id % 8 = 0 then 'DUE_SOON' else 'UPDATED' end as execution_state,
    run_id % 10 = 0 as diagnostic_mode, store_id <> 4 as comparison_enabled, store_id in (3, 4) as personal_comparison_enabled from v_runs"""


def results(t):
    i, s = F.col("run_id"), F.col("store_id")
    st = F.when(i % 9 == 0, "PAUSED").when(F.col("status") != "success", "FAILED").when(F.col("health_status") == "STALE", "STALE").when(i % 8 == 0, "DUE_SOON").otherwise("UPDATED")
    return t.v_runs.select("run_id", "products_found", "health_status", (F.col("status") == "success").alias("success"), st.alias("execution_state"), (i % 10 == 0).alias("diagnostic_mode"),
                           (s != 4).alias("comparison_enabled"), s.isin(3, 4).alias("personal_comparison_enabled"))


@query("execution_state_summary", "A13", """select count(*) filter (pub and success and execution_state = 'UPDATED') as updated, count(*) filter (pub and success and execution_state = 'STALE') as stale,
    count(*) filter (pub and success and execution_state = 'DUE_SOON') as due_soon, count(*) filter (pub and execution_state = 'PAUSED') as paused,
    count(*) filter (pub and (execution_state = 'FAILED' or (not success and execution_state <> 'PAUSED'))) as failed, count(*) filter (per) as personal_sources, count(*) filter (per and success) as personal_ok,
    count(*) filter (diagnostic_mode) as diagnostic_sources, count(*) filter (diagnostic_mode and success) as diagnostic_ok
  from (select *, comparison_enabled and not diagnostic_mode as pub, personal_comparison_enabled and not comparison_enabled and not diagnostic_mode as per from v_results)""")
def execution_state_summary(t):
    return H.execution_state_summary(results(t))


@query("coverage_complete", "I13", """select coalesce(bool_and(products_found > 0 and ((execution_state = 'UPDATED' and health_status = 'HEALTHY') or execution_state in ('STALE', 'DUE_SOON'))), false) as complete
  from v_results where execution_state <> 'PAUSED' and not diagnostic_mode""")
def coverage_complete(t):
    return H.coverage_complete(results(t))


@query("cycle_outcome", "I17", "select bool_or(not diagnostic_mode and success and execution_state in ('UPDATED', 'STALE', 'DUE_SOON')) as success from v_results")
def cycle_outcome(t):
    return H.cycle_outcome(results(t))


@query("run_metrics", "I14", """select o_orderkey as run_id, 3600000::bigint as duration_ms, coalesce(c.created, 0) as products_created, coalesce(c.updated, 0) as products_updated, coalesce(c.changed, 0) as price_changes, coalesce(m.n, 0) as missing_products
  from orders left join (select l_orderkey, count(*) filter (l_linenumber = 1) as created, count(*) filter (l_linenumber <> 1) as updated, count(*) filter (l_discount > 0.05) as changed from lineitem group by 1) c on c.l_orderkey = o_orderkey
  left join (select l_orderkey, count(*) as n from lineitem where l_tax = 0 group by 1) m on m.l_orderkey = o_orderkey""")
def run_metrics(t):
    li = t.lineitem.withColumnRenamed("l_orderkey", "run_id")
    moved = li.select("run_id", (F.col("l_linenumber") == 1).alias("is_new"), (F.col("l_discount") > 0.05).alias("price_changed"))
    runs = t.orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), (F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(1))).alias("finished_at"))
    return H.run_metrics(moved, li.where("l_tax = 0"), runs)


@query("shard_plausibility", "I16", """select shard, max_plausible, coalesce(n, 0) as distinct_listings, coalesce(n, 0) <= max_plausible as plausible from (select s_suppkey as shard, s_suppkey * 3 as max_plausible from supplier)
  left join (select l_suppkey as shard, count(distinct l_partkey) as n from lineitem where l_suppkey % 11 <> 0 group by 1) using (shard)""")
def shard_plausibility(t):
    listings = t.lineitem.where("l_suppkey % 11 <> 0").select(F.col("l_suppkey").alias("shard"), F.col("l_partkey").alias("listing_id"))
    return H.shard_plausibility(listings, t.supplier.select(F.col("s_suppkey").alias("shard"), (F.col("s_suppkey") * 3).alias("max_plausible")))


@query("collection_stats", "A14", """select run_id, count(*) as sections_visited, count(*) filter (status = 'success') as sections_succeeded, count(*) filter (status <> 'success') as sections_failed, sum(pages)::bigint as pages_visited,
    sum(pages * 10)::bigint as cards_seen, count(*) as duplicates_removed, count(*) filter (structural_warning) as structural_warnings, count(distinct listing_id) as unique_products from v_sections group by 1""")
def collection_stats(t):
    s = sections(t).withColumns({"cards": F.col("pages") * 10, "duplicates": F.lit(1)})
    return H.collection_stats(s, s.select("run_id", "listing_id"))


@query("merge_phase_metrics", "A17", "select l_returnflag as phase, sum(l_quantity)::bigint as ms from lineitem group by 1 union all select 'collect', sum(l_linenumber)::bigint from lineitem")
def merge_phase_metrics(t):
    runs = t.lineitem.select(F.create_map("l_returnflag", F.col("l_quantity").cast("bigint"), F.lit("collect"), F.col("l_linenumber").cast("bigint")).alias("performance_ms"))
    return H.merge_phase_metrics(runs)


@query("weekly_health", "A12", f"""
  with r as (select s.store_id, v.* exclude (store_id) from v_stores s left join (select * from v_runs where started_at >= timestamp '{ORDERS_AS_OF}' - interval 168 day and finished_at is not null) v on v.store_id = s.store_id where s.is_active),
  a as (select store_id, count(run_id) as runs, count(*) filter (health_status = 'HEALTHY' and status = 'success') as healthy, count(*) filter (health_status in ('DEGRADED', 'STALE')) as degraded,
    count(*) filter (status = 'failed' or health_status = 'BROKEN') as failures, count(*) filter (regexp_matches(error_message, '429|430|403|RateLimit')) as rate_limits, coalesce(avg(duration_ms), 0.0) as average_duration_ms,
    coalesce(round_even(avg(products_found) filter (products_found > 0), 0), 0)::bigint as average_products, count(*) filter (duration_ms >= 1200000) as near_timeout, arg_max(source, epoch_us(started_at)::hugeint * 1000000000 + run_id) as latest_source
    from r group by grouping sets ((store_id), ()))
  select *, case when runs > 0 then healthy / runs::double * 100 else 0.0 end as success_rate, case when runs > 0 and healthy / runs::double * 100 >= 90 and failures = 0 then 'green' when healthy > 0 then 'yellow' else 'red' end as light from a""")
def weekly_health(t):
    return H.weekly_health(t.v_runs, t.v_stores, orders_as_of(), 168)


@query("catalog_pulse", "A11", f"""select (select count(*) from v_stores where is_active and comparison_enabled) as public_stores, (select count(*) from v_stores where is_active and personal_comparison_enabled) as personal_sources,
    count(*) as fresh_offers, count(distinct master_id) as comparable_products from v_listings join v_stores using (store_id) where is_active and comparison_enabled and is_available and not excluded_from_comparison
    and current_price > 0 and last_seen_at >= timestamp '{AS_OF}' - interval 72 hour""")
def catalog_pulse(t):
    return H.catalog_pulse(t.v_listings, t.v_stores, as_of())


@query("new_store_names", "U2", """select master_id, array_to_string(list_sort(list_distinct(list(store_id) filter (day(observed_at) >= 20 and store_id not in (select o.store_id from v_obs o where o.master_id = v_obs.master_id and day(o.observed_at) < 3)))), ',') as added from v_obs group by 1""")
def new_store_names(t):
    sets = t.v_obs.groupBy("master_id").agg(F.collect_set(F.when(F.dayofmonth("observed_at") >= 20, F.col("store_id"))).alias("now"), F.collect_set(F.when(F.dayofmonth("observed_at") < 3, F.col("store_id"))).alias("before"))
    added = F.array_join(F.array_sort(F.array_except("now", "before")).cast("array<string>"), ",")
    return sets.select("master_id", F.when(added != "", added).alias("added"))


@query("token_overlap", "U3", """select l.listing_id, len(list_intersect(l.core_tokens, r.core_tokens)) / least(len(list_distinct(l.core_tokens)), len(list_distinct(r.core_tokens)))::double as containment,
    len(list_intersect(l.core_tokens, r.core_tokens)) / len(list_distinct(list_concat(l.core_tokens, r.core_tokens)))::double as jaccard
  from v_sig_names l join v_sig_names r on r.listing_id = l.listing_id + 1""")
def token_overlap(t):
    from pricetide.functions.text import core_tokens

    base = t.v_names.select("listing_id", core_tokens(F.col("name")).alias("tokens"))
    right = base.select((F.col("listing_id") - 1).alias("listing_id"), F.col("tokens").alias("other"))
    shared = F.size(F.array_intersect("tokens", "other"))
    return base.join(right, "listing_id").select(
        "listing_id", (shared / F.least(F.size(F.array_distinct("tokens")), F.size(F.array_distinct("other")))).alias("containment"), (shared / F.size(F.array_union("tokens", "other"))).alias("jaccard"))
