"""Comparison, personal prices and opportunity reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.functions import scoring as K
from pricetide.operators import comparison as C
from pricetide.operators import opportunity as O
from pricetide.operators import personal as R
from pricetide.session import materialize

from .q_history import as_of, context_stats, master_stats, recent_runs
from .q_matching import _PAIR_FACTS, score, sequence_score
from .registry import ORACLE_VIEWS, query
from .views import AS_OF

# Half-even rounding to one decimal of the decimal text of a double, as Spark's bround does it.
ROUND1 = (
    "lambda d: (floor(d * 10) + case when d * 10 - floor(d * 10) > 0.5 then 1 "
    "when d * 10 - floor(d * 10) = 0.5 and floor(d * 10) % 2 = 1 then 1 else 0 end)::double / 10"
)


def _verified(scored):
    """Per product: are all its offers one product, and how sure is that?"""
    return f"""select master_id, bool_and(ok) as verified, min(c) as confidence from (
        select master_id, case when label in ('excluded_pack', 'volume_conflict', 'vintage_conflict', 'abv_conflict') then false when trusted then true
            else confidence >= 0.86 end as ok,
          case when trusted then least(ls, rs) else least(confidence, coalesce(ls, confidence), coalesce(rs, confidence)) end as c
        from ({scored})) group by 1"""


ORACLE_VIEWS.update(
    v_best_public="select * from v_public_quote qualify row_number() over (partition by listing_id order by price, case when price_type = 'SALE' then 0 else 1 end, audience_key) = 1",
    v_products="""select l.listing_id, l.store_id, l.master_id, s.name as store_name, l.name, l.url, trim(l.ean) as ean, l.last_seen_at,
        coalesce(q.price, l.current_price) as price, g.* exclude (listing_id, source_name), l.is_available
      from v_listings l join v_stores s using (store_id) left join v_best_public q using (listing_id) join v_sig_listings g using (listing_id)
      where s.is_active and s.comparison_enabled and not l.excluded_from_comparison and l.package_quantity = 1 and not g.is_pack
        and (not s.personal_comparison_enabled or q.price is not null)
        and l.listing_id in (select listing_id from v_obs where run_id in (select run_id from v_recent_runs))""",
    v_offers_all="""select p.* from v_products p join v_masters m using (master_id) where m.package_quantity = 1
      qualify row_number() over (partition by p.master_id, p.store_id order by p.price, p.listing_id) = 1""",
    v_offers="select * from v_offers_all qualify count(*) over (partition by master_id) >= 2",
    v_ranked="""select master_id, max(n) as offer_count, max(listing_id) filter (rn = 1) as winner_listing_id, max(store_id) filter (rn = 1) as winner_store_id,
        max(store_name) filter (rn = 1) as winner_store_name, max(price) filter (rn = 1) as winner_price, max(store_id) filter (rn = 2) as runner_store_id,
        max(price) filter (rn = 2) as runner_price, count(nullif(ean, '')) = count(*) and count(distinct nullif(ean, '')) = 1 as one_ean, max(last_seen_at) filter (rn = 1) as seen
      from (select *, row_number() over (partition by master_id order by price, lower(store_name), listing_id) as rn, count(*) over (partition by master_id) as n from v_offers) group by 1""",
    v_pair_facts=f"""select l.master_id, l.listing_id as a, r.listing_id as b, ml.confidence as ls, mr.confidence as rs,
        coalesce(ml.master_id = mr.master_id, false) as trusted, {_PAIR_FACTS}
      from v_offers l join v_offers r on l.master_id = r.master_id and l.listing_id < r.listing_id
      left join v_matches ml on ml.listing_id = l.listing_id left join v_matches mr on mr.listing_id = r.listing_id""",
    v_verified=_verified(score("v_pair_facts")),
    v_seq_verified=_verified(sequence_score("v_pair_seq", "v_pair_facts")),
    v_prev_winner="""select master_id, store_id as previous_winner_store_id, store_name as previous_winner_store_name from (
        select o.master_id, o.store_id, o.store_name, previous_price, row_number() over w as rn, lead(previous_price) over w as next_price
        from v_offers o join v_previous using (listing_id) window w as (partition by o.master_id order by previous_price, lower(o.store_name), o.listing_id))
      where rn = 1 and previous_price < next_price""",
)

_HOURS = f"epoch(timestamp '{AS_OF}' - seen) / 3600"
_POSITION = """case when min_90d <> 0 and winner_price <= min_90d then greatest(p0, 0.95::double) else p0 end"""


def _money(c):
    return f"('$' || replace(format('{{:,}}', ({c})::bigint), ',', '.'))"


def _percent(c, digits):
    return f"(format('{{:.{digits}f}}', ({c}) * 100) || '%')"


ORACLE_VIEWS["v_comparison"] = f"""
  with base as (select r.*, v.confidence, v.verified and not coalesce(r.runner_price / r.winner_price::double >= 4.0 and not r.one_ean, false) as ok,
      r.winner_price = r.runner_price as is_tie from v_ranked r join v_verified v using (master_id)),
  c1 as (select b.*, p.previous_winner_store_id, p.previous_winner_store_name, pv.previous_price as winner_previous_price, s.* exclude (master_id), m.previous_historical_min,
      case when is_tie then 0 else runner_price - winner_price end as saving, case when is_tie then 0.0 else (runner_price - winner_price) / runner_price::double end as saving_pct,
      case when coalesce(s.observations_90d, 0) > 0 then s.low_price_frequency_90d end as freq,
      case when s.avg_90d > 0 then greatest(0.0::double, least(1.0::double, ((s.avg_90d - winner_price) / s.avg_90d) / 0.25::double)) else 0.0 end as p0
    from base b left join v_prev_winner p using (master_id) left join v_previous pv on pv.listing_id = b.winner_listing_id
    left join v_stats s using (master_id) left join v_previous_min m using (master_id) where ok),
  c2 as (select *, case when is_tie then 0.0 else {_POSITION} end as history_position,
      case when is_tie then 0.0 when {_HOURS} <= 12 then 1.0::double when {_HOURS} <= 24 then 0.8::double when {_HOURS} <= 48 then 0.5::double else 0.2::double end as freshness,
      case when is_tie then 0.0 else greatest(0.0::double, least(1.0::double, (7 - offer_count) / 5.0::double)) end as scarcity from c1),
  c3 as (select *, case when is_tie or freq is null or observations_90d < 6 then 0.0 else greatest(0.0::double, least(1.0::double, (1.0::double - freq) * history_position)) end as rarity from c2),
  c4 as (select *, case when is_tie then 0.0 else list_transform([(100.0::double * (0.30::double * least(1.0::double, saving_pct / 0.30::double) + 0.25::double * history_position + 0.15::double * rarity
      + 0.15::double * confidence + 0.10::double * freshness + 0.05::double * scarcity))::varchar::decimal(28,17)], {ROUND1})[1] end as score,
      case when is_tie then 'NORMAL' when previous_historical_min <> 0 and winner_price > 0 and winner_price < previous_historical_min then 'NEW_HISTORICAL_MIN'
        when observations_90d >= 6 and freq <= 0.15 and rarity >= 0.70 then 'RARE_OFFER'
        when historical_min <> 0 and winner_price > 0 and winner_price <= historical_min then 'AT_HISTORICAL_MIN'
        when historical_min <> 0 and winner_price > historical_min and (winner_price - historical_min) / historical_min::double <= 0.03 then 'NEAR_HISTORICAL_MIN'
        when saving_pct >= 0.15 then 'MARKET_LEADER' else 'NORMAL' end as price_event from c3)
  select master_id, m.canonical_name, m.volume_ml, offer_count, is_tie, case when not is_tie then winner_store_name end as winner_store_name, previous_winner_store_name, min_90d, avg_90d, median_90d,
    coalesce(days_at_current_price, 0) as days_at_current_price, 'v2' as score_version, case price_event
      when 'NEW_HISTORICAL_MIN' then 'nuevo mínimo histórico: ' || {_money('winner_price')} || ' queda ' || {_money('previous_historical_min - winner_price')} || ' (' || {_percent('(previous_historical_min - winner_price) / previous_historical_min::double', 1)} || ') bajo el mínimo anterior de ' || {_money('previous_historical_min')}
      when 'RARE_OFFER' then 'oferta poco frecuente: sólo ' || {_percent('freq', 0)} || ' de ' || observations_90d || ' observaciones de 90 días estuvieron en la zona del mínimo (hasta 5% sobre el piso)'
      when 'AT_HISTORICAL_MIN' then 'precio actual iguala el mínimo histórico de ' || {_money('historical_min')}
      when 'NEAR_HISTORICAL_MIN' then 'precio a ' || {_percent('(winner_price - historical_min) / historical_min::double', 1)} || ' del mínimo histórico de ' || {_money('historical_min')}
      when 'MARKET_LEADER' then 'líder de mercado con ' || {_percent('saving_pct', 1)} || ' de ventaja frente al segundo precio' else 'sin señal comercial excepcional' end as intelligence_reason,
    case when not is_tie then winner_listing_id end as winner_listing_id, case when not is_tie then winner_store_id end as winner_store_id,
    case when not is_tie then winner_price end as winner_price, case when not is_tie then runner_store_id end as runner_store_id, case when not is_tie then runner_price end as runner_price,
    saving, saving_pct, confidence, previous_winner_store_id, not is_tie and coalesce(winner_store_id <> previous_winner_store_id, false) as winner_changed,
    case when not is_tie then winner_previous_price end as winner_previous_price, historical_min, previous_historical_min, coalesce(observations_90d, 0) as observations_90d, score,
    case when score >= 90 then 'Excelente' when score >= 80 then 'Muy buena' when score >= 70 then 'Buena' when score >= 55 then 'Normal' else 'No destacada' end as classification,
    history_position, freshness, scarcity, rarity, freq as rarity_frequency_90d, price_event,
    case when price_event = 'NEW_HISTORICAL_MIN' then previous_historical_min - winner_price else 0 end as historical_gap,
    case when price_event = 'NEW_HISTORICAL_MIN' then (previous_historical_min - winner_price) / previous_historical_min::double else 0.0 end as historical_gap_pct
  from c4 left join v_masters m using (master_id)"""
ORACLE_VIEWS["v_seq_comparison"] = ORACLE_VIEWS["v_comparison"].replace("v_verified", "v_seq_verified")

def compare(t, similarity="levenshtein"):
    return C.PriceComparison(
        t.v_listings, t.v_stores, t.v_quotes, t.v_obs, t.v_matches, t.v_masters, materialize(master_stats(t)), recent_runs(t), as_of(),
        similarity=similarity)


@query("price_comparison", "C9 J14", "select * from v_comparison")
def price_comparison(t):
    return compare(t).result


@query("price_comparison_sequence", "C9 J14", "select * from v_seq_comparison")
def price_comparison_sequence(t):
    return compare(t, "sequence").result


@query("opportunities", "C9", "select master_id, score, saving, saving_pct from v_comparison where not is_tie and saving > 0")
def opportunities(t):
    return compare(t).opportunities().select("master_id", "score", "saving", "saving_pct")


@query("comparison_summary", "A18", """
  select (select count(*) from v_products) as current_products, (select count(distinct master_id) from v_products) as master_groups,
    (select count(*) from v_comparison) as verified_matches, (select count(*) from v_comparison where is_tie) as ties,
    (select count(*) from v_ranked) - (select count(*) from v_comparison) + (select count(distinct master_id) from v_products join v_masters m using (master_id) where m.package_quantity > 1) as unverified_groups,
    (select count(*) from v_comparison where not is_tie and saving > 0) as opportunities,
    (select count(*) from v_comparison where not is_tie and saving > 0 and winner_changed) as winner_changes""")
def comparison_summary(t):
    return compare(t).summary()


@query("winner_changes", "C15", "select master_id, previous_winner_store_id, winner_store_id, saving from v_comparison where not is_tie and saving > 0 and winner_changed")
def winner_changes(t):
    return compare(t).winner_changes().select("master_id", "previous_winner_store_id", "winner_store_id", "saving")


def comparable_offers(t):
    return t.v_listings.where("is_available and current_price > 0").join(
        t.v_stores.select("store_id", F.col("name").alias("store_name")), "store_id").select(
        "master_id", "store_id", "listing_id", "store_name", F.col("current_price").alias("price"))


ORACLE_VIEWS["v_simple_offers"] = """select l.master_id, l.store_id, l.listing_id, s.name as store_name, l.current_price as price from v_listings l join v_stores s using (store_id)
  where is_available and current_price > 0 qualify row_number() over (partition by l.master_id, l.store_id order by current_price, l.listing_id) = 1"""


@query("cheapest_per_store", "W1", "select * from v_simple_offers")
def cheapest_per_store(t):
    return C.cheapest_per_store(comparable_offers(t))


@query("winner_and_runner_up", "W2", """
  select master_id, n as offer_count, coalesce(price = next_price, false) as is_tie, case when not coalesce(price = next_price, false) then listing_id end as winner_listing_id,
    case when price < next_price then next_price - price else 0 end as saving, case when price < next_price then (next_price - price) / next_price::double else 0.0 end as saving_pct
  from (select *, row_number() over w as rn, lead(price) over w as next_price, count(*) over (partition by master_id) as n from v_simple_offers
    window w as (partition by master_id order by price, lower(store_name), listing_id)) where rn = 1""")
def winner_and_runner_up(t):
    ranked = C.winner_and_runner_up(C.cheapest_per_store(comparable_offers(t)))
    return ranked.select("master_id", "offer_count", "is_tie", F.col("winner.listing_id").alias("winner_listing_id"), "saving", "saving_pct")


@query("previous_winner", "W5", """select master_id, store_id as previous_winner_store_id, store_name as previous_winner_store_name from (
    select o.master_id, o.store_id, o.store_name, previous_price, row_number() over w as rn, lead(previous_price) over w as next_price
    from v_simple_offers o join v_previous using (listing_id) window w as (partition by o.master_id order by previous_price, lower(o.store_name), o.listing_id))
  where rn = 1 and previous_price < next_price""")
def previous_winner(t):
    from pricetide.operators.history import previous_prices

    return C.previous_winner(C.cheapest_per_store(comparable_offers(t)), previous_prices(t.v_obs, recent_runs(t)))


_ALLOWED = "is_active and price > 0 and (not eligibility_required or audience_key = 'cav_member')"
ORACLE_VIEWS["v_best_quote"] = f"""select * from v_quotes where {_ALLOWED} qualify row_number() over (partition by listing_id
  order by price, case price_type when 'MEMBER' then 0 when 'SALE' then 1 when 'PUBLIC' then 2 else 4 end, audience_key) = 1"""


@query("best_quote", "W3", "select listing_id, price, price_type, audience_key from v_best_quote")
def best_quote(t):
    return R.best_quote(t.v_quotes).select("listing_id", "quote.price", "quote.price_type", "quote.audience_key")


_SEEN = f"epoch(timestamp '{AS_OF}' - last_seen_at) / 3600"
ORACLE_VIEWS["v_personal"] = f"""
  with base as (select l.listing_id, l.store_id, l.master_id, l.current_price, l.last_seen_at, s.name as store_name, s.comparison_enabled, s.personal_comparison_enabled
      from v_listings l join v_stores s using (store_id) where s.is_active and (comparison_enabled or personal_comparison_enabled) and is_available
        and not excluded_from_comparison and package_quantity = 1 and listing_id in (select listing_id from v_quotes where is_active)),
  off as (select b.*, q.price, q.price_type, q.audience_key, coalesce(m.confidence, 1.0) as conf,
      case when {_SEEN} <= 6 then 1.0::double when {_SEEN} <= 24 then 0.9::double when {_SEEN} <= 72 then 0.7::double else 0.4::double end as fresh
    from base b join v_best_quote q using (listing_id) left join v_matches m using (listing_id)),
  two as (select * from (select *, row_number() over w as rn, count(*) over (partition by master_id) as n, lead(price) over w as next_price, lead(conf) over w as next_conf,
      lead(fresh) over w as next_fresh from off window w as (partition by master_id order by price, lower(store_name), listing_id)) where rn = 1 and n >= 2),
  ref as (select master_id, min(coalesce(q.p, case when not personal_comparison_enabled and current_price > 0 then current_price end)) as public_reference_price
    from base left join (select listing_id, min(price) as p from v_public_quote group by 1) q using (listing_id) where comparison_enabled group by 1),
  x as (select two.*, ref.public_reference_price as pub, s.avg_90d, s.min_90d, next_price - price as saving, (next_price - price) / next_price::double as saving_pct,
      coalesce(greatest(0, ref.public_reference_price - price), 0) as personal_advantage,
      case when s.avg_90d > 0 then greatest(0.0::double, least(1.0::double, case when s.min_90d <> 0 and price <= s.min_90d
          then greatest(1.0::double, 0.5::double + ((s.avg_90d - price) / s.avg_90d) / 0.30::double) else 0.5::double + ((s.avg_90d - price) / s.avg_90d) / 0.30::double end)) else 0.5 end as history_position,
      least(conf, next_conf) as match_confidence, least(fresh, next_fresh) as freshness, greatest(0.0::double, least(1.0::double, (7 - n) / 5.0::double)) as scarcity
    from two left join ref using (master_id) left join v_context_stats s on s.listing_id = two.listing_id and s.price_type = two.price_type and s.audience_key = two.audience_key),
  y as (select *, list_transform([(100.0::double * (0.35::double * least(1.0::double, saving_pct / 0.30::double) + 0.30::double * history_position + 0.15::double * match_confidence + 0.10::double * freshness + 0.10::double * scarcity))::varchar::decimal(28,17)], {ROUND1})[1] as score from x)
  select master_id, score, case when score >= 90 then 'Excelente' when score >= 80 then 'Muy buena' when score >= 70 then 'Buena' when score >= 55 then 'Normal' else 'No destacada' end as classification,
    listing_id as winner_listing_id, store_id as winner_store_id, price as winner_price, price_type as winner_price_type, audience_key as winner_audience_key, saving, saving_pct,
    pub as public_reference_price, personal_advantage, case when pub <> 0 then personal_advantage / pub::double else 0.0 end as personal_advantage_pct,
    history_position, match_confidence, freshness, scarcity from y"""


def personal(t):
    return R.personal_opportunities(t.v_listings, t.v_stores, t.v_quotes, t.v_matches, context_stats(t), as_of())


@query("personal_opportunities", "C10", "select * from v_personal")
def personal_opportunities(t):
    return personal(t)


@query("personal_history_view", "Q7", """select master_id, winner_price, winner_price_type, s.min_30d, s.avg_30d, s.min_90d, s.avg_90d, s.historical_min, s.days_at_current_price,
    public_reference_price, personal_advantage, personal_advantage_pct, case when s.avg_90d > 0 then (winner_price - s.avg_90d) / s.avg_90d end as vs_avg_90d
  from v_personal p left join v_context_stats s on s.listing_id = p.winner_listing_id and s.price_type = p.winner_price_type and s.audience_key = p.winner_audience_key""")
def personal_history_view(t):
    return R.personal_history_view(personal(t), context_stats(t))


# Score formulas on every observation: components derived from its own columns.
_COMPONENTS = "price % 97 / 48.0::double as a, discount_pct * 3 as b, price % 13 / 12.0::double as c, price % 7 / 6.0::double as d, price % 5 / 4.0::double as e, price % 11 / 10.0::double as f"
_U = "greatest(0.0::double, least(1.0::double, {0}))"


def components(t):
    p = F.col("price")
    return t.v_obs.select("obs_id", "price", (p % 97 / 48.0).alias("a"), (F.col("discount_pct") * 3).alias("b"), (p % 13 / 12.0).alias("c"),
                          (p % 7 / 6.0).alias("d"), (p % 5 / 4.0).alias("e"), (p % 11 / 10.0).alias("f"))


@query("opportunity_scores", "C1 C2 C3", f"""select obs_id, v1, v2, case when v2 >= 90 then 'Excelente' when v2 >= 80 then 'Muy buena' when v2 >= 70 then 'Buena' when v2 >= 55 then 'Normal' else 'No destacada' end as classification
  from (select obs_id, list_transform([(100.0::double * (0.35::double * {_U.format('a')} + 0.30::double * {_U.format('b')} + 0.15::double * {_U.format('c')} + 0.10::double * {_U.format('d')} + 0.10::double * {_U.format('e')}))::varchar::decimal(28,17)], {ROUND1})[1] as v1,
    list_transform([(100.0::double * (0.30::double * {_U.format('a')} + 0.25::double * {_U.format('b')} + 0.15::double * {_U.format('f')} + 0.15::double * {_U.format('c')} + 0.10::double * {_U.format('d')} + 0.05::double * {_U.format('e')}))::varchar::decimal(28,17)], {ROUND1})[1] as v2
    from (select obs_id, {_COMPONENTS} from v_obs))""")
def opportunity_scores(t):
    c = F.col
    return components(t).select(
        "obs_id",
        K.opportunity_score_v1(market_saving=c("a"), history_position=c("b"), match_confidence=c("c"), freshness=c("d"), scarcity=c("e")).alias("v1"),
        K.opportunity_score_v2(market_saving=c("a"), history_position=c("b"), rarity=c("f"), match_confidence=c("c"), freshness=c("d"), scarcity=c("e")).alias("v2"),
    ).withColumn("classification", K.classify_opportunity(c("v2")))


@query("score_components", "C4 C5 C6 C7", f"""
  select listing_id, case when min_90d <> 0 and price <= min_90d then greatest(p0, 0.95) else p0 end as public_position,
    case when avg_90d > 0 then {_U.format('case when min_90d <> 0 and price <= min_90d then greatest(q0, 1.0::double) else q0 end')} else 0.5 end as personal_position,
    case when {_SEEN} <= 12 then 1.0::double when {_SEEN} <= 24 then 0.8::double when {_SEEN} <= 48 then 0.5::double else 0.2::double end as public_freshness,
    case when {_SEEN} <= 6 then 1.0::double when {_SEEN} <= 24 then 0.9::double when {_SEEN} <= 72 then 0.7::double else 0.4::double end as personal_freshness,
    {_U.format('(7 - listing_id % 9) / 5.0::double')} as scarcity,
    case when observations_90d >= 6 then {_U.format('(1.0::double - low_price_frequency_90d) * p0')} else 0.0 end as rarity
  from (select listing_id, current_price as price, last_seen_at, s.*, case when avg_90d > 0 then {_U.format('((avg_90d - current_price) / avg_90d) / 0.25::double')} else 0.0 end as p0,
    0.5::double + ((avg_90d - current_price) / avg_90d) / 0.30::double as q0 from v_listings l join v_stats s using (master_id))""")
def score_components(t):
    joined = t.v_listings.join(master_stats(t), "master_id")
    p, avg, low = F.col("current_price"), F.col("avg_90d"), F.col("min_90d")
    base = F.when(avg > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((avg - p) / avg) / 0.25))).otherwise(0.0)
    return joined.select(
        "listing_id", K.history_position(p, avg, low).alias("public_position"), K.personal_history_position(p, avg, low).alias("personal_position"),
        K.freshness(as_of(), F.col("last_seen_at")).alias("public_freshness"),
        K.freshness(as_of(), F.col("last_seen_at"), K.PERSONAL_FRESHNESS, K.PERSONAL_STALE).alias("personal_freshness"),
        K.scarcity(F.col("listing_id") % 9).alias("scarcity"),
        K.rarity(F.col("low_price_frequency_90d"), base, F.col("observations_90d")).alias("rarity"))


@query("commercial_signal", "C8", """
  select listing_id, price_event, case when price_event = 'NEW_HISTORICAL_MIN' then prev - price else 0 end as historical_gap,
    case when price_event = 'NEW_HISTORICAL_MIN' then (prev - price) / prev::double else 0.0 end as historical_gap_pct
  from (select listing_id, price, prev, case when prev <> 0 and price > 0 and price < prev then 'NEW_HISTORICAL_MIN'
      when observations_90d >= 6 and freq <= 0.15 and listing_id % 10 / 10.0::double >= 0.7 then 'RARE_OFFER'
      when historical_min <> 0 and price > 0 and price <= historical_min then 'AT_HISTORICAL_MIN'
      when historical_min <> 0 and price > historical_min and (price - historical_min) / historical_min::double <= 0.03 then 'NEAR_HISTORICAL_MIN'
      when discount_pct >= 0.06 then 'MARKET_LEADER' else 'NORMAL' end as price_event
    from (select listing_id, current_price as price, discount_pct, previous_historical_min as prev, historical_min, observations_90d, low_price_frequency_90d as freq
      from v_listings join v_stats using (master_id) left join v_previous_min using (master_id)))""")
def commercial_signal(t):
    from pricetide.operators.history import previous_historical_min

    from .q_history import pobs

    joined = t.v_listings.join(master_stats(t), "master_id").join(previous_historical_min(pobs(t), recent_runs(t)), "master_id", "left")
    saving = F.when(F.col("discount_pct") >= 0.06, 0.2).otherwise(0.0)
    signal = K.commercial_signal(F.col("current_price"), F.col("previous_historical_min"), F.col("historical_min"), F.col("observations_90d"),
                                 F.col("low_price_frequency_90d"), F.col("listing_id") % 10 / 10.0, saving)
    signal.pop("intelligence_reason")
    return joined.select("listing_id", *[c.alias(n) for n, c in signal.items()])


# Snapshots of every product for the reports: listing facts stand in for the scores.
ORACLE_VIEWS["v_snapshots"] = """select master_id, score, saving, saving / 1000.0::double as saving_pct, winner_listing_id, winner_store_id, winner_price,
    case master_id % 6 when 0 then 'NEW_HISTORICAL_MIN' when 1 then 'RARE_OFFER' when 2 then 'AT_HISTORICAL_MIN' when 3 then 'NEAR_HISTORICAL_MIN' when 4 then 'MARKET_LEADER' else 'NORMAL' end as price_event,
    master_id % 17 / 100.0::double as historical_gap_pct from (
    select master_id, winner_price % 600 / 10.0::double + 35 as score, winner_price % 300 as saving, winner_listing_id, winner_store_id, winner_price from (
      select master_id, listing_id as winner_listing_id, store_id as winner_store_id, price as winner_price from v_simple_offers
      qualify row_number() over (partition by master_id order by price, lower(store_name), listing_id) = 1))"""
ORACLE_VIEWS["v_views"] = """select n.*, m.canonical_name as display_name, s.name as winner_store, st.historical_min, st.observations_total from v_snapshots n join v_masters m using (master_id)
  join v_listings l on l.listing_id = n.winner_listing_id join v_stores s on s.store_id = n.winner_store_id join v_sig_listings g on g.listing_id = n.winner_listing_id
  left join v_stats st on st.master_id = n.master_id
  where m.package_quantity = 1 and l.is_available and not l.excluded_from_comparison and l.package_quantity = 1 and s.is_active and not g.is_pack"""


def snapshots(t):
    top = C.winner_and_runner_up(C.cheapest_per_store(comparable_offers(t)), ties_have_winner=True)
    m, price = F.col("master_id") % 6, F.col("winner.price")
    event = F
    for i, name in enumerate(K.SIGNALS):
        event = event.when(m == i, name)
    return top.select(
        "master_id", (price % 600 / 10.0 + 35).alias("score"), (price % 300).alias("saving"), (price % 300 / 1000.0).alias("saving_pct"),
        F.col("winner.listing_id").alias("winner_listing_id"), F.col("winner.store_id").alias("winner_store_id"), price.alias("winner_price"),
        event.otherwise("NORMAL").alias("price_event"), (F.col("master_id") % 17 / 100.0).alias("historical_gap_pct"))


def views(t):
    return O.opportunity_views(snapshots(t), t.v_masters, t.v_listings, t.v_stores, master_stats(t))


@query("opportunity_views", "J2", "select master_id, score, winner_store, winner_price, historical_min, observations_total from v_views")
def opportunity_views(t):
    return views(t).select("master_id", "score", "winner_store", "winner_price", "historical_min", "observations_total")


@query("top_opportunities", "C11", "select master_id, score, saving_pct from v_views where score >= 40 order by score desc, saving_pct desc, display_name, master_id limit 20")
def top_opportunities(t):
    return O.top_opportunities(views(t), 20, 40.0).select("master_id", "score", "saving_pct")


@query("top_opportunities_by_saving", "C11", "select master_id, score, saving_pct from v_views order by saving_pct desc, saving desc, display_name, master_id limit 10")
def top_opportunities_by_saving(t):
    return O.top_opportunities(views(t), 10, 0.0, "saving").select("master_id", "score", "saving_pct")


_TIERED = """with x as (select *, {tier} as tier from v_views) select master_id, score, tier from x where tier = (select min(tier) from x) order by {order} limit 10"""


@query("commercial_radar", "C12", _TIERED.format(tier="case when price_event <> 'NORMAL' and score >= 70 then 1 when score >= 55 then 2 when score >= 0 then 3 end",
                                                 order="score desc, saving_pct desc, display_name, master_id"))
def commercial_radar(t):
    return O.commercial_radar(views(t)).select("master_id", "score", "tier")


@query("historical_floors", "C13", _TIERED.format(
    tier="case when price_event in ('NEW_HISTORICAL_MIN', 'AT_HISTORICAL_MIN', 'NEAR_HISTORICAL_MIN') then 1 when historical_min > 0 and observations_total >= 2 then 2 end",
    order="historical_gap_pct desc, score desc, display_name, master_id"))
def historical_floors(t):
    return O.historical_floors(views(t)).select("master_id", "score", "tier")


@query("historical_floors_fallback", "C13", """select master_id, score, 2 as tier from v_views where historical_min > 0 and observations_total >= 2
  order by abs((winner_price - historical_min) / historical_min::double), score desc, display_name, master_id limit 10""")
def historical_floors_fallback(t):
    return O.historical_floors(views(t).withColumn("price_event", F.lit("NORMAL"))).select("master_id", "score", "tier")


@query("top_personal_opportunities", "C14", """select p.master_id, p.score, p.personal_advantage_pct from v_personal p join v_masters m using (master_id) join v_sig_listings g on g.listing_id = p.winner_listing_id
  where m.package_quantity = 1 and not g.is_pack and p.score >= 30 order by p.score desc, p.personal_advantage_pct desc, p.saving_pct desc, p.master_id limit 20""")
def top_personal_opportunities(t):
    shown = O.opportunity_views(personal(t), t.v_masters, t.v_listings, t.v_stores)
    return O.top_personal_opportunities(shown, 20, 30.0).select("master_id", "score", "personal_advantage_pct")


ORACLE_VIEWS["v_shop_offers"] = """select l.listing_id, l.master_id, l.store_id, s.name as store_name, coalesce(q.price, l.current_price) as price,
    case when q.listing_id is not null then q.price_type when l.regular_price > l.current_price then 'SALE' else 'PUBLIC' end as price_type
  from v_listings l join v_stores s using (store_id) left join v_best_public q using (listing_id) where q.listing_id is not null or not s.personal_comparison_enabled"""


@query("public_offer", "Q3", "select listing_id, price, price_type from v_shop_offers")
def public_offer(t):
    return R.shop_offers(t.v_listings, t.v_stores, t.v_quotes).select("listing_id", "price", "price_type")


@query("personal_offer", "Q3", """select l.listing_id, coalesce(b.price, o.price) as price, coalesce(b.price_type, o.price_type) as price_type,
    case when b.listing_id is null then true else s.comparison_enabled and not b.eligibility_required end as is_public_market
  from v_listings l join v_stores s using (store_id) left join v_best_quote b using (listing_id) left join v_shop_offers o using (listing_id) where coalesce(b.price, o.price) is not null""")
def personal_offer(t):
    return R.shop_offers(t.v_listings, t.v_stores, t.v_quotes, "personal").select("listing_id", "price", "price_type", "is_public_market")


# Collected listings with their quotes nested, as a collector would hand them over.
def collected(t):
    quotes = t.v_quotes.groupBy("listing_id").agg(F.collect_list(F.struct("price", "regular_price", "price_type", "audience_key", "eligibility_required")).alias("price_quotes"))
    return t.v_listings.join(quotes, "listing_id")


@query("member_projection", "C16", """select m.listing_id, m.price as current_price, case when r > m.price then r end as regular_price, case when r > m.price then (r - m.price) / r::double else 0.0 end as discount_pct
  from (select q.listing_id, q.price, coalesce(nullif(q.regular_price, 0), (select min(price) from v_quotes p where p.listing_id = q.listing_id and p.price_type = 'PUBLIC' and p.price > 0)) as r
    from v_quotes q where price_type = 'MEMBER' and audience_key = 'cav_member' and price > 0) m""")
def member_projection(t):
    changes = collected(t).withColumn("previous_price", F.lit(1).cast("bigint"))
    return R.member_projection(changes).select("listing_id", "current_price", "regular_price", "discount_pct")
