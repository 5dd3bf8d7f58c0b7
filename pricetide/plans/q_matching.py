"""Entity resolution over the whole catalog (every part in every shop)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.functions import signature as S
from pricetide.operators import matching as M
from pricetide.session import materialize

from . import duck_text as D
from .registry import ORACLE_VIEWS, query

_CATALOG = "(select * from v_sig_catalog where not excluded_from_comparison)"


def lev(a, b):
    return f"(1.0::double - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::double)"


def conflict(l, r):
    return f"""case when {l}.is_pack or {r}.is_pack then 'excluded_pack'
      when {l}.volume_ml is null or {r}.volume_ml is null then 'unknown_volume'
      when {l}.volume_ml <> {r}.volume_ml then 'volume_conflict'
      when {l}.vintage_year <> {r}.vintage_year then 'vintage_conflict'
      when abs({l}.abv_pct - {r}.abv_pct) > 1.5 then 'abv_conflict'
      when len({l}.core_tokens) = 0 or len({r}.core_tokens) = 0 then 'empty_signature'
      when {l}.brand <> {r}.brand then 'brand_conflict'
      when len({l}.variant_tokens) > 0 and len({r}.variant_tokens) > 0 and {l}.variant_tokens <> {r}.variant_tokens then 'variant_conflict'
      when not list_has_any({l}.core_tokens, {r}.core_tokens) then 'no_overlap'
      when {l}.core_key = {r}.core_key then 'alias_exact' end"""


def confidence(source, ordered, by_key):
    """Confidence of rows that carry ``label``, word counts and the two ratios of both sides' texts."""
    return f"""select *, case when label = 'alias_exact' then 1.0 when label is not null then 0.0 else
        greatest(0.0::double, least(0.999::double, (case when shared = least(nl, nr) and least(nl, nr) >= 2 then greatest(raw, 0.92) else raw end)
          - case when shared < 2 and least(nl, nr) > 1 then 0.1 else 0.0 end
          + case when same_vintage then 0.02 else 0.0 end + case when close_abv then 0.015 else 0.0 end)) end as confidence
      from (select *, 0.5::double * (shared / least(nl, nr)::double) + 0.25::double * (shared / (nl + nr - shared)::double)
          + 0.25::double * greatest({ordered}, {by_key}) as raw from {source})"""


def score(source):
    return confidence(source, lev("tl", "tr"), lev("kl", "kr"))


def sequence_score(view, source):
    """The same with the ratio of longest common blocks: adds the views it needs under the name ``view``."""
    ORACLE_VIEWS[view + "_facts"] = f"select * from {source}"
    ORACLE_VIEWS[view + "_ratio"] = D.sequence_ratios(f"select tl as a, tr as b from {view}_facts where label is null union all select kl, kr from {view}_facts where label is null")
    joined = f"(select f.*, x.ratio as ordered_ratio, y.ratio as key_ratio from {view}_facts f left join {view}_ratio x on x.a = tl and x.b = tr left join {view}_ratio y on y.a = kl and y.b = kr)"
    return confidence(joined, "ordered_ratio", "key_ratio")


def edges_of(scored, best):
    """Edges that are the clear best from both sides."""
    return f"""select s.left_id, s.right_id, s.confidence, case when label = 'alias_exact' then label else 'fuzzy_brand_variant_volume' end as method
      from {scored} s join {best} a on a.id = s.left_id and a.best = s.right_id and not a.ambiguous
      join {best} b on b.id = s.right_id and b.best = s.left_id and not b.ambiguous where s.confidence >= 0.86"""


def best_of(scored):
    """Best counterpart of a listing in every other shop."""
    return f"""select id, other_store, max(other) filter (rn = 1) as best, max(confidence) filter (rn = 1) as confidence,
        max(other) filter (rn = 2) as runner_id, max(confidence) filter (rn = 2) as runner_confidence,
        coalesce(max(confidence) filter (rn = 1) - max(confidence) filter (rn = 2) < 0.015, false) as ambiguous
      from (select *, row_number() over (partition by id, other_store order by confidence desc, other) as rn from (
        select left_id as id, right_id as other, right_store as other_store, confidence from {scored} where confidence >= 0.86
        union all select right_id, left_id, left_store, confidence from {scored} where confidence >= 0.86)) where rn <= 2 group by 1, 2"""


_PAIR_FACTS = f"""{conflict('l', 'r')} as label, len(list_intersect(l.core_tokens, r.core_tokens)) as shared,
  len(list_distinct(l.core_tokens)) as nl, len(list_distinct(r.core_tokens)) as nr,
  array_to_string(l.core_tokens, ' ') as tl, array_to_string(r.core_tokens, ' ') as tr, l.core_key as kl, r.core_key as kr,
  coalesce(l.vintage_year = r.vintage_year, false) as same_vintage, coalesce(abs(l.abv_pct - r.abv_pct) <= 0.2, false) as close_abv"""

_BLOCK_FACTS = f"""(select l.listing_id as left_id, r.listing_id as right_id, l.store_id as left_store, r.store_id as right_store,
        l.brand = r.brand as same_brand, {_PAIR_FACTS}
      from {_CATALOG} l join {_CATALOG} r on l.store_id < r.store_id and l.volume_ml = r.volume_ml and l.brand = r.brand
      where not l.is_pack and not r.is_pack)"""
ORACLE_VIEWS.update(
    v_scored=score(_BLOCK_FACTS), v_best=best_of("v_scored"), v_edges=edges_of("v_scored", "v_best"),
    v_seq_scored=sequence_score("v_seq", _BLOCK_FACTS), v_seq_best=best_of("v_seq_scored"), v_seq_edges=edges_of("v_seq_scored", "v_seq_best"),
)


def listings(t):
    return t.v_catalog.where("not excluded_from_comparison")


def plan(t, similarity="levenshtein"):
    return M.MatchPlan(listings(t), similarity=similarity)


# Neighbouring shops' listings of one part: a pair list that grows with the catalog.
_NEIGHBOURS = "select l.listing_id as left_id, r.listing_id as right_id, {facts} from v_sig_catalog l join v_sig_catalog r on r.listing_id // 10 = (l.listing_id // 10) + l.listing_id % 2 and r.store_id = l.store_id + 1"


def neighbours(t):
    base = materialize(M.signed(t.v_catalog))  # both sides read it
    left = base.select(F.col("listing_id").alias("left_id"), F.col("sig").alias("l"),
                       (F.floor(F.col("listing_id") / 10) + F.col("listing_id") % 2).alias("part"), (F.col("store_id") + 1).alias("store"))
    right = base.select(F.col("listing_id").alias("right_id"), F.col("sig").alias("r"),
                        F.floor(F.col("listing_id") / 10).alias("part"), F.col("store_id").alias("store"))
    return left.join(right, ["part", "store"])


@query("structural_conflict", "R1", _NEIGHBOURS.format(facts=conflict("l", "r") + " as label"))
def structural_conflict(t):
    return neighbours(t).select("left_id", "right_id", M.structural_conflict(F.col("l"), F.col("r")).alias("label"))


@query("pair_score", "R2", "select left_id, right_id, confidence, confidence >= 0.86 as accepted from (" + score("(" + _NEIGHBOURS.format(facts=_PAIR_FACTS) + ")") + ")")
def pair_score(t):
    return M.with_pair_score(neighbours(t), similarity="levenshtein").select("left_id", "right_id", "confidence", "accepted")


ORACLE_VIEWS["v_seq_neighbours"] = sequence_score("v_neighbour", "(" + _NEIGHBOURS.format(facts=_PAIR_FACTS) + ")")


@query("pair_score_sequence", "R2", """select left_id, right_id, confidence, confidence >= 0.86 as accepted,
    coalesce(label, case when confidence >= 0.86 then 'fuzzy_brand_variant_volume' else 'below_threshold' end) as method from v_seq_neighbours""")
def pair_score_sequence(t):
    return M.with_pair_score(neighbours(t)).select("left_id", "right_id", "confidence", "accepted", "method")


@query("candidate_blocking", "J9", """
  with w as (select listing_id, store_id, volume_ml, unnest(list_distinct(core_tokens)) as word from v_sig_catalog where not is_pack and volume_ml is not null)
  select count(*) as candidate_pairs from (select distinct a.listing_id, b.listing_id as other from w a join w b on a.volume_ml = b.volume_ml and a.word = b.word and a.store_id < b.store_id)""")
def candidate_blocking(t):
    return M.candidate_pair_count(M.signed(t.v_catalog))


@query("best_match_per_store", "W7", "select * from v_best")
def best_match_per_store(t):
    p = plan(t)
    return p.best.withColumnRenamed("profile_id", "id").join(p.members.select(F.col("profile_id").alias("id"), F.col("listing_id")), "id").select(
        F.col("listing_id").alias("id"), "other_store", "best", "confidence", "runner_id", "runner_confidence", "ambiguous")


@query("match_plan", "R3 W8", "select * from v_edges")
def match_plan(t):
    return plan(t).candidates


@query("match_plan_sequence", "R3 W8", "select * from v_seq_edges")
def match_plan_sequence(t):
    return plan(t, "sequence").candidates


@query("match_counters", "R3", f"""select count(*) as total_products, count(*) filter (not is_pack and volume_ml is not null) as eligible_products,
  count(*) filter (is_pack) as skipped_packs, count(*) filter (not is_pack and volume_ml is null) as skipped_unknown_volume,
  (select count(distinct id) from v_best where ambiguous) as ambiguous_products from {_CATALOG}""")
def match_counters(t):
    return plan(t).counters()


ORACLE_VIEWS["v_reviews"] = """select left_id, right_id, confidence, method from (
    select least(l, r) as left_id, greatest(l, r) as right_id, max(confidence) as confidence, max(method) as method from (
      select left_id as l, right_id as r, confidence, 'near_threshold' as method from v_scored where confidence >= 0.74 and confidence < 0.86
      union all select id, best, confidence, 'ambiguous_best' from v_best where ambiguous
      union all select id, runner_id, runner_confidence, 'ambiguous_best' from v_best where ambiguous) group by 1, 2)
  order by confidence desc, left_id, right_id limit 500"""


@query("review_pairs", "R3", "select * from v_reviews")
def review_pairs(t):
    return plan(t).reviews().drop("reason")


_VETO = "coalesce({c} in ('excluded_pack', 'volume_conflict', 'vintage_conflict', 'abv_conflict'), false)"
ORACLE_VIEWS["v_ean_edges"] = f"""select least(l.listing_id, r.listing_id) as left_id, greatest(l.listing_id, r.listing_id) as right_id
  from {_CATALOG} l join {_CATALOG} r on trim(l.ean) = trim(r.ean) and l.store_id < r.store_id
  where not ({_VETO.format(c='(' + conflict('l', 'r') + ')')})"""


@query("ean_pairs", "J10", "select * from v_ean_edges")
def ean_pairs(t):
    return M.identifier_edges(materialize(M.signed(listings(t))), F.trim("ean"))


ORACLE_VIEWS["v_sku_edges"] = f"""select s.left_id, s.right_id, greatest(0.97::double, s.confidence) as confidence from v_scored s
  join v_catalog l on l.listing_id = s.left_id join v_catalog r on r.listing_id = s.right_id
  where lower(trim(l.sku)) = lower(trim(r.sku)) and s.confidence >= 0.92 and s.same_brand"""


@query("sku_pairs", "J11", "select least(left_id, right_id) as left_id, greatest(left_id, right_id) as right_id, confidence from v_sku_edges")
def sku_pairs(t):
    return M.sku_edges(plan(t))


# Rules derived from the catalog: exclusions between two shops' spellings of some
# parts, equivalences between others.
ORACLE_VIEWS["v_keys"] = "select listing_id, store_id, core_key || '|' || coalesce(volume_ml::varchar, 'unknown') as k from v_sig_catalog"
ORACLE_VIEWS["v_rules"] = """select distinct case when a.listing_id // 10 % 12 = 5 then 'exclusion' else 'equivalence' end as rule_type,
    least(a.k, b.k) as left_key, greatest(a.k, b.k) as right_key, true as is_active
  from v_keys a join v_keys b on a.listing_id // 10 = b.listing_id // 10 and a.store_id = 1 and b.store_id in (2, 5)
  where a.listing_id // 10 % 12 in (5, 7)"""


def rules(t):
    keyed = t.v_catalog.select("listing_id", "store_id", S.comparison_key(S.signature(F.col("name"))).alias("k"),
                               F.floor(F.col("listing_id") / 10).alias("part")).where("part % 12 in (5, 7)")
    a = keyed.where("store_id = 1").select("part", F.col("k").alias("a"))
    b = keyed.where("store_id in (2, 5)").select("part", F.col("k").alias("b"))
    kind = F.when(F.col("part") % 12 == 5, "exclusion").otherwise("equivalence")
    return materialize(a.join(b, "part").select(kind.alias("rule_type"), F.least("a", "b").alias("left_key"), F.greatest("a", "b").alias("right_key"),
                                    F.lit(True).alias("is_active")).distinct())


@query("manual_exclusion", "J12", """select e.left_id, e.right_id, e.confidence, e.method from v_edges e join v_keys a on a.listing_id = e.left_id join v_keys b on b.listing_id = e.right_id
  where not exists (select 1 from v_rules x where rule_type = 'exclusion' and left_key = least(a.k, b.k) and right_key = greatest(a.k, b.k))""")
def manual_exclusion(t):
    p = plan(t)
    return M.without_exclusions(p.candidates, p.signed, rules(t).where("rule_type = 'exclusion'"))


ORACLE_VIEWS["v_equiv_edges"] = f"""select distinct least(l.listing_id, r.listing_id) as left_id, greatest(l.listing_id, r.listing_id) as right_id
  from v_rules x join v_keys ka on ka.k = x.left_key join v_keys kb on kb.k = x.right_key and kb.store_id <> ka.store_id
  join {_CATALOG} l on l.listing_id = ka.listing_id join {_CATALOG} r on r.listing_id = kb.listing_id
  where rule_type = 'equivalence' and not ({_VETO.format(c='(' + conflict('l', 'r') + ')')})"""


@query("manual_equivalence", "J13", "select * from v_equiv_edges")
def manual_equivalence(t):
    return M.equivalence_edges(materialize(M.signed(listings(t))), rules(t).where("rule_type = 'equivalence'"))


ORACLE_VIEWS["v_all_edges"] = """
  with first as (select left_id, right_id, arg_max(confidence, confidence * 10 - source) as confidence, arg_max(method, confidence * 10 - source) as method from (
      select least(left_id, right_id) as left_id, greatest(left_id, right_id) as right_id, confidence, method, 0 as source from v_edges
      union all select left_id, right_id, 1.0, 'ean_exact', 0.001 from v_ean_edges
      union all select least(left_id, right_id), greatest(left_id, right_id), confidence, 'sku_secondary_verified', 0.002 from v_sku_edges) group by 1, 2),
  kept as (select f.* from first f join v_keys a on a.listing_id = f.left_id join v_keys b on b.listing_id = f.right_id
    where not exists (select 1 from v_rules x where rule_type = 'exclusion' and left_key = least(a.k, b.k) and right_key = greatest(a.k, b.k)))
  select left_id, right_id, arg_max(confidence, confidence * 10 - source) as confidence, arg_max(method, confidence * 10 - source) as method from (
    select *, 0 as source from kept union all select left_id, right_id, 1.0, 'manual_equivalence', 0.001 from v_equiv_edges) group by 1, 2"""


@query("augment_candidates", "R4", "select * from v_all_edges")
def augment_candidates(t):
    return M.augment_candidates(plan(t), rules(t))


ORACLE_VIEWS["v_components"] = """
  with recursive e as materialized (select left_id as a, right_id as b from v_all_edges union select right_id, left_id from v_all_edges),
  walk(id, root) as (select a, a from e union select e.b, w.root from walk w join e on e.a = w.id where e.b > w.root)
  select id as listing_id, min(root) as component_id from walk group by 1"""


@query("connected_components", "R5", "select * from v_components")
def connected_components(t):
    return M.connected_components(M.augment_candidates(plan(t), rules(t)))
