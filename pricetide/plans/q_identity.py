"""Canonical products over the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.functions.signature import signature
from pricetide.operators import identity as I
from pricetide.operators import matching as M
from pricetide.session import materialize

from . import duck_text as D
from .q_history import recent_runs
from .q_matching import plan, rules
from .q_text import _FINGERPRINT
from .registry import ORACLE_VIEWS, query


class Pass:
    """One full reconciliation of the catalog."""

    def __init__(self, t):
        self.plan = plan(t)
        self.edges = materialize(M.augment_candidates(self.plan, rules(t)))
        self.components = M.connected_components(self.edges)
        self.assigned = I.assign_masters(self.components, self.edges, self.plan.signed)


ORACLE_VIEWS["v_assigned"] = """
  with ends as (select left_id as listing_id, * from v_all_edges union all select right_id, * from v_all_edges),
  best as (select * from ends qualify row_number() over (partition by listing_id order by confidence desc, left_id desc, right_id desc) = 1),
  t as (select component_id, min(master_id) as target from v_components join v_catalog using (listing_id) group by 1)
  select listing_id, component_id, c.master_id as old_master_id, target as master_id, confidence, method as matching_method,
    case when method = 'manual_equivalence' then 'manual' else 'automatic' end as review_status, c.master_id <> target as relinked
  from v_components join t using (component_id) join v_catalog c using (listing_id) join best using (listing_id)"""


@query("assign_masters", "R6", "select * from v_assigned")
def assign_masters(t):
    return Pass(t).assigned.drop("evidence")


# New facts of every target product; a component's weakest edge is the product's identity confidence.
ORACLE_VIEWS["v_master_updates"] = f"""
  with named as (select a.component_id, a.master_id, arg_max(s.name, {{'words': len(core_tokens), 'length': length(s.name), 'first': -listing_id}}) as best_name,
      case when count(distinct volume_ml) = 1 then min(volume_ml) end as volume_ml, case when count(distinct brand) = 1 then min(brand) end as brand
    from v_assigned a join v_sig_catalog s using (listing_id) group by 1, 2),
  weakest as (select component_id, min(confidence) as identity_confidence from v_all_edges e join v_components c on c.listing_id = e.left_id group by 1)
  select master_id, volume_ml, brand, {D.canonical_name('best_name')} as canonical_name, identity_confidence from named join weakest using (component_id)"""


@query("master_updates", "R6 W15 A16", "select * from v_master_updates")
def master_updates(t):
    p = Pass(t)
    return I.master_updates(p.assigned, p.components, p.edges, p.plan.signed)


@query("reconcile_summary", "R6", """select (select count(*) from v_all_edges) as matched_pairs,
    (select count(*) from v_all_edges where method in ('alias_exact', 'ean_exact', 'sku_secondary_verified', 'manual_equivalence')) as exact_matches,
    (select count(*) from v_all_edges where method = 'fuzzy_brand_variant_volume') as fuzzy_matches, (select count(*) from v_assigned where relinked) as products_relinked,
    (select count(distinct old_master_id) from v_assigned where relinked and old_master_id not in (
      select coalesce(a.master_id, c.master_id) from v_catalog c left join v_assigned a using (listing_id))) as masters_merged""")
def reconcile_summary(t):
    p = Pass(t)
    assigned = materialize(p.assigned)
    return I.reconcile_summary(p.edges, assigned, I.merged_masters(assigned, t.v_catalog))


@query("best_named", "W15", """select part_id, arg_max(name, (len(core_tokens) * 1000 + length(name))::hugeint * 1000000000000 - listing_id) as best_name,
    case when count(distinct volume_ml) = 1 then min(volume_ml) end as volume_ml, case when count(distinct brand) = 1 then min(brand) end as brand
  from (select listing_id // 10 as part_id, name, core_tokens, listing_id, volume_ml, brand from v_sig_catalog) group by 1""")
def best_named(t):
    s = M.signed(t.v_catalog).withColumn("part_id", F.floor(F.col("listing_id") / 10))
    return s.groupBy("part_id").agg(I.best_named(F.col("name"), F.col("sig"), F.col("listing_id")).alias("best_name"),
                                    I.consensus(F.col("sig.volume_ml")).alias("volume_ml"), I.consensus(F.col("sig.brand")).alias("brand"))


@query("consensus", "A16", """select master_id, case when count(distinct store_id) = 1 then min(store_id) end as store_id, case when count(distinct price_type) = 1 then min(price_type) end as price_type from v_obs group by 1""")
def consensus(t):
    return t.v_obs.groupBy("master_id").agg(I.consensus(F.col("store_id")).alias("store_id"), I.consensus(F.col("price_type")).alias("price_type"))


# Products known by exact key: those of the even parts, as the first shop spells them.
ORACLE_VIEWS["v_key_masters"] = f"select key as normalized_key, min(listing_id) as master_id from (select listing_id, {D.normalized_key('name')} as key from v_names where part_id % 2 = 0 and store_id = 1) group by 1"


@query("master_for_new_listing", "R7", f"""select n.listing_id, n.key as normalized_key, m.master_id as known_master_id, m.master_id is null as is_new
  from (select listing_id, {D.normalized_key('name')} as key from v_names) n left join v_key_masters m on m.normalized_key = n.key""")
def master_for_new_listing(t):
    from pricetide.functions.text import normalized_key

    masters = t.v_names.where("part_id % 2 = 0 and store_id = 1").groupBy(normalized_key(F.col("name")).alias("normalized_key")).agg(F.min("listing_id").alias("master_id"))
    got = I.master_for_new_listing(t.v_names, masters)
    return got.select("listing_id", "normalized_key", F.when(~F.col("is_new"), F.col("master_id")).alias("known_master_id"), "is_new")


# Review rows of earlier passes: neighbouring listings of the catalog.
ORACLE_VIEWS["v_old_reviews"] = """select listing_id as left_id, listing_id + 1 as right_id, 0.75::double as confidence, 'near_threshold' as proposed_method, 'old' as reason,
    case listing_id % 4 when 0 then 'confirmed' when 1 then 'rejected' else 'pending' end as status from v_catalog where store_id in (1, 3)"""


def old_reviews(t):
    status = F.when(F.col("listing_id") % 4 == 0, "confirmed").when(F.col("listing_id") % 4 == 1, "rejected").otherwise("pending")
    return t.v_catalog.where("store_id in (1, 3)").select(
        F.col("listing_id").alias("left_id"), (F.col("listing_id") + 1).alias("right_id"), F.lit(0.75).alias("confidence"),
        F.lit("near_threshold").alias("proposed_method"), F.lit("old").alias("reason"), status.alias("status"))


@query("review_queue", "R8", """
  with n as (select left_id, right_id, confidence, method, case when method = 'near_threshold' then 'similarity below threshold' else 'two candidates within 0.015' end as reason from v_reviews),
  e as (select least(left_id, right_id) as left_id, greatest(left_id, right_id) as right_id from v_edges), p as (select listing_id from v_sig_catalog where is_pack and not excluded_from_comparison)
  select left_id, right_id, case when coalesce(o.status, 'pending') = 'pending' then coalesce(n.confidence, o.confidence) else o.confidence end as confidence,
    case when coalesce(o.status, 'pending') = 'pending' then coalesce(n.method, o.proposed_method) else o.proposed_method end as proposed_method,
    case when coalesce(o.status, 'pending') <> 'pending' then o.status when left_id in (from p) or right_id in (from p) then 'rejected'
      when (left_id, right_id) in (select (left_id, right_id) from e) then 'auto_resolved' else 'pending' end as status
  from v_old_reviews o full join n using (left_id, right_id)""")
def review_queue(t):
    p = plan(t)
    packs = p.signed.where("sig.is_pack").select("listing_id")
    accepted = p.candidates.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"))
    return I.review_queue(old_reviews(t), p.reviews(), accepted, packs).drop("reason")


ORACLE_VIEWS["v_decisions"] = "select left_id, right_id, case when left_id % 3 = 0 then 'reject' else 'confirm' end as decision from v_old_reviews where status = 'pending'"
_DECIDED = """from v_decisions d join v_keys a on a.listing_id = d.left_id join v_keys b on b.listing_id = d.right_id
  join v_catalog l on l.listing_id = d.left_id join v_catalog r on r.listing_id = d.right_id"""


def decide(t):
    reviews = old_reviews(t)
    decisions = reviews.where("status = 'pending'").select("left_id", "right_id", F.when(F.col("left_id") % 3 == 0, "reject").otherwise("confirm").alias("decision"))
    return I.apply_review_decisions(reviews, decisions, t.v_catalog)


@query("review_decision_rules", "R9", f"select distinct case when decision = 'confirm' then 'equivalence' else 'exclusion' end as rule_type, least(a.k, b.k) as left_key, greatest(a.k, b.k) as right_key, true as is_active {_DECIDED}")
def review_decision_rules(t):
    return I.add_rules(decide(t)[0].withColumn("is_active", F.lit(False)), decide(t)[0])


@query("review_decision_aliases", "R9", f"""select l.master_id, r.name as alias_text {_DECIDED} where decision = 'confirm' union select r.master_id, l.name {_DECIDED} where decision = 'confirm'""")
def review_decision_aliases(t):
    return decide(t)[1].select("master_id", "alias_text")


ORACLE_VIEWS["v_catalog_masters"] = """select part_id * 2 as master_id, concat('Part ', part_id::varchar) as canonical_name, concat('part ', part_id::varchar) as normalized_key,
    null::varchar as canonical_fingerprint, case when part_id % 4 = 0 then null else 'x' end as brand, case when part_id % 3 = 0 then null else 500 end as volume_ml, null::double as abv_pct, null::int as vintage_year,
    1 as package_quantity, case when part_id % 20 = 0 then 'merged' else 'active' end as status from (select distinct part_id from v_names)"""


def catalog_masters(t):
    part, text = F.col("part_id"), F.col("part_id").cast("string")
    none = F.lit(None)
    return t.v_names.select("part_id").distinct().select(
        (part * 2).alias("master_id"), F.concat(F.lit("Part "), text).alias("canonical_name"), F.concat(F.lit("part "), text).alias("normalized_key"),
        none.cast("string").alias("canonical_fingerprint"), F.when(part % 4 != 0, "x").alias("brand"), F.when(part % 3 != 0, 500).alias("volume_ml"),
        none.cast("double").alias("abv_pct"), none.cast("int").alias("vintage_year"), F.lit(1).alias("package_quantity"),
        F.when(part % 20 == 0, "merged").otherwise("active").alias("status"))


def signed_catalog(t):
    return materialize(t.v_catalog.withColumn("sig", signature(F.col("name"))))


_PICK = """select * from (select c.*, g.* exclude (listing_id, store_id, master_id, sku, ean, name, url, excluded_from_comparison, abv_pct, vintage_year), g.abv_pct as sig_abv, g.vintage_year as sig_vintage
    from v_catalog c join v_sig_catalog g using (listing_id))
  qualify row_number() over (partition by master_id order by not is_pack desc, data_quality_score desc, length(name) desc, listing_id) = 1"""
ORACLE_VIEWS["v_pick"] = _PICK


@query("canonical_pick", "W14", "select master_id, listing_id, name from v_pick")
def canonical_pick(t):
    return I.canonical_pick(signed_catalog(t)).select("master_id", "best.listing_id", "best.name")


@query("refresh_canonical", "R12", f"""select m.master_id, {D.canonical_name('p.name')} as canonical_name, {_FINGERPRINT.replace('abv_pct', 'p.sig_abv').replace('brand,', 'p.brand,').replace('volume_ml::', 'p.volume_ml::').replace('vintage_year::', 'p.sig_vintage::')} as canonical_fingerprint,
    coalesce(p.brand, m.brand) as brand, coalesce(p.volume_ml, m.volume_ml) as volume_ml, p.sig_abv as abv_pct, p.sig_vintage as vintage_year, 1 as package_quantity, true as changed
  from v_catalog_masters m join v_pick p using (master_id) where m.status = 'active'""")
def refresh_canonical(t):
    return I.refresh_canonical(catalog_masters(t), signed_catalog(t))


@query("masters_touched", "U5", "select distinct master_id from v_listings where last_confirmed_run_id in (select run_id from v_recent_runs)")
def masters_touched(t):
    return I.masters_touched(t.v_listings, recent_runs(t))


@query("register_aliases", "R13", f"""
  with n as (select master_id, key, arg_max(name, listing_id) as alias_text, arg_max('store:' || store_id, listing_id) as source
    from (select part_id as master_id, name, store_id, listing_id, {D.normalized_key('name')} as key from v_names) group by 1, 2),
  o as (select part_id as master_id, key, min(name) as alias_text, part_id % 2 = 0 as is_confirmed from (select part_id, upper(name) as name, {D.normalized_key('name')} as key from v_names where store_id <= 2) group by 1, 2)
  select master_id, key as alias_key, case when o.is_confirmed or n.key is null then o.alias_text else n.alias_text end as alias_text,
    case when o.is_confirmed or n.key is null then 'old' else n.source end as source, coalesce(o.is_confirmed, false) as is_confirmed, o.key is null as registered
  from o full join n using (master_id, key)""")
def register_aliases(t):
    from pricetide.functions.text import normalized_key

    old = t.v_names.where("store_id <= 2").groupBy(F.col("part_id").alias("master_id"), normalized_key(F.col("name")).alias("alias_key")).agg(
        F.min(F.upper("name")).alias("alias_text")).withColumns({"source": F.lit("old"), "is_confirmed": F.col("master_id") % 2 == 0})
    new = t.v_names.select(F.col("part_id").alias("master_id"), F.col("name").alias("alias_text"), F.concat(F.lit("store:"), F.col("store_id").cast("string")).alias("source"),
                           F.lit(False).alias("is_confirmed"), F.col("listing_id").alias("seq"))
    return I.register_aliases(old, new)


ORACLE_VIEWS["v_alias_names"] = f"""select master_id, seq, alias_text, {D.search_norm('alias_text')} as key from (
    select user_id as master_id, -1 as seq, 'Master ' || user_id || ' 750 ml' as alias_text from (select distinct user_id from events) where user_id % 50 <> 49
    union all select master_id, listing_id, v_listings.name from v_listings join v_stores using (store_id) where is_available and is_active and comparison_enabled and master_id % 50 <> 49)"""
ORACLE_VIEWS["v_unique_aliases"] = """select master_id, list(alias_text order by seq) as aliases from (select * from (
    select master_id, key, seq, alias_text, row_number() over (partition by master_id, key order by seq) as rk from v_alias_names where key <> '') where rk = 1) group by 1"""


def alias_names(t):
    active = t.v_masters.where("status <> 'merged'")
    open_stores = t.v_stores.where("is_active and comparison_enabled").select("store_id")
    listed = t.v_listings.where("is_available").join(open_stores, "store_id", "left_semi").join(active.select("master_id"), "master_id", "left_semi")
    return active.select("master_id", F.lit(-1).cast("bigint").alias("seq"), F.col("canonical_name").alias("alias_text")).unionByName(
        listed.select("master_id", F.col("listing_id").alias("seq"), F.col("name").alias("alias_text")))


@query("unique_aliases", "U4", "select master_id, array_to_string(aliases, ' / ') as aliases from v_unique_aliases")
def unique_aliases(t):
    return I.unique_aliases(alias_names(t)).select("master_id", F.array_join("aliases", " / ").alias("aliases"))


ORACLE_VIEWS["v_search_catalog"] = f"""
  with listed as (select l.master_id, g.brand, g.volume_ml, g.pack_count from v_listings l join v_stores s using (store_id) join v_sig_listings g using (listing_id) where is_available and is_active and comparison_enabled),
  f as (select master_id, case when count(distinct pack_count) = 1 then min(pack_count) end as pack from listed group by 1),
  x as (select m.master_id, m.canonical_name, m.normalized_key, m.brand, m.volume_ml, greatest(coalesce(f.pack, 1), 1) as package_quantity, 'master ' || m.master_id as variant, u.aliases
    from v_masters m left join f using (master_id) left join v_unique_aliases u using (master_id) where m.status <> 'merged')
  select *, {D.search_norm("concat_ws(' ', canonical_name, normalized_key, brand, variant, array_to_string(aliases, ' '))")} as search_text from x"""


def search_catalog(t):
    return I.refresh_search_catalog(t.v_masters, t.v_listings, t.v_stores)


@query("refresh_search_catalog", "R14", "select master_id, brand, volume_ml, package_quantity, variant, search_text from v_search_catalog")
def refresh_search_catalog(t):
    return search_catalog(t).select("master_id", "brand", "volume_ml", "package_quantity", "variant", "search_text")


@query("pending_reviews", "R15", """select left_id, right_id, confidence, l.name as left_name, r.name as right_name from v_old_reviews v left join v_catalog l on l.listing_id = left_id left join v_catalog r on r.listing_id = right_id
  where status = 'pending' order by confidence desc, left_id, right_id limit 50""")
def pending_reviews(t):
    return I.pending_reviews(old_reviews(t), t.v_catalog, 50).select("left_id", "right_id", "confidence", "left_name", "right_name")


# Whole parts as products: every shop's listing of a part shares one product.
def mixed_listings(t):
    return t.v_catalog.withColumn("master_id", F.floor(F.col("master_id") / 2) * 2)


_KEYED = f"select listing_id, listing_id // 10 * 2 as master_id, name, is_pack, coalesce(pack_count, 1) as quantity, {D.normalized_key('name')} as key from v_sig_catalog"
ORACLE_VIEWS["v_pack_rows"] = _KEYED
ORACLE_VIEWS["v_pack_masters"] = "select min(listing_id) + 900000000000 as master_id, key from v_pack_rows where is_pack and master_id % 4 = 0 group by 2"


def repair(t):
    base = catalog_masters(t).select("master_id", "canonical_name", "normalized_key", "package_quantity")
    read = I.PackRepair.read(mixed_listings(t))
    packs = read.where("sig.is_pack and master_id % 4 = 0").groupBy("normalized_key").agg(
        (F.min("listing_id") + 900000000000).alias("master_id"))
    extra = packs.select("master_id", F.lit("Pack 6").alias("canonical_name"), "normalized_key", F.lit(6).alias("package_quantity"))
    return I.PackRepair(read, base.unionByName(extra))


@query("repair_pack_identity", "R10", """
  select r.listing_id, case when r.is_pack and s.singles > 0 then m.master_id else r.master_id end as known_master_id, r.quantity as package_quantity, r.is_pack and s.singles > 0 as relinked, r.quantity <> 1 as reclassified
  from v_pack_rows r join (select master_id, count(*) filter (not is_pack) as singles from v_pack_rows group by 1) s using (master_id) left join v_pack_masters m using (key)""")
def repair_pack_identity(t):
    r = repair(t).repaired_listings()
    known = F.when(~F.col("is_new"), F.col("master_id"))
    return r.select("listing_id", known.alias("known_master_id"), "package_quantity", "relinked", "reclassified")


@query("repair_pack_summary", "R10", """select (select count(*) from v_pack_rows) as products_scanned, (select count(*) from v_pack_rows where quantity <> 1) as quantities_reclassified,
    (select count(*) from v_pack_rows where is_pack and master_id in (select master_id from v_pack_rows where not is_pack)) as products_relinked,
    (select count(*) from (select master_id from v_pack_rows group by 1 having bool_or(is_pack) and bool_or(not is_pack))) as mixed_masters_found""")
def repair_pack_summary(t):
    return repair(t).summary()


_DIRTY_NAME = "case when listing_id // 10 % 3 = 0 then '3 Vinos Montes Alpha 750 ml Vino ' || replace(regexp_extract(url, '/product/([^/?#]+)', 1), '-', ' ') || ' 750 ml' else 'Clean ' || (listing_id % 7) || ' 750 ml' end"
ORACLE_VIEWS["v_titles"] = "select listing_id, master_id, store_id, data_quality_score, excluded_from_comparison, case when listing_id // 10 % 3 = 0 then replace(regexp_extract(url, '/product/([^/?#]+)', 1), '-', ' ') else 'Clean ' || (listing_id % 7) || ' 750 ml' end as name from v_catalog"


def titles(t):
    from pricetide.functions.text import name_from_url

    slug = name_from_url(F.col("url"))
    dirty = F.when(F.floor(F.col("listing_id") / 10) % 3 == 0, F.concat(F.lit("3 Vinos Montes Alpha 750 ml Vino "), slug, F.lit(" 750 ml"))).otherwise(
        F.concat(F.lit("Clean "), (F.col("listing_id") % 7).cast("string"), F.lit(" 750 ml")))
    return I.repair_titles(t.v_catalog.withColumn("name", dirty), catalog_masters(t))


@query("repair_titles", "R11", "select listing_id, name, listing_id // 10 % 3 = 0 as repaired from v_titles")
def repair_titles(t):
    return titles(t)[0].select("listing_id", "name", "repaired")


@query("repair_titles_masters", "R11", f"""select master_id, {D.canonical_name('name')} as canonical_name from (select * from v_titles where not excluded_from_comparison and listing_id // 10 % 3 = 0
    qualify row_number() over (partition by master_id order by data_quality_score desc, length(name), listing_id) = 1) where master_id % 2 = 0""")
def repair_titles_masters(t):
    return titles(t)[1]
