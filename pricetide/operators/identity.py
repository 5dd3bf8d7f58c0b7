"""Canonical products: assignment of listings, repairs, names, aliases, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions import text as X
from pricetide.functions import wordlists as W
from pricetide.functions.signature import canonical_fingerprint, comparison_key, pack_signature, signature
from pricetide.session import materialize

ALIAS_LIMIT = 25


def evidence_json(method: Column, confidence: Column) -> Column:
    return F.to_json(F.struct(method.alias("method"), F.round(confidence, 4).alias("confidence")))


def consensus(c: Column) -> Column:
    """The group's only value, null when it has none or several."""
    return F.when(F.min(c) == F.max(c), F.min(c))


def assign_masters(components: DataFrame, edges: DataFrame, signed: DataFrame) -> DataFrame:
    """Target product of every listing that has an edge.

    The target is the lowest product of the component; a listing keeps its best
    edge, the later edge (by ids) on ties.
    """
    ends = edges.select(F.explode(F.array("left_id", "right_id")).alias("listing_id"), "left_id", "right_id", "confidence", "method")
    best = ends.groupBy("listing_id").agg(
        F.max_by(F.struct("confidence", "method"), F.struct("confidence", "left_id", "right_id")).alias("edge")
    )
    facts = components.join(signed.select("listing_id", F.col("master_id").alias("old_master_id")), "listing_id")
    target = facts.groupBy("component_id").agg(F.min("old_master_id").alias("target_master_id")).where("target_master_id is not null")
    method = F.col("edge.method")
    return facts.join(target, "component_id").join(best, "listing_id").select(
        "listing_id", "component_id", "old_master_id", F.col("target_master_id").alias("master_id"),
        F.col("edge.confidence").alias("confidence"), method.alias("matching_method"),
        F.when(method == "manual_equivalence", "manual").otherwise("automatic").alias("review_status"),
        evidence_json(method, F.col("edge.confidence")).alias("evidence"),
        (~F.col("old_master_id").eqNullSafe(F.col("target_master_id"))).alias("relinked"),
    )


def master_updates(assigned: DataFrame, components: DataFrame, edges: DataFrame, signed: DataFrame) -> DataFrame:
    """New facts of every target product: name, volume, brand, identity confidence."""
    rooted = edges.join(components.withColumnRenamed("listing_id", "left_id"), "left_id")
    floor = rooted.groupBy("component_id").agg(F.min("confidence").alias("identity_confidence"))
    names = assigned.select("listing_id", "component_id", "master_id").join(signed.select("listing_id", "name", "sig"), "listing_id")
    grouped = names.groupBy("component_id", "master_id").agg(
        consensus(F.col("sig.volume_ml")).alias("volume_ml"), consensus(F.col("sig.brand")).alias("brand"),
        best_named(F.col("name"), F.col("sig"), F.col("listing_id")).alias("best_name"),
    )
    return grouped.join(floor, "component_id").select(
        "master_id", "volume_ml", "brand", X.canonical_name(F.col("best_name")).alias("canonical_name"), "identity_confidence"
    )


def best_named(name: Column, sig: Column, listing_id: Column) -> Column:
    """Aggregate: the name with most identity words, then the longest, then the lowest id."""
    return F.max_by(name, F.struct(F.size(sig["core_tokens"]), F.length(name), -listing_id))


def merged_masters(assigned: DataFrame, listings: DataFrame) -> DataFrame:
    """Products every listing has moved away from."""
    left = assigned.where("relinked and old_master_id is not null").select(F.col("old_master_id").alias("master_id")).distinct()
    moved = assigned.select("listing_id", F.col("master_id").alias("new_master_id"))
    current = listings.join(moved, "listing_id", "left").select(F.coalesce("new_master_id", "master_id").alias("master_id"))
    return left.join(current, "master_id", "left_anti")


def reconcile_summary(edges: DataFrame, assigned: DataFrame, merged: DataFrame) -> DataFrame:
    exact = F.col("method").isin(*W.EXACT_METHODS)
    e = edges.agg(F.count("*").alias("matched_pairs"), F.count_if(exact).alias("exact_matches"), F.count_if(~exact).alias("fuzzy_matches"))
    a = assigned.agg(F.count_if("relinked").alias("products_relinked"))
    return e.join(a, F.lit(True)).join(merged.agg(F.count("*").alias("masters_merged")), F.lit(True))


def master_for_new_listing(listings: DataFrame, masters: DataFrame) -> DataFrame:
    """Exact identity: each listing's product by normalized key; unknown keys get ids.

    New ids are a hash of the key, so they need no global numbering step.
    """
    keyed = listings.select("listing_id", X.normalized_key(F.col("name")).alias("normalized_key"))
    known = masters.select("normalized_key", "master_id")
    fresh = F.xxhash64("normalized_key").bitwiseAND(0x7FFFFFFFFFFFFFFF)
    return keyed.join(known, "normalized_key", "left").select(
        "listing_id", "normalized_key", F.coalesce("master_id", fresh).alias("master_id"), F.col("master_id").isNull().alias("is_new"),
        F.lit(1.0).alias("confidence"), F.lit("exact_normalized").alias("matching_method"),
    )


def review_queue(existing: DataFrame, candidates: DataFrame, accepted: DataFrame, pack_ids: DataFrame | None = None) -> DataFrame:
    """Queue after a matching pass: pending rows refreshed, solved and pack pairs closed."""
    pair = ["left_id", "right_id"]
    fresh = candidates.select(*pair, F.struct("confidence", "method", "reason").alias("new"))
    solved = accepted.select(*pair).distinct().withColumn("solved", F.lit(True))
    both = existing.select(*pair, F.struct("confidence", "proposed_method", "reason", "status").alias("old")).join(fresh, pair, "full").join(solved, pair, "left")
    if pack_ids is None:
        both = both.withColumn("pack", F.lit(False))
    else:
        packs = pack_ids.select("listing_id").distinct()
        flags = both.select(*pair)
        hit = flags.join(packs.withColumnRenamed("listing_id", "left_id"), "left_id", "left_semi").unionByName(
            flags.join(packs.withColumnRenamed("listing_id", "right_id"), "right_id", "left_semi")
        ).distinct().withColumn("pack", F.lit(True))
        both = both.join(hit, pair, "left").withColumn("pack", F.coalesce("pack", F.lit(False)))
    pending = F.coalesce("old.status", F.lit("pending")) == "pending"
    refreshed = F.col("new").isNotNull() & pending
    status = (
        F.when(~pending, F.col("old.status")).when(F.col("pack"), "rejected")
        .when(F.coalesce("solved", F.lit(False)), "auto_resolved").otherwise("pending")
    )
    return both.select(
        *pair,
        F.when(refreshed, F.col("new.confidence")).otherwise(F.col("old.confidence")).alias("confidence"),
        F.when(refreshed, F.col("new.method")).otherwise(F.col("old.proposed_method")).alias("proposed_method"),
        F.when(refreshed, F.col("new.reason")).otherwise(F.col("old.reason")).alias("reason"),
        status.alias("status"),
    )


def apply_review_decisions(reviews: DataFrame, decisions: DataFrame, listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules and confirmed aliases that follow from ``decision`` = confirm | reject."""
    names = listings.select("listing_id", "name", "master_id", comparison_key(signature(F.col("name"))).alias("rule_key"))
    l = names.select(F.col("listing_id").alias("left_id"), F.struct("name", "master_id", "rule_key").alias("l"))
    r = names.select(F.col("listing_id").alias("right_id"), F.struct("name", "master_id", "rule_key").alias("r"))
    decided = reviews.join(decisions, ["left_id", "right_id"]).join(l, "left_id").join(r, "right_id")
    kind = F.when(F.col("decision") == "confirm", "equivalence").otherwise("exclusion")
    rules = decided.select(
        kind.alias("rule_type"), F.least("l.rule_key", "r.rule_key").alias("left_key"), F.greatest("l.rule_key", "r.rule_key").alias("right_key"),
        F.lit(True).alias("is_active"),
    ).distinct()
    crossed = decided.where("decision = 'confirm'").select(F.explode(F.array(
        F.struct(F.col("l.master_id").alias("master_id"), F.col("r.name").alias("alias_text")),
        F.struct(F.col("r.master_id").alias("master_id"), F.col("l.name").alias("alias_text")))).alias("a")).select("a.*")
    aliases = crossed.where("master_id is not null").select(
        "master_id", "alias_text", F.lit("manual_review").alias("source"), F.lit(True).alias("is_confirmed")).distinct()
    return rules, aliases


def add_rules(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rules by key; a rule given again becomes active."""
    key = ["rule_type", "left_key", "right_key"]
    ordered = [c.select("rule_type", F.least("left_key", "right_key").alias("left_key"), F.greatest("left_key", "right_key").alias("right_key"), "is_active")
               for c in (existing, new.withColumn("is_active", F.lit(True)))]
    return ordered[0].unionByName(ordered[1]).groupBy(*key).agg(F.max("is_active").alias("is_active"))


def canonical_pick(listings: DataFrame) -> DataFrame:
    """Representative listing per product: singles first, best quality, longest name, lowest id."""
    single = (F.coalesce("package_quantity", F.lit(1)) == 1) & ~F.col("sig.is_pack")
    order = F.struct(single.alias("s"), F.coalesce("data_quality_score", F.lit(0)).alias("q"), F.length(F.coalesce("name", F.lit(""))).alias("n"), (-F.col("listing_id")).alias("i"))
    row = F.struct("listing_id", "name", "abv_pct", "vintage_year", "package_quantity", "sig")
    return listings.where("master_id is not null").groupBy("master_id").agg(F.max_by(row, order).alias("best"))


def refresh_canonical(masters: DataFrame, listings: DataFrame) -> DataFrame:
    """Products with facts of their representative listing; ``changed`` marks updates.

    ``listings`` carries the signature column ``sig``. Null facts keep the old value.
    """
    sig = F.col("best.sig")
    new = {
        "canonical_name": X.canonical_name(F.col("best.name")),
        "canonical_fingerprint": canonical_fingerprint(sig),
        "brand": F.coalesce(sig["brand"], F.col("brand")),
        "volume_ml": F.coalesce(sig["volume_ml"], F.col("volume_ml")),
        "abv_pct": F.coalesce("best.abv_pct", sig["abv_pct"]),
        "vintage_year": F.coalesce("best.vintage_year", sig["vintage_year"]),
        "package_quantity": F.coalesce("best.package_quantity", sig["pack_count"], F.lit(1)),
    }
    joined = masters.where("status = 'active'").join(canonical_pick(listings), "master_id").withColumns({f"_{n}": c for n, c in new.items()})
    changed = F.lit(False)
    for name in new:
        changed = changed | (F.col(f"_{name}").isNotNull() & ~F.col(f"_{name}").eqNullSafe(F.col(name)))
    return joined.select("master_id", *[F.coalesce(f"_{n}", n).alias(n) for n in new], changed.alias("changed"))


def masters_touched(listings: DataFrame, runs: DataFrame) -> DataFrame:
    """Products with a listing confirmed by one of the runs."""
    confirmed = listings.join(runs.select(F.col("run_id").alias("last_confirmed_run_id")), "last_confirmed_run_id", "left_semi")
    return confirmed.where("master_id is not null").select("master_id").distinct()


def register_aliases(existing: DataFrame, observed: DataFrame) -> DataFrame:
    """Aliases by (product, key): a confirmed text stays, confirmation is never lost.

    ``observed``: master_id, alias_text, source, is_confirmed, seq (later wins).
    """
    text = X.normalize_spaces(F.col("alias_text"))
    clean = observed.withColumn("alias_text", text).where("alias_text <> ''").withColumn("alias_key", X.normalized_key(F.col("alias_text")))
    new = clean.groupBy("master_id", "alias_key").agg(
        F.max_by(F.struct("alias_text", "source"), "seq").alias("n"), F.max("is_confirmed").alias("new_confirmed"))
    old = existing.select("master_id", "alias_key", F.struct("alias_text", "source", "is_confirmed").alias("o"))
    joined = old.join(new, ["master_id", "alias_key"], "full")
    keep = F.coalesce("o.is_confirmed", F.lit(False)) | F.col("n").isNull()
    return joined.select(
        "master_id", "alias_key",
        F.when(keep, F.col("o.alias_text")).otherwise(F.col("n.alias_text")).alias("alias_text"),
        F.when(keep, F.col("o.source")).otherwise(F.col("n.source")).alias("source"),
        (F.coalesce("o.is_confirmed", F.lit(False)) | F.coalesce("new_confirmed", F.lit(False))).alias("is_confirmed"),
        F.col("o").isNull().alias("registered"),
    )


def unique_aliases(names: DataFrame, limit: int | None = None) -> DataFrame:
    """Different names per product by search text, in ``seq`` order; with a ``limit``, the first so many."""
    clean = names.select("master_id", "seq", X.normalize_spaces(F.col("alias_text")).alias("alias_text"))
    keyed = clean.withColumn("key", X.search_normalize(F.col("alias_text"))).where("key <> ''")
    first = keyed.groupBy("master_id", "key").agg(F.min_by("alias_text", "seq").alias("alias_text"), F.min("seq").alias("seq"))
    order = Window.partitionBy("master_id").orderBy("seq", "key")
    kept = first.withColumn("rank", F.row_number().over(order))
    kept = kept if limit is None else kept.where(F.col("rank") <= limit)
    listed = F.array_sort(F.collect_list(F.struct("rank", "alias_text")))
    return kept.groupBy("master_id").agg(F.transform(listed, lambda a: a["alias_text"]).alias("aliases"))


def variant_words(name_sig: Column, brand: Column) -> Column:
    """Identity words of a name without the first occurrence of each brand word."""
    drop = F.filter(F.split(X.search_normalize(brand), " "), lambda w: w != "")

    def without(tokens: Column, word: Column) -> Column:
        at = F.array_position(tokens, word).cast("int")
        cut = F.concat(F.slice(tokens, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(tokens, at + 1, F.size(tokens)))
        return F.when(at > 0, cut).otherwise(tokens)

    kept = F.aggregate(F.coalesce(drop, F.array().cast("array<string>")), name_sig["core_tokens"], without)
    return F.nullif(F.array_join(kept, " "), F.lit(""))


def refresh_search_catalog(masters: DataFrame, listings: DataFrame, stores: DataFrame) -> DataFrame:
    """Search columns of every product that is not merged away."""
    open_stores = stores.where("is_active and comparison_enabled").select("store_id")
    seen = listings.where("is_available").join(open_stores, "store_id", "left_semi").select("master_id", "listing_id", "name")
    active = masters.where("status <> 'merged'")
    own = active.select("master_id", F.lit(-1).cast("bigint").alias("seq"), F.col("canonical_name").alias("alias_text"), F.lit(False).alias("listed"))
    names = own.unionByName(seen.join(active.select("master_id"), "master_id", "left_semi").select(
        "master_id", F.col("listing_id").alias("seq"), F.col("name").alias("alias_text"), F.lit(True).alias("listed")))
    names = names.withColumn("sig", signature(F.col("alias_text")))
    names = materialize(names)

    def agreed(field: str, listed: bool) -> Column:
        return consensus(F.when(F.col("listed") == listed, F.col(f"sig.{field}")))

    facts = names.groupBy("master_id").agg(
        F.max("listed").alias("any_listed"),
        *[agreed(f, flag).alias(f"{f}_{int(flag)}") for f in ("brand", "volume_ml", "pack_count") for flag in (True, False)],
        F.max(F.when(~F.col("listed"), F.col("sig"))).alias("name_sig"),
    )

    def pick(field: str) -> Column:
        return F.when(F.col("any_listed"), F.col(f"{field}_1")).otherwise(F.col(f"{field}_0"))

    joined = active.join(facts, "master_id").join(unique_aliases(names), "master_id", "left").withColumns({
        "new_brand": F.coalesce(F.nullif("brand", F.lit("")), pick("brand")),
        "new_volume": F.coalesce("volume_ml", pick("volume_ml")),
        "new_pack": F.greatest(F.coalesce(pick("pack_count"), F.lit(1)), F.lit(1)),
        "new_aliases": F.coalesce("aliases", F.array().cast("array<string>")),
    }).withColumn("variant", variant_words(F.col("name_sig"), F.col("new_brand")))
    parts = F.concat_ws(" ", "canonical_name", "normalized_key", F.coalesce("new_brand", F.lit("")), F.coalesce("variant", F.lit("")), F.array_join("new_aliases", " "))
    return joined.select(
        "master_id", "canonical_name", F.col("new_brand").alias("brand"), F.col("new_volume").alias("volume_ml"), F.col("new_pack").alias("package_quantity"),
        "variant", F.col("new_aliases").alias("aliases"), X.search_normalize(parts).alias("search_text"),
    )


def pending_reviews(reviews: DataFrame, listings: DataFrame, limit: int = 50) -> DataFrame:
    """Pending pairs with both names, most confident first."""
    names = listings.select("listing_id", "name", "store_id")
    l = names.select(F.col("listing_id").alias("left_id"), F.col("name").alias("left_name"), F.col("store_id").alias("left_store"))
    r = names.select(F.col("listing_id").alias("right_id"), F.col("name").alias("right_name"), F.col("store_id").alias("right_store"))
    top = reviews.where("status = 'pending'").orderBy(F.desc("confidence"), "left_id", "right_id").limit(max(1, limit))
    return top.join(l, "left_id", "left").join(r, "right_id", "left").orderBy(F.desc("confidence"), "left_id", "right_id")


class PackRepair:
    """Split products that mix packs and single bottles.

    Packs move to the product of their exact name; where the product's own name
    is a pack, the singles move instead. If nothing can move because the target
    is the product itself, the other side moves.

    ``listings`` may be the table that ``read`` has made of them.
    """

    @staticmethod
    def read(listings: DataFrame) -> DataFrame:
        """The listings with all that is read from their names, stored."""
        return materialize(listings.select(
            "listing_id", "master_id", "name", "data_quality_score", F.coalesce("package_quantity", F.lit(1)).alias("old_quantity"),
            pack_signature(F.col("name")).alias("sig"), X.normalized_key(F.col("name")).alias("normalized_key")))

    def __init__(self, listings: DataFrame, masters: DataFrame):
        rows = listings if "sig" in listings.columns else self.read(listings)
        masters = materialize(masters.select("master_id", "canonical_name", "normalized_key", "package_quantity"))
        rows = rows.withColumn("quantity", F.coalesce("sig.pack_count", F.lit(1)))
        self.listings = rows
        best = F.max_by(F.when(~F.col("sig.is_pack"), F.struct("name")),
                        F.struct(~F.col("sig.is_pack"), F.coalesce("data_quality_score", F.lit(0)), F.length("name"), -F.col("listing_id")))
        sides = rows.where("master_id is not null").groupBy("master_id").agg(
            F.count_if("sig.is_pack").alias("packs"), F.count_if(~F.col("sig.is_pack")).alias("singles"),
            F.max(F.when(F.col("sig.is_pack"), F.col("quantity"))).alias("max_pack"), best.alias("best"))
        self.masters = masters.join(sides, "master_id").withColumns({
            "mixed": (F.col("packs") > 0) & (F.col("singles") > 0),
            # The name is repaired from a single bottle first, so it is a pack only without one.
            "keep_packs": pack_signature(F.when(F.col("singles") > 0, X.canonical_name(F.col("best.name"))).otherwise(F.col("canonical_name")))["is_pack"],
        })
        known = masters.select("normalized_key", F.col("master_id").alias("known_id"))
        fresh = F.xxhash64("normalized_key").bitwiseAND(0x7FFFFFFFFFFFFFFF)
        mixed = self.masters.where("mixed").select("master_id", "keep_packs")
        aimed = rows.join(mixed, "master_id").join(known, "normalized_key", "left").select(
            "listing_id", "master_id", "keep_packs", "sig.is_pack", F.coalesce("known_id", fresh).alias("target_id"), F.col("known_id").isNull().alias("is_new"))
        movable = aimed.where("target_id <> master_id").withColumn("first_side", F.col("is_pack") != F.col("keep_packs"))
        first = movable.groupBy("master_id").agg(F.max("first_side").alias("first_moves"))
        self.moves = movable.join(first, "master_id").where("first_side = first_moves").select("listing_id", "master_id", "target_id", "is_new")

    def repaired_listings(self) -> DataFrame:
        """Every listing with its product; ``is_new`` tells a product that is made for the name, whatever its id looks like."""
        moved = self.moves.select("listing_id", "target_id", "is_new")
        return self.listings.join(moved, "listing_id", "left").select(
            "listing_id", F.coalesce("target_id", "master_id").alias("master_id"), F.col("quantity").alias("package_quantity"),
            F.col("target_id").isNotNull().alias("relinked"), F.coalesce("is_new", F.lit(False)).alias("is_new"), (F.col("old_quantity") != F.col("quantity")).alias("reclassified"))

    def affected_masters(self) -> DataFrame:
        """Products whose snapshots must be rebuilt."""
        renamed = self.masters.where(
            (F.col("singles") > 0) & ((X.canonical_name(F.col("best.name")) != F.col("canonical_name")) | (F.coalesce("package_quantity", F.lit(1)) != 1)))
        return renamed.select("master_id").unionByName(self.masters.where("mixed").select("master_id")).unionByName(
            self.moves.select(F.col("target_id").alias("master_id"))).distinct()

    def summary(self) -> DataFrame:
        listed = self.repaired_listings().agg(
            F.count("*").alias("products_scanned"), F.count_if("reclassified").alias("quantities_reclassified"), F.count_if("relinked").alias("products_relinked"))
        return listed.join(self.masters.agg(F.count_if("mixed").alias("mixed_masters_found")), F.lit(True))


def repair_titles(listings: DataFrame, masters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listings with polluted titles replaced, and the new names of their products.

    The representative here is the best-quality single listing with the shortest name.
    """
    fixed = listings.withColumn("safe", X.safe_name(F.col("name"), F.col("url"))).withColumn(
        "repaired", (X.name_from_url(F.col("url")) != "") & (F.col("safe") != "") & (F.col("safe") != F.col("name")))
    fixed = materialize(fixed.withColumn("name", F.when(F.col("repaired"), F.col("safe")).otherwise(F.col("name"))).drop("safe"))
    touched = fixed.where("repaired and master_id is not null").select("master_id").distinct()
    order = F.struct(F.coalesce("data_quality_score", F.lit(0)).alias("q"), (-F.length("name")).alias("n"), (-F.col("listing_id")).alias("i"))
    names = (
        fixed.where((F.coalesce("package_quantity", F.lit(1)) == 1) & ~F.col("excluded_from_comparison"))
        .join(touched, "master_id", "left_semi").groupBy("master_id").agg(F.max_by("name", order).alias("best_name"))
        .select("master_id", X.canonical_name(F.col("best_name")).alias("new_name"))
    )
    changed = masters.join(names, "master_id").where("new_name <> canonical_name").select("master_id", F.col("new_name").alias("canonical_name"))
    return fixed, changed
