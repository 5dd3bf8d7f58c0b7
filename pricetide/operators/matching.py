"""Which listings of different shops are the same product.

Listings that agree on everything scoring looks at form one *profile* per shop
and are scored once, however many copies there are. Candidate pairs of profiles
come from a set-similarity join: a profile probes only with its rarest words,
enough of them that no pair above the score floor can be missed. Group-wise
rules (barcode, stock code, manual equivalence) emit a spanning set of edges
instead of every pair in the group: the components, the best edge of a listing
and the edge scores come out the same.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.functions.ratio import JVM_SIMILARITIES, SIMILARITIES, distinct_ratios, ratio_bound
from pricetide.functions.signature import comparison_key, signature
from pricetide.functions.text import bind
from pricetide.functions import wordlists as W
from pricetide.session import cut_lineage, materialize

# Score weights, bonuses and limits of the pair score.
CONTAINMENT_WEIGHT, JACCARD_WEIGHT, SEQUENCE_WEIGHT = 0.50, 0.25, 0.25
CONTAINED_FLOOR, SINGLE_WORD_PENALTY = 0.92, 0.10
SAME_VINTAGE_BONUS, SAME_ABV_BONUS = 0.02, 0.015
ABV_TOLERANCE, ABV_SAME = 1.5, 0.2
REVIEW_FLOOR, REVIEW_MARGIN, AMBIGUITY_GAP = 0.72, 0.12, 0.015
#: Near misses are first looked for within this distance of the least confidence.
NEAR_MARGIN = 0.01
SKU_SCORE, SKU_CONFIDENCE = 0.92, 0.97
REVIEW_LIMIT = 500

PROFILE = ["store_id", "volume_ml", "brand", "core_tokens", "core_key", "variant_tokens", "abv_pct", "vintage_year"]


def structural_conflict(left: Column, right: Column) -> Column:
    """First reason why two signatures cannot be compared by score, else null."""

    def differ(name: str) -> Column:
        return left[name].isNotNull() & right[name].isNotNull() & (left[name] != right[name])

    def empty(side: Column) -> Column:
        return F.size(side["core_tokens"]) == 0

    checks = (
        (left["is_pack"] | right["is_pack"], "excluded_pack"),
        (left["volume_ml"].isNull() | right["volume_ml"].isNull(), "unknown_volume"),
        (left["volume_ml"] != right["volume_ml"], "volume_conflict"),
        (differ("vintage_year"), "vintage_conflict"),
        (F.abs(left["abv_pct"] - right["abv_pct"]) > ABV_TOLERANCE, "abv_conflict"),
        (empty(left) | empty(right), "empty_signature"),
        (differ("brand"), "brand_conflict"),
        ((F.size(left["variant_tokens"]) > 0) & (F.size(right["variant_tokens"]) > 0)
         & (left["variant_tokens"] != right["variant_tokens"]), "variant_conflict"),
        (~F.arrays_overlap(left["core_tokens"], right["core_tokens"]), "no_overlap"),
        (left["core_key"] == right["core_key"], "alias_exact"),
    )
    label = F
    for condition, name in checks:
        label = label.when(condition, F.lit(name))
    return label


def vetoed(left: Column, right: Column) -> Column:
    """Conflict that even a barcode or a manual rule does not override."""
    return bind(
        structural_conflict(left, right),
        lambda label: F.coalesce(label.isin(*W.VETO_METHODS), F.lit(False)),
    )


def _score(facts: Column, left: Column, right: Column, minimum_confidence: float) -> Column:
    """Struct (confidence, method, accepted) of one compared pair."""
    smaller = F.least(facts["nl"], facts["nr"])
    containment = facts["shared"] / smaller
    jaccard = facts["shared"] / (facts["nl"] + facts["nr"] - facts["shared"])
    raw = (
        F.lit(CONTAINMENT_WEIGHT) * containment
        + F.lit(JACCARD_WEIGHT) * jaccard
        + F.lit(SEQUENCE_WEIGHT) * F.greatest(facts["ordered"], facts["sorted"])
    )
    contained = (facts["shared"] == smaller) & (smaller >= 2)

    def adjusted(base: Column) -> Column:
        value = F.when(contained, F.greatest(base, F.lit(CONTAINED_FLOOR))).otherwise(base)
        value = value - F.when((facts["shared"] < 2) & (smaller > 1), SINGLE_WORD_PENALTY).otherwise(0.0)
        value = value + F.when(left["vintage_year"] == right["vintage_year"], SAME_VINTAGE_BONUS).otherwise(0.0)
        value = value + F.when(F.abs(left["abv_pct"] - right["abv_pct"]) <= ABV_SAME, SAME_ABV_BONUS).otherwise(0.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(0.999), value))

    confidence = (
        F.when(facts["conflict"] == "alias_exact", 1.0)
        .when(facts["conflict"].isNotNull(), 0.0)
        .otherwise(bind(raw, adjusted))
    )

    def outcome(value: Column) -> Column:
        fuzzy = F.when(value >= minimum_confidence, "fuzzy_brand_variant_volume").otherwise("below_threshold")
        accepted = F.when(facts["conflict"].isNull(), value >= minimum_confidence).otherwise(
            facts["conflict"] == "alias_exact"
        )
        return F.struct(
            value.alias("confidence"), F.coalesce(facts["conflict"], fuzzy).alias("method"), accepted.alias("accepted")
        )

    return bind(confidence, outcome)


def with_pair_score(pairs: DataFrame, minimum_confidence: float = 0.86, similarity: str = "sequence", floor: float | None = None) -> DataFrame:
    """Add ``confidence``, ``method`` and ``accepted`` to rows with structs ``l`` and ``r``.

    The text ratio runs on the rows that survive the structural checks; for the others its input is null. With a
    ``floor``, pairs that cannot reach it are left out: the common characters of their texts, counted in the JVM, bound the
    ratio. A ratio in Python sees each distinct pair of texts once.
    """
    ratio = SIMILARITIES[similarity]
    left, right = F.col("l"), F.col("r")

    def words(side: Column, conflict: Column) -> Column:
        return F.when(conflict.isNull(), F.array_join(side["core_tokens"], " "))

    def keys(side: Column, conflict: Column) -> Column:
        return F.when(conflict.isNull(), side["core_key"])

    def score(conflict: Column, ordered: Column, by_key: Column) -> Column:
        facts = F.struct(
            conflict.alias("conflict"),
            F.size(F.array_intersect(left["core_tokens"], right["core_tokens"])).alias("shared"),
            F.size(F.array_distinct(left["core_tokens"])).alias("nl"),
            F.size(F.array_distinct(right["core_tokens"])).alias("nr"),
            ordered.alias("ordered"),
            by_key.alias("sorted"),
        )
        return bind(facts, lambda f: _score(f, left, right, minimum_confidence))

    label = structural_conflict(left, right)
    if ratio in JVM_SIMILARITIES:
        result = bind(label, lambda conflict: score(
            conflict, ratio(words(left, conflict), words(right, conflict)), ratio(keys(left, conflict), keys(right, conflict))))
        if floor is None:
            return pairs.withColumn("_score", result).select(*pairs.columns, "_score.*")
        # Filtered inside the array: a filter behind it would be pushed below and score every pair twice.
        return pairs.select(*pairs.columns, F.inline(F.filter(F.array(result), lambda s: s["confidence"] >= floor)))
    conflict = F.col("_conflict")
    texts = {"_tl": words(left, conflict), "_tr": words(right, conflict), "_kl": keys(left, conflict), "_kr": keys(right, conflict)}
    staged = pairs.withColumn("_conflict", label).withColumns(texts)
    if floor is not None:
        # Both texts of a pair have the same characters but for their order: one bound holds for both.
        most = ratio_bound(F.col("_tl"), F.col("_tr"))
        staged = staged.where(score(conflict, most, most)["confidence"] >= floor)
    staged = materialize(staged)
    both = staged.select(F.explode(F.array(F.struct(F.col("_tl").alias("a"), F.col("_tr").alias("b")), F.struct(F.col("_kl").alias("a"), F.col("_kr").alias("b")))).alias("t")).select("t.*")
    known = distinct_ratios(both, "a", "b", "ratio", similarity)
    known = materialize(known)
    for name, one, two in (("_ordered", "_tl", "_tr"), ("_sorted", "_kl", "_kr")):
        staged = staged.join(known.select(F.col("a").alias(one), F.col("b").alias(two), F.col("ratio").alias(name)), [one, two], "left")
    result = score(conflict, F.col("_ordered"), F.col("_sorted"))
    return staged.withColumn("_score", result).select(*pairs.columns, "_score.*")


def signed(listings: DataFrame) -> DataFrame:
    """Listing ids, shop, identifiers and signature: compute once, then reuse."""
    keep = [c for c in ("listing_id", "store_id", "master_id", "sku", "ean", "name") if c in listings.columns]
    return listings.select(*keep, signature(F.col("name")).alias("sig"))


def eligible(signed_listings: DataFrame) -> DataFrame:
    return signed_listings.where(
        "store_id is not null and not sig.is_pack and sig.volume_ml is not null and size(sig.core_tokens) > 0"
    )


def profile_members(signed_listings: DataFrame) -> DataFrame:
    """Listings with the profile they belong to; a profile is named by its lowest id."""
    flat = eligible(signed_listings).select("listing_id", "store_id", *[F.col(f"sig.{c}").alias(c) for c in PROFILE[1:]])
    named = flat.groupBy(*PROFILE).agg(F.min("listing_id").alias("profile_id"))
    same = [flat[c].eqNullSafe(named[c]) if c in ("abv_pct", "vintage_year") else flat[c] == named[c] for c in PROFILE]
    return flat.select("listing_id", *PROFILE).join(named, same).select("listing_id", "profile_id")


def profiles(signed_listings: DataFrame) -> DataFrame:
    flat = eligible(signed_listings).select("listing_id", "store_id", *[F.col(f"sig.{c}").alias(c) for c in PROFILE[1:]])
    return flat.groupBy(*PROFILE).agg(F.min("listing_id").alias("profile_id"), F.count("*").alias("copies")).select(
        "profile_id", "store_id", "copies", F.struct(*PROFILE[1:], F.lit(False).alias("is_pack")).alias("sig")
    )


def _bonus(vintage: Column, abv: Column) -> Column:
    return F.when(vintage, SAME_VINTAGE_BONUS).otherwise(0.0) + F.when(abv, SAME_ABV_BONUS).otherwise(0.0)


def _most(shared: Column, small: Column, large: Column, bonus: Column) -> Column:
    """Upper bound of a pair's score from its word counts: the text ratio counts as 1."""
    return F.lit(CONTAINMENT_WEIGHT) * shared / small + F.lit(JACCARD_WEIGHT) * shared / (small + large - shared) + SEQUENCE_WEIGHT + bonus + 1e-9


def rare_words(profs: DataFrame) -> DataFrame:
    """Profiles with their distinct words, the rarest of the block (volume and brand) first."""
    block = [F.col("sig.volume_ml").alias("volume_ml"), F.col("sig.brand").alias("brand")]
    words = profs.select("profile_id", *block, F.explode(F.array_distinct("sig.core_tokens")).alias("word"))
    keys = ["volume_ml", "brand", "word"]
    frequency = words.groupBy(*keys).agg(F.count("*").alias("uses"))
    # Words of one name: a bounded list.
    found = words.join(frequency, keys).groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("uses", "word"))).alias("found"))
    return profs.select("profile_id", "store_id", "sig", *block).join(found, "profile_id").select(
        "profile_id", "store_id", "sig", "volume_ml", "brand", F.col("found.word").alias("words"), F.size("found").alias("size")
    )


def candidate_profiles(ordered: DataFrame, floor: float) -> DataFrame:
    """Pairs of profiles of different shops that can reach ``floor``; ``ordered`` comes from ``rare_words``.

    Blocks on volume and brand, which differ only in pairs that score zero, and
    inside a block on words. The smaller word set probes with its rarest words;
    by the pigeonhole principle one of them is shared. How many words it must share follows from its size and from
    the bonuses it can get. A pair is emitted by its first shared probe word only, so no duplicate elimination is needed.
    With a column ``closed`` (shops that a profile needs no pair of), pairs that neither side needs are left out.
    A profile is sent once for every word of its name, so only what the join asks for goes along; signatures are added to the pairs.
    """
    size, sigs = F.col("size"), ordered.select("profile_id", "sig")
    ordered = ordered.withColumns({c: F.col(f"sig.{c}") for c in ("vintage_year", "abv_pct")}).drop("sig")
    bonus = _bonus(F.col("vintage_year").isNotNull(), F.col("abv_pct").isNotNull())
    needed = F.array_min(F.filter(F.sequence(F.lit(1), size), lambda s: (s == size) | (_most(s, size, size, bonus) >= floor)))
    ordered = ordered.withColumn("probes", size - needed + 1)
    probe = ordered.select("*", F.posexplode(F.slice("words", F.lit(1), F.col("probes"))).alias("pos", "word"))
    index = ordered.select("*", F.explode("words").alias("word"))
    a, b = probe.alias("a"), index.alias("b")

    def differ(name: str) -> Column:
        return F.coalesce(F.col(f"a.{name}") != F.col(f"b.{name}"), F.lit(False))

    apart = F.abs(F.col("a.abv_pct") - F.col("b.abv_pct"))
    shared = F.size(F.array_intersect("a.words", "b.words"))
    same = _bonus(F.col("a.vintage_year") == F.col("b.vintage_year"), apart <= ABV_SAME)
    condition = (
        (F.col("a.volume_ml") == F.col("b.volume_ml")) & (F.col("a.brand") == F.col("b.brand"))
        & (F.col("a.word") == F.col("b.word")) & (F.col("a.store_id") != F.col("b.store_id"))
        & ((F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.profile_id") < F.col("b.profile_id"))))
        & ~differ("vintage_year") & ~F.coalesce(apart > ABV_TOLERANCE, F.lit(False))
    )
    if "closed" in ordered.columns:
        condition &= ~F.array_contains("a.closed", F.col("b.store_id")) | ~F.array_contains("b.closed", F.col("a.store_id"))
    met = a.join(b, condition & ~F.arrays_overlap(F.slice("a.words", F.lit(1), F.col("a.pos")), F.col("b.words")))
    first = F.col("a.store_id") < F.col("b.store_id")

    def side(name: str, when_first: str, otherwise: str) -> Column:
        return F.when(first, F.col(f"{when_first}.{name}")).otherwise(F.col(f"{otherwise}.{name}"))

    pairs = met.where((shared == F.col("a.size")) | (_most(shared, F.col("a.size"), F.col("b.size"), same) >= floor)).select(
        side("profile_id", "a", "b").alias("left_profile"), side("profile_id", "b", "a").alias("right_profile"),
        side("store_id", "a", "b").alias("left_store"), side("store_id", "b", "a").alias("right_store"),
    )
    left = sigs.select(F.col("profile_id").alias("left_profile"), F.col("sig").alias("l"))
    right = sigs.select(F.col("profile_id").alias("right_profile"), F.col("sig").alias("r"))
    return pairs.join(left, "left_profile").join(right, "right_profile").select("left_profile", "right_profile", "left_store", "right_store", "l", "r")


def scored_profiles(ordered: DataFrame, minimum_confidence: float = 0.86, similarity: str = "sequence", floor: float | None = None) -> DataFrame:
    """Pairs with a confidence of at least ``floor``, without one all that are worth keeping: accepted, or close enough for a review."""
    if floor is None:
        floor = min(minimum_confidence, max(REVIEW_FLOOR, minimum_confidence - REVIEW_MARGIN))
    scored = with_pair_score(candidate_profiles(ordered, floor), minimum_confidence, similarity, floor)
    keep = ["left_profile", "right_profile", "left_store", "right_store", "confidence", "method", "accepted"]
    return scored.where(F.col("confidence") >= floor).select(*keep, (F.col("l.brand") == F.col("r.brand")).alias("same_brand"))


def best_per_store(scored: DataFrame, profs: DataFrame, members: DataFrame) -> DataFrame:
    """Best counterpart of a profile in each other shop, and whether it is ambiguous."""
    pairs = scored.where("accepted").select("left_profile", "right_profile", "left_store", "right_store", "confidence")
    both = pairs.select(
        F.col("left_profile").alias("profile_id"), F.col("right_profile").alias("other"),
        F.col("right_store").alias("other_store"), "confidence",
    ).unionByName(
        pairs.select(
            F.col("right_profile").alias("profile_id"), F.col("left_profile").alias("other"),
            F.col("left_store").alias("other_store"), "confidence",
        )
    )
    # The two lowest ids of every profile with copies; the rank filter limits before the shuffle.
    second = (
        members.withColumn("rank", F.row_number().over(Window.partitionBy("profile_id").orderBy("listing_id")))
        .where("rank <= 2").where("rank = 2")
        .select(F.col("profile_id").alias("other"), F.col("listing_id").alias("second_id"))
    )
    order = Window.partitionBy("profile_id", "other_store").orderBy(F.desc("confidence"), "other")
    top = both.withColumn("rank", F.row_number().over(order)).where("rank <= 2").join(second, "other", "left")
    first, runner = F.col("rank") == 1, F.col("rank") == 2
    best = top.groupBy("profile_id", "other_store").agg(
        F.max(F.when(first, F.col("other"))).alias("best"),
        F.max(F.when(first, F.col("confidence"))).alias("confidence"),
        F.max(F.when(first, F.col("second_id"))).alias("copy_id"),
        F.max(F.when(runner, F.col("other"))).alias("next_id"),
        F.max(F.when(runner, F.col("confidence"))).alias("next_confidence"),
    )
    tied = F.col("next_confidence") == F.col("confidence")
    runner_id = (
        F.when(F.col("copy_id").isNull(), F.col("next_id"))
        .when(tied, F.least("copy_id", "next_id"))
        .otherwise(F.col("copy_id"))
    )
    runner_confidence = F.when(F.col("copy_id").isNotNull(), F.col("confidence")).otherwise(F.col("next_confidence"))
    return best.select(
        "profile_id", "other_store", "best", "confidence", runner_id.alias("runner_id"),
        runner_confidence.alias("runner_confidence"),
        F.coalesce(F.col("confidence") - runner_confidence < AMBIGUITY_GAP, F.lit(False)).alias("ambiguous"),
    )


def reciprocal_best(scored: DataFrame, best: DataFrame) -> DataFrame:
    """Edges that are the unambiguous best from both sides.

    A profile with copies is ambiguous for its counterpart, so both ends of an
    edge are single listings and the profile name is the listing id.
    """
    clear = best.where("not ambiguous").select("profile_id", "best")
    left = clear.select(F.col("profile_id").alias("left_profile"), F.col("best").alias("right_profile"))
    right = clear.select(F.col("best").alias("left_profile"), F.col("profile_id").alias("right_profile"))
    keys = ["left_profile", "right_profile"]
    return (
        scored.where("accepted").join(left, keys, "left_semi").join(right, keys, "left_semi")
        .select(F.col("left_profile").alias("left_id"), F.col("right_profile").alias("right_id"), "confidence", "method")
    )


def review_pairs(scored: DataFrame, best: DataFrame, members: DataFrame, limit: int = REVIEW_LIMIT) -> DataFrame:
    """The ``limit`` most confident pairs to look at: near misses and ambiguous bests.

    The one cut is at the end, by (confidence, least id, greatest id). Before it, only rows go that
    ``limit`` others precede: near misses below the ``limit``-th best confidence, and of the copies of two profiles
    the pair of ranks i and j if i * j is larger, as each pair of lower ranks comes first.
    """
    low = (
        members.withColumn("rank", F.row_number().over(Window.partitionBy("profile_id").orderBy("listing_id")))
        .where(F.col("rank") <= limit).select("profile_id", "listing_id", F.col("rank").cast("bigint").alias("rank"))
    )
    left = low.select(F.col("profile_id").alias("left_profile"), F.col("listing_id").alias("left_id"), F.col("rank").alias("left_rank"))
    right = low.select(F.col("profile_id").alias("right_profile"), F.col("listing_id").alias("right_id"), F.col("rank").alias("right_rank"))
    misses = scored.where("not accepted").select("left_profile", "right_profile", "confidence")
    floor = misses.orderBy(F.desc("confidence")).limit(limit).agg(F.min("confidence").alias("floor"))
    top_near = misses.join(floor, F.col("confidence") >= F.col("floor"))
    # Ranks are listed before the join, so that only pairs of copies that are kept are formed.
    copies = low.groupBy(F.col("profile_id").alias("right_profile")).agg(F.max("rank").alias("copies"))
    ranks = F.sequence(F.lit(1).cast("bigint"), F.least(F.floor(F.lit(limit) / F.col("left_rank")), F.col("copies")))
    ranked = top_near.join(copies, "right_profile").join(left, "left_profile").withColumn("right_rank", F.explode(ranks))
    near = ranked.join(right, ["right_profile", "right_rank"]).select(
        "left_id", "right_id", "confidence", F.lit("near_threshold").alias("method")
    )
    doubtful = best.where("ambiguous").select(
        "profile_id",
        F.explode(
            F.array(
                F.struct(F.col("best").alias("other_id"), "confidence"),
                F.struct(F.col("runner_id").alias("other_id"), F.col("runner_confidence").alias("confidence")),
            )
        ).alias("o"),
    )
    ambiguous = doubtful.join(members, "profile_id").select(
        F.col("listing_id").alias("left_id"), F.col("o.other_id").alias("right_id"),
        F.col("o.confidence").alias("confidence"), F.lit("ambiguous_best").alias("method"),
    )
    both = near.unionByName(ambiguous)
    pair = both.groupBy(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).agg(
        F.max("confidence").alias("confidence"), F.max_by("method", "confidence").alias("method")
    )
    reason = F.when(F.col("method") == "near_threshold", "similarity below threshold").otherwise(
        "two candidates within 0.015"
    )
    return pair.withColumn("reason", reason).orderBy(F.desc("confidence"), "left_id", "right_id").limit(limit)


class MatchPlan:
    """The DataFrames of one matching pass.

    Signatures and scored pairs feed several branches each, so they are written
    out once, when they are first asked for; everything else stays lazy.
    """

    def __init__(self, listings: DataFrame, minimum_confidence: float = 0.86, similarity: str = "sequence"):
        self.minimum_confidence, self.similarity = minimum_confidence, similarity
        self.signed = materialize(signed(listings))
        self.profiles = profiles(self.signed)
        self.members = profile_members(self.signed)

    def pairs(self, ordered: DataFrame, floor: float | None = None) -> DataFrame:
        return materialize(scored_profiles(ordered, self.minimum_confidence, self.similarity, floor))

    @cached_property
    def ordered(self) -> DataFrame:
        return materialize(rare_words(self.profiles))

    @cached_property
    def scored(self) -> DataFrame:
        """All accepted pairs and near misses."""
        return self.pairs(self.ordered)

    @cached_property
    def accepted(self) -> DataFrame:
        """All accepted pairs."""
        return self.pairs(self.ordered, self.minimum_confidence)

    @cached_property
    def best(self) -> DataFrame:
        """Best counterparts with their runners-up."""
        return best_per_store(self.accepted, self.profiles, self.members)

    @cached_property
    def deciding(self) -> DataFrame:
        """The accepted pairs that decide which best counterparts are clear.

        Where a profile has a counterpart of confidence 1 in a shop, only pairs within ``AMBIGUITY_GAP`` of it matter;
        lower ones are formed for the other profiles and shops.
        """
        high = max(self.minimum_confidence, 1.0 - AMBIGUITY_GAP)
        top = self.pairs(self.ordered, high)
        full = top.where("confidence = 1")
        closed = full.select(F.col("left_profile").alias("profile_id"), F.col("right_store").alias("shop")).unionByName(
            full.select(F.col("right_profile").alias("profile_id"), F.col("left_store").alias("shop"))
        ).groupBy("profile_id").agg(F.collect_set("shop").alias("closed"))
        none = F.array().cast(f"array<{dict(full.dtypes)['left_store']}>")
        marked = self.ordered.join(closed, "profile_id", "left").withColumn("closed", F.coalesce("closed", none))
        rest = self.pairs(marked, self.minimum_confidence)
        return top.unionByName(rest.where(F.col("confidence") < high))

    @cached_property
    def clear(self) -> DataFrame:
        """``best`` as far as ``deciding`` goes: of runners-up, it has for certain those that make a best one ambiguous."""
        return best_per_store(self.deciding, self.profiles, self.members)

    @cached_property
    def candidates(self) -> DataFrame:
        return reciprocal_best(self.deciding, self.clear)

    def reviews(self, limit: int = REVIEW_LIMIT) -> DataFrame:
        # Near misses just below the limit first: as soon as there are enough of them, lower ones cannot be listed.
        high = self.minimum_confidence - NEAR_MARGIN
        found = self.pairs(self.ordered, high) if high > REVIEW_FLOOR else self.scored
        if found.where("not accepted").count() < limit:
            found = self.scored
        return review_pairs(found, best_per_store(found, self.profiles, self.members), self.members, limit)

    def counters(self) -> DataFrame:
        """One row: how many listings took part and how many had an ambiguous best."""
        pack, unknown = F.col("sig.is_pack"), F.col("sig.volume_ml").isNull()
        totals = self.signed.agg(
            F.count("*").alias("total_products"),
            F.count_if(~pack & ~unknown).alias("eligible_products"),
            F.count_if(pack).alias("skipped_packs"),
            F.count_if(~pack & unknown).alias("skipped_unknown_volume"),
        )
        doubtful = self.clear.where("ambiguous").select("profile_id").distinct()
        ambiguous = self.profiles.join(doubtful, "profile_id", "left_semi").agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("ambiguous_products")
        )
        return totals.join(ambiguous, F.lit(True))


#: Names with more words are compared pair by pair: their subsets would be too many.
SUBSET_WORDS = 10


def candidate_pair_count(signed_listings: DataFrame) -> DataFrame:
    """How many pairs of shops' listings share a volume and at least one word: an optional counter.

    Names with the same words count as one row per shop. Pairs that have at least one word in common are counted by
    inclusion and exclusion over the subsets of each name's words: subsets are grouped, pairs are not formed, so the
    work grows with the names. The few names with more than ``SUBSET_WORDS`` words meet the others at the first word they share.
    """
    words = F.array_sort(F.array_distinct("sig.core_tokens"))
    names = profiles(signed_listings).select("store_id", "copies", F.col("sig.volume_ml").alias("volume_ml"), words.alias("words"))
    names = materialize(names.groupBy("volume_ml", "words", "store_id").agg(F.sum("copies").alias("copies")))
    short = F.size("words") <= SUBSET_WORDS

    # A subset is named by 128 bits of its words' hashes; ``odd``: it has an odd number of words.
    def grown(sets: Column, word: Column) -> Column:
        one, two = F.xxhash64(word), F.xxhash64(F.lit("other"), word)
        return F.concat(sets, F.transform(sets, lambda s: F.struct(
            s["one"].bitwiseXOR(one).alias("one"), s["two"].bitwiseXOR(two).alias("two"), (~s["odd"]).alias("odd"))))

    empty = F.array(F.struct(F.lit(0).cast("bigint").alias("one"), F.lit(0).cast("bigint").alias("two"), F.lit(False).alias("odd")))
    subsets = F.slice(F.aggregate("words", empty, grown), F.lit(2), F.lit(2**SUBSET_WORDS))
    exact = "decimal(38,0)"
    keys = ["volume_ml", "one", "two", "odd"]
    rows = names.where(short).select("volume_ml", "store_id", "copies", F.inline(subsets))
    by_shop = rows.groupBy(*keys, "store_id").agg(F.sum("copies").alias("n"))
    by_set = by_shop.groupBy(*keys).agg(((F.sum("n").cast(exact) * F.sum("n") - F.sum(F.col("n").cast(exact) * F.col("n"))) / 2).alias("pairs"))
    of_short = by_set.agg(F.sum(F.when(F.col("odd"), F.col("pairs")).otherwise(-F.col("pairs"))).alias("pairs"))

    left = names.select("*", short.alias("short"), F.explode("words").alias("word"))
    right = left.select("volume_ml", "word", *(F.col(c).alias(f"other_{c}") for c in ("store_id", "copies", "words", "short")))
    first = F.array_min(F.array_intersect("words", "other_words"))
    # Two long names once, by shop; a long and a short one once, from the long one.
    once = (F.col("store_id") != F.col("other_store_id")) & (F.col("other_short") | (F.col("store_id") < F.col("other_store_id")))
    met = left.where("not short").join(right, ["volume_ml", "word"]).where(once & (F.col("word") == first))
    of_long = met.agg(F.sum((F.col("copies") * F.col("other_copies")).cast(exact)).alias("pairs"))
    return of_short.unionByName(of_long).agg(F.coalesce(F.sum("pairs").cast("bigint"), F.lit(0).cast("bigint")).alias("candidate_pairs"))


def _spanning_edges(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges that connect what every pair of two groups' members would connect.

    ``members``: ``group_id``, ``listing_id``; a group is named by its lowest id.
    ``pairs``: ``left_group``, ``right_group``. Group heads are joined pair by
    pair, every other member to the head of one partner group.
    """
    heads = pairs.select(F.col("left_group").alias("left_id"), F.col("right_group").alias("right_id"))
    both = pairs.select(F.col("left_group").alias("group_id"), F.col("right_group").alias("partner")).unionByName(
        pairs.select(F.col("right_group").alias("group_id"), F.col("left_group").alias("partner"))
    )
    partner = both.groupBy("group_id").agg(F.min("partner").alias("partner"))
    rest = members.where("listing_id <> group_id").join(partner, "group_id").select(
        F.col("listing_id").alias("left_id"), F.col("partner").alias("right_id")
    )
    return heads.unionByName(rest).select(
        F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")
    ).distinct()


def _identifier_groups(signed_listings: DataFrame, identifier: Column, watched_keys: DataFrame | None) -> DataFrame:
    """Listings with one identifier, grouped by all that decides about a veto."""
    base = signed_listings.withColumn("identifier", identifier).where(
        "identifier is not null and identifier <> '' and not sig.is_pack and store_id is not null"
    ).withColumn("rule_key", comparison_key(F.col("sig")))
    if watched_keys is None:
        base = base.withColumn("watched", F.lit(None).cast("string"))
    else:
        flagged = watched_keys.select(F.col("rule_key"), F.col("rule_key").alias("watched")).distinct()
        base = base.join(flagged, "rule_key", "left")
    return base.select(
        "identifier", "listing_id", "store_id", "watched", F.col("sig.volume_ml").alias("volume_ml"),
        F.when(F.col("sig.volume_ml").isNotNull(), F.col("sig.vintage_year")).alias("vintage_year"),
        F.when(F.col("sig.volume_ml").isNotNull(), F.col("sig.abv_pct")).alias("abv_pct"),
    )


_GROUP = ["identifier", "store_id", "watched", "volume_ml", "vintage_year", "abv_pct"]


def _compatible(a: str, b: str) -> Column:
    """No veto between two groups: an unknown volume hides the later checks."""
    unknown = F.col(f"{a}.volume_ml").isNull() | F.col(f"{b}.volume_ml").isNull()

    def agree(name: str) -> Column:
        return F.coalesce(F.col(f"{a}.{name}") == F.col(f"{b}.{name}"), F.lit(True))

    close = F.coalesce(F.abs(F.col(f"{a}.abv_pct") - F.col(f"{b}.abv_pct")) <= ABV_TOLERANCE, F.lit(True))
    return unknown | (agree("volume_ml") & agree("vintage_year") & close)


def identifier_edges(signed_listings: DataFrame, identifier: Column, exclusions: DataFrame | None = None) -> DataFrame:
    """Edges between listings of different shops that share an identifier."""
    watched = None
    if exclusions is not None:
        watched = exclusions.select(F.explode(F.array("left_key", "right_key")).alias("rule_key")).distinct()
    rows = _identifier_groups(signed_listings, identifier, watched)
    groups = rows.groupBy(*_GROUP).agg(F.min("listing_id").alias("group_id"))
    same = None
    for c in _GROUP:
        test = rows[c].eqNullSafe(groups[c])
        same = test if same is None else same & test
    members = rows.join(groups, same).select("group_id", "listing_id")
    a, b = groups.alias("a"), groups.alias("b")
    pairs = a.join(
        b,
        (F.col("a.identifier") == F.col("b.identifier")) & (F.col("a.store_id") < F.col("b.store_id")) & _compatible("a", "b"),
    ).select(
        F.col("a.group_id").alias("left_group"), F.col("b.group_id").alias("right_group"),
        F.least("a.watched", "b.watched").alias("left_key"), F.greatest("a.watched", "b.watched").alias("right_key"),
        F.col("a.watched").isNotNull().alias("wl"), F.col("b.watched").isNotNull().alias("wr"),
    )
    if exclusions is not None:
        free = pairs.where("not (wl and wr)")
        checked = pairs.where("wl and wr").join(exclusions.select("left_key", "right_key"), ["left_key", "right_key"], "left_anti")
        pairs = free.select("left_group", "right_group").unionByName(checked.select("left_group", "right_group"))
    return _spanning_edges(members, pairs)


def _upgrade_by_ean(edges: DataFrame, signed_listings: DataFrame) -> DataFrame:
    """Edges whose ends share a barcode without a veto become barcode edges."""
    facts = signed_listings.select("listing_id", F.trim("ean").alias("ean"), "store_id", "sig")
    l = facts.select(F.col("listing_id").alias("left_id"), F.struct("ean", "store_id", "sig").alias("lf"))
    r = facts.select(F.col("listing_id").alias("right_id"), F.struct("ean", "store_id", "sig").alias("rf"))
    joined = edges.join(l, "left_id").join(r, "right_id")
    same = (
        (F.col("lf.ean") == F.col("rf.ean")) & (F.col("lf.ean") != "") & (F.col("confidence") < 1.0)
        & ~vetoed(F.col("lf.sig"), F.col("rf.sig"))
    )
    hit = F.coalesce(same, F.lit(False))
    return joined.select(
        "left_id", "right_id", F.when(hit, 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(hit, F.lit("ean_exact")).otherwise(F.col("method")).alias("method"),
    )


def sku_edges(plan: MatchPlan) -> DataFrame:
    """Same stock code, same brand and a strong score of their own."""
    codes = plan.signed.select("listing_id", F.lower(F.trim("sku")).alias("sku")).where("sku <> ''").join(plan.members, "listing_id")
    coded = plan.ordered.join(codes.select("profile_id"), "profile_id", "left_semi")
    strong = plan.pairs(coded, SKU_SCORE).where("same_brand")
    groups = codes.groupBy("profile_id", "sku").agg(F.min("listing_id").alias("group_id"))
    members = codes.join(groups, ["profile_id", "sku"]).select("group_id", "listing_id")
    l = groups.select(F.col("profile_id").alias("left_profile"), "sku", F.col("group_id").alias("left_group"))
    r = groups.select(F.col("profile_id").alias("right_profile"), "sku", F.col("group_id").alias("right_group"))
    pairs = strong.join(l, "left_profile").join(r, ["right_profile", "sku"]).select("left_group", "right_group", "confidence")
    score = F.greatest(F.lit(SKU_CONFIDENCE), F.col("confidence"))
    by_head = pairs.select(F.col("left_group").alias("h"), F.col("right_group").alias("o"), score.alias("c")).unionByName(
        pairs.select(F.col("right_group").alias("h"), F.col("left_group").alias("o"), score.alias("c"))
    )
    chosen = by_head.groupBy("h").agg(F.max_by(F.struct("o", "c"), F.struct("c", "o")).alias("p"))
    heads = pairs.select(F.col("left_group").alias("left_id"), F.col("right_group").alias("right_id"), score.alias("confidence"))
    rest = members.where("listing_id <> group_id").join(chosen, F.col("group_id") == F.col("h")).select(
        F.col("listing_id").alias("left_id"), F.col("p.o").alias("right_id"), F.col("p.c").alias("confidence")
    )
    both = heads.unionByName(rest)
    return both.groupBy(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).agg(
        F.max("confidence").alias("confidence")
    )


def equivalence_edges(signed_listings: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges of manual equivalences: rule keys joined to listings on both sides.

    ``signed_listings`` should be a stored table: a signature that is still an expression is evaluated by the filter and again behind it.
    """
    numbered = rules.select("left_key", "right_key").distinct().withColumn("rule_id", F.concat_ws("\u0001", "left_key", "right_key"))
    keyed = signed_listings.where("not sig.is_pack and store_id is not null").withColumn("rule_key", comparison_key(F.col("sig")))
    sides = numbered.select("rule_id", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), F.col("left_key").alias("rule_key")),
        F.struct(F.lit("r").alias("side"), F.col("right_key").alias("rule_key")))).alias("s")).select("rule_id", "s.*")
    rows = keyed.join(sides, "rule_key").select(
        "rule_id", "side", "listing_id", "store_id", F.col("sig.volume_ml").alias("volume_ml"),
        F.when(F.col("sig.volume_ml").isNotNull(), F.col("sig.vintage_year")).alias("vintage_year"),
        F.when(F.col("sig.volume_ml").isNotNull(), F.col("sig.abv_pct")).alias("abv_pct"),
    )
    rows = materialize(rows)  # the listings that a rule names: groups, members and both sides of the pairs read them
    keys = ["rule_id", "side", "store_id", "volume_ml", "vintage_year", "abv_pct"]
    groups = rows.groupBy(*keys).agg(F.min("listing_id").alias("group_id"))
    same = None
    for c in keys:
        test = rows[c].eqNullSafe(groups[c])
        same = test if same is None else same & test
    members = rows.join(groups, same).select(groups["group_id"], rows["listing_id"]).distinct()
    a, b = groups.alias("a"), groups.alias("b")
    pairs = a.join(
        b,
        (F.col("a.rule_id") == F.col("b.rule_id")) & (F.col("a.side") == "l") & (F.col("b.side") == "r")
        & (F.col("a.store_id") != F.col("b.store_id")) & _compatible("a", "b"),
    ).select(F.col("a.group_id").alias("left_group"), F.col("b.group_id").alias("right_group"))
    return _spanning_edges(members, pairs)


def without_exclusions(edges: DataFrame, signed_listings: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Drop edges between two names a reviewer ruled out."""
    keys = signed_listings.select("listing_id", comparison_key(F.col("sig")).alias("k"))
    named = edges.join(keys.select(F.col("listing_id").alias("left_id"), F.col("k").alias("lk")), "left_id").join(
        keys.select(F.col("listing_id").alias("right_id"), F.col("k").alias("rk")), "right_id"
    )
    rules = exclusions.select(F.least("left_key", "right_key").alias("lo"), F.greatest("left_key", "right_key").alias("hi")).distinct()
    hit = (F.least("lk", "rk") == F.col("lo")) & (F.greatest("lk", "rk") == F.col("hi"))
    return named.join(rules, hit, "left_anti").drop("lk", "rk")


def _strongest(edges: DataFrame) -> DataFrame:
    """One edge per pair: highest confidence, earlier source on ties."""
    pair = [F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")]
    return edges.groupBy(*pair).agg(
        F.max_by(F.struct("confidence", "method"), F.struct("confidence", (-F.col("source")).alias("s"))).alias("e")
    ).select("left_id", "right_id", "e.confidence", "e.method")


def augment_candidates(plan: MatchPlan, rules: DataFrame | None = None) -> DataFrame:
    """Scored edges plus barcode, stock code and manual edges, minus exclusions.

    Exclusions act before equivalences, so a manual equivalence wins.
    """
    exclusions = equivalences = None
    if rules is not None:
        active = rules.where("is_active").select(
            "rule_type", F.least("left_key", "right_key").alias("left_key"), F.greatest("left_key", "right_key").alias("right_key")
        )
        exclusions, equivalences = active.where("rule_type = 'exclusion'"), active.where("rule_type = 'equivalence'")
    edges = _upgrade_by_ean(plan.candidates, plan.signed).withColumn("source", F.lit(0))
    ean = identifier_edges(plan.signed, F.trim("ean"), exclusions).select(
        "left_id", "right_id", F.lit(1.0).alias("confidence"), F.lit("ean_exact").alias("method"), F.lit(1).alias("source")
    )
    sku = sku_edges(plan).select(
        "left_id", "right_id", "confidence", F.lit("sku_secondary_verified").alias("method"), F.lit(2).alias("source")
    )
    merged = _strongest(edges.unionByName(ean).unionByName(sku))
    if exclusions is None:
        return merged
    kept = without_exclusions(merged, plan.signed, exclusions).withColumn("source", F.lit(0))
    manual = equivalence_edges(plan.signed, equivalences).select(
        "left_id", "right_id", F.lit(1.0).alias("confidence"), F.lit("manual_equivalence").alias("method"), F.lit(1).alias("source")
    )
    return _strongest(kept.unionByName(manual))


def connected_components(edges: DataFrame) -> DataFrame:
    """Lowest reachable id per vertex: alternating large-star and small-star rounds.

    A round is two aggregations and two equi-joins; a hub with a third of all
    edges only makes one skewed join side, which AQE splits.
    """
    links = edges.select(F.col("left_id").cast("bigint").alias("u"), F.col("right_id").cast("bigint").alias("v")).where("u <> v")
    links = cut_lineage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            down.select("u", F.col("m").alias("v"))
        ).distinct()
        links = cut_lineage(small)
        seen = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return links.select(F.col("u").alias("listing_id"), F.col("v").alias("component_id")).unionByName(
        links.select(F.col("v").alias("listing_id"), F.col("v").alias("component_id")).distinct()
    )
