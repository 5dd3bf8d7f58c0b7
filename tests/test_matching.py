import random
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pricetide.functions.signature import signature
from pricetide.operators import identity as I
from pricetide.operators import matching as M


def pair(spark, left, right, minimum=0.86):
    df = spark.createDataFrame([(left, right)], "a string, b string").select(signature(F.col("a")).alias("l"), signature(F.col("b")).alias("r"))
    return M.with_pair_score(df, minimum).first()


@pytest.mark.parametrize("left,right,method", [
    ("Whisky Johnnie Walker Black Label 750 ml", "Johnnie Walker Etiqueta Negra 75 cl", "alias_exact"),
    ("Johnnie Walker Black Label 750 ml", "Johnnie Walker Black Label 1 litro", "volume_conflict"),
    ("Johnnie Walker Black Label 750 ml", "Johnnie Walker Red Label 750 ml", "variant_conflict"),
    ("Santa Rita Reserva 2021 750 ml", "Santa Rita Reserva 2022 750 ml", "vintage_conflict"),
    ("Gin Norte Azul 40° 700 ml", "Gin Norte Azul 47° 700 ml", "abv_conflict"),
    ("Gin Norte 700 ml X6", "Gin Norte 700 ml", "excluded_pack"),
    ("Gin Norte", "Gin Norte 700 ml", "unknown_volume"),
])
def test_labels(spark, left, right, method):
    row = pair(spark, left, right)
    assert row["method"] == method
    assert row["accepted"] == (method == "alias_exact")


def test_review_band(spark):
    row = pair(spark, "Johnnie Walker Black Label 750 ml", "Johnnie Walker Black Edition 750 ml", 0.80)
    assert not row["accepted"] and 0.72 <= row["confidence"] < 0.80


def listings(spark, rows):
    return spark.createDataFrame(rows, "listing_id bigint, store_id int, master_id bigint, name string, sku string, ean string")


def edges(df):
    return {(r["left_id"], r["right_id"]): (round(r["confidence"], 6), r["method"]) for r in df.collect()}


def test_copies_are_ambiguous(spark):
    rows = [(1, 1, 1, "Absolut Vodka Azul 750 ml", None, None), (2, 2, 2, "Absolut Azul 75 cl", None, None), (3, 2, 3, "Absolut Azul 750 ml", None, None)]
    plan = M.MatchPlan(listings(spark, rows))
    assert edges(plan.candidates) == {}
    assert {(r["left_id"], r["right_id"], r["method"]) for r in plan.reviews().collect()} == {(1, 2, "ambiguous_best"), (1, 3, "ambiguous_best")}


def test_four_spellings_form_one_component(spark):
    names = ["Whisky Johnnie Walker Black Label 750 ml", "Johnnie Walker Etiqueta Negra 75 cl", "JW Black Label 750cc", "Johnny Walker Black Label 750 ml"]
    plan = M.MatchPlan(listings(spark, [(i, i, i, n, None, None) for i, n in enumerate(names, 1)]))
    found = M.augment_candidates(plan)
    assert found.count() >= 3 and plan.counters().first()["ambiguous_products"] == 0
    components = M.connected_components(found)
    assert {r["component_id"] for r in components.collect()} == {1} and components.count() == 4
    assigned = I.assign_masters(components, found, plan.signed).collect()
    assert {r["master_id"] for r in assigned} == {1}


def test_barcode_and_rules(spark):
    rows = [(1, 1, 1, "Absolut Uno 750 ml", None, "780000000001"), (2, 2, 2, "Smirnoff Dos 750 ml", None, "780000000001"),
            (3, 1, 3, "Bacardi Oro Viejo 700 ml", None, None), (4, 2, 4, "Bacardi Oro Viejo 70 cl", None, None),
            (5, 1, 5, "Capel Uno 700 ml", None, None), (6, 2, 6, "Mistral Otro 700 ml", None, None), (7, 2, 7, "Absolut Uno 1 litro", None, "780000000001")]
    rules = spark.createDataFrame([("exclusion", "bacardi oro viejo|700", "bacardi oro viejo|700", True), ("equivalence", "capel uno|700", "mistral otro|700", True)],
                                  "rule_type string, left_key string, right_key string, is_active boolean")
    plan = M.MatchPlan(listings(spark, rows))
    assert edges(plan.candidates) == {(3, 4): (1.0, "alias_exact")}
    assert edges(M.augment_candidates(plan, rules)) == {(1, 2): (1.0, "ean_exact"), (5, 6): (1.0, "manual_equivalence")}


def test_hot_barcode_is_not_quadratic(spark):
    n = 400
    rows = [(i, i % 2, i, f"Absolut Sabor{i} 750 ml", None, "0000") for i in range(n)]
    found = M.identifier_edges(M.signed(listings(spark, rows)), F.trim("ean"))
    assert found.count() <= 2 * n
    assert {r["component_id"] for r in M.connected_components(found).collect()} == {0}


def _score(a, b):
    """Brute-force score of two signatures (rows) without conflicts."""
    if a["variant_tokens"] and b["variant_tokens"] and a["variant_tokens"] != b["variant_tokens"]:
        return 0.0
    left, right = set(a["core_tokens"]), set(b["core_tokens"])
    shared = len(left & right)
    if not shared:
        return 0.0
    if a["core_key"] == b["core_key"]:
        return 1.0
    small = min(len(left), len(right))
    ratio = max(SequenceMatcher(None, " ".join(a["core_tokens"]), " ".join(b["core_tokens"])).ratio(), SequenceMatcher(None, a["core_key"], b["core_key"]).ratio())
    score = 0.5 * (shared / small) + 0.25 * (shared / len(left | right)) + 0.25 * ratio
    if shared == small and small >= 2:
        score = max(score, 0.92)
    if shared < 2 and small > 1:
        score -= 0.1
    return max(0.0, min(0.999, score))


def test_candidates_lose_no_pair(spark):
    """The similarity join keeps every pair brute force finds above the review floor."""
    random.seed(7)
    words = ["norte", "sur", "valle", "azul", "sol", "luna", "rio", "alto"]
    rows = [(i, i % 3, i, "Absolut " + " ".join(random.choices(words, k=random.randint(1, 5))) + " 750 ml", None, None) for i in range(90)]
    plan = M.MatchPlan(listings(spark, rows))
    sigs = {r["listing_id"]: (r["store_id"], r["sig"]) for r in plan.signed.collect()}
    want = set()
    for a, b in combinations(sorted(sigs), 2):
        (sa, x), (sb, y) = sigs[a], sigs[b]
        if sa == sb or x["brand"] != y["brand"]:
            continue
        left, right = ((a, x), (b, y)) if sa < sb else ((b, y), (a, x))
        score = _score(left[1], right[1])
        if score >= 0.74:
            want.add((left[0], right[0], round(score, 9)))
    members = {}
    for r in plan.members.collect():
        members.setdefault(r["profile_id"], []).append(r["listing_id"])
    got = {(l, r, round(row["confidence"], 9)) for row in plan.scored.collect() for l in members[row["left_profile"]] for r in members[row["right_profile"]]}
    assert got == want and len(want) > 20


def test_near_copies_do_not_form_all_pairs(spark):
    """Copies of a product whose names differ in one word: only pairs that decide something are formed."""
    rows = [(i * 10 + shop, shop, i, f"Absolut Gin Norte k7 m{i} Reserva 2019 750 ml", None, None) for i in range(30) for shop in (1, 2, 3)]
    plan = M.MatchPlan(listings(spark, rows))
    assert plan.deciding.count() == 30 * 3 and plan.accepted.count() > 3 * 30 * 3
    assert edges(plan.candidates) == {(i * 10 + a, i * 10 + b): (1.0, "alias_exact") for i in range(30) for a, b in ((1, 2), (1, 3), (2, 3))}


def test_deciding_pairs_give_what_all_pairs_give(spark):
    random.seed(11)
    words = ["norte", "sur", "valle", "azul", "sol", "luna", "rio", "alto", "2019", "2020"]
    rows = [(i, i % 3, i, "Absolut " + " ".join(random.sample(words, random.randint(2, 6))) + random.choice(["", " 40%", " 45%"]) + " 750 ml", None, None) for i in range(90)]
    plan = M.MatchPlan(listings(spark, rows), similarity="levenshtein")
    full = M.best_per_store(plan.scored, plan.profiles, plan.members)
    want = edges(M.reciprocal_best(plan.scored, full))
    assert edges(plan.candidates) == want and len(want) > 5
    told = lambda best: {(r["profile_id"], r["other_store"], r["best"], r["ambiguous"], r["runner_id"] if r["ambiguous"] else None) for r in best.collect()}
    assert told(plan.clear) == told(full) == told(plan.best)
    listed = lambda df: [(r["left_id"], r["right_id"], round(r["confidence"], 9), r["method"]) for r in df.collect()]
    assert listed(plan.reviews(3)) == listed(M.review_pairs(plan.scored, full, plan.members, 3))


def test_pair_counter_forms_no_pairs(spark):
    """A common word in every name: all pairs of shops count, by subsets of words."""
    random.seed(9)
    words = [f"w{chr(97 + i)}" for i in range(9)]
    rows = [(i, i % 4, i, "comun " + " ".join(random.sample(words, random.randint(1, 5))) + " 750 ml", None, None) for i in range(400)]
    signed = M.signed(listings(spark, rows))
    sizes = [sum(1 for i in range(400) if i % 4 == s) for s in range(4)]
    count = M.candidate_pair_count(signed)
    assert count.first()["candidate_pairs"] == sum(a * b for a, b in combinations(sizes, 2))
    assert M.SUBSET_WORDS < 13  # the test of long names takes both ways


def test_components_against_union_find(spark):
    random.seed(3)
    pairs = [(random.randint(1, 300), random.randint(1, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["listing_id"]: r["component_id"] for r in M.connected_components(spark.createDataFrame(pairs, "left_id bigint, right_id bigint")).collect()}
    assert got == {v: find(v) for p in pairs for v in p if p[0] != p[1]}


def test_pair_counter_with_long_names(spark):
    random.seed(5)
    words = [f"w{chr(97 + i)}" for i in range(18)]
    rows = [(i, i % 3, i, " ".join(random.sample(words, k)) + " 750 ml", None, None) for i, k in enumerate([2, 3, 1, 4, 14, 2, 15, 3, 5, 1, 13, 2, 16, 4, 14])]
    signed = M.signed(listings(spark, rows))
    sigs = [(r["store_id"], set(r["sig"]["core_tokens"])) for r in signed.collect()]
    want = sum(1 for (s, x), (t, y) in combinations(sigs, 2) if s != t and x & y)
    assert M.candidate_pair_count(signed).first()["candidate_pairs"] == want


def test_new_products_are_told_by_the_join_not_by_their_id(spark):
    from types import SimpleNamespace

    from pricetide.functions.text import normalized_key
    from pricetide.plans.q_identity import repair_pack_identity

    # Names whose hashed product ids look like those of known packs.
    hashed = F.xxhash64(normalized_key(F.col("name"))).bitwiseAND(0x7FFFFFFFFFFFFFFF)
    named = spark.range(200000).select(F.concat(F.lit("Gin Norte k"), F.col("id").cast("string"), F.lit(" 750 ml X6")).alias("name")).where(hashed.between(900000000000, 999999999999999))
    pack = named.first()["name"]
    rows = [(11, 1, 1, 2, pack, 100, 1), (12, 2, 1, 3, "Gin Norte Solo 750 ml", 100, 1)]
    catalog = spark.createDataFrame(rows, "listing_id bigint, store_id int, part_id bigint, master_id bigint, name string, data_quality_score int, package_quantity int")
    found = {r["listing_id"]: (r["known_master_id"], r["relinked"]) for r in repair_pack_identity(SimpleNamespace(v_catalog=catalog, v_names=catalog)).collect()}
    assert found == {11: (None, True), 12: (2, False)}


def test_words_are_joined_without_signatures(spark):
    plan = M.MatchPlan(listings(spark, [(i, i, i, f"Ron Abuelo Anejo {7 + i} 700 ml", None, None) for i in range(1, 5)]))
    steps = M.candidate_profiles(plan.ordered, 0.5)._jdf.queryExecution().executedPlan().toString().splitlines()
    exploded = [s for s in steps if "Generate" in s]
    assert len(exploded) >= 2 and not any("sig#" in s for s in exploded)
