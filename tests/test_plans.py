"""Texts are read once: what the optimised plan says about how often a pattern is evaluated."""

import pytest

from pricetide.functions import wordlists as W
from pricetide.plans import q_identity, q_matching, q_sources
from pricetide.plans.views import Tables
from pricetide.sources.pages import LABELS


@pytest.fixture(scope="module")
def tables(spark, folder):
    return Tables(spark, folder)


def times(df, pattern: str) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count(pattern)


def test_labelled_quotes_read_a_card_once(tables):
    rows = q_sources.extract_labelled_quotes(tables)
    assert times(rows, LABELS["member"]) == 1 and times(rows, "<(script|style)") == 3  # text, heading and link


@pytest.mark.parametrize("name", ["extract_cards_heading_quantity", "extract_cards_heading_cart", "extract_cards_unit_priced", "extract_cards_last_price"])
def test_cards_read_their_prices_once(tables, name):
    assert times(getattr(q_sources, name)(tables), r"\$\s*([\d.]+)") == 1


def test_json_ld_reads_a_page_once(tables):
    rows = q_sources.extract_json_ld(tables)
    assert times(rows, "<(script|style)") == 1 and times(rows, "product:price:amount|og:price:amount") == 1


def test_pack_repair_reads_names_once(tables):
    # Left is the repaired name of each mixed product, which both sides of the moves read.
    assert times(q_identity.repair_pack_summary(tables), W.PACK_WORD_PATTERN) <= 2


@pytest.mark.parametrize("name", ["structural_conflict", "manual_equivalence", "ean_pairs"])
def test_pairs_read_stored_signatures(tables, name):
    assert times(getattr(q_matching, name)(tables), W.PACK_WORD_PATTERN) == 0
