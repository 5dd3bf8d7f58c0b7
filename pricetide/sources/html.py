"""Product cards out of HTML.

Walking a tree is the one thing Spark has no expression for, so these readers
run a small parser per page inside ``mapInPandas``. Pages are independent rows;
everything before and after the walk stays in the plan.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.functions.money import PRICE_HIGH, PRICE_LOW, UNIT_PRICE_PATTERNS, discount_pct, price_values
from pricetide.functions.text import ascii_fold, bind
from pricetide.functions.urls import UrlRules, canonical_url

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset(("script", "style"))
#: Pages whose cards are held in Python before they go to the plan.
PAGES_AT_ONCE = 32


class Node:
    """One element: tag, attributes, children (nodes and text), and the nodes among them."""

    __slots__ = ("tag", "attrs", "parent", "children", "elements", "_text", "size", "links", "anchor")

    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.parent, self.children, self.elements, self._text = tag, attrs, parent, [], [], None
        self.size, self.links, self.anchor = 0, 0, None

    def text(self) -> str:
        """Visible text; texts below are made first, by a stack, however deep the page is."""
        waiting = [self]
        while self._text is None:
            node = waiting[-1]
            open_ = [c for c in node.elements if c._text is None and c.tag not in _SILENT]
            if open_:
                waiting += open_
                continue
            parts = [c if isinstance(c, str) else c._text for c in node.children if isinstance(c, str) or c.tag not in _SILENT]
            node._text = " ".join(" ".join(parts).replace("\xa0", " ").split())
            waiting.pop()
        return self._text

    def walk(self) -> Iterator["Node"]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += node.elements[::-1]

    def release(self) -> None:
        """Take the tree apart: without links to its parents it goes at once, not at some later garbage collection."""
        for node in list(self.walk()):
            node.parent = node.anchor = None
            node.children = node.elements = ()

    def classes(self) -> str:
        return (self.attrs.get("class") or "").casefold()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("[document]", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.here)
        self.here.children.append(node)
        self.here.elements.append(node)
        if tag not in _VOID:
            self.here = node

    def handle_endtag(self, tag):
        node = self.here
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        self.here.children.append(data)


def parse_html(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    return builder.root


@dataclass(frozen=True)
class CardProfile:
    """How one kind of shop page shows its products."""

    link_pattern: str                      # what the address of a product link looks like
    start: str = "link"                    # cards are found from a product link, a heading or a code
    low: int = PRICE_LOW
    high: int = PRICE_HIGH
    drop: str | None = None                # unit prices to ignore (see UNIT_PRICE_PATTERNS)
    price_rule: str = "min_max"            # min_max | last_previous | min_only
    minimum_name: int = 3
    max_text: int = 4200
    max_links: int | None = 4
    stop_classes: tuple[str, ...] = ()
    stop_words: tuple[str, ...] = ()
    unavailable: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    title_classes: tuple[str, ...] = ("title",)
    code_pattern: str | None = None
    skip_name: str | None = None
    whole_card_classes: tuple[str, ...] = ()  # cards are these elements; no climbing


# The page styles known so far.
PROFILES = {
    "grid_last_price": CardProfile(r"/(?:producto|product|tienda)/", low=500, high=1_000_000, price_rule="last_previous", minimum_name=4,
                                   title_classes=("woocommerce-loop-product__title", "product-title", "name"),
                                   whole_card_classes=("product", "product-small", "product-item", "wc-block-grid__product")),
    "unit_priced": CardProfile(r"/productos/", low=500, high=2_000_000, drop="per_measure", minimum_name=4, max_text=2500, max_links=3,
                               title_classes=("product-name", "product-title", "nombre"), unavailable=("producto no disponible",)),
    "heading_quantity": CardProfile(r"^(?:https?://[^/]+)?/[^/]{4,}/?$", start="heading", minimum_name=4, max_text=3500, max_links=3,
                                    stop_words=("agregar", "cantidad"), unavailable=("no disponible",), unless=("cantidad",)),
    "heading_card": CardProfile(r"^(?:https?://[^/]+)?/(?:products?/|productos?/)?[^/]{4,}/?$", start="heading", stop_classes=("product", "item", "card"),
                                unavailable=("no disponible", "agotado")),
    "heading_cart": CardProfile(r"^(?:https?://[^/]+)?/(?:tienda/)?[^/]{3,}/?$", start="heading", minimum_name=4, max_text=3500, max_links=3,
                                stop_words=("agregar",), unavailable=("agotado", "sin stock", "no disponible"), unless=("agregar",)),
    "coded": CardProfile(r"[?&](?:q|codigo|code)=", start="code", price_rule="min_only", max_text=3000, max_links=None, stop_classes=("product", "card", "item"),
                         title_classes=("name", "title"), code_pattern=r"(?i)C[oó]digo\s*:\s*([A-Za-z0-9_-]+)"),
    "litre_priced": CardProfile(r"/products/[^/?#]+/?$", drop="per_litre", max_text=3500, max_links=3,
                                skip_name=r"(?i)\b(personalizad[oa]s?|personalizalo|personalízalo|graba(?:do)?|grabada)\b"),
    "shop_card": CardProfile(r"/producto/", stop_classes=("product",), title_classes=("woocommerce-loop-product__title", "title")),
    "shop_item": CardProfile(r"/producto/", max_text=4500, stop_classes=("product", "card", "item"), title_classes=("name", "title")),
    "club_priced": CardProfile(r"/products/[^/?#]+", drop="club", max_text=3500, max_links=None, unavailable=("agotado", "sold out")),
}

_pattern = functools.cache(re.compile)
_HEADINGS = ("h1", "h2", "h3", "h4")
_CARD_SCHEMA = "store string, page_url string, seq int, href string, name string, text string, sku string"


_AMOUNT = re.compile(r"\$\s*([\d.]+)")


def _amounts(text: str, profile: CardProfile) -> list[int]:
    if profile.drop:
        text = re.sub(UNIT_PRICE_PATTERNS[profile.drop], " ", text)
    digits = (raw.replace(".", "") for raw in _AMOUNT.findall(text))
    return [int(d) for d in digits if d and profile.low <= int(d) <= profile.high]


def _is_product_link(node: Node, profile: CardProfile) -> bool:
    return node.tag == "a" and bool(node.attrs.get("href")) and _pattern(profile.link_pattern, re.I).search(node.attrs["href"]) is not None


def _product_links(node: Node, profile: CardProfile) -> list[Node]:
    return [n for n in node.walk() if n.tag == "a" and _is_product_link(n, profile)]


def _measure(root: Node, profile: CardProfile) -> None:
    """One pass over the page: the link around each node, then bottom-up its number of product links and the length of its text."""
    nodes = list(root.walk())
    for node in nodes:
        if node.parent is not None:
            node.anchor = node.parent if node.parent.tag == "a" else node.parent.anchor
    for node in reversed(nodes):
        links, size, parts = int(node.tag == "a" and _is_product_link(node, profile)), 0, 0
        for c in node.children:
            if isinstance(c, str):
                n = len(" ".join(c.replace("\xa0", " ").split()))
            else:
                links += c.links
                n = 0 if c.tag in _SILENT else c.size
            if n:
                size += n
                parts += 1
        node.links, node.size = links, size + max(parts - 1, 0)


def _card_around(node: Node, profile: CardProfile) -> Node:
    """Outermost acceptable ancestor, up to the first one that is a card by itself."""
    card, parent = node, node.parent
    while parent is not None and parent.tag not in ("body", "html", "[document]"):
        # Ancestors only get longer and have more links: beyond a limit none can be accepted.
        if parent.size > profile.max_text or (profile.max_links is not None and parent.links > profile.max_links):
            break
        text = parent.text()
        alone = profile.code_pattern is None or len(re.findall(profile.code_pattern, text)) <= 1
        if alone and _amounts(text, profile):
            card = parent
            lowered = text.casefold()
            if parent.tag in ("article", "li") or any(c in parent.classes() for c in profile.stop_classes) or any(w in lowered for w in profile.stop_words):
                break
        parent = parent.parent
    return card


def _title(card: Node, link: Node | None, heading: Node | None, minimum: int, profile: CardProfile) -> str:
    if heading is not None:
        return heading.text()
    titled = [n for n in card.walk() if n.tag in _HEADINGS] + [n for n in card.walk() if any(c in n.classes() for c in profile.title_classes)]
    names = [n.text() for n in titled]
    if link is not None:
        names += [link.attrs.get("title") or "", link.attrs.get("aria-label") or ""]
        names += [n.attrs.get("alt") or "" for n in link.walk() if n.tag == "img"] + [link.text()]
    return next((n for n in (" ".join(v.split()) for v in names) if len(n) >= minimum), "")


def _starts(root: Node, profile: CardProfile) -> Iterator[tuple[Node, Node | None, Node | None]]:
    """(start node, link, heading) of every possible card, in reading order."""
    if profile.start == "link":
        for link in _product_links(root, profile):
            yield link, link, None
    elif profile.start == "heading":
        for node in root.walk():
            if node.tag in _HEADINGS[1:]:
                yield node, node.anchor, node
    else:
        for node in root.walk():
            if any(isinstance(c, str) and re.search(profile.code_pattern, c) for c in node.children):
                yield node, None, None


def _cards(html: str, profile: CardProfile) -> Iterator[tuple[str, str, str, str | None]]:
    """(href, name, text, code) of each card of a page."""
    root, seen = parse_html(html), set()
    if profile.whole_card_classes:
        wanted = set(profile.whole_card_classes)
        starts = ((node, None, None) for node in root.walk() if wanted & set(node.classes().split()))
    else:
        _measure(root, profile)
        starts = _starts(root, profile)
    for node, link, heading in starts:
        card = node if profile.whole_card_classes else _card_around(node, profile)
        if id(card) in seen:
            continue
        links = _product_links(card, profile)
        if link is None or link not in links:
            link = links[0] if links else None
        text = card.text()
        code = re.search(profile.code_pattern, text) if profile.code_pattern else None
        if (link is None and code is None) or not _amounts(text, profile):
            continue
        name = _title(card, link, heading, profile.minimum_name, profile)
        if len(name) < profile.minimum_name or (profile.skip_name and re.search(profile.skip_name, name)):
            continue
        seen.add(id(card))
        yield (link.attrs["href"] if link is not None else f"?q={code.group(1)}"), name, text, code.group(1) if code else None
    root.release()


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut to so many pages that what is found in them stays small, whatever the size of a batch."""
    for batch in batches:
        for start in range(0, len(batch), PAGES_AT_ONCE):
            yield batch.iloc[start : start + PAGES_AT_ONCE]


def register_explode_cards(spark: SparkSession, profile: CardProfile, name: str = "explode_cards") -> None:
    """Make the cards of a page a table function of SQL: ``from pages p, lateral explode_cards(p.body)``."""

    @F.udtf(returnType="seq int, href string, name string, text string, sku string")
    class Cards:
        def eval(self, body: str) -> Iterator[tuple]:
            for seq, (href, title, text, code) in enumerate(_cards(body, profile)):
                yield seq, href, title, text, code

    spark.udtf.register(name, Cards)


def extract_cards(pages: DataFrame, profile: CardProfile, rules: UrlRules = UrlRules()) -> DataFrame:
    """Listings of catalog pages (``store, url, body``) of one style."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _pages(batches):
            rows = [
                (store, url, seq, href, name, text, code)
                for store, url, body in zip(batch["store"], batch["url"], batch["body"])
                for seq, (href, name, text, code) in enumerate(_cards(body, profile))
            ]
            yield pd.DataFrame(rows, columns=["store", "page_url", "seq", "href", "name", "text", "sku"])

    cards = pages.select("store", "url", "body").mapInPandas(read, _CARD_SCHEMA)
    amounts = price_values(F.col("text"), profile.low, profile.high, profile.drop, distinct=profile.price_rule != "last_previous")
    gone = F.lit(False)
    if profile.unavailable:
        def is_gone(folded: Column) -> Column:
            found = folded.rlike("|".join(profile.unavailable))
            return found & ~folded.rlike("|".join(profile.unless)) if profile.unless else found

        gone = bind(ascii_fold(F.col("text")), is_gone)
    # Filtered inside the array: a filter behind it would be pushed below and read every text again for each of its uses.
    priced = cards.select("store", "page_url", "seq", "href", "name", "sku", F.inline(F.filter(
        F.array(F.struct(amounts.alias("amounts"))), lambda a: (F.size(a["amounts"]) > 0) & ~gone)))
    if profile.price_rule == "last_previous":
        current = F.element_at("amounts", -1)
        before = F.try_element_at("amounts", F.lit(-2))
        regular = F.when(before > current, before)
    else:
        current = F.array_min("amounts")
        highest = F.array_max("amounts")
        regular = F.when(highest > current, highest) if profile.price_rule == "min_max" else F.lit(None).cast("bigint")
    return priced.withColumns({"current_price": current, "regular_price": regular}).select(
        "store", "page_url", "seq", "name", canonical_url(F.col("href"), rules).alias("url"), "current_price", "regular_price",
        discount_pct(F.col("regular_price"), F.col("current_price")).alias("discount_pct"), "sku")
