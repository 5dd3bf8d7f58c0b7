"""Products inside nested JSON and JSON-LD.

A small walk per document finds the objects of interest and lists their members that a table names, as
(role, place in the table, label, kind, text). Which of them is the name, the address or a price is decided by
column expressions over those lists, so prices are read and compared in the plan.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.money import PRICE_HIGH, PRICE_LOW, discount_pct, price_values
from pricetide.functions.text import ascii_fold, bind, normalize_spaces
from pricetide.functions.urls import UrlRules, canonical_url

from .pages import page_text

# Keys under which shops keep names, addresses and prices.
NAME_KEYS = ("name", "title", "productName", "product_name", "displayName")
URL_KEYS = ("url", "href", "permalink", "productUrl", "product_url", "path")
SLUG_KEYS = ("slug", "handle", "seoSlug", "urlKey")
CURRENT_KEYS = ("salePrice", "sale_price", "currentPrice", "current_price", "sellingPrice", "selling_price", "finalPrice", "final_price", "bestPrice", "best_price", "price", "amount")
REGULAR_KEYS = ("regularPrice", "regular_price", "listPrice", "list_price", "referencePrice", "reference_price", "compareAtPrice", "compare_at_price", "originalPrice", "original_price")
MONEY_KEYS = ("amount", "value", "price", "centAmount")
OFFER_CURRENT_KEYS = ("price", "lowPrice", "salePrice")
OFFER_REGULAR_KEYS = ("highPrice", "regularPrice", "listPrice")
REGULAR_SPECIFICATION = "list|regular|strikethrough"

#: Documents whose members are held as Python objects.
DOCUMENTS_AT_ONCE = 32
#: Places in a table: the key counts more than the member inside its value.
_STEP = 10


def _entries(role: str, keys: tuple[str, ...], inner: tuple[str, ...], above: str = "") -> dict[str, tuple[str, int]]:
    """Paths of the keys, by themselves and with each inner key, in order."""
    return {f"{above}{key}{tail}": (role, _STEP * k + i) for k, key in enumerate(keys) for i, tail in enumerate(("", *(f".{x}" for x in inner)))}


PRODUCT_MEMBERS = {
    **_entries("name", NAME_KEYS, ("rendered", "value")), **_entries("href", URL_KEYS, ("url", "href")), **_entries("slug", SLUG_KEYS, ()),
    **_entries("current", CURRENT_KEYS, MONEY_KEYS), **_entries("regular", REGULAR_KEYS, MONEY_KEYS),
    **_entries("inner_current", CURRENT_KEYS, MONEY_KEYS, "prices."), **_entries("inner_regular", REGULAR_KEYS, MONEY_KEYS, "prices."),
}
JSON_LD_MEMBERS = {
    **_entries("name", ("name",), ()), **_entries("href", ("url",), ()), **_entries("current", OFFER_CURRENT_KEYS, (), "offers."), **_entries("regular", OFFER_REGULAR_KEYS, (), "offers."),
    **_entries("specified", ("price",), (), "offers.priceSpecification."),
}

_MEMBER = pa.struct([("role", pa.string()), ("place", pa.int32()), ("label", pa.string()), ("kind", pa.string()), ("text", pa.string())])
_NODES = "array<struct<seq:int,members:array<struct<role:string,place:int,label:string,kind:string,text:string>>>>"
_ARROW_NODES = pa.list_(pa.struct([("seq", pa.int32()), ("members", pa.list_(_MEMBER))]))


def objects(document: object, max_depth: int | None) -> Iterator[dict]:
    """All objects of a document, each before those inside it."""
    waiting = [(document, 0)]
    while waiting:
        here, depth = waiting.pop()
        if isinstance(here, dict):
            yield here
        if isinstance(here, (dict, list)) and (max_depth is None or depth < max_depth):
            inside = list(here.values()) if isinstance(here, dict) else here
            waiting += [(x, depth + 1) for x in inside[::-1] if isinstance(x, (dict, list))]


def members(node: dict, table: dict[str, tuple[str, int]], levels: int) -> list[dict]:
    """The members that the table names, up to so many names deep; a list stands for each of its elements."""
    found, waiting = [], [("", node, "", levels)]
    while waiting:
        path, here, label, left = waiting.pop()
        if isinstance(here, list):
            waiting += [(path, x, label, left) for x in here if not isinstance(x, list)]
        elif isinstance(here, dict):
            if left:
                own = str(here.get("priceType") or here.get("@type") or "")
                waiting += [(f"{path}.{key}" if path else key, x, own, left - 1) for key, x in here.items() if path or isinstance(x, (dict, list)) or key in table]
        elif path in table and here not in (None, "") and not isinstance(here, bool):
            role, place = table[path]
            found.append({"role": role, "place": place, "label": label, "kind": "number" if isinstance(here, (int, float)) else "text", "text": str(here)})
    return found


def _parsed(text: str) -> object:
    try:
        return json.loads(text or "")
    except (ValueError, RecursionError):
        return None


def node_lists(table: dict[str, tuple[str, int]], levels: int, wanted: Callable[[dict], bool], max_depth: int | None):
    """Column function from an array of JSON texts to the member lists of the objects wanted."""

    @F.arrow_udf(_NODES)
    def nodes(texts: pa.Array) -> pa.Array:
        done = []
        # Members are dictionaries only for so many documents at a time; then they are Arrow columns.
        for start in range(0, len(texts), DOCUMENTS_AT_ONCE):
            out = []
            for documents in texts.slice(start, DOCUMENTS_AT_ONCE).to_pylist():
                found = (node for text in documents or () for node in objects(_parsed(text), max_depth) if wanted(node))
                out.append([{"seq": seq, "members": members(node, table, levels)} for seq, node in enumerate(found)])
            done.append(pa.array(out, _ARROW_NODES))
        return pa.concat_arrays(done) if done else pa.array([], _ARROW_NODES)

    return nodes


def _amount(member: Column, fraction: bool) -> Column:
    """A price as a whole number within bounds, else null; with `fraction`, ",00" and ".00" are cents."""
    text = F.trim(F.replace(F.replace(member["text"], F.lit("$"), F.lit("")), F.lit("CLP"), F.lit("")))
    if fraction:
        text = F.regexp_replace(text, r"^(\d+)[,.]00$", "$1")
    value = F.when(member["kind"] == "number", F.rint(member["text"].try_cast("double")).cast("bigint")).otherwise(F.regexp_replace(text, r"\D", "").try_cast("bigint"))
    return F.when(value.between(PRICE_LOW, PRICE_HIGH), value)


def _of(node: Column, role: str) -> Column:
    return F.filter(node["members"], lambda m: m["role"] == role)


def _first_text(node: Column, role: str) -> Column:
    """Text of the member that comes first in its table."""
    return F.array_min(F.transform(_of(node, role), lambda m: F.struct(m["place"], m["text"])))["text"]


def _prices(node: Column, role: str, fraction: bool = False) -> Column:
    """(place, amount) of the readable prices of a role, in table order."""
    read = F.transform(_of(node, role), lambda m: F.struct(m["place"].alias("place"), _amount(m, fraction).alias("amount")))
    return F.array_sort(F.filter(read, lambda p: p["amount"].isNotNull()))


def _by_key(prices: Column) -> Column:
    """Amounts, only the first of each key's value."""
    key = lambda p: F.floor(p["place"] / _STEP)
    firsts = F.filter(prices, lambda p, i: (i == 0) | (key(p) != key(F.get(prices, i - 1))))
    return F.transform(firsts, lambda p: p["amount"])


def _finish(found: DataFrame, rules: UrlRules) -> DataFrame:
    return found.select(
        "store", "seq", "name", canonical_url(F.col("href"), rules).alias("url"), "current_price", "regular_price",
        discount_pct(F.col("regular_price"), F.col("current_price")).alias("discount_pct"))


def _quoted(text: Column) -> Column:
    """Percent-encoding of a path."""
    for plain, coded in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def extract_nested_products(payloads: DataFrame, max_depth: int | None = None, product_path: str = "/producto/", rules: UrlRules = UrlRules()) -> DataFrame:
    """Anything that looks like a product (a name, an address, a price) in a JSON body; `max_depth` bounds the walk on request."""
    tops = {role: {path.partition(".")[0] for path, (r, _) in PRODUCT_MEMBERS.items() if r.endswith(role)} for role in ("name", "current")}
    wanted = lambda node: not tops["name"].isdisjoint(node) and not tops["current"].isdisjoint(node)
    nodes = node_lists(PRODUCT_MEMBERS, 3, wanted, max_depth)(F.array("body"))
    node = F.col("node")
    rows = payloads.select("store", F.explode(nodes).alias("node")).select(
        "store", node["seq"].alias("seq"), normalize_spaces(_first_text(node, "name")).alias("name"), _first_text(node, "href").alias("own"), _first_text(node, "slug").alias("slug"),
        _by_key(_prices(node, "current")).alias("current"), _by_key(_prices(node, "inner_current")).alias("inner_current"),
        _by_key(_prices(node, "regular")).alias("regular"), _by_key(_prices(node, "inner_regular")).alias("inner_regular"))
    built = F.concat(F.lit(product_path), _quoted(F.url_encode(F.trim(F.col("slug"), F.lit("/")))))
    current = F.coalesce(F.array_min("current"), F.get("inner_current", F.lit(0)))
    regular = F.coalesce(F.array_max("regular"), F.get("inner_regular", F.lit(0)))
    rows = rows.select("store", "seq", "name", F.coalesce("own", built).alias("href"), current.alias("current_price"), regular.alias("highest"))
    rows = rows.where((F.length("name") >= 3) & F.col("href").contains(product_path) & F.col("current_price").isNotNull())
    return _finish(rows.withColumn("regular_price", F.when(F.col("highest") > F.col("current_price"), F.col("highest"))), rules)


def _is_product(node: dict) -> bool:
    kinds = node.get("@type")
    return any(isinstance(k, str) and k.casefold() == "product" for k in (kinds if isinstance(kinds, list) else (kinds,)))


def extract_json_ld(pages: DataFrame, rules: UrlRules = UrlRules()) -> DataFrame:
    """One listing per product page: its first whole JSON-LD product, else marked prices, else prices in the text."""
    attribute = r"(?is)<meta\b(?=[^>]*(?:property|name|itemprop)=[\"'](?:{0})[\"'])[^>]*content=[\"']([^\"']*)[\"']"
    everything = lambda pattern: F.regexp_extract_all("body", F.lit(pattern), F.lit(1))
    marked = F.concat(everything(attribute.format("product:price:amount|og:price:amount|price")),
                      everything(r"(?is)<(?!meta\b)[a-z][\w-]*\b(?=[^>]*itemprop=[\"']price[\"'])(?=[^>]*content=[\"'])[^>]*content=[\"']([^\"']*)[\"']"),
                      everything(r"(?is)<(?!meta\b)[a-z][\w-]*\b(?=[^>]*itemprop=[\"']price[\"'])(?![^>]*content=[\"'][^\"'])[^>]*>([^<]*)<"))
    slug = F.regexp_replace(F.try_url_decode(F.regexp_extract("url", r"([^/?#]+)/?(?:[?#].*)?$", 1)), r"^\d+-", "")
    read = pages.select("store", "url", "body", node_lists(JSON_LD_MEMBERS, 3, _is_product, None)(everything(r"(?is)<script\b[^>]*ld\+json[^>]*>(.*?)</script>")).alias("nodes"))
    page = F.struct(
        "nodes", F.regexp_extract("body", attribute.format("og:title|twitter:title"), 1).alias("title"), marked.alias("marked"), price_values(page_text(F.col("body"))).alias("amounts"),
        F.initcap(normalize_spaces(F.translate(slug, "+-", "  "))).alias("slug_name"))

    def named(text: Column, slug_name: Column) -> Column:
        return bind(normalize_spaces(F.coalesce(text, F.lit(""))), lambda name: F.when(ascii_fold(name).isin("", "undefined", "producto"), slug_name).otherwise(name))

    def offer(node: Column, slug_name: Column) -> Column:
        listed = lambda m: F.lower(m["label"]).rlike(REGULAR_SPECIFICATION)
        amounts = lambda array: F.filter(F.transform(array, lambda m: _amount(m, True)), lambda a: a.isNotNull())
        asked = F.filter(node["members"], lambda m: (m["role"] == "current") | ((m["role"] == "specified") & ~listed(m)))
        return F.struct(named(_first_text(node, "name"), slug_name).alias("name"), _first_text(node, "href").alias("own"), F.array_min(amounts(asked)).alias("low"),
                        F.array_max(amounts(F.filter(node["members"], lambda m: m["role"].isin("current", "regular", "specified")))).alias("high"))

    readable = lambda o: o["low"].isNotNull() & (F.length(o["name"]) >= 3)

    def listing(page: Column) -> Column:
        whole = F.filter(F.transform(page["nodes"], lambda node: offer(node, page["slug_name"])), readable)
        plain = F.filter(F.transform(page["marked"], lambda text: _amount(F.struct(F.lit("text").alias("kind"), text.alias("text")), True)), lambda a: a.isNotNull())
        shown = bind(plain, lambda p: F.when(F.size(p) > 0, p).otherwise(page["amounts"].cast("array<bigint>")))
        fallback = bind(shown, lambda p: F.struct(named(page["title"], page["slug_name"]).alias("name"), F.lit(None).cast("string").alias("own"), F.array_min(p).alias("low"), F.array_max(p).alias("high")))
        return F.coalesce(F.get(whole, F.lit(0)), fallback)

    # Read and filtered inside the array, once a page: a filter behind a projection would be pushed below it and read the page again for each use.
    best = read.select("store", "url", F.inline(F.filter(F.transform(F.array(page), listing), readable)))
    return _finish(best.select("store", F.lit(0).alias("seq"), "name", F.coalesce("own", "url").alias("href"), F.col("low").alias("current_price"), F.when(F.col("high") > F.col("low"), F.col("high")).alias("regular_price")), rules)
