"""Listings out of JSON payloads.

Payload rows (``store, url, kind, body, fetched_at``) are parsed with a declared
schema and flattened with array expressions: one row in, its listings out, no
shuffle. Duplicate addresses are left to ``dedup_listings``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions import wordlists as W
from pricetide.functions.money import PRICE_HIGH, PRICE_LOW, discount_pct, parse_money
from pricetide.functions.text import classify_category, is_accessory, is_relevant, normalize_spaces
from pricetide.functions.urls import UrlRules, canonical_url

_VARIANT = "id string, title string, available boolean, price string, compare_at_price string, sku string, barcode string"
FEED_SCHEMA = (
    "products array<struct<title string, handle string, product_type string, tags string, "
    f"variants array<struct<{_VARIANT}>>>>"
)
_MONEY = "struct<amount string>"
_GRAPH_VARIANT = f"struct<id string, availableForSale boolean, price {_MONEY}, compareAtPrice {_MONEY}, sku string, barcode string>"
GRAPHQL_SCHEMA = (
    "data struct<products struct<nodes array<struct<title string, handle string, productType string, vendor string, "
    f"availableForSale boolean, variants struct<nodes array<{_GRAPH_VARIANT}>>, selectedOrFirstAvailableVariant {_GRAPH_VARIANT}, "
    f"priceRange struct<minVariantPrice {_MONEY}>, compareAtPriceRange struct<maxVariantPrice {_MONEY}>>>>>"
)
_OFFER = "struct<IsAvailable boolean, AvailableQuantity string, Price string, ListPrice string>"
SELLER_SCHEMA = (
    "productName string, productTitle string, productReference string, link string, linkText string, "
    f"items array<struct<itemId string, ean string, sellers array<struct<commertialOffer {_OFFER}, commercialOffer {_OFFER}>>>>"
)
MINOR_UNIT_SCHEMA = (
    "array<struct<name string, permalink string, sku string, categories array<struct<name string, slug string>>, "
    "prices struct<price string, regular_price string, sale_price string, currency_minor_unit int>>>"
)
# What a feed puts in front of or behind a title.
_TITLE_HEAD = r"(?i)^(?:agotado|oferta\s+\d+%|agregar al carro)\s+"
_TITLE_TAIL = r"\s+\$\s*[\d.]+(?:\s+\$\s*[\d.]+)?\s*$"


def clean_product_name(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(normalize_spaces(c), _TITLE_HEAD, ""), _TITLE_TAIL, "")
    return F.regexp_replace(c, "^[ –—-]+|[ –—-]+$", "")


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _listing(store: str, name: Column, url: Column, current: Column, regular: Column, sku: Column, ean: Column, sections: Column) -> list[Column]:
    return [
        F.col(store).alias("store"), name.alias("name"), url.alias("url"), current.alias("current_price"),
        regular.alias("regular_price"), discount_pct(regular, current).alias("discount_pct"),
        _blank_to_null(normalize_spaces(sku)).alias("sku"), _blank_to_null(F.regexp_replace(ean, r"\D", "")).alias("ean"),
        sections.alias("source_sections"),
    ]


def _from_products(products: DataFrame, rules: UrlRules) -> DataFrame:
    """``store`` and ``p``: one feed product per row."""
    p = F.col("p")
    tags = F.regexp_replace(F.coalesce(p["tags"], F.lit("")), r'[\[\]",]+', " ")
    named = products.select(
        "store", "p", clean_product_name(F.coalesce(p["title"], F.lit(""))).alias("name"), F.trim(p["handle"]).alias("handle"), tags.alias("tags"),
    ).where("length(name) >= 3 and handle <> '' and p.variants is not null")
    offered = F.filter(p["variants"], lambda v: F.coalesce(v["available"], F.lit(True)))
    priced = F.filter(
        F.transform(offered, lambda v, i: F.struct(parse_money(v["price"], "decimal").alias("price"), i.alias("at"), v["sku"].alias("sku"), v["barcode"].alias("ean"))),
        lambda v: v["price"].isNotNull())
    compared = F.transform(offered, lambda v: parse_money(v["compare_at_price"], "decimal"))
    category = classify_category(p["product_type"], F.col("tags"), p["title"])
    rows = named.withColumns({"best": F.array_min(priced), "compared": compared, "category": category}).where("best is not null")
    rows = rows.where(~is_accessory(p["product_type"], F.col("tags"), p["title"], F.col("category")))
    current = F.col("best.price")
    regular = F.array_max(F.filter("compared", lambda amount: amount > current))
    url = canonical_url(F.concat(F.lit("/products/"), "handle"), rules)
    return rows.select(*_listing("store", F.col("name"), url, current, regular, F.col("best.sku"), F.col("best.ean"), F.array("category")))


_FEED_RULES = UrlRules(product_folder="products")


def extract_feed_products(payloads: DataFrame, rules: UrlRules = _FEED_RULES) -> DataFrame:
    """One listing per product of a shop feed: cheapest available variant."""
    parsed = payloads.select("store", F.from_json("body", FEED_SCHEMA).alias("f"))
    return _from_products(parsed.select("store", F.explode("f.products").alias("p")), rules)


def extract_graphql_products(payloads: DataFrame, rules: UrlRules = _FEED_RULES) -> DataFrame:
    """The same from a storefront GraphQL answer.

    The selected variant is added when its id is new; a product for sale without
    variants is priced by its price range.
    """
    parsed = payloads.select("store", F.from_json("body", GRAPHQL_SCHEMA).alias("g"))
    nodes = parsed.select("store", F.explode("g.data.products.nodes").alias("n"))
    n = F.col("n")
    none = F.lit(None).cast("string")

    def variant(v: Column) -> Column:
        return F.struct(
            v["id"].alias("id"), none.alias("title"), F.coalesce(v["availableForSale"], F.lit(True)).alias("available"),
            v["price"]["amount"].alias("price"), v["compareAtPrice"]["amount"].alias("compare_at_price"), v["sku"].alias("sku"), v["barcode"].alias("barcode"))

    listed = F.coalesce(F.transform(n["variants"]["nodes"], variant), F.array().cast(f"array<struct<{_VARIANT}>>"))
    selected = n["selectedOrFirstAvailableVariant"]
    unseen = selected.isNotNull() & (F.coalesce(selected["id"], F.lit("")).isin("") | ~F.coalesce(
        F.array_contains(F.transform(listed, lambda v: v["id"]), selected["id"]), F.lit(False)))
    extra = F.when(unseen, F.array(variant(selected))).otherwise(F.array().cast(f"array<struct<{_VARIANT}>>"))
    ranged = F.array(F.struct(
        none.alias("id"), none.alias("title"), F.lit(True).alias("available"), n["priceRange"]["minVariantPrice"]["amount"].alias("price"),
        n["compareAtPriceRange"]["maxVariantPrice"]["amount"].alias("compare_at_price"), none.alias("sku"), none.alias("barcode")))
    both = F.concat(listed, extra)
    variants = F.when((F.size(both) == 0) & F.coalesce(n["availableForSale"], F.lit(False)), ranged).otherwise(both)
    products = nodes.select("store", F.struct(
        n["title"].alias("title"), n["handle"].alias("handle"), n["productType"].alias("product_type"), n["vendor"].alias("tags"), variants.alias("variants")).alias("p"))
    return _from_products(products, rules)


def extract_sku_seller_offers(payloads: DataFrame, rules: UrlRules = UrlRules()) -> DataFrame:
    """One listing per product: cheapest available offer over its items and sellers."""
    parsed = payloads.select("store", F.from_json("body", SELLER_SCHEMA).alias("p"))
    p = F.col("p")

    def offers(item: Column, at: Column) -> Column:
        def offer(seller: Column, seller_at: Column) -> Column:
            o = F.coalesce(seller["commertialOffer"], seller["commercialOffer"])
            quantity = o["AvailableQuantity"].try_cast("int")
            usable = F.coalesce(o["IsAvailable"], F.lit(True)) & F.coalesce(quantity > 0, F.lit(True))
            return F.struct(
                F.when(usable, parse_money(o["Price"], "rounded")).alias("price"), at.alias("item_at"), seller_at.alias("seller_at"),
                parse_money(o["ListPrice"], "rounded").alias("regular"), F.trim(item["itemId"]).alias("sku"), F.trim(item["ean"]).alias("ean"))
        return F.transform(item["sellers"], offer)

    every = F.flatten(F.filter(F.transform(p["items"], offers), lambda a: a.isNotNull()))
    best = F.array_min(F.filter(every, lambda o: o["price"].isNotNull()))
    name = F.trim(F.coalesce(_blank_to_null(p["productName"]), _blank_to_null(p["productTitle"]), _blank_to_null(p["productReference"]), F.lit("")))
    link = F.coalesce(_blank_to_null(F.trim(p["link"])), _blank_to_null(F.trim(p["linkText"])), F.lit(""))
    rows = parsed.select("store", name.alias("name"), link.alias("link"), best.alias("best")).where("name <> '' and link <> '' and best is not null")
    current, regular = F.col("best.price"), F.when(F.col("best.regular") > F.col("best.price"), F.col("best.regular"))
    listed = rows.select(*_listing("store", F.col("name"), F.regexp_replace("link", r"\?.*$", ""), current, regular, F.col("best.sku"), F.col("best.ean"), F.array(F.lit("catalog"))))
    return listed.withColumn("price_quotes", F.array(F.struct(
        F.col("current_price").alias("price"), F.when(F.col("regular_price").isNotNull(), "SALE").otherwise("PUBLIC").alias("price_type"), "regular_price",
        F.lit("public").alias("audience_key"), F.lit(False).alias("eligibility_required"))))


def extract_minor_unit_products(payloads: DataFrame, rules: UrlRules = UrlRules()) -> DataFrame:
    """Listings of a store API that prices in minor units; only relevant categories."""
    parsed = payloads.select("store", F.explode(F.from_json("body", MINOR_UNIT_SCHEMA)).alias("p"))
    p = F.col("p")
    unit = F.greatest(F.lit(0), F.least(F.coalesce(p["prices"]["currency_minor_unit"], F.lit(0)), F.lit(4)))

    def money(c: Column) -> Column:
        value = F.bround(c.try_cast("bigint") / F.pow(F.lit(10.0), unit), 0).cast("bigint")
        return F.when(value.between(PRICE_LOW, PRICE_HIGH), value)

    categories = F.array_distinct(F.filter(
        F.transform(F.coalesce(p["categories"], F.array().cast("array<struct<name string, slug string>>")),
                    lambda c: normalize_spaces(F.coalesce(_blank_to_null(c["name"]), c["slug"], F.lit("")))), lambda c: c != ""))
    rows = parsed.select(
        "store", normalize_spaces(F.coalesce(p["name"], F.lit(""))).alias("name"), p["permalink"].alias("permalink"), p["sku"].alias("sku"), categories.alias("categories"),
        money(p["prices"]["price"]).alias("price"), money(p["prices"]["regular_price"]).alias("regular"), money(p["prices"]["sale_price"]).alias("sale"))
    rows = rows.where("length(name) >= 3 and permalink <> ''").where(is_relevant(F.array_join("categories", " "), F.col("name")))
    rows = rows.withColumn("current", F.when(F.col("price").isNull() | (F.col("sale") < F.col("price")), F.coalesce("sale", "price")).otherwise(F.col("price"))).where("current is not null")
    regular = F.when(F.col("regular") > F.col("current"), F.col("regular"))
    sections = F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(F.lit("Catálogo general")))
    return rows.select(*_listing("store", F.col("name"), canonical_url(F.col("permalink"), rules), F.col("current"), regular, F.col("sku"), F.lit(None).cast("string"), sections))


def extract_variant_rows(payloads: DataFrame, base: str = "") -> DataFrame:
    """One listing per available variant; the variant is named unless it is the default."""
    parsed = payloads.select("store", F.from_json("body", FEED_SCHEMA).alias("f")).select("store", F.explode("f.products").alias("p"))
    p = F.col("p")
    rows = parsed.select(
        "store", normalize_spaces(F.coalesce(p["title"], F.lit(""))).alias("title"), F.trim(p["handle"]).alias("handle"), F.size(p["variants"]).alias("many"), F.explode(p["variants"]).alias("v"),
    ).where("length(title) >= 3 and handle <> ''").where(~F.lower("title").rlike(W.PERSONALISED_PATTERN) & F.coalesce(F.col("v.available"), F.lit(True)))
    label = normalize_spaces(F.coalesce("v.title", F.lit("")))
    plain = (F.col("many") <= 1) | F.lower(label).isin("", "default title", "default") | F.contains(F.lower("title"), F.lower(label))
    name = F.when(plain, F.col("title")).otherwise(F.concat_ws(" · ", "title", label))
    current, compared = parse_money(F.col("v.price"), "mixed"), parse_money(F.col("v.compare_at_price"), "mixed")
    url = F.concat(F.lit(f"{base}/products/"), F.regexp_replace("handle", "^/+|/+$", ""), F.when((F.col("many") > 1) & F.col("v.id").isNotNull(), F.concat(F.lit("?variant="), "v.id")).otherwise(F.lit("")))
    none = F.lit(None).cast("string")
    return rows.withColumns({"current": current, "compared": compared}).where("current is not null").select(
        *_listing("store", name, url, F.col("current"), F.when(F.col("compared") > F.col("current"), F.col("compared")), none, none, F.array(F.lit("feed"))))
