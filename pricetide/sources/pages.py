"""Facts out of HTML and XML pages that text patterns are enough for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.functions.money import discount_pct, parse_money
from pricetide.functions.text import bind, normalize_spaces
from pricetide.functions.urls import UrlRules, canonical_url, is_product_url


def _entities(c: Column) -> Column:
    for entity, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def page_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags removed."""
    c = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return normalize_spaces(_entities(F.regexp_replace(c, r"(?s)<[^>]*>", " ")))


# Labels of prices and stock on a members' shop page.
LABELS = {
    "member": r"(?i)Socio\s*:\s*\$?\s*([\d.]+)",
    "sale": r"(?i)Oferta\s*:\s*\$?\s*([\d.]+)",
    "normal": r"(?i)Normal\s*:\s*\$?\s*([\d.]+)",
    "stock": r"(?i)Stock\s*:\s*(50\+|\d+)",
}
MEMBER_AUDIENCE, SALE_AUDIENCE = "cav_member", "public_offer"


def extract_labelled_quotes(pages: DataFrame, rules: UrlRules = UrlRules(), product_path: str = "/tienda/producto/") -> DataFrame:
    """Cards whose prices carry labels: member, sale and normal price side by side."""
    cards = F.regexp_extract_all("body", F.lit(r"(?is)<(?:article|li)\b[^>]*>.*?</(?:article|li)>"), F.lit(0))

    def texts(card: Column) -> Column:
        return F.struct(
            F.regexp_extract(card, rf'(?i)<a\b[^>]*href="([^"]*{product_path}[^"]*)"', 1).alias("href"), page_text(card).alias("text"),
            page_text(F.regexp_extract(card, r"(?is)<h[234]\b[^>]*>(.*?)</h[234]>", 1)).alias("heading"),
            page_text(F.regexp_extract(card, rf'(?is)<a\b[^>]*href="[^"]*{product_path}[^"]*"[^>]*>(.*?)</a>', 1)).alias("link_text"))

    def facts(c: Column) -> Column:
        return F.struct(
            c["href"].alias("href"), F.when(F.length(c["heading"]) >= 3, c["heading"]).otherwise(c["link_text"]).alias("name"),
            F.regexp_extract(c["text"], LABELS["stock"], 1).try_cast("int").alias("stock"),
            *(bind(F.regexp_extract(c["text"], p, 1), lambda digits: parse_money(digits)).alias(k) for k, p in LABELS.items() if k != "stock"))

    # Read inside the array, once a card: filters behind a projection would be pushed below it and read every card again.
    rows = pages.select("store", F.inline(F.transform(F.transform(cards, texts), facts))).where("href <> ''")
    rows = rows.where(F.coalesce(F.col("stock") > 0, F.lit(True))).where("coalesce(normal, member, sale) is not null and length(name) >= 3")
    current = F.coalesce(F.least("sale", "normal"), F.col("member"))
    rows = rows.withColumn("current", current)
    regular = F.when(F.col("normal") > F.col("current"), F.col("normal"))
    none = F.lit(None).cast("bigint")

    def quote(price: str, kind: str, regular_price: Column, audience: str, restricted: bool) -> Column:
        return F.when(F.col(price).isNotNull(), F.struct(
            F.col(price).alias("price"), F.lit(kind).alias("price_type"), regular_price.alias("regular_price"),
            F.lit(audience).alias("audience_key"), F.lit(restricted).alias("eligibility_required")))

    quotes = F.filter(F.array(
        quote("normal", "PUBLIC", none, "public", False), quote("sale", "SALE", F.col("normal"), SALE_AUDIENCE, False),
        quote("member", "MEMBER", F.col("normal"), MEMBER_AUDIENCE, True)), lambda q: q.isNotNull())
    url = canonical_url(F.col("href"), rules)
    return rows.select(
        "store", "name", url.alias("url"), F.col("current").alias("current_price"), regular.alias("regular_price"),
        discount_pct(regular, F.col("current")).alias("discount_pct"), F.nullif(F.regexp_extract(url, r"-(\d{3,})/?$", 1), F.lit("")).alias("sku"), quotes.alias("price_quotes"))


def extract_sitemap(pages: DataFrame, rules: UrlRules = UrlRules()) -> DataFrame:
    """Addresses of a sitemap: child maps of an index, product addresses of a url set."""
    kind = F.when(F.col("body").rlike(r"(?i)<(?:\w+:)?sitemapindex\b"), "index").otherwise("urlset")
    located = pages.select("store", kind.alias("kind"), F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"), F.lit(1))).alias("loc"))
    located = located.withColumn("loc", _entities(F.col("loc"))).where("loc <> ''")
    index = F.col("kind") == "index"
    return located.where(index | is_product_url(F.col("loc"), rules)).select(
        "store", "kind", F.when(index, F.col("loc")).otherwise(canonical_url(F.col("loc"), rules)).alias("url"),
        (index & F.lower("loc").rlike("product")).alias("is_product_map")).distinct()


def page_links(pages: DataFrame) -> DataFrame:
    """All links with their text, in reading order."""
    anchor = r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    hrefs = F.regexp_extract_all("body", F.lit(anchor), F.lit(1))
    texts = F.regexp_extract_all("body", F.lit(anchor), F.lit(2))
    other = [c for c in pages.columns if c != "body"]
    return pages.select(*other, F.posexplode(F.arrays_zip(hrefs.alias("href"), texts.alias("label"))).alias("pos", "l")).select(
        *other, "pos", _entities(F.col("l.href")).alias("href"), page_text(F.col("l.label")).alias("label"))


def discover_categories(pages: DataFrame, folder: str = "/product-category/", excluded=(), order: str = "url") -> DataFrame:
    """Root categories a menu links to; the last link read gives the label."""
    links = page_links(pages)
    key = F.lower(F.regexp_extract("href", rf"(?i)^(?:https?://[^/]+)?{folder}([^/?#]+)/?(?:[?#].*)?$", 1))
    found = links.withColumn("key", key).where((F.col("key") != "") & ~F.col("key").isin(*excluded, "uncategorized", "sin-categoria"))
    named = F.when(F.length("label").between(1, 60), F.col("label")).otherwise(F.initcap(F.translate("key", "-", " ")))
    return found.groupBy("store", "key").agg(F.max_by(named, F.struct(order, "pos")).alias("name"))


def discover_facets(pages: DataFrame, key: str) -> DataFrame:
    """Values of a facet, from links and from encoded addresses anywhere in the page."""
    decoded = F.url_decode(F.regexp_replace(_entities(F.col("body")), r"%(?![0-9A-Fa-f]{2})", "%25"))
    target = r"fR\[" + key + r"\]\[0\]=([^&\"'<>]+)"
    values = pages.select("store", F.explode(F.regexp_extract_all(decoded, F.lit(target), F.lit(1))).alias("value"))
    return values.select("store", normalize_spaces(F.col("value")).alias("value")).where("value <> ''").distinct()


def detect_page_count(pages: DataFrame, page_size: Column, max_pages: int | None = None) -> DataFrame:
    """Number of pages: stated, linked, or total results over the page size."""
    text = F.col("_text")

    def largest(source: Column, pattern: str) -> Column:
        return F.array_max(F.transform(F.regexp_extract_all(source, F.lit(pattern), F.lit(1)), lambda n: n.cast("int")))

    stated = F.regexp_extract(text, r"(?i)P[aá]gina\s+\d+\s+de\s+(\d+)", 1).try_cast("int")
    total = F.coalesce(
        largest(text, r"(?i)Mostrar\s+(\d+)\s+resultados?"), largest(text, r"(?i)Mostrando\s+\d+\s+de\s+(\d+)"), largest(text, r"(?i)(\d+)\s+resultados?"),
        F.regexp_extract(text, r"(?:[A-Za-z-]+\s+)?\d+-\d+/(\d+)", 1).try_cast("int"))
    linked = largest(F.col("body"), r"(?i)(?:[?&]page=|&amp;page=|/page/)(\d+)")
    by_size = F.ceil(total / F.greatest(page_size, F.lit(1))).cast("int")
    count = F.greatest(F.lit(1), stated, linked, by_size)
    rows = pages.withColumn("_text", page_text(F.col("body")))
    return rows.withColumn("page_count", count if max_pages is None else F.least(count, F.lit(max_pages))).drop("_text", "body")
