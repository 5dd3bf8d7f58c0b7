"""Extraction from payloads built out of the catalog, and the sinks.

Each payload query writes every part and shop into the payload form of one kind
of shop and reads it back: the oracle computes from the catalog itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pricetide.functions.money import format_money
from pricetide.functions.urls import UrlRules
from pricetide.session import ensure_checkpoint_dir
from pricetide.sources import feeds, html, json_products, pages, sinks

from .registry import ORACLE_VIEWS, query

PAGE = 20
RULES = UrlRules(host="shop.example.com", product_folder="products")
HOST = UrlRules(host="shop.example.com")


def offers(t):
    """Catalog rows with the words a payload shows."""
    return t.v_names.select(
        "part_id", "listing_id", "store_id", "product_type", "price", "regular_price", F.concat(F.lit("Item K"), F.col("part_id").cast("string")).alias("title"),
        F.concat(F.lit("k"), F.col("part_id").cast("string")).alias("handle"), F.floor(F.col("part_id") / PAGE).alias("page"),
        (F.col("listing_id") % 5 != 0).alias("available"), F.concat(F.lit("S-"), F.col("listing_id").cast("string")).alias("sku"),
        F.concat(F.lit("78 "), F.col("listing_id").cast("string")).alias("ean"))


def variants_of(t, *fields):
    """One row per part with its shops' offers as an ordered array."""
    ordered = F.array_sort(F.collect_list(F.struct("store_id", *fields)))
    return offers(t).groupBy("part_id", "page", "title", "handle", "product_type").agg(ordered.alias("variants"))


def payload(df, body):
    return df.select(F.lit("shop").alias("store"), F.lit("").alias("url"), F.to_json(body).alias("body"))


def bodies(per_part, page_struct, wrap):
    """One payload per catalog page."""
    grouped = per_part.groupBy("page").agg(F.collect_list(page_struct).alias("rows"))
    return payload(grouped, wrap(F.col("rows")))


ORACLE_VIEWS["v_offer_rows"] = """select part_id, listing_id, store_id, price, regular_price, listing_id % 5 <> 0 as available, concat('S-', listing_id::varchar) as sku, concat('78', listing_id::varchar) as ean from v_names"""
_BEST = """select part_id, price as current_price, sku, ean from v_offer_rows where {where} qualify row_number() over (partition by part_id order by price, store_id) = 1"""
_COMPARE = "(select part_id, max(regular_price) as compare from v_offer_rows where {where} group by 1)"
_FEED = f"""select 'Item K' || b.part_id as name, 'https://shop.example.com/products/k' || b.part_id as url, current_price, case when compare > current_price then compare end as regular_price, sku, ean
  from ({_BEST}) b join {_COMPARE} c using (part_id)"""


def shown(df):
    return df.select("name", "url", "current_price", "regular_price", "sku", "ean")


def feed_payloads(t):
    variant = ("sku", F.col("ean").alias("barcode"), "available", F.col("price").cast("string").alias("price"), F.concat(F.col("regular_price").cast("string"), F.lit(".00")).alias("compare_at_price"),
               F.col("listing_id").cast("string").alias("id"), F.concat(F.lit("Shop "), F.col("store_id").cast("string")).alias("title"))
    products = variants_of(t, *variant)
    return bodies(products, F.struct("title", "handle", "product_type", F.array(F.lit("a"), F.lit("b")).alias("tags"), "variants"), lambda rows: F.struct(rows.alias("products")))


@query("extract_feed_products", "S2", _FEED.format(where="available"))
def extract_feed_products(t):
    return shown(feeds.extract_feed_products(feed_payloads(t), RULES))


@query("extract_variant_rows", "S6", """select 'Item K' || part_id || case when n > 1 then ' · Shop ' || store_id else '' end as name,
    'https://shop.example.com/products/k' || part_id || case when n > 1 then '?variant=' || listing_id else '' end as url, price as current_price, case when regular_price > price then regular_price end as regular_price
  from (select *, count(*) over (partition by part_id) as n from v_offer_rows) where available""")
def extract_variant_rows(t):
    return feeds.extract_variant_rows(feed_payloads(t), "https://shop.example.com").select("name", "url", "current_price", "regular_price")


@query("extract_graphql_products", "S3", """
  with v as (select part_id, price, regular_price, sku, ean, store_id, available from v_offer_rows where part_id % 4 <> 0
      union all select part_id, price // 2, null, 'SEL', '99', 9, true from v_offer_rows where part_id % 4 <> 0 and part_id % 3 = 0 and store_id = (select min(store_id) from v_offer_rows o where o.part_id = v_offer_rows.part_id)
      union all select part_id, min(price), max(regular_price), null, null, 0, true from v_offer_rows where part_id % 4 = 0 group by 1)
  select 'Item K' || b.part_id as name, 'https://shop.example.com/products/k' || b.part_id as url, b.price as current_price, case when c.compare > b.price then c.compare end as regular_price, sku, ean
  from (select * from v where available qualify row_number() over (partition by part_id order by price, store_id) = 1) b join (select part_id, max(regular_price) as compare from v where available group by 1) c using (part_id)""")
def extract_graphql_products(t):
    money = lambda c: F.struct(c.cast("string").alias("amount"))
    node = (F.col("listing_id").cast("string").alias("id"), F.col("available").alias("availableForSale"), money(F.col("price")).alias("price"), money(F.col("regular_price")).alias("compareAtPrice"), "sku", F.col("ean").alias("barcode"))
    parts = variants_of(t, *node, F.col("price").alias("p"), F.col("regular_price").alias("r"))
    v, first = F.col("variants"), F.get("variants", F.lit(0))
    shownv = F.when(F.col("part_id") % 4 != 0, F.transform(v, lambda x: x.dropFields("p", "r", "store_id"))).otherwise(F.array().cast("array<struct<id string, availableForSale boolean, price struct<amount string>, compareAtPrice struct<amount string>, sku string, barcode string>>"))
    selected = F.when((F.col("part_id") % 4 != 0) & (F.col("part_id") % 3 == 0), F.struct(
        F.lit("sel").alias("id"), F.lit(True).alias("availableForSale"), money(F.floor(first["p"] / 2)).alias("price"), F.lit("SEL").alias("sku"), F.lit("99").alias("barcode")))
    struct = F.struct(
        "title", "handle", F.col("product_type").alias("productType"), F.lit("v").alias("vendor"), F.lit(True).alias("availableForSale"), F.struct(shownv.alias("nodes")).alias("variants"),
        selected.alias("selectedOrFirstAvailableVariant"), F.struct(money(F.array_min(F.transform(v, lambda x: x["p"]))).alias("minVariantPrice")).alias("priceRange"),
        F.struct(money(F.array_max(F.transform(v, lambda x: x["r"]))).alias("maxVariantPrice")).alias("compareAtPriceRange"))
    got = bodies(parts, struct, lambda rows: F.struct(F.struct(F.struct(rows.alias("nodes")).alias("products")).alias("data")))
    return shown(feeds.extract_graphql_products(got, RULES))


@query("extract_sku_seller_offers", "S4", """select 'Item K' || part_id as name, 'https://shop.example.com/k' || part_id as url, price as current_price, case when regular_price > price then regular_price end as regular_price, sku, ean
  from v_offer_rows where available and listing_id % 6 <> 0 qualify row_number() over (partition by part_id order by price, store_id) = 1""")
def extract_sku_seller_offers(t):
    offer = lambda extra, quantity: F.struct(F.struct(
        F.col("available").alias("IsAvailable"), quantity.cast("string").alias("AvailableQuantity"), (F.col("price") + extra).cast("double").alias("Price"), F.col("regular_price").cast("double").alias("ListPrice")).alias("commertialOffer"))
    item = (F.col("sku").alias("itemId"), "ean", F.array(offer(10, F.col("listing_id") % 6), offer(0, F.col("listing_id") % 6)).alias("sellers"))
    parts = variants_of(t, *item)
    body = F.struct(F.col("title").alias("productName"), F.concat(F.lit("https://shop.example.com/"), "handle", F.lit("?x=1")).alias("link"), F.col("variants").alias("items"))
    return shown(feeds.extract_sku_seller_offers(payload(parts, body)))


@query("extract_minor_unit_products", "S5", """select 'Item K' || part_id as name, 'https://shop.example.com/item/' || listing_id as url, case when listing_id % 3 = 0 then price - 10 else price end as current_price,
    case when regular_price > case when listing_id % 3 = 0 then price - 10 else price end then regular_price end as regular_price, sku from v_offer_rows where part_id % 2 = 0""")
def extract_minor_unit_products(t):
    text = lambda c: (c * 100).cast("string")
    price, regular = F.col("price"), F.col("regular_price")
    item = F.struct(
        F.col("title").alias("name"), F.concat(F.lit("https://www.shop.example.com/item/"), F.col("listing_id").cast("string"), F.lit("/")).alias("permalink"), "sku",
        F.array(F.struct(F.when(F.col("part_id") % 2 == 0, "Gin").otherwise("Bebida").alias("name"))).alias("categories"),
        F.struct(text(price).alias("price"), text(regular).alias("regular_price"), F.when(F.col("listing_id") % 3 == 0, text(price - 10)).alias("sale_price"), F.lit(2).alias("currency_minor_unit")).alias("prices"))
    got = bodies(offers(t), item, lambda rows: rows)
    return feeds.extract_minor_unit_products(got, HOST).select("name", "url", "current_price", "regular_price", "sku")


def page_of(t, block):
    """HTML pages of ``PAGE`` parts per shop."""
    cards = offers(t).withColumn("card", block)
    grouped = cards.groupBy("store_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("listing_id", "card"))), lambda x: x["card"]), "\n").alias("cards"))
    body = F.concat(F.lit("<html><head><style>.x{}</style></head><body><nav><a href='/about'>Info</a></nav><div class='grid'>"), "cards", F.lit("</div></body></html>"))
    return grouped.select(F.lit("shop").alias("store"), F.concat_ws("/", F.lit("https://shop.example.com"), "store_id", "page").alias("url"), body.alias("body"))


def link(folder):
    return F.concat(F.lit(f"/{folder}/item-"), F.col("listing_id").cast("string"))


def tag(name, content, attributes=""):
    return F.concat(F.lit(f"<{name}{attributes}>"), content, F.lit(f"</{name}>"))


_CARDS = "select 'Item K' || part_id as name, 'https://shop.example.com{folder}/item-' || listing_id as url, {current} as current_price, {regular} as regular_price from v_offer_rows where {where}"


@query("extract_cards", "S9", _CARDS.format(folder="/producto", current="price", regular="case when regular_price > price then regular_price end", where="true"))
def extract_cards(t):
    block = F.concat(F.lit("<article class='product'><a href='"), link("producto"), F.lit("'>"), tag("h3", F.col("title")), F.lit("</a><del>"),
                     format_money(F.col("regular_price")), F.lit("</del> <b>"), format_money(F.col("price")), F.lit("</b></article>"))
    return html.extract_cards(page_of(t, block), html.PROFILES["shop_card"], HOST).select("name", "url", "current_price", "regular_price")


# The prices of a card that a profile takes, in reading order.
_BOUNDED = "(select *, list_filter([regular_price, price], lambda x: x between {low} and {high}) as a from v_offer_rows where {where})"
_BOUNDED_CARDS = "select 'Item K' || part_id as name, 'https://shop.example.com{folder}/item-' || listing_id as url, list_min(a) as current_price, case when list_max(a) > list_min(a) then list_max(a) end as regular_price from " + _BOUNDED + " where len(a) > 0"


@query("extract_cards_last_price", "S9", "select 'Item K' || part_id as name, 'https://shop.example.com/product/item-' || listing_id as url, a[-1] as current_price, case when len(a) > 1 and a[-2] > a[-1] then a[-2] end as regular_price from "
       + _BOUNDED.format(low=500, high=1_000_000, where="true") + " where len(a) > 0")
def extract_cards_last_price(t):
    block = F.concat(F.lit("<li class='grid product'><a href='"), link("product"), F.lit("?x=1'><h2 class='woocommerce-loop-product__title'>"), "title", F.lit("</h2></a><span>"),
                     format_money(F.col("regular_price")), F.lit("</span><span>"), format_money(F.col("price")), F.lit("</span></li>"))
    return html.extract_cards(page_of(t, block), html.PROFILES["grid_last_price"], HOST).select("name", "url", "current_price", "regular_price")


def listed_pages(t, folder, block):
    """Pages whose grid begins with links that are no cards, as a menu of categories."""
    menu = "".join(f"<a href='{folder}/lead-{k}'></a>" for k in range(5))
    return page_of(t, block).withColumn("body", F.replace("body", F.lit("<div class='grid'>"), F.lit(f"<div class='grid'>{menu}")))


def cards_of(t, profile, folder, block):
    return html.extract_cards(listed_pages(t, folder, block), html.PROFILES[profile], HOST).select("name", "url", "current_price", "regular_price")


def prices(between=" ", around="b"):
    return F.concat(tag("s", format_money(F.col("regular_price"))), F.lit(between), tag(around, format_money(F.col("price"))))


@query("extract_cards_unit_priced", "S9", _BOUNDED_CARDS.format(folder="/productos", low=500, high=2_000_000, where="available"))
def extract_cards_unit_priced(t):
    block = F.concat(F.lit("<li><a href='"), link("productos"), F.lit("'>"), tag("span", F.col("title"), " class='product-name'"), F.lit("</a>"), prices(), F.lit(" <small>$ 7.777 x litro</small>"),
                     F.when(F.col("available"), "").otherwise("<i>Producto no disponible</i>"), F.lit("</li>"))
    return cards_of(t, "unit_priced", "/productos", block)


@query("extract_cards_heading_quantity", "S9", _BOUNDED_CARDS.format(folder="", low=100, high=20_000_000, where="available"))
def extract_cards_heading_quantity(t):
    block = F.concat(F.lit("<div><a href='/item-"), F.col("listing_id").cast("string"), F.lit("'>"), tag("h3", F.col("title")), F.lit("</a>"), prices(),
                     F.when(F.col("available"), "<label>Cantidad</label><i>No disponible en tienda</i>").otherwise("<i>No disponible</i>"), F.lit("</div>"))
    return cards_of(t, "heading_quantity", "", block)


@query("extract_cards_heading_cart", "S9", _BOUNDED_CARDS.format(folder="/tienda", low=100, high=20_000_000, where="available"))
def extract_cards_heading_cart(t):
    block = F.concat(F.lit("<div><a href='"), link("tienda"), F.lit("'>"), tag("h2", F.col("title")), F.lit("</a>"), prices("<br>", "p"), F.when(F.col("available"), "<button>Agregar</button>").otherwise("<b>Sin stock</b>"), F.lit("</div>"))
    return cards_of(t, "heading_cart", "/tienda", block)


@query("extract_cards_litre_priced", "S9", _BOUNDED_CARDS.format(folder="/products", low=100, high=20_000_000, where="listing_id % 7 <> 3"))
def extract_cards_litre_priced(t):
    name = F.concat("title", F.when(F.col("listing_id") % 7 == 3, " Grabada").otherwise(""))
    block = F.concat(F.lit("<li><a href='"), link("products"), F.lit("'>"), tag("h3", name), F.lit("</a>"), prices(), F.lit(" <small>$9.999 / litro</small></li>"))
    return cards_of(t, "litre_priced", "/products", block)


def shop_items(t):
    block = F.concat(F.lit("<div class='box item'><a href='"), link("producto"), F.lit("' title='"), "title", F.lit("'><img alt='photo'></a>"), prices(), F.lit("</div>"))
    return listed_pages(t, "/producto", block)


@query("extract_cards_shop_item", "S9", _BOUNDED_CARDS.format(folder="/producto", low=100, high=20_000_000, where="true"))
def extract_cards_shop_item(t):
    return html.extract_cards(shop_items(t), html.PROFILES["shop_item"], HOST).select("name", "url", "current_price", "regular_price")


@query("explode_cards", "S9", "select store_id, 'Item K' || part_id as name, '/producto/item-' || listing_id as href from " + _BOUNDED.format(low=100, high=20_000_000, where="true") + " where len(a) > 0")
def explode_cards(t):
    html.register_explode_cards(t.spark, html.PROFILES["shop_item"])
    shop = F.regexp_extract("url", r"com/(\d+)/", 1).cast("bigint").alias("store_id")
    return t.spark.sql("select p.url, c.name, c.href from {pages} p, lateral explode_cards(p.body) c", pages=shop_items(t)).select(shop, "name", "href")


@query("extract_cards_club", "S9", _CARDS.format(folder="/products", current="price", regular="null::bigint", where="available"))
def extract_cards_club(t):
    block = F.concat(F.lit("<li><a href='"), link("products"), F.lit("'>"), "title", F.lit("</a><p>Club: "), format_money(F.col("price") - 5), F.lit("</p><p>"), format_money(F.col("price")),
                     F.lit("</p>"), F.when(F.col("available"), "").otherwise("<i>AGOTADO</i>"), F.lit("</li>"))
    return html.extract_cards(page_of(t, block), html.PROFILES["club_priced"], HOST).select("name", "url", "current_price", "regular_price")


@query("extract_cards_heading", "S9", _CARDS.format(folder="", current="price", regular="case when regular_price > price then regular_price end", where="available"))
def extract_cards_heading(t):
    block = F.concat(F.lit("<div class='card item'><h4><a href='/item-"), F.col("listing_id").cast("string"), F.lit("'>"), "title", F.lit("</a></h4><s>"), format_money(F.col("regular_price")),
                     F.lit("</s> "), format_money(F.col("price")), F.when(F.col("available"), "<button>Agregar</button>").otherwise("<b>No disponible</b>"), F.lit("</div>"))
    return html.extract_cards(page_of(t, block), html.PROFILES["heading_card"], HOST).select("name", "url", "current_price", "regular_price")


@query("extract_cards_coded", "S9", "select 'Item K' || part_id as name, price as current_price, null::bigint as regular_price, 'S-' || listing_id as sku from v_offer_rows")
def extract_cards_coded(t):
    block = F.concat(F.lit("<div class='product'><span class='name'>"), "title", F.lit("</span><span>Código: "), "sku", F.lit("</span><b>"), format_money(F.col("price")), F.lit("</b></div>"))
    return html.extract_cards(page_of(t, block), html.PROFILES["coded"], HOST).select("name", "current_price", "regular_price", "sku")


@query("extract_labelled_quotes", "S10", """select 'Item K' || part_id as name, 'https://shop.example.com/tienda/producto/item-' || (listing_id + 1000) as url, price as current_price, case when regular_price > price then regular_price end as regular_price,
    (listing_id + 1000)::varchar as sku, 3 as quotes, price - 50 as member_price from v_offer_rows where available and price >= 150""")
def extract_labelled_quotes(t):
    i = (F.col("listing_id") + 1000).cast("string")
    block = F.concat(F.lit('<article class="hit"><a href="/tienda/producto/item-'), i, F.lit('?q=1"><h3>'), "title", F.lit("</h3></a> Socio: "), format_money(F.col("price") - 50), F.lit(" Oferta: "),
                     format_money(F.col("price")), F.lit(" Normal: "), format_money(F.col("regular_price")), F.lit(" Stock: "), F.when(F.col("available"), "50+").otherwise("0"), F.lit("</article>"))
    rows = pages.extract_labelled_quotes(page_of(t, block), HOST).where("current_price >= 150")
    member = F.element_at(F.filter("price_quotes", lambda q: q["price_type"] == "MEMBER"), 1)["price"]
    return rows.select("name", "url", "current_price", "regular_price", "sku", F.size("price_quotes").alias("quotes"), member.alias("member_price"))


@query("extract_json_ld", "S7", """select case when listing_id % 3 = 2 then 'Meta ' || listing_id else 'Item K' || part_id end as name, 'https://shop.example.com/producto/item-' || listing_id as url, price as current_price,
    case when regular_price > price then regular_price end as regular_price from v_offer_rows""")
def extract_json_ld(t):
    i, name = F.col("listing_id"), F.col("title")
    spec = F.when(i % 2 == 0, F.struct(F.lit("ListPrice").alias("priceType"), F.col("regular_price").cast("string").alias("price")))
    offer = F.struct(F.col("price").alias("price"), F.when(i % 2 == 1, F.concat(F.col("regular_price").cast("string"), F.lit(",00"))).alias("highPrice"), spec.alias("priceSpecification"))
    product = F.struct(F.lit("Product").alias("@type"), name.alias("name"), offer.alias("offers"))
    graph = F.struct(F.array(F.struct(F.lit("WebSite").alias("@type"), F.lit("x").alias("name"), F.lit(None).cast("string").alias("item")).alias("a")).alias("ignored"), F.array(product).alias("@graph"))
    script = F.concat(F.lit('<script type="application/ld+json">'), F.when(i % 3 == 0, F.to_json(product)).otherwise(F.to_json(graph)), F.lit("</script>"))
    meta = F.concat(F.lit('<meta property="og:title" content="Meta '), i.cast("string"), F.lit('"/><meta property="product:price:amount" content="'), F.col("price").cast("string"),
                    F.lit('.00"/><meta content="'), F.col("regular_price").cast("string"), F.lit('" itemprop="price"/>'))
    built = offers(t).select(F.lit("shop").alias("store"), F.concat(F.lit("https://shop.example.com/producto/item-"), i.cast("string")).alias("url"),
                             F.concat(F.lit("<html><head>"), F.when(i % 3 == 2, meta).otherwise(script), F.lit("</head><body>$1</body></html>")).alias("body"))
    return json_products.extract_json_ld(built, HOST).select("name", "url", "current_price", "regular_price")


@query("extract_nested_products", "S8", """select 'Item K' || part_id as name, 'https://shop.example.com/producto/k' || listing_id as url, price as current_price, case when regular_price > price then regular_price end as regular_price from v_offer_rows""")
def extract_nested_products(t):
    i = F.col("listing_id")
    item = F.struct(F.struct(F.col("title").alias("rendered")).alias("title"), F.concat(F.lit("k"), i.cast("string")).alias("slug"), F.col("price").alias("salePrice"), (F.col("price") + 1).alias("price"),
                    F.struct(format_money(F.col("regular_price")).alias("amount")).alias("listPrice"), F.lit("x").alias("other"))
    got = bodies(offers(t), F.struct(F.array(item).alias("cells")), lambda rows: F.struct(F.struct(rows.alias("list")).alias("data")))
    return json_products.extract_nested_products(got, rules=HOST).select("name", "url", "current_price", "regular_price")


@query("extract_sitemap", "S11", """select distinct 'urlset' as kind, 'https://shop.example.com/product/' || regexp_extract(url, '/product/([^/?#]+)', 1) as url from v_names
  union all select distinct 'index', 'https://shop.example.com/product-map-' || part_id // 20 || '.xml' from v_names""")
def extract_sitemap(t):
    located = t.v_names.withColumn("page", F.floor(F.col("part_id") / PAGE))
    entry = tag("url", tag("loc", F.col("url")))
    sets = located.groupBy("page").agg(F.array_join(F.collect_list(entry), "").alias("b")).select(F.concat(F.lit('<?xml version="1.0"?><urlset>'), "b", F.lit("<url><loc>https://x/about</loc></url></urlset>")).alias("body"))
    maps = located.select("page").distinct().select(F.concat(F.lit("<sitemapindex><sitemap><loc> https://shop.example.com/product-map-"), F.col("page").cast("string"), F.lit(".xml </loc></sitemap></sitemapindex>")).alias("body"))
    both = sets.unionByName(maps).withColumn("store", F.lit("shop"))
    return pages.extract_sitemap(both, HOST).select("kind", "url")


@query("discover_categories", "S12", r"""
  with l as (select 'shop' as store, page_id, regexp_extract_all(html, '(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1) as h from pages),
  k as (select lower(regexp_extract(u, '(?i)^(?:https?://[^/]+)?/([^/?#]+)/?(?:[?#].*)?$', 1)) as key from (select unnest(h) as u from l))
  select distinct key from k where key <> '' and key not in ('uncategorized', 'sin-categoria')""")
def discover_categories(t):
    raw = t.pages.select(F.lit("shop").alias("store"), "page_id", F.col("html").alias("body"))
    return pages.discover_categories(raw, "/", order="page_id").select("key")


@query("discover_categories_labels", "S12", "select lower(product_type) as key, concat('Label ', max(part_id)::varchar) as name from v_names group by 1")
def discover_categories_labels(t):
    built = t.v_names.select("part_id", "product_type").distinct().select(
        F.lit("shop").alias("store"), F.col("part_id").alias("page_id"),
        F.concat(F.lit('<a class="m" href="https://x.cl/product-category/'), "product_type", F.lit('/"><b>Label</b> '), F.col("part_id").cast("string"), F.lit('</a><a href="/product-category/a/b/">sub</a>')).alias("body"))
    return pages.discover_categories(built, order="page_id").select("key", "name")


@query("discover_facets", "S13", "select distinct p_brand || ' ' || p_type as value from part union select distinct 'Json ' || p_type from part")
def discover_facets(t):
    built = t.part.select(F.lit("shop").alias("store"), F.concat(
        F.lit('<a href="/x?fR%5Bmarca%5D%5B0%5D='), F.replace(F.replace("p_brand", F.lit("#"), F.lit("%23")), F.lit(" "), F.lit("+")), F.lit("%20"), "p_type", F.lit('&amp;page=2">f</a><script>var u="/y?fR[marca][0]=Json%20'), "p_type",
        F.lit('";</script> 100% <a href="/x?fR%5Bother%5D%5B0%5D=no">n</a>')).alias("body"))
    return pages.discover_facets(built, "marca").select("value")


@query("detect_page_count", "S14", """select o_orderkey as run_id, case o_orderkey % 4 when 0 then o_orderkey % 90 + 2 when 1 then ceil((o_orderkey % 900 + 1) / 24.0)::int when 2 then greatest(o_orderkey % 30, 3) else ceil((o_orderkey % 500 + 1) / 24.0)::int end::int as page_count from orders""")
def detect_page_count(t):
    i = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    body = (F.when(i % 4 == 0, F.concat(F.lit("<p>Página <b>1</b> de "), text(i % 90 + 2), F.lit("</p>"))).when(i % 4 == 1, F.concat(F.lit("<div>Mostrando 24 de "), text(i % 900 + 1), F.lit("</div>")))
            .when(i % 4 == 2, F.concat(F.lit('<a href="/c?page=3">3</a><a href="/c?s=1&amp;page='), text(i % 30), F.lit('">last</a>'))).otherwise(F.concat(F.lit("Content-Range: resources 0-49/"), text(i % 500 + 1))))
    return pages.detect_page_count(t.orders.select(i.alias("run_id"), body.alias("body")), F.lit(24))


def scratch(t, name):
    return f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/sinks/{name}-{uuid.uuid4().hex}"


@query("append_observations", "S15", "select obs_id, listing_id, price, cast(observed_at as date) as observed_date from v_obs")
def append_observations(t):
    path = scratch(t, "observations")
    obs = t.v_obs.select("obs_id", "listing_id", "price", "observed_at")
    for run in (0, 1, 0):  # the repeated run changes nothing
        sinks.append_observations(obs.where(f"obs_id % 2 = {run}"), path, run)
    return sinks.read_observations(t.spark, path, "obs_id long, listing_id long, price long, observed_at timestamp").drop("observed_at")


@query("overwrite_snapshot", "S16", "select listing_id, current_price from v_listings where listing_id % 2 = 0")
def overwrite_snapshot(t):
    path = scratch(t, "snapshot")
    rows = t.v_listings.select("listing_id", "current_price")
    sinks.overwrite_snapshot(rows, path)
    sinks.overwrite_snapshot(rows.where("listing_id % 2 = 0"), path)
    return sinks.read_snapshot(t.spark, path, "listing_id long, current_price long")
