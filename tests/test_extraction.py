"""Pages and JSON bodies that real shops serve: deep, with short names, encoded slugs, prices in other places."""

import json
import time

from pricetide.sources import html, json_products
from pricetide.sources.html import parse_html

HOST = "https://shop.example.com/producto/"


def page(spark, body, url=HOST + "some-item"):
    return spark.createDataFrame([("s", url, body)], "store string, url string, body string")


def script(document):
    return f'<script type="application/ld+json">{json.dumps(document)}</script>'


def product(name, price, **more):
    return {"@type": ["Thing", "Product"], "name": name, "offers": {"price": price, **more}}


def test_deep_page_text():
    deep = parse_html("<div>" * 10_000 + "end")
    assert deep.text() == "end"


def test_cards_of_a_deep_page(spark):
    body = "<div>" * 10_000 + "<article class='product'><a href='/producto/a'><h3>Long name</h3></a><b>$5.990</b></article>"
    rows = html.extract_cards(page(spark, body), html.PROFILES["shop_card"]).collect()
    assert [(r["name"], r["current_price"]) for r in rows] == [("Long name", 5990)]


def test_many_cards_and_deep_cards_in_linear_time():
    card = "<div><div><a href='/productos/x{k}'><span class='product-name'>Name {k}</span></a></div><b>$5.990</b></div>"
    began = time.monotonic()
    many = list(html._cards("<div>" + "".join(card.replace("{k}", str(k)) for k in range(10_000)) + "</div>", html.PROFILES["unit_priced"]))
    deep = list(html._cards("<div>" * 20_000 + card.replace("{k}", "1"), html.PROFILES["unit_priced"]))
    assert [name for _, name, _, _ in many] == [f"Name {k}" for k in range(10_000)] and len(deep) == 1
    assert time.monotonic() - began < 20


def test_measures_equal_texts_and_links():
    profile = html.PROFILES["shop_item"]
    root = parse_html("<div> a <p>b\xa0 c</p><script>no</script><style>x</style><i> </i><a href='/producto/1'>d<b>e</b></a><a href='/other'>f</a></div> tail")
    html._measure(root, profile)
    for node in root.walk():
        assert node.size == len(node.text()) and node.links == len(html._product_links(node, profile))


def test_json_ld_goes_on_after_a_short_name(spark):
    rows = json_products.extract_json_ld(page(spark, script([product("ab", 900), product("Whole name", 1200, highPrice="1500,00")]))).collect()
    assert [(r["name"], r["current_price"], r["regular_price"]) for r in rows] == [("Whole name", 1200, 1500)]


def test_json_ld_at_any_depth(spark):
    node = product("Deep item", 1990)
    for _ in range(80):
        node = {"x": [node]}
    assert json_products.extract_json_ld(page(spark, script(node))).first()["name"] == "Deep item"


def test_json_ld_specifications_and_names(spark):
    offers = [{"@type": "Offer", "priceSpecification": [{"priceType": "https://schema.org/StrikethroughPrice", "price": 5000}, {"@type": "UnitPriceSpecification", "price": "3.990"}]}, {"lowPrice": 4500}]
    row = json_products.extract_json_ld(page(spark, script({"@type": "product", "name": "undefined", "offers": offers}), HOST + "12-red-wine")).first()
    assert (row["name"], row["current_price"], row["regular_price"]) == ("Red Wine", 3990, 5000)


def test_marked_price_outside_meta(spark):
    row = json_products.extract_json_ld(page(spark, '<meta property="og:title" content="A name"><span itemprop="price" content="2490.00">x</span><b itemprop="price">$1.990</b>')).first()
    assert (row["name"], row["current_price"], row["regular_price"]) == ("A name", 1990, 2490)


def test_nested_products(spark):
    body = {"data": [{"name": "First", "slug": "ñ 1", "price": {"value": "abc", "price": 2000}, "listPrice": "$ 2.500"}, {"title": {"rendered": "Second"}, "permalink": "https://x/producto/2", "prices": {"salePrice": 990, "price": 500}},
                     {"name": "No price", "slug": "a"}, {"name": "True price", "slug": "a", "price": True}, {"name": "x", "slug": "a", "price": 1000}]}
    for _ in range(40):
        body = {"in": body}
    rows = json_products.extract_nested_products(spark.createDataFrame([("s", json.dumps(body)), ("s", "not json"), ("s", None)], "store string, body string")).collect()
    assert sorted((r["name"], r["current_price"], r["regular_price"]) for r in rows) == [("First", 2000, 2500), ("Second", 990, None)]
    assert any("%C3%B1%201" in r["url"] for r in rows)
