import pytest
from pyspark.sql import functions as F

from pricetide.functions import money as M
from pricetide.functions import text as X
from pricetide.functions import urls as U
from pricetide.functions.signature import signature, with_search_query


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("v")).first()["v"]


@pytest.mark.parametrize("text,volume", [("750 cc", 750), ("75 cl", 750), ("1 litro", 1000), ("0,75 L", 750), ("5 ml", None), ("nada", None)])
def test_volume(spark, text, volume):
    assert one(spark, text, X.extract_volume_ml) == volume


@pytest.mark.parametrize("name,count", [
    ("Vino Casas X6 750 ml", 6), ("Vino Casas x 6 750 ml", 6), ("Coctel X6 1000 ml", 6), ("Vodka 700cc x6", 6), ("Cerveza 6x750 ml", 6),
    ("Casas Patronales Gran Reserva Carmenere 750 ml", None), ("Six pack cerveza", 6), ("Gin + copa 700 ml", 2), ("Caja de 12 botellas", 12)])
def test_pack(spark, name, count):
    assert one(spark, name, X.extract_pack_count) == count


def test_abv_and_vintage(spark):
    name = "Cabernet Reserva 2022 14% alc. 750 ml"
    assert one(spark, name, X.extract_abv_pct) == 14.0
    assert one(spark, name, X.extract_vintage_year) == 2022
    assert one(spark, "100% agave", X.extract_abv_pct) is None


def test_same_key_for_spellings(spark):
    keys = {one(spark, n, X.normalized_key) for n in ("Whisky Johnnie Walker Black 750 ml", "Johnnie Walker Black 75 cl")}
    assert keys == {"johnnie walker black|750"}


def test_fold(spark):
    assert one(spark, "Añejo STRASSE ß ½ Ñandú é", X.ascii_fold) == "anejo strasse ss 1⁄2 nandu e"
    assert one(spark, "Añejo ß", X.unicode_fold) == "anejo ss"


def test_signature_of_alias(spark):
    s = one(spark, "Whisky JW Etiqueta Negra 75 cl", signature)
    assert s["brand"] == "johnnie walker" and s["core_tokens"] == ["johnnie", "walker", "black", "label"]
    assert s["variant_tokens"] == ["black"] and s["volume_ml"] == 750 and not s["is_pack"]


def test_search_query(spark):
    row = with_search_query(spark.createDataFrame([("jw black 750",)], "query string")).first()
    assert row["query_volume_ml"] == 750 and {"johnnie", "walker"} <= set(row["tokens"])


@pytest.mark.parametrize("style,text,value", [
    ("digits", "$ 18.891", 18891), ("decimal", "19990.00", 19990), ("decimal", "$19.990", None), ("mixed", "19.990", 19990), ("mixed", "19990,50", 19990),
    ("structured", "12990,00", 12990), ("structured", "$12.990", 12990), ("rounded", "12990.5", 12990), ("digits", "99", None)])
def test_money(spark, style, text, value):
    assert one(spark, text, lambda c: M.parse_money(c, style)) == value


def test_urls(spark):
    rules = U.UrlRules(host="shop.cl", product_folder="products")
    assert one(spark, "https://WWW.Shop.cl/collections/x//products/abc?v=1#y", lambda c: U.canonical_url(c, rules)) == "https://shop.cl/products/abc"
    assert one(spark, "HTTP://Shop.CL//a//b/?q=1", U.canonical_url) == "http://shop.cl/a/b"
    assert one(spark, "mailto:x", U.is_valid_url) is False


def test_contaminated_title(spark):
    url = "https://x.cl/product/vino-marques-de-casa-concha-merlot-750-ml/"
    title = "3 Vinos Montes Alpha 750 ml 3 Vino Marques De Casa Concha Merlot 750 ml"
    row = spark.createDataFrame([(title, url)], "t string, u string").select(X.safe_name(F.col("t"), F.col("u")).alias("v")).first()
    assert row["v"] == "vino marques de casa concha merlot 750 ml"
