"""Scalar functions over every listing name and address."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.functions import money as M
from pricetide.functions import signature as S
from pricetide.functions import text as X
from pricetide.functions import urls as U
from pricetide.functions import wordlists as W

from . import duck_text as D
from .registry import query


def scalar(name, item, spark_expr, duck_expr, source="v_names"):
    """Register one function of the rows of ``source``."""

    @query(name, item, f"select listing_id, {duck_expr} as value from {source}")
    def run(t):
        return getattr(t, source).select("listing_id", spark_expr().alias("value"))


scalar("ascii_fold", "F1", lambda: X.ascii_fold(F.col("name")), D.fold("name"))
scalar("normalize_spaces", "F2", lambda: X.normalize_spaces(F.concat(F.lit("  "), F.replace(F.col("name"), F.lit(" "), F.lit("   ")))),
       r"trim(regexp_replace('  ' || replace(name, ' ', '   '), '\s+', ' ', 'g'))")
scalar("extract_volume_ml", "F3", lambda: X.extract_volume_ml(F.col("name")), D.volume("name"))
scalar("extract_abv_pct", "F4", lambda: X.extract_abv_pct(F.col("name")), D.abv("name"))
scalar("extract_vintage_year", "F5", lambda: X.extract_vintage_year(F.col("name")), D.vintage("name"))
scalar("extract_pack_count", "F6", lambda: X.extract_pack_count(F.col("name")),
       D.pack(D.aliases("name"), D.volume(D.aliases("name"))))
scalar("apply_aliases", "F7", lambda: X.apply_aliases(F.col("name")), D.aliases("name"))
scalar("normalized_key", "F8", lambda: X.normalized_key(F.col("name")), D.normalized_key("name"))
scalar("canonical_name", "F8", lambda: X.canonical_name(F.col("name")), D.canonical_name("name"))
scalar("core_tokens", "F9", lambda: F.array_join(X.core_tokens(F.col("name")), " "),
       f"array_to_string({D.tokens(D.aliases('name'))}, ' ')")
scalar("core_key", "F10", lambda: X.core_key(X.core_tokens(F.col("name"))),
       f"array_to_string(list_sort({D.tokens(D.aliases('name'))}), ' ')")
scalar("search_normalize", "F24", lambda: X.search_normalize(F.col("name")), D.search_norm("name"))
scalar("discount_pct", "F16", lambda: M.discount_pct(F.col("regular_price"), F.col("price")),
       "case when regular_price > price then (regular_price - price) / regular_price::double else 0.0 end")
scalar("format_money", "F27", lambda: M.format_money(F.col("price")),
       "'$' || replace(format('{:,}', price), ',', '.')")
scalar("format_duration", "F27", lambda: M.format_duration(F.col("price")),
       "case when price >= 60000 then (price // 60000)::varchar || 'm ' || lpad((price // 1000 % 60)::varchar, 2, '0') || 's' "
       "else (price // 1000)::varchar || 's' end")
scalar("unit_clamp", "F28", lambda: M.unit_clamp(F.col("price") / 50000.0 - 0.5),
       "greatest(0.0::double, least(1.0::double, price / 50000.0::double - 0.5::double))")
scalar("canonical_url", "F19", lambda: U.canonical_url(F.col("url")), r"regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '')")
scalar("canonical_url_shop", "F19",
       lambda: U.canonical_url(F.col("url"), U.UrlRules(host="shop.example.com", product_folder="product", trailing_slash=True)),
       "'https://shop.example.com/product/' || regexp_extract(url, '/product/([^/?#]+)', 1) || '/'")
scalar("is_product_url", "F20", lambda: U.is_product_url(F.col("url"), U.UrlRules(product_paths=("/product/red", "/product/old"), excluded=("utm=",))),
       "(contains(url, '/product/red') or contains(url, '/product/old')) and not contains(url, 'utm=')")
scalar("is_valid_url", "F20", lambda: U.is_valid_url(F.when(F.col("listing_id") % 3 == 0, F.substr(F.col("url"), F.lit(9))).otherwise(F.col("url"))),
       "listing_id % 3 <> 0")
scalar("name_from_url", "F22", lambda: X.name_from_url(F.col("url")), "replace(regexp_extract(url, '/product/([^/?#]+)', 1), '-', ' ')")
scalar("is_relevant", "F21", lambda: X.is_relevant(F.col("product_type"), F.col("name")),
       f"not regexp_matches({D.fold('''product_type || ' ' || name''')}, '{'|'.join(W.IRRELEVANT_WORDS)}') "
       f"and regexp_matches({D.fold('''product_type || ' ' || name''')}, '{'|'.join(W.RELEVANT_WORDS)}')")

_HAY = D.replace_all(D.fold("' ' || product_type || '  ' || name || ' '"), r"\s+", " ")
_CASES = " ".join(
    f"when regexp_matches({_HAY}, '{'|'.join(m for m in ms if m.isascii())}') then '{c}'" for c, ms in W.CATEGORY_RULES
)
_CATEGORY = f"case {_CASES} else product_type end"
scalar("classify_category", "F21", lambda: X.classify_category(F.col("product_type"), F.lit(""), F.col("name")), _CATEGORY)
scalar("is_accessory", "F21",
       lambda: X.is_accessory(F.col("product_type"), F.lit(""), F.col("name"), F.when(F.col("listing_id") % 2 == 0, "Otros").otherwise("Gin")),
       f"listing_id % 2 = 0 and regexp_matches({_HAY}, '{'|'.join(W.ACCESSORY_MARKERS)}')")

# A polluted title carries the neighbour's words before its own.
def _dirty():
    return F.when(F.col("part_id") % 3 == 0, F.concat(F.lit("3 Vinos Montes Alpha 750 ml Vino "), F.translate(X.name_from_url(F.col("url")), "-", " "), F.lit(" 750 ml"))).otherwise(F.col("name"))


@query("safe_name", "F23", """
  select listing_id, part_id % 3 = 0 as contaminated,
    case when part_id % 3 = 0 then replace(regexp_extract(url, '/product/([^/?#]+)', 1), '-', ' ')
      else trim(regexp_replace(regexp_replace(regexp_replace(trim(name), '\\$\\s*[\\d.\\s]+', '', 'g'), '\\s+', ' ', 'g'), '^[ |-]+|[ |-]+$', '', 'g')) end as value
  from v_names""")
def safe_name(t):
    dirty = t.v_names.withColumn("dirty", _dirty())
    return dirty.select(
        "listing_id",
        X.is_contaminated_title(X.clean_title(F.col("dirty")), X.name_from_url(F.col("url"))).alias("contaminated"),
        X.safe_name(F.col("dirty"), F.col("url")).alias("value"),
    )


_AMOUNT = "case listing_id % 4 when 0 then '$ ' || format('{:,}', price) when 1 then price::varchar || '.00' when 2 then '$' || replace(format('{:,}', price), ',', '.') else price::varchar || ' CLP' end"


@query("parse_money", "F17", f"""
  with raw as (select listing_id, price, listing_id % 4 as kind, {_AMOUNT} as amount from v_names),
  parsed as (select listing_id, amount, case when kind = 1 then price * 100 else price end as digits,
    case when kind = 2 and price >= 1000 and price < 1000000 then price // 1000 else price end as decimal_style,
    case when kind = 0 and price >= 1000000 then null when kind = 0 and price >= 1000 then price // 1000
      when kind = 3 then null else price end as mixed, price as structured from raw)
  select listing_id, amount, case when digits between 100 and 20000000 then digits end as digits,
    case when decimal_style between 100 and 20000000 then decimal_style end as decimal_style,
    case when mixed between 100 and 20000000 then mixed end as mixed,
    case when structured between 100 and 20000000 then structured end as structured from parsed""")
def parse_money(t):
    kind, price = F.col("listing_id") % 4, F.col("price")
    amount = (
        F.when(kind == 0, F.concat(F.lit("$ "), F.format_number(price, 0)))
        .when(kind == 1, F.concat(price.cast("string"), F.lit(".00")))
        .when(kind == 2, M.format_money(price))
        .otherwise(F.concat(price.cast("string"), F.lit(" CLP")))
    )
    text = F.col("amount")
    return t.v_names.select("listing_id", amount.alias("amount")).select(
        "listing_id", "amount",
        M.parse_money(text, "digits").alias("digits"),
        M.parse_money(text, "decimal").alias("decimal_style"),
        M.parse_money(text, "mixed").alias("mixed"),
        M.parse_money(text, "structured").alias("structured"),
    )


@query("price_values", "F18", """
  select listing_id, list_filter([p1, p2, p1 + 7], lambda x: x between 5000 and 5000000) as amounts,
    len(list_filter([p1, p2, p1 + 7], lambda x: x between 5000 and 5000000)) as n
  from (select listing_id, price as p1, price * 2 as p2 from v_names)""")
def price_values(t):
    p = F.col("price")
    text = F.concat(
        F.lit("Club: "), M.format_money(p + 1), F.lit(" Antes "), M.format_money(p), F.lit(" x "),
        M.format_money(p * 2), F.lit(" "), M.format_money(p), F.lit(" "), M.format_money(p + 7),
    )
    amounts = t.v_names.select("listing_id", text.alias("text")).select(
        "listing_id", M.price_values(F.col("text"), 5000, 5_000_000, drop="club").alias("amounts"))
    return amounts.withColumn("n", F.size("amounts"))


@query("signature", "F13", """
  select listing_id, array_to_string(core_tokens, ' ') as tokens, core_key, volume_ml, pack_count, is_pack, brand,
    array_to_string(variant_tokens, ' ') as variants, abv_pct, vintage_year from v_sig_names""")
def signature(t):
    s = F.col("sig")
    return S.with_signature(t.v_names).select(
        "listing_id", F.array_join(s["core_tokens"], " ").alias("tokens"), s["core_key"].alias("core_key"),
        s["volume_ml"].alias("volume_ml"), s["pack_count"].alias("pack_count"), s["is_pack"].alias("is_pack"),
        s["brand"].alias("brand"), F.array_join(s["variant_tokens"], " ").alias("variants"),
        s["abv_pct"].alias("abv_pct"), s["vintage_year"].alias("vintage_year"),
    )


@query("variant_tokens", "F11", "select listing_id, array_to_string(variant_tokens, ' ') as value from v_sig_names")
def variant_tokens(t):
    return S.with_signature(t.v_names).select("listing_id", F.array_join("sig.variant_tokens", " ").alias("value"))


@query("infer_brand", "F12", "select listing_id, brand as value from v_sig_names")
def infer_brand(t):
    return S.with_signature(t.v_names).select("listing_id", F.col("sig.brand").alias("value"))


@query("comparison_key", "F14", "select listing_id, core_key || '|' || coalesce(volume_ml::varchar, 'unknown') as value from v_sig_names")
def comparison_key(t):
    return S.with_signature(t.v_names).select("listing_id", S.comparison_key(F.col("sig")).alias("value"))


_FINGERPRINT = (
    "concat_ws('|', coalesce(brand, 'unknown'), coalesce(nullif(core_key, ''), 'unknown'), coalesce(volume_ml::varchar, 'unknown'), "
    "coalesce(nullif(array_to_string(variant_tokens, '+'), ''), 'base'), coalesce(vintage_year::varchar, 'nv'), "
    "case when abv_pct is null then 'na' else format('{:.1f}', abv_pct) end, coalesce(pack_count, 1)::varchar)"
)


@query("canonical_fingerprint", "F15", f"select listing_id, {_FINGERPRINT} as value from v_sig_names")
def canonical_fingerprint(t):
    return S.with_signature(t.v_names).select("listing_id", S.canonical_fingerprint(F.col("sig")).alias("value"))


@query("parse_search_query", "F25", f"""
  select listing_id, q.normalized, array_to_string(list_distinct_ordered, ' ') as tokens, query_volume_ml, query_pack, query_brand
  from (select s.listing_id, norm as normalized,
      list_filter(string_split(norm, ' '), lambda w, i: w <> '' and list_position(string_split(norm, ' '), w) = i) as list_distinct_ordered,
      coalesce(volume_ml, list_filter(list_transform(regexp_extract_all(replace(norm, ' ', '  '), '(?:^|[^0-9])([0-9]{{2,4}})(?:[^0-9]|$)', 1), lambda x: x::int), lambda x: x between 50 and 5000)[-1]) as query_volume_ml,
      pack_count as query_pack, brand as query_brand
    from (select *, {D.search_norm('source_name')} as norm from v_sig_names) s) q""")
def parse_search_query(t):
    parsed = S.with_search_query(t.v_names.select("listing_id", F.col("name").alias("query")))
    return parsed.select("listing_id", "normalized", F.array_join("tokens", " ").alias("tokens"),
                         "query_volume_ml", "query_pack", "query_brand")


@query("change_columns", "F26", """
  select listing_id, coalesce(price < prev, false) as price_dropped, coalesce(price > prev, false) as price_increased,
    coalesce(price <> prev, false) as price_changed, coalesce(price - prev, 0) as price_change_amount,
    case when coalesce(prev, 0) = 0 then 0.0 else (price - prev) / prev::double end as price_change_pct
  from (select listing_id, price, case when listing_id % 5 = 0 then null else regular_price - 20000 end as prev from v_names)""")
def change_columns(t):
    prev = F.when(F.col("listing_id") % 5 != 0, F.col("regular_price") - 20000)
    return t.v_names.select("listing_id", "price", prev.alias("prev")).select(
        "listing_id", *[c.alias(n) for n, c in M.change_columns(F.col("prev"), F.col("price")).items()])


@query("local_time", "F27", """
  select obs_id, strftime(timezone('America/Santiago', timezone('UTC', observed_at)), '%d-%m-%Y %H:%M') as value from v_obs""")
def local_time(t):
    return t.v_obs.select("obs_id", M.local_time(F.col("observed_at")).alias("value"))


@query("payload_hash", "F29", """
  select store_id, sha256('[' || string_agg('{"rank":' || rank || ',"listing_id":' || listing_id || ',"price":' || price || '}', ',' order by rank) || ']') as payload_hash
  from (select store_id, listing_id, price, row_number() over (partition by store_id order by price desc, listing_id) as rank from v_names)
  where rank <= 30 group by store_id""")
def payload_hash(t):
    from pyspark.sql import Window

    from pricetide.operators.alerts import payload_hash as digest

    w = Window.partitionBy("store_id").orderBy(F.desc("price"), "listing_id")
    top = t.v_names.withColumn("rank", F.row_number().over(w)).where("rank <= 30")
    return top.groupBy("store_id").agg(digest("rank", "listing_id", "price").alias("payload_hash"))


@query("evidence_json", "F30", """
  select listing_id, '{"method":"' || matching_method || '","confidence":' || round(confidence, 4)::varchar || '}' as evidence from v_matches""")
def evidence_json(t):
    from pricetide.operators.identity import evidence_json as evidence

    return t.v_matches.select("listing_id", evidence(F.col("matching_method"), F.col("confidence")).alias("evidence"))


@query("usable_payload", "P9", "select page_id, not regexp_matches(lower(strip_accents(html)), '%s') as usable from pages" % "|".join(W.NOTICE_MARKERS))
def usable_payload(t):
    return t.pages.select("page_id", X.usable_payload(F.col("html")).alias("usable"))
