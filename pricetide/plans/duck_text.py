"""Oracle side of the name functions: the same rules as DuckDB (RE2) expressions."""

from __future__ import annotations

from pricetide.functions import wordlists as W

from .registry import ORACLE_VIEWS


def lst(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def fold(x: str) -> str:
    return f"lower(strip_accents({x}))"


def replace_all(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def phrases(x: str, table) -> str:
    for source, target in table:
        x = replace_all(x, rf"\b{source}\b", target)
    return x


def loose(x: str) -> str:
    return f"translate(replace({fold(x)}, '&', ' and '), '''’', '  ')"


def aliases(x: str) -> str:
    text = phrases(f"(' ' || {loose(x)} || ' ')", W.PHRASE_ALIASES)
    return f"trim({replace_all(text, r'\s+', ' ')})"


def volume(x: str) -> str:
    p = "(?i)" + W.VOLUME_PATTERN
    unit = f"lower(regexp_extract({x}, '{p}', 2))"
    num = f"try_cast(replace(regexp_extract({x}, '{p}', 1), ',', '.') as double)"
    v = (
        f"round_even({num} * case when {unit} in ('ml','cc') then 1.0 when {unit} = 'cl' "
        "then 10.0 else 1000.0 end, 0)"
    )
    return f"case when {v} between 20 and 20000 then cast({v} as int) end"


def abv(x: str) -> str:
    p = "(?i)(?:^|[^0-9])" + W.ABV_PATTERN + "(?:[^0-9]|$)"
    v = f"try_cast(replace(regexp_extract({x}, '{p}', 1), ',', '.') as double)"
    return f"case when {v} between 0 and 96 then {v} end"


def vintage(x: str) -> str:
    return (
        f"list_max(list_filter(list_transform(regexp_extract_all({x}, '{W.VINTAGE_PATTERN}', 1), "
        "lambda y: cast(y as int)), lambda y: y <= 2035))"
    )


def is_pack(text: str) -> str:
    return f"(regexp_matches({text}, '{W.PACK_WORD_PATTERN}') or regexp_matches({text}, '{W.BUNDLE_PATTERN}'))"


def pack(text: str, vol: str) -> str:
    steps = []
    for p in W.PACK_COUNT_PATTERNS:
        n = f"try_cast(regexp_extract({text}, '(?i){p}', 1) as int)"
        steps.append(f"case when {n} between 2 and 48 then {n} end")
    for p in W.MULTIPLIER_PATTERNS:
        n = f"try_cast(regexp_extract({text}, '(?i){p}', 1) as int)"
        steps.append(f"case when {vol} is not null and {n} in {lst(W.MULTIPLIER_COUNTS)} then {n} end")
    steps.append(f"case when {is_pack(text)} then 2 end")
    return "coalesce(" + ", ".join(steps) + ")"


def without_amounts(x: str) -> str:
    x = replace_all(x, W.PRICE_IN_NAME_PATTERN, " ")
    x = replace_all(x, W.PERCENT_IN_NAME_PATTERN, " ")
    return replace_all(x, "(?i)" + W.VOLUME_PATTERN, " ")


def tokens(text: str) -> str:
    x = without_amounts(text)
    for p in W.PACK_COUNT_PATTERNS:
        x = replace_all(x, "(?i)" + p, " ")
    cases = " ".join(f"when w = '{a}' then '{b}'" for a, b in W.TOKEN_ALIASES.items())
    return (
        f"list_filter(list_transform(regexp_extract_all({x}, '([a-z0-9]+)', 1), "
        f"lambda w: case {cases} else w end), lambda w: w not in {lst([*W.GENERIC_WORDS, 'and'])})"
    )


def variant_test(w: str) -> str:
    return f"({w} in {lst(W.VARIANT_MARKERS)} or regexp_matches({w}, '^[0-9]+$'))"


def brand(toks: str) -> str:
    padded = f"(' ' || array_to_string({toks}, ' ') || ' ')"
    cases = " ".join(f"when contains({padded}, ' {b} ') then '{b}'" for b in W.KNOWN_BRANDS)
    return (
        f"case {cases} when len({toks}) >= 2 and not {variant_test(f'{toks}[2]')} "
        f"then {toks}[1] || ' ' || {toks}[2] else {toks}[1] end"
    )


def key_words(folded: str) -> str:
    return (
        f"list_filter(regexp_extract_all({without_amounts(folded)}, '([a-z0-9]+)', 1), "
        f"lambda w: w not in {lst(W.KEY_STOP_WORDS)})"
    )


def normalized_key(x: str) -> str:
    words = f"array_to_string({key_words(fold(x))}, ' ')"
    key = f"concat_ws('|', nullif({words}, ''), cast({volume(fold(x))} as varchar))"
    return f"case when {key} = '' then trim({fold(x)}) else {key} end"


def canonical_name(x: str) -> str:
    words = (
        f"array_to_string(list_transform({key_words(fold(x))}, "
        "lambda w: upper(w[1]) || w[2:]), ' ')"
    )
    return (
        f"concat_ws(' ', case when {words} = '' then trim({x}) else {words} end, "
        f"cast({volume(fold(x))} as varchar) || ' ml')"
    )


def search_norm(x: str) -> str:
    text = phrases(f"(' ' || {loose(f'''coalesce({x}, '')''')} || ' ')", W.SEARCH_PHRASE_ALIASES)
    return (
        f"array_to_string(list_filter(regexp_extract_all({text}, '([a-z0-9]+)', 1), "
        f"lambda w: w not in {lst(W.SEARCH_STOP_WORDS)}), ' ')"
    )


def sig_view(source: str, id_col: str = "listing_id", name: str = "name", keep: str = "") -> str:
    """Signature columns of every row of ``source``, computed in stages."""
    cols = (", " + keep) if keep else ""
    return f"""
      select s3.*, {brand('core_tokens')} as brand,
        list_sort(list_distinct(list_filter(core_tokens, lambda w: {variant_test('w')}))) as variant_tokens,
        array_to_string(list_sort(core_tokens), ' ') as core_key, pack_count is not null as is_pack
      from (select s2.*, {pack('normalized_text', 'volume_ml')} as pack_count
        from (select s1.*, {volume('normalized_text')} as volume_ml, {tokens('normalized_text')} as core_tokens,
                {abv('source_name')} as abv_pct, {vintage('source_name')} as vintage_year
          from (select {id_col}, {name} as source_name, {aliases(name)} as normalized_text{cols} from {source}) s1) s2) s3"""


def sequence_ratios(pairs: str) -> str:
    """Matched share of each distinct text pair (a, b) by recursion: the longest common block, then what lies left and right of it.

    ``cells`` are equal characters with the lengths of their runs; in texts of 200 and more, frequent
    characters begin no block (``seed``) and only extend one.
    """
    return f"""
  with recursive p as materialized (select row_number() over () as p, a, b, length(a) as la, length(b) as lb from (select distinct a, b from ({pairs}) where a is not null and b is not null)),
  ca as (select p, i - 1 as i, a[i] as c from (select p, a, unnest(range(1, la + 1)) as i from p)),
  cb as (select p, lb, j - 1 as j, b[j] as c from (select p, b, lb, unnest(range(1, lb + 1)) as j from p)),
  usual as (select *, lb < 200 or count(*) over (partition by p, c) <= lb // 100 + 1 as seed from cb),
  met as (select p, i, j, seed, i - j as d, i - row_number() over (partition by p, i - j order by i) as run,
      i - row_number() over (partition by p, i - j, seed order by i) as seed_run from ca join usual using (p, c)),
  cells as materialized (select p, i, j, seed, count(*) over ahead as ahead, count(*) over behind as behind, count(*) over seeds as seeds from met
    window ahead as (partition by p, d, run order by i desc), behind as (partition by p, d, run order by i), seeds as (partition by p, d, seed, seed_run order by i desc)),
  walk(p, alo, ahi, blo, bhi, gain) as (
    select p, 0::bigint, la::bigint, 0::bigint, lb::bigint, 0::bigint from p
    union all
    select p, unnest([alo, best.i + best.k]), unnest([best.i, ahi]), unnest([blo, best.j + best.k]), unnest([best.j, bhi]), unnest([best.k, 0]) from (
      select w.p, alo, ahi, blo, bhi, min({{'n': -(case when seed then least(seeds, ahi - i, bhi - j) else 0 end), 'si': i, 'sj': j,
          'i': case when seed then i - least(behind - 1, i - alo, j - blo) else i end, 'j': case when seed then j - least(behind - 1, i - alo, j - blo) else j end,
          'k': case when seed then least(behind - 1, i - alo, j - blo) else 0 end + least(ahead, ahi - i, bhi - j)}}) as best
      from walk w join cells c on c.p = w.p and i >= alo and i < ahi and j >= blo and j < bhi and (seed or i = alo and j = blo)
      where alo < ahi and blo < bhi group by w.p, alo, ahi, blo, bhi))
  select a, b, case when la + lb = 0 then 1.0 else 2.0::double * sum(gain) / (la + lb)::double end as ratio from walk join p using (p) group by a, b, la, lb"""


ORACLE_VIEWS["v_sig_names"] = sig_view("v_names", keep="store_id")
ORACLE_VIEWS["v_sig_catalog"] = sig_view(
    "v_catalog", keep="store_id, master_id, sku, ean, name, url, excluded_from_comparison"
)
ORACLE_VIEWS["v_sig_listings"] = sig_view("v_listings")
