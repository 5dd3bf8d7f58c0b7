"""Text columns: folding, product names, search text. Built-in expressions only."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordlists as W


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Binding through a lambda keeps an intermediate from being evaluated again in
    each of its uses, also when a filter is pushed below the projection.
    """
    return F.transform(F.array(value), body)[0]


def _fold_table() -> tuple[str, str, list[tuple[str, str]]]:
    """Latin letters and signs whose compatibility form differs from themselves."""
    singles, expansions = {}, []
    blocks = (range(0xA0, 0x250), range(0x1E00, 0x1F00))
    for point in (p for block in blocks for p in block):
        char = chr(point)
        plain = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        ).casefold()
        if plain == char or not plain:
            continue
        if len(plain) == 1:
            singles[char] = plain
        else:
            expansions.append((char, plain))
    return "".join(singles), "".join(singles.values()), expansions


_FOLD_FROM, _FOLD_TO, _FOLD_LONG = _fold_table()
_LONG_CLASS = "[" + "".join(char for char, _ in _FOLD_LONG) + "]"


def ascii_fold(c: Column) -> Column:
    """Lower case without accents. Plain ASCII input skips the tables."""
    folded = F.regexp_replace(F.translate(c, _FOLD_FROM, _FOLD_TO), "[̀-ͯ]", "")
    long = folded
    for char, plain in _FOLD_LONG:
        long = F.replace(long, F.lit(char), F.lit(plain))
    return (
        F.when(~c.rlike("[^\\x00-\\x7F]"), F.lower(c))
        .when(~c.rlike(_LONG_CLASS), F.lower(folded))
        .otherwise(F.lower(long))
    )


@F.pandas_udf(T.StringType())
def unicode_fold(values: pd.Series) -> pd.Series:
    """Full Unicode variant of ``ascii_fold`` for text outside the Latin blocks."""
    return values.map(
        lambda text: None
        if text is None
        else "".join(
            c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)
        ).casefold()
    )


def normalize_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(c, " ", " "), r"\s+", " "))


def _replace_phrases(c: Column, phrases) -> Column:
    for source, target in phrases:
        c = F.regexp_replace(c, rf"\b{source}\b", target)
    return c


def _loose_marks(folded: Column) -> Column:
    marked = F.replace(folded, F.lit("&"), F.lit(" and "))
    return F.translate(marked, "'’", "  ")


# Every phrase table entry contains one of these, so most names skip the table.
_PHRASE_HINT = r"\bjw\b|etiqueta|walker|jack|\bj [bw]\b|six pack"


def _unify_phrases(text: Column, phrases) -> Column:
    return bind(
        text,
        lambda t: F.when(t.rlike(_PHRASE_HINT), _replace_phrases(t, phrases)).otherwise(t),
    )


def apply_aliases(c: Column) -> Column:
    """Fold, open up ``&`` and quotes, and unify spelling variants."""
    text = F.concat(F.lit(" "), _loose_marks(ascii_fold(c)), F.lit(" "))
    return F.trim(F.regexp_replace(_unify_phrases(text, W.PHRASE_ALIASES), r"\s+", " "))


def _number(raw: Column) -> Column:
    return F.replace(raw, F.lit(","), F.lit(".")).try_cast("double")


def _within(value: Column, low, high) -> Column:
    return bind(value, lambda v: F.when(v.between(low, high), v))


def extract_volume_ml(c: Column) -> Column:
    pattern = "(?i)(?<!\\d)" + W.VOLUME_PATTERN

    def scaled(hit: Column) -> Column:
        unit = F.lower(F.regexp_extract(hit, pattern, 2))
        factor = F.when(unit.isin("ml", "cc"), 1.0).when(unit == "cl", 10.0).otherwise(1000.0)
        volume = F.bround(_number(F.regexp_extract(hit, pattern, 1)) * factor, 0)
        return F.when(hit != "", _within(volume, 20, 20000).cast("int"))

    return bind(F.regexp_extract(c, pattern, 0), scaled)


def extract_abv_pct(c: Column) -> Column:
    value = _number(F.regexp_extract(c, "(?i)(?<!\\d)" + W.ABV_PATTERN + r"(?!\d)", 1))
    return F.when(c.rlike("(?i)[%°]|grado"), _within(value, 0.0, 96.0))


def extract_vintage_year(c: Column) -> Column:
    years = F.transform(
        F.regexp_extract_all(c, F.lit(W.VINTAGE_PATTERN), F.lit(1)),
        lambda y: y.cast("int"),
    )
    return F.array_max(F.filter(years, lambda y: y <= 2035))


# No pack pattern or word matches a name without one of these.
_PACK_HINT = (
    r"[0-9]\s*[x×u]|[x×]\s*[0-9]|pack|caja|case|combo|estuche|botella|lata|regalo|incluye"
    r"|copa|vaso|jigger|miniatura|personalizad|grabad|\+|\by\b"
)


def pack_count_of(text: Column, volume_ml: Column) -> Column:
    """Units per pack of an aliased name; null for a single bottle."""

    def number(pattern: str) -> Column:
        return F.regexp_extract(text, "(?i)" + pattern, 1).try_cast("int")

    steps = [_within(number(pattern), 2, 48) for pattern in W.PACK_COUNT_PATTERNS]
    steps += [
        F.when(
            volume_ml.isNotNull(),
            bind(number(pattern), lambda n: F.when(n.isin(*W.MULTIPLIER_COUNTS), n)),
        )
        for pattern in W.MULTIPLIER_PATTERNS
    ]
    steps.append(F.when(is_pack_text(text), F.lit(2)))
    return F.when(text.rlike(_PACK_HINT), F.coalesce(*steps))


def is_pack_text(text: Column) -> Column:
    return text.rlike(W.PACK_WORD_PATTERN) | text.rlike(W.BUNDLE_PATTERN)


def extract_pack_count(c: Column) -> Column:
    return bind(apply_aliases(c), lambda text: pack_count_of(text, extract_volume_ml(text)))


def _without_amounts(text: Column) -> Column:
    def marked(t: Column) -> Column:
        cut = F.regexp_replace(t, W.PRICE_IN_NAME_PATTERN, " ")
        return F.when(
            t.rlike("[$%]"), F.regexp_replace(cut, W.PERCENT_IN_NAME_PATTERN, " ")
        ).otherwise(t)

    return F.regexp_replace(bind(text, marked), "(?i)(?<!\\d)" + W.VOLUME_PATTERN, " ")


def _without_packs(text: Column) -> Column:
    cleaned = text
    for pattern in W.PACK_COUNT_PATTERNS:
        cleaned = F.regexp_replace(cleaned, "(?i)" + pattern, " ")
    return F.when(text.rlike(_PACK_HINT), cleaned).otherwise(text)


def core_tokens_of(text: Column) -> Column:
    """Identity-bearing words of an aliased name, in order, repeats kept."""
    cleaned = bind(_without_amounts(text), _without_packs)
    words = F.regexp_extract_all(cleaned, F.lit("([a-z0-9]+)"), F.lit(1))

    def unify(word: Column) -> Column:
        renamed = None
        for source, target in W.TOKEN_ALIASES.items():
            renamed = (F if renamed is None else renamed).when(word == source, F.lit(target))
        return renamed.otherwise(word)

    return F.filter(
        F.transform(words, unify), lambda word: ~word.isin(*W.GENERIC_WORDS, "and")
    )


def core_tokens(c: Column) -> Column:
    return core_tokens_of(apply_aliases(c))


def core_key(tokens: Column) -> Column:
    return F.array_join(F.array_sort(tokens), " ")


def _is_variant(token: Column) -> Column:
    return token.isin(*W.VARIANT_MARKERS) | token.rlike("^[0-9]+$")


def variant_tokens(tokens: Column) -> Column:
    return F.array_distinct(F.array_sort(F.filter(tokens, _is_variant)))


def infer_brand(tokens: Column) -> Column:
    """Known brand phrase, else the leading words; null only without tokens."""
    padded = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    openers = F.array(*[F.lit(w) for w in sorted({b.split()[0] for b in W.KNOWN_BRANDS})])
    maybe_known = F.arrays_overlap(tokens, openers)
    known = bind(
        padded,
        lambda p: F.coalesce(
            *[F.when(p.contains(f" {brand} "), F.lit(brand)) for brand in W.KNOWN_BRANDS]
        ),
    )
    first, second = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))
    leading = F.when(
        second.isNotNull() & ~_is_variant(second), F.concat_ws(" ", first, second)
    ).otherwise(first)
    return F.when(maybe_known, F.coalesce(known, leading)).otherwise(leading)


def _key_words(folded: Column) -> Column:
    words = F.regexp_extract_all(_without_amounts(folded), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(words, lambda word: ~word.isin(*W.KEY_STOP_WORDS))


def normalized_key(c: Column) -> Column:
    """Exact identity of a name: meaningful words and volume."""

    def key_of(folded: Column) -> Column:
        words = F.array_join(_key_words(folded), " ")
        key = F.concat_ws("|", F.nullif(words, F.lit("")), extract_volume_ml(folded).cast("string"))
        return bind(key, lambda k: F.when(k == "", F.trim(folded)).otherwise(k))

    return bind(ascii_fold(c), key_of)


def canonical_name(c: Column) -> Column:
    """Display form: capitalised meaningful words and volume."""

    def name_of(folded: Column) -> Column:
        words = F.array_join(F.transform(_key_words(folded), F.initcap), " ")
        volume = bind(
            extract_volume_ml(folded),
            lambda v: F.when(v.isNotNull(), F.concat(v.cast("string"), F.lit(" ml"))),
        )
        return F.concat_ws(" ", F.coalesce(F.nullif(words, F.lit("")), F.trim(c)), volume)

    return bind(ascii_fold(c), name_of)


def search_normalize(c: Column) -> Column:
    text = F.concat(F.lit(" "), _loose_marks(ascii_fold(F.coalesce(c, F.lit("")))), F.lit(" "))
    text = _unify_phrases(text, W.SEARCH_PHRASE_ALIASES)
    words = F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_join(F.filter(words, lambda word: ~word.isin(*W.SEARCH_STOP_WORDS)), " ")


def classify_category(product_type: Column, tags: Column, title: Column) -> Column:
    haystack = F.concat(
        F.lit(" "), normalize_spaces(ascii_fold(F.concat_ws(" ", product_type, tags, title))), F.lit(" ")
    )
    rule = None
    for category, markers in W.CATEGORY_RULES:
        hit = _contains_any(haystack, [m for m in markers if m.isascii()])
        rule = F.when(hit, category) if rule is None else rule.when(hit, category)
    named = F.nullif(normalize_spaces(product_type), F.lit(""))
    return rule.otherwise(F.coalesce(named, F.lit("Otros")))


def _contains_any(text: Column, markers) -> Column:
    return text.rlike("|".join(markers))


def is_accessory(product_type: Column, tags: Column, title: Column, category: Column) -> Column:
    text = F.concat(
        F.lit(" "), normalize_spaces(ascii_fold(F.concat_ws(" ", product_type, tags, title))), F.lit(" ")
    )
    return (category == "Otros") & _contains_any(text, W.ACCESSORY_MARKERS)


def is_relevant(categories: Column, name: Column) -> Column:
    text = ascii_fold(F.concat_ws(" ", categories, name))
    return ~_contains_any(text, W.IRRELEVANT_WORDS) & _contains_any(text, W.RELEVANT_WORDS)


def usable_payload(body: Column) -> Column:
    """False for maintenance notices and challenge pages."""
    return ~_contains_any(ascii_fold(body), W.NOTICE_MARKERS)


def name_from_url(url: Column) -> Column:
    """Words of the last path segment below a product folder; empty if under three."""
    path = F.url_decode(F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*://[^/?#]*)?([^?#]*)", 1))

    def from_parts(parts: Column) -> Column:
        folder = F.lower(F.try_element_at(parts, F.lit(-2)))
        slug = F.translate(F.trim(F.try_element_at(parts, F.lit(-1))), "_", "-")
        return F.when(
            folder.isin("product", "producto", "tienda"),
            bind(
                F.filter(F.split(slug, "-"), lambda word: F.trim(word) != ""),
                lambda words: F.when(F.size(words) >= 3, normalize_spaces(F.array_join(words, " "))),
            ),
        )

    parts = F.filter(F.split(path, "/"), lambda part: part != "")
    return F.coalesce(bind(parts, from_parts), F.lit(""))


def clean_title(c: Column) -> Column:
    c = F.regexp_replace(F.trim(c), r"^-\d+(?:[.,]\d+)?%\s*", "")
    c = F.regexp_replace(c, r"\$\s*[\d.\s]+", "")
    c = F.regexp_replace(c, r"(?i)\bLLEVAR\b", "")
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"^[ |-]+|[ |-]+$", "")


def _title_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def is_contaminated_title(title: Column, url_name: Column) -> Column:
    """Title that carries a neighbouring product's text around the slug's own words."""
    volumes = F.regexp_count(
        title, F.lit(r"(?i)(?<!\d)\d+(?:[.,]\d+)?\s*(?:ml|cc|cl|l|lt|lts)\b")
    )
    leading = title.rlike(r"(?i)^\s*\d+\s+(?:vinos?|botellas?|un(?:idades?)?)\b")

    def test(words: Column, slug: Column) -> Column:
        slug_set = F.array_distinct(slug)
        overlap = F.size(F.array_intersect(slug_set, words)) / F.size(slug_set)
        nouns = F.size(F.filter(words, lambda word: word.isin(*W.PRODUCT_NOUNS)))
        return F.when(
            (F.size(slug) >= 3) & (F.size(words) - F.size(slug) >= 3),
            (overlap >= 0.72) & ((nouns >= 2) | (volumes >= 2) | leading),
        ).otherwise(F.lit(False))

    return bind(
        F.struct(_title_words(title).alias("t"), _title_words(url_name).alias("u")),
        lambda pair: test(pair["t"], pair["u"]),
    )


def safe_name(title: Column, url: Column) -> Column:
    """The title, or the slug's name where the title is polluted or empty."""
    return bind(
        F.struct(clean_title(title).alias("t"), clean_title(name_from_url(url)).alias("u")),
        lambda pair: F.when(
            (pair["u"] != "") & is_contaminated_title(pair["t"], pair["u"]), pair["u"]
        ).otherwise(F.coalesce(F.nullif(pair["t"], F.lit("")), pair["u"])),
    )
