"""Money, rates and display columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a plausible shelf price may be, in minor units.
PRICE_LOW, PRICE_HIGH = 100, 20_000_000


def unit_clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def discount_pct(regular: Column, current: Column) -> Column:
    return F.when(regular > current, (regular - current) / regular).otherwise(F.lit(0.0))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "").try_cast("bigint")


def parse_money(c: Column, style: str = "digits", low: int = PRICE_LOW, high: int = PRICE_HIGH) -> Column:
    """Amount in minor units, null outside the bounds.

    ``digits``      every digit counts (``$1.234`` is 1234)
    ``decimal``     plain decimal text is truncated, anything else as ``digits``
    ``mixed``       two trailing decimals are a fraction, other dots group thousands
    ``structured``  like ``digits`` but ``,00`` / ``.00`` is a fraction
    ``rounded``     numeric text is rounded half to even, anything else as ``digits``
    """
    if style == "digits":
        value = _digits(c)
    elif style == "decimal":
        raw = F.translate(F.trim(c), "$ ", "")
        whole = F.regexp_extract(raw, r"^(\d+)(?:\.\d+)?$", 1).try_cast("bigint")
        value = F.coalesce(whole, _digits(raw))
    elif style == "mixed":
        raw = F.translate(F.trim(c), "$ ", "")
        cents = F.regexp_extract(raw, r"^(\d+)[.,]\d{2}$", 1).try_cast("bigint")
        grouped = F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        value = F.coalesce(cents, F.regexp_extract(grouped, r"^(\d+)(?:\.\d*)?$", 1).try_cast("bigint"))
    elif style == "structured":
        raw = F.trim(F.replace(F.translate(F.trim(c), "$", ""), F.lit("CLP"), F.lit("")))
        cents = F.regexp_extract(raw, r"^(\d+)[.,]00$", 1).try_cast("bigint")
        value = F.coalesce(cents, _digits(raw))
    elif style == "rounded":
        value = F.coalesce(F.bround(c.try_cast("double"), 0).cast("bigint"), _digits(c))
    else:
        raise ValueError(f"unknown money style {style!r}")
    return F.when(value.between(low, high), value)


# Amounts that are not the price of the item itself.
UNIT_PRICE_PATTERNS = {
    "per_measure": r"(?i)\$\s*[\d.\s]+\s*x\s*(?:lt|l|litro|kg|gr|g|ml|cc|unidad|un)\b",
    "per_litre": r"(?i)\$\s*[\d.]+\s*(?:/\s*litros?|cada\s+art[ií]culo)",
    "club": r"(?i)Club:\s*\$\s*[\d.]+",
}


def price_values(
    text: Column,
    low: int = PRICE_LOW,
    high: int = PRICE_HIGH,
    drop: str | None = None,
    distinct: bool = True,
) -> Column:
    """Dollar amounts inside the bounds, in reading order."""
    if drop is not None:
        text = F.regexp_replace(text, UNIT_PRICE_PATTERNS[drop], " ")
    amounts = F.transform(
        F.regexp_extract_all(text, F.lit(r"\$\s*([\d.]+)"), F.lit(1)), _digits
    )
    amounts = F.filter(amounts, lambda amount: amount.between(low, high))
    return F.array_distinct(amounts) if distinct else amounts


def change_columns(previous: Column, current: Column) -> dict[str, Column]:
    """Columns describing a price change; a missing previous price is no change."""
    dropped = F.coalesce(current < previous, F.lit(False))
    increased = F.coalesce(current > previous, F.lit(False))
    amount = F.coalesce(current - previous, F.lit(0))
    pct = F.when(F.coalesce(previous, F.lit(0)) == 0, F.lit(0.0)).otherwise(amount / previous)
    return {
        "price_dropped": dropped,
        "price_increased": increased,
        "price_changed": dropped | increased,
        "price_change_amount": amount.cast("bigint"),
        "price_change_pct": pct,
    }


def format_money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.translate(F.format_number(c.cast("bigint"), 0), ",", "."))


def fixed_text(c: Column, digits: int = 1) -> Column:
    """A number with none or one decimal, rounded as Python and C do: by the exact binary value, ties to even.

    ``format_string`` rounds ties away from zero, and rounds the shortest decimal form instead of the value.
    """
    if digits not in (0, 1):
        raise ValueError("none or one decimal")
    size = F.abs(c.cast("double"))
    scaled = size * 10 ** digits
    low = F.floor(scaled)
    # 20 * size against 2 * low + 1 in two exact terms; without decimals the halves themselves are exact.
    above, below = (size * 16 - (low * 2 + 1), size * -4) if digits else (size, low + F.lit(0.5))
    units = low + F.when((above > below) | ((above == below) & (low % 2 == 1)), 1).otherwise(0)
    text = F.concat(F.floor(units / 10).cast("string"), F.lit("."), (units % 10).cast("string")) if digits else units.cast("string")
    return F.concat(F.when(c < 0, "-").otherwise(""), text)


def format_duration(ms: Column) -> Column:
    seconds = F.greatest(F.floor(ms / 1000), F.lit(0)).cast("int")
    minutes = F.floor(seconds / 60).cast("int")
    return F.when(
        minutes > 0, F.format_string("%dm %02ds", minutes, seconds % 60)
    ).otherwise(F.format_string("%ds", seconds))


def local_time(ts: Column, zone: str = "America/Santiago") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "dd-MM-yyyy HH:mm")
