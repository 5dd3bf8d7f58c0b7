"""Opportunity scores, classes and commercial signals as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import fixed_text, format_money, unit_clamp

# Component weights of the two score versions.
V1_WEIGHTS = {"market_saving": 0.35, "history_position": 0.30, "match_confidence": 0.15,
              "freshness": 0.10, "scarcity": 0.10}
V2_WEIGHTS = {"market_saving": 0.30, "history_position": 0.25, "rarity": 0.15,
              "match_confidence": 0.15, "freshness": 0.10, "scarcity": 0.05}
# Class limits, best first.
CLASSES = ((90, "Excelente"), (80, "Muy buena"), (70, "Buena"), (55, "Normal"))
# Fixed values: (age in hours up to, freshness); beyond the last limit the rest value.
PUBLIC_FRESHNESS, PUBLIC_STALE = ((12, 1.0), (24, 0.8), (48, 0.5)), 0.2
PERSONAL_FRESHNESS, PERSONAL_STALE = ((6, 1.0), (24, 0.9), (72, 0.7)), 0.4
FULL_SAVING = 0.30
SIGNALS = ("NEW_HISTORICAL_MIN", "RARE_OFFER", "AT_HISTORICAL_MIN", "NEAR_HISTORICAL_MIN", "MARKET_LEADER")


def _weighted(weights: dict[str, float], components: dict[str, Column]) -> Column:
    total = None
    for name, weight in weights.items():
        part = F.lit(weight) * unit_clamp(components[name])
        total = part if total is None else total + part
    return F.bround(F.lit(100.0) * total, 1)


def opportunity_score_v1(**components: Column) -> Column:
    return _weighted(V1_WEIGHTS, components)


def opportunity_score_v2(**components: Column) -> Column:
    return _weighted(V2_WEIGHTS, components)


def classify_opportunity(score: Column) -> Column:
    label = F
    for limit, name in CLASSES:
        label = label.when(score >= limit, name)
    return label.otherwise("No destacada")


def market_saving(saving_pct: Column) -> Column:
    return F.least(F.lit(1.0), saving_pct / FULL_SAVING)


def history_position(price: Column, average: Column, minimum: Column) -> Column:
    """How far below its own 90-day average the public price is."""
    below = F.when(average > 0, unit_clamp(((average - price) / average) / 0.25)).otherwise(F.lit(0.0))
    at_floor = (minimum != 0) & (price <= minimum)
    return F.when(at_floor, F.greatest(below, F.lit(0.95))).otherwise(below)


def personal_history_position(price: Column, average: Column, minimum: Column) -> Column:
    """The same for a personal price: neutral at the average or when unknown."""
    spread = F.lit(0.5) + ((average - price) / average) / 0.30
    at_floor = (minimum != 0) & (price <= minimum)
    known = F.when(at_floor, F.greatest(spread, F.lit(1.0))).otherwise(spread)
    return F.when(average > 0, unit_clamp(known)).otherwise(F.lit(0.5))


def freshness(as_of: Column, seen: Column, tiers=PUBLIC_FRESHNESS, rest: float = PUBLIC_STALE) -> Column:
    hours = (F.unix_micros(as_of) - F.unix_micros(seen)) / 3_600_000_000
    value = F.when(seen.isNull(), 0.0)
    for limit, score in tiers:
        value = value.when(hours <= limit, score)
    return value.otherwise(rest)


def scarcity(offers: Column) -> Column:
    return unit_clamp((7 - offers) / 5)


def rarity(low_frequency: Column, position: Column, observations: Column, minimum: int = 6) -> Column:
    known = (observations >= minimum) & low_frequency.isNotNull()
    return F.when(known, unit_clamp((1.0 - low_frequency) * position)).otherwise(F.lit(0.0))


def commercial_signal(
    price: Column, previous_min: Column, historical_min: Column, observations: Column,
    low_frequency: Column, rarity_value: Column, saving_pct: Column,
    minimum_observations: int = 6, rare_frequency: float = 0.15, near_pct: float = 0.03,
) -> dict[str, Column]:
    """Strongest signal of a price: event, gap to the previous floor, reason."""
    new_min = (previous_min != 0) & (price > 0) & (price < previous_min)
    rare = (
        (observations >= max(1, minimum_observations)) & (low_frequency <= rare_frequency) & (rarity_value >= 0.70)
    )
    known = (historical_min != 0) & (price > 0)
    distance = (price - historical_min) / historical_min
    tests = (new_min, rare, known & (price <= historical_min), known & (distance > 0) & (distance <= near_pct), saving_pct >= 0.15)
    event = F
    for test, name in zip(tests, SIGNALS):
        event = event.when(test, name)
    gap = previous_min - price
    share = gap / previous_min

    def percent(c: Column, digits: int = 1) -> Column:
        return F.concat(fixed_text(c * 100, digits), F.lit("%"))

    # The wording of a reason.
    reason = (
        F.when(tests[0], F.concat(
            F.lit("nuevo mínimo histórico: "), format_money(price), F.lit(" queda "), format_money(gap), F.lit(" ("),
            F.replace(percent(share), F.lit(","), F.lit(".")), F.lit(") bajo el mínimo anterior de "), format_money(previous_min)))
        .when(tests[1], F.concat(
            F.lit("oferta poco frecuente: sólo "), percent(low_frequency, 0), F.lit(" de "), observations.cast("string"),
            F.lit(" observaciones de 90 días estuvieron en la zona del mínimo (hasta 5% sobre el piso)")))
        .when(tests[2], F.concat(F.lit("precio actual iguala el mínimo histórico de "), format_money(historical_min)))
        .when(tests[3], F.concat(F.lit("precio a "), percent(distance), F.lit(" del mínimo histórico de "), format_money(historical_min)))
        .when(tests[4], F.concat(F.lit("líder de mercado con "), percent(saving_pct), F.lit(" de ventaja frente al segundo precio")))
        .otherwise("sin señal comercial excepcional")
    )
    return {
        "price_event": event.otherwise("NORMAL"),
        "historical_gap": F.when(tests[0], gap).otherwise(0).cast("bigint"),
        "historical_gap_pct": F.when(tests[0], share).otherwise(0.0),
        "intelligence_reason": reason,
    }
