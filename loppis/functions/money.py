"""Prices: currencies, rounding, tolerant parsing and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import round_half_up

#: Kroner for a unit of each currency, for display and for batch ingest.
APPROXIMATE = {"DKK": 1.0, "SEK": 0.65, "NOK": 0.60, "EUR": 7.45, "USD": 7.00, "GBP": 8.80}
BATCH = {"DKK": 1.0, "USD": 7.0, "EUR": 7.46, "SEK": 0.65, "NOK": 0.63}


def rate(currency: Column, rates: dict[str, float], unknown: str = "null") -> Column:
    """Rate of a currency. Unknown ones get null, the dollar's rate ("usd") or 1 ("one")."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), currency)
    if unknown == "null":
        return known
    if unknown in ("usd", "one"):
        return F.coalesce(known, F.lit(rates["USD"] if unknown == "usd" else 1.0))
    raise ValueError(f"unknown must be null, usd or one, not {unknown}")


def to_dkk(amount: Column, currency: Column, rates: dict[str, float] = APPROXIMATE, unknown: str = "null") -> Column:
    """Whole kroner, halves rounded up."""
    return round_half_up(amount * rate(currency, rates, unknown))


def cross_rates(usd: dict[str, Column]) -> dict[str, Column]:
    """Kroner for each currency from units for one dollar."""
    return {c: usd["DKK"] / per_usd for c, per_usd in usd.items()}


def inverted_rates(per_dkk: dict[str, Column]) -> dict[str, Column]:
    """Kroner for each currency from units for one krone."""
    return {c: 1 / x for c, x in per_dkk.items()}


def parse_int(c: Column) -> Column:
    """Leading integer of a text, or null."""
    return F.regexp_extract(c, r"^\s*([-+]?\d+)", 1).try_cast("long")


def parse_float(c: Column) -> Column:
    """Leading number of a text, or null."""
    return F.regexp_extract(c, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double")


def parse_amount(c: Column) -> Column:
    """"6,513 DKK" to 6513, or null."""
    return round_half_up(F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"([\d.]+)", 1).try_cast("double"))


def discount_percent(price: Column, original: Column) -> Column:
    """Whole per cent off, null unless the original is higher."""
    return F.when(original > price, round_half_up((1 - price / original) * 100))


def format_dkk(amount: Column, prefix: str = "", suffix: str = " kr.") -> Column:
    """Danish grouping by points."""
    return F.concat(F.lit(prefix), F.translate(F.format_number(amount, 0), ",", "."), F.lit(suffix))


def page_count(total: Column, size: Column) -> Column:
    return F.ceil(total / size).cast("long")


def clamp(c: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def image_score(tier: Column, hero: Column, image: Column) -> Column:
    """0 to 6: by tier, with a hero image before a plain one."""
    has_hero, has_image = F.coalesce(hero, F.lit("")) != "", F.coalesce(image, F.lit("")) != ""
    return (
        F.when((tier == "legendary") & has_hero, 6)
        .when((tier == "classic") & has_hero, 5)
        .when((tier == "legendary") & has_image, 4)
        .when((tier == "classic") & has_image, 3)
        .when(has_hero, 2)
        .when(has_image, 1)
        .otherwise(0)
    )


def usable_image(url: Column) -> Column:
    """Neither a staff photo nor a thumbnail."""
    return ~(F.contains(url, F.lit("sbpics")) | F.contains(url, F.lit("thumb72x72")))
