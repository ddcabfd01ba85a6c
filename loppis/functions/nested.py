"""Arrays, maps and JSON objects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once: an expression used inside a lambda is otherwise computed for each
    element."""
    return F.transform(F.array(value), f)[0]


def merged(base: Column, patch: Column) -> Column:
    """Shallow merge of two maps; the patch wins."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(patch, k)), patch)


def shown_specs(specs: Column) -> Column:
    """Map entries with a value, without keys that start with an underscore."""
    return F.map_filter(specs, lambda k, v: v.isNotNull() & ~F.startswith(k, F.lit("_")))


#: Codes of countries that locations end with.
COUNTRIES = {
    "Germany": "DE", "Netherlands": "NL", "Italy": "IT", "Spain": "ES", "United States": "US", "United Kingdom": "GB",
    "France": "FR", "Denmark": "DK", "Sweden": "SE", "Norway": "NO", "Japan": "JP", "Australia": "AU", "Canada": "CA",
    "Belgium": "BE", "Austria": "AT", "Poland": "PL", "Portugal": "PT", "Finland": "FI", "Switzerland": "CH",
    "Czech Republic": "CZ", "Hungary": "HU", "Greece": "GR",
}


def country_code(location: Column) -> Column:
    """Code of the country after the last ", ", or null."""
    codes = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])
    return F.when(F.contains(location, F.lit(", ")), F.try_element_at(codes, F.substring_index(location, ", ", -1)))


def location_shown(source: Column, location: Column) -> Column:
    """What a listing card shows of a location: country of foreign listings, nothing of shops and placeholders."""
    home = {"dba.dk": "DK", "kleinanzeigen": "DE", "blocket": "SE", "finn": "NO"}
    shown = F.coalesce(F.concat_ws(" ", country_code(location), F.substring_index(location, ", ", -1)), location)
    shown = F.when(country_code(location).isNull(), location).otherwise(shown)
    chain = F.when(source == "thomann", F.lit(None).cast("string"))
    for name, code in home.items():
        chain = chain.when(source == name, code)
    return chain.when((source == "reverb") & location.isin("International", "Local", ""), F.lit(None).cast("string")).when(source == "reverb", shown).otherwise(location)
