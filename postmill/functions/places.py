"""Places of listings: names of countries, what is shown, and how the sources write places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.vocabulary import BOARD_DOMAIN, COUNTRY_CURRENCY, COUNTRY_OF, COUNTRY_SHOWN, REVIEW_HOST, lookup


def country_named(text: Column) -> Column:
    """The name of the country that a spelling stands for; null if unknown."""
    return lookup(COUNTRY_OF, F.lower(F.trim(text)))


def currency_hint(country: Column) -> Column:
    return lookup(COUNTRY_CURRENCY, country)


def review_host(country: Column) -> Column:
    return lookup(REVIEW_HOST, country)


def board_domain(country: Column) -> Column:
    return lookup({k: v[0] for k, v in BOARD_DOMAIN.items()}, country)


def board_country_code(country: Column) -> Column:
    return lookup({k: v[1] for k, v in BOARD_DOMAIN.items()}, country)


def place(city: Column, state: Column, country: Column) -> Column:
    """STRUCT<country, city, state>; a known country has its name in capitals, other text stays."""
    return F.struct(country.cast("string").alias("country"), city.cast("string").alias("city"), state.cast("string").alias("state"))


def shown(location: Column) -> Column:
    """City, state and country joined by commas.  A country is shown by its usual name, worldwide
    and the like not at all, free text as it is; a country that repeats another part is left out."""
    city, state, country = location["city"], location["state"], location["country"]
    silent = country.isin("US_CANADA", "WORLDWIDE")
    name = F.when(silent, F.lit(None)).otherwise(F.coalesce(lookup(COUNTRY_SHOWN, country), country))
    repeats = F.coalesce(name == city, F.lit(False)) | F.coalesce(name == state, F.lit(False))
    parts = F.array(F.nullif(city, F.lit("")), F.nullif(state, F.lit("")), F.when(~repeats, F.nullif(name, F.lit(""))))
    return F.when(location.isNotNull(), F.array_join(F.array_compact(parts), ", "))


def _parts(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def _at(parts: Column, k: int) -> Column:
    return F.try_element_at(parts, F.lit(k))


def _is_region_code(text: Column) -> Column:
    return (F.length(text) <= 3) & (F.upper(text) == text)


def by_comma_blank(text: Column, country: Column) -> Column:
    """City up to the first ", ", the rest as state; nothing for empty text and "Remote"."""
    city = F.regexp_extract(text, r"(?s)^(.*?)(?:, |$)", 1)
    state = F.nullif(F.regexp_extract(text, r"(?s)^.*?, (.*)$", 1), F.lit(""))
    return F.when((F.length(text) > 0) & (text != "Remote"), place(city, state, country))


def region_or_country(text: Column, default_country: Column) -> Column:
    """Two parts: a short one in capitals is a region of the default country, else a country;
    three or more: city, state, country; one: a city anywhere; none: the default country."""
    parts = F.split(F.trim(text), ", ")
    two = place(
        _at(parts, 1),
        F.when(_is_region_code(_at(parts, 2)), _at(parts, 2)),
        F.when(_is_region_code(_at(parts, 2)), default_country).otherwise(_at(parts, 2)),
    )
    three = place(_at(parts, 1), _at(parts, 2), F.coalesce(country_named(_at(parts, 3)), _at(parts, 3)))
    return (
        F.when(text.isNull() | (text == "N/A"), place(F.lit(None), F.lit(None), default_country))
        .when(F.size(parts) == 2, two)
        .when(F.size(parts) >= 3, three)
        .otherwise(place(_at(parts, 1), F.lit(None), F.lit("WORLDWIDE")))
    )


def region_or_rest(text: Column) -> Column:
    """City first; the second of two parts is a region if short and in capitals, else a country;
    of more parts the second is the state and what follows the country."""
    parts = _parts(text)
    many = F.size(parts) > 2
    region = (F.size(parts) == 2) & _is_region_code(_at(parts, 2))
    return F.when(
        F.length(F.trim(text)) > 0,
        place(
            _at(parts, 1),
            F.when(many | region, _at(parts, 2)),
            F.when(many, F.array_join(F.slice(parts, 3, 100), ", ")).when((F.size(parts) == 2) & ~region, _at(parts, 2)),
        ),
    )


def city_then_state(text: Column, country: Column) -> Column:
    """City first, all other parts as state."""
    parts = _parts(text)
    return place(_at(parts, 1), F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, 100), ", ")), country)


def country_last(text: Column) -> Column:
    """City, middle parts as state, country last; one part is a city anywhere."""
    parts = _parts(text)
    n = F.size(parts)
    return F.when(
        n > 0,
        place(
            _at(parts, 1),
            F.when(n > 2, F.array_join(F.slice(parts, F.lit(2), n - 2), ", ")),
            F.when(n > 1, F.element_at(parts, -1)).otherwise(F.lit("WORLDWIDE")),
        ),
    )


def without_country(text: Column, country: str = "BANGLADESH", spelled: str = "bangladesh") -> Column:
    """City first, then the state; the country at the end is left out of the state."""
    parts = _parts(text)
    n = F.size(parts)
    ends = F.lower(F.element_at(parts, -1)) == spelled
    rest = F.slice(parts, F.lit(2), F.greatest(F.lit(0), n - F.when(ends, 2).otherwise(1)))
    return F.when(n > 0, place(_at(parts, 1), F.when(n > 1, F.nullif(F.array_join(rest, ", "), F.lit(""))), F.lit(country)))
