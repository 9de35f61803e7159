"""Money: currencies, pay periods and amounts written in many number styles, as native columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
ANNUAL_FACTORS = {"hourly": 2080, "daily": 260, "weekly": 52, "monthly": 12, "yearly": 1}

#: Spellings of pay periods, compared in lower case without surrounding blanks.
PERIOD_SPELLINGS = {
    "hourly": ["hourly", "hour", "hours", "hr", "hrs", "h", "/hr", "/h", "/hour", "per hour", "an hour", "pro stunde",
               "stunde", "stündlich", "par heure", "heure", "por hora", "hora", "hourly rate", "p.h.", "ph"],
    "daily": ["daily", "day", "days", "d", "/day", "/d", "per day", "a day", "daily rate", "pro tag", "tag", "täglich",
              "par jour", "jour", "por día", "día", "per diem", "p.d."],
    "weekly": ["weekly", "week", "weeks", "wk", "w", "/wk", "/week", "per week", "a week", "pro woche", "woche",
               "wöchentlich", "par semaine", "semaine", "por semana", "semana", "p.w.", "pw"],
    "monthly": ["monthly", "month", "months", "mo", "mth", "/mo", "/month", "per month", "a month", "monat", "pro monat",
                "monatlich", "par mois", "mois", "al mes", "por mes", "mes", "p.m.", "pm", "pcm"],
    "yearly": ["yearly", "year", "years", "yr", "/yr", "/year", "per year", "a year", "annual", "annually", "annum",
               "per annum", "p.a.", "pa", "pro jahr", "jahr", "jährlich", "par an", "an", "annuel", "por año", "al año",
               "año", "anual"],
}

#: Spellings of currencies, compared in lower case without surrounding blanks; a bare $ is USD.
CURRENCY_SPELLINGS = {
    "USD": ["usd", "us$", "$", "us dollar", "us dollars", "dollar", "dollars", "u.s. dollar", "u.s. dollars", "usd$"],
    "EUR": ["eur", "€", "euro", "euros"],
    "GBP": ["gbp", "£", "pound", "pounds", "pound sterling", "pounds sterling", "sterling"],
    "CAD": ["cad", "c$", "ca$", "cad$", "canadian dollar", "canadian dollars"],
    "AUD": ["aud", "a$", "au$", "aud$", "australian dollar", "australian dollars"],
    "CHF": ["chf", "sfr", "sfr.", "fr.", "swiss franc", "swiss francs"],
    "INR": ["inr", "₹", "rs", "rs.", "rupee", "rupees", "indian rupee", "indian rupees"],
    "BDT": ["bdt", "৳", "tk", "tk.", "taka"],
}


def _lookup(table: dict[str, list[str]]) -> Column:
    pairs = {spelling: name for name, spellings in table.items() for spelling in spellings}
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def _tidy(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, r"[\s\u00a0]+", " ")))


def period_name(text: Column) -> Column:
    """One of hourly, daily, weekly, monthly and yearly; null if unknown."""
    return F.try_element_at(_lookup(PERIOD_SPELLINGS), _tidy(text))


def currency_code(text: Column) -> Column:
    """A code of CURRENCY_SPELLINGS; null if unknown."""
    return F.try_element_at(_lookup(CURRENCY_SPELLINGS), _tidy(text))


def annual_factor(period: Column) -> Column:
    return F.try_element_at(
        F.create_map(*[F.lit(x) for x in chain.from_iterable(ANNUAL_FACTORS.items())]), period
    )


#: A number with separators of any style; spaces only between groups of three digits.
NUMBER = r"\d{1,3}(?:[ \u00a0\u202f'’]\d{3})+(?:[.,]\d{1,2})?(?![\d])|\d+(?:[.,]\d+)*"

_SCALE = r"(?:[ \u00a0]?(k|m|mio|thousand|lakhs?|lacs?|crores?|cr)(?![\p{L}]))?"


def parse_number(text: Column) -> Column:
    """DECIMAL(24,6) of a number in any style; null if there is none.

    With both separators the last one is decimal.  A single kind is a thousands separator if it
    occurs more than once or has exactly three digits behind it.
    """
    bare = F.regexp_replace(text, r"[ \u00a0\u202f'’]", "")
    return (
        F.when(bare.rlike(r"\.[\d.]*,\d*$"), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(bare.rlike(r",[\d,]*\.\d*$"), F.replace(bare, F.lit(","), F.lit("")))
        .when(bare.rlike(r"[.,]\d{3}$|[.,]\d+[.,]"), F.regexp_replace(bare, "[.,]", ""))
        .otherwise(F.replace(bare, F.lit(","), F.lit(".")))
        .try_cast("decimal(24,6)")
    )


def scale_of(word: Column) -> Column:
    low = F.lower(word)
    return (
        F.when(low.isin("k", "thousand"), F.lit(1_000))
        .when(low.isin("m", "mio"), F.lit(1_000_000))
        .when(low.rlike("^la[kc]"), F.lit(100_000))
        .when(low.rlike("^cr"), F.lit(10_000_000))
        .cast("decimal(10,0)")
    )


#: Patterns of what a statement about pay names, tried in this order; Java syntax, any case.
STATED_CURRENCY = {
    "CHF": r"\bCHF\b|\bSfr\b",
    "CAD": r"C\$|CA\$|\bCAD\b|canadian dollar",
    "AUD": r"(?<!\p{L})A\$|AU\$|\bAUD\b|australian dollar",
    "INR": r"₹|\bINR\b|\bRs\b|\brupees?\b",
    "BDT": r"৳|\bBDT\b|\bTk\b|\btaka\b",
    "EUR": r"€|\bEUR\b|\beuros?\b",
    "GBP": r"£|\bGBP\b|\bpounds?\b|\bpence\b|\bsterling\b",
    "USD": r"\$|\bUSD\b|\bdollars?\b",
}
STATED_PERIOD = {
    "hourly": r"\bhourly\b|(\bper|\ban|/|\bpro|\bpar|\bpor) ?(hour|hr|h|stunde|heure|hora)\b",
    "daily": r"\bdaily\b|\bper diem\b|(\bper|\ba|/|\bpro|\bpar|\bpor) ?(day|tag|jour|día)\b",
    "weekly": r"\bweekly\b|(\bper|\ba|/|\bpro|\bpar|\bpor) ?(week|wk|woche|semaine|semana)\b",
    "monthly": r"\bmonthly\b|\bmonatlich\b|(\bper|\ba|/|\bpro|\bpar|\bpor|\bal|\bim) ?(month|mo|mth|monat|mois|mes)\b|(?<![\p{L}.])p\.m\.",
    "yearly": r"\byearly\b|\bannual(ly)?\b|\bannum\b|\bjährlich\b|(\bper|\ba|/|\bpro|\bpar|\bpor|\bal|\bim) ?(year|yr|annum|jahr|an|año)\b|(?<![\p{L}.])p\.a\.?(?![\p{L}])",
}
ONLY_HIGH = r"(?iU)(\bup to\b|\bbis zu\b|\bjusqu|\bhasta\b|\bmax(imum)?\b|\bat most\b)[^\d]{0,12}\d"
ONLY_LOW = r"(?iU)(\bfrom\b|\bab\b|\bstarting\b|\bdès\b|\bdesde\b|\bmin(imum)?\b|\bat least\b)[^\d]{0,12}\d"
OPENS_RANGE = r"(?iU)^[^\d]*\b(between|zwischen|entre|de|desde|von)\b[^\d]*\d"
MINOR_UNIT = r"(?iU)\b(cents?|pence|paise)\b"


def _first_named(text: Column, patterns: dict[str, str]) -> Column:
    chosen = F.lit(None).cast("string")
    for name, pattern in reversed(patterns.items()):
        chosen = F.when(text.rlike(f"(?iU){pattern}"), F.lit(name)).otherwise(chosen)
    return chosen


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are each worked out once: a generator keeps the optimizer from copying
    their expressions into every later use."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*df.columns, F.inline(F.array(made)))


def with_statement(df: DataFrame, text: str) -> DataFrame:
    """Adds what the sentence about pay in column ``text`` states: ``said_low``, ``said_high``
    (DECIMAL, whole currency units), ``said_currency`` and ``said_period``; null if not stated.

    "from" and "up to" (and their German, French and Spanish forms) give one bound; one amount
    without such a word is both.  A scale word behind the second amount holds for the first too,
    if that has none.  Cents and pence are a hundredth; pence state GBP.
    """
    amount = rf"({NUMBER}){_SCALE}"
    # signs and words of a range stand anywhere between two amounts; words that also join other things
    # stand close by, unless the statement opens as a range
    span = r"(?:[^\d]*?(?:-|–|—|\bto\b|\bbis\b)[^\d]*?|[^\d]{0,14}?(?:\bà\b|\ba\b|\band\b|\bund\b|\by\b)[^\d]{0,12}?)"
    opened = r"[^\d]*?(?:-|–|—|\bto\b|\bbis\b|\bà\b|\ba\b|\band\b|\bund\b|\by\b|\bet\b)[^\d]*?"
    shape = rf"(?i)^[^\d]*{amount}(?:{span}{amount})?"
    range_shape = rf"(?i)^[^\d]*{amount}(?:{opened}{amount})?"
    t = F.col(text)
    said = lambda k: F.when(t.rlike(OPENS_RANGE), F.regexp_extract(t, range_shape, k)).otherwise(F.regexp_extract(t, shape, k))
    part = lambda k: F.nullif(said(k), F.lit(""))
    out = _step(
        df,
        _a=part(1), _as=scale_of(part(2)), _b=part(3), _bs=scale_of(part(4)),
        said_currency=_first_named(t, STATED_CURRENCY),
        said_period=_first_named(t, STATED_PERIOD),
        _minor=F.when(t.rlike(MINOR_UNIT), F.lit(100)).otherwise(F.lit(1)).cast("decimal(4,0)"),
        _form=F.when(t.rlike(ONLY_HIGH), F.lit("high")).when(t.rlike(ONLY_LOW), F.lit("low")).otherwise(F.lit("")),
    )
    out = _step(out, _n=parse_number(F.col("_a")), _m=parse_number(F.col("_b")))
    one = F.lit(1).cast("decimal(10,0)")
    high = F.col("_m") * F.coalesce("_bs", one)
    shared = F.when(F.col("_n") < high, F.col("_bs"))
    out = _step(out, _low=(F.col("_n") * F.coalesce("_as", shared, one) / F.col("_minor")).cast("decimal(30,6)"),
                _high=(high / F.col("_minor")).cast("decimal(30,6)"))
    both = F.col("_high").isNotNull()
    out = _step(
        out,
        said_low=F.when(both | (F.col("_form") != "high"), F.col("_low")),
        said_high=F.when(both, F.col("_high")).when(F.col("_form") != "low", F.col("_low")),
    )
    return out.drop("_a", "_as", "_b", "_bs", "_minor", "_form", "_n", "_m", "_low", "_high")
