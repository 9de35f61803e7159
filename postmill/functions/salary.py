"""Pay ranges in free text, and pay as the sources state it.

A text is cut into sentences, and a sentence into tokens: numbers, currency marks, dashes and joining
words, periods of pay, words about pay, words about other money.  Everything is decided on that
list: a range is a run of tokens of the right kinds, its period is the nearest one in the sentence,
and words that rule it out are looked up in the same list.  The first sound range of the text counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.money import ANNUAL_FACTORS
from postmill.vocabulary import lookup

# Words about pay, and words that tell of other money, alone or as two in a row.
PAY_WORDS = frozenset(
    "salary pay wage wages compensation remuneration salario sueldo salari salaire rémunération gehalt vergütung "
    "verguetung lohn salário stipendio retribuzione".split()
)
OTHER_MONEY = frozenset("bonus commission equity stock signing relocation budget cost costs revenue turnover".split())
OTHER_MONEY_PAIRS = frozenset([("sign", "on"), ("contract", "value"), ("project", "value"), ("deal", "value")])

# Units of time behind a linking word or sign, and words that name a period by themselves.
LINKED_UNITS = {
    "/": {"hourly": "h hr hour hora heure", "daily": "day día dia jour", "weekly": "wk week semana semaine", "monthly": "mo month mes mois", "yearly": "yr year año ano jahr"},
    "per": {"hourly": "hour hora heure", "daily": "day día dia", "weekly": "week semana", "monthly": "month", "yearly": "year annum"},
    "a": {"hourly": "hour hora heure", "daily": "day día dia", "weekly": "week semana", "yearly": "year l'any"},
    "an": {"hourly": "hour hora heure"},
    "por": {"hourly": "hour hora heure", "daily": "day día dia", "weekly": "week semana", "monthly": "mes mês", "yearly": "año ano"},
    "par": {"hourly": "hour hora heure", "daily": "jour", "weekly": "semaine", "monthly": "mois", "yearly": "an"},
    "pro": {"hourly": "stunde", "daily": "tag", "weekly": "woche", "monthly": "monat", "yearly": "jahr"},
    "al": {"monthly": "mes", "yearly": "año"},
}
PERIOD_WORDS = {
    "hourly": "hourly horaire stündlich all'ora",
    "daily": "daily diario diaria quotidien täglich",
    "weekly": "weekly semanal hebdomadaire wöchentlich",
    "monthly": "monthly mensual mensal mensuel monatlich",
    "yearly": "yearly annual annually anual annuel annuelle jährlich annuo annua all'anno",
}
JOINING_WORDS = frozenset("to bis à a até".split())
CURRENCY_MARKS = {
    "US$": "USD", "USD": "USD", "CA$": "CAD", "C$": "CAD", "CAD": "CAD", "AU$": "AUD", "A$": "AUD", "AUD": "AUD",
    "NZ$": "NZD", "NZD": "NZD", "EUR": "EUR", "€": "EUR", "GBP": "GBP", "£": "GBP", "INR": "INR", "₹": "INR",
    "BDT": "BDT", "৳": "BDT", "CHF": "CHF",
}
DOLLARS = frozenset(("USD", "CAD", "AUD", "NZD"))
BLOCK_TAGS = "br p div li h1 h2 h3 h4 h5 h6 td th tr section article".split()

# Least and largest amounts that are taken for pay.
LARGEST = {"hourly": 10_000, "daily": 100_000, "weekly": 500_000, "monthly": 5_000_000, "yearly": 100_000_000}
_MAJOR = {"hourly": 1, "daily": 10, "weekly": 25, "monthly": 100, "yearly": 1_000}
LEAST = {c: _MAJOR for c in ("USD", "EUR", "GBP", "CAD", "AUD", "NZD", "CHF")} | {
    "INR": {"hourly": 40, "daily": 300, "weekly": 1_500, "monthly": 5_000, "yearly": 60_000},
    "BDT": {"hourly": 20, "daily": 150, "weekly": 750, "monthly": 3_000, "yearly": 36_000},
}
WIDEST = 20  # of the upper to the lower amount
REACH = 32  # characters between a range and its period
CONTEXT = 240  # characters of a sentence on either side that count
EVIDENCE = 160

_UNIT_OF = {(link, unit): name for link, units in LINKED_UNITS.items() for name, words in units.items() for unit in words.split()}
_PERIOD_OF = {word: name for name, words in PERIOD_WORDS.items() for word in words.split()}
_SCALE = {"": 1, "k": 1_000, "m": 1_000_000}

_SENTENCE_END = re.compile(rf"[\r\n  ]+|</?(?:{'|'.join(BLOCK_TAGS)})\b[^>]*>|[.!?;](?=\s|$)", re.I)
_CODES = "|".join(re.escape(m) for m in sorted(CURRENCY_MARKS, key=len, reverse=True) if m[0].isalpha())
_SIGNS = "|".join(re.escape(m) for m in [*CURRENCY_MARKS, "$"] if not m[0].isalpha())
_TOKENS = re.compile(
    rf"""(?P<mark>(?<![^\W\d_])(?:{_CODES})(?![^\W\d_])|{_SIGNS})
    | (?P<number>\d+(?:[.,]\d+|[   ]\d{{3}}(?!\d))*)(?:(?P<scale>[km])(?!\w))?
    | (?P<year>\bp\.?\s?a\b\.?)
    | (?P<word>[^\W\d_]+(?:['’][^\W\d_]+)?)
    | (?P<dash>[-–—])
    | (?P<other>\S)""",
    re.I | re.X,
)

RESULT = T.StructType(
    [
        T.StructField("interval", T.StringType()),
        T.StructField("min_amount", T.DoubleType()),
        T.StructField("max_amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("evidence", T.StringType()),
    ]
)


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    scale: str = ""


def sentences(text: str) -> Iterator[str]:
    at = 0
    for cut in _SENTENCE_END.finditer(text):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def tokens_of(sentence: str) -> list[Token]:
    """Tokens with their kinds; a linking word or sign and the unit behind it make one period."""
    out: list[Token] = []
    for m in _TOKENS.finditer(sentence):
        kind, value = m.lastgroup, m.group()
        if kind in ("number", "scale"):
            out.append(Token("number", m["number"], m.start(), m.end(), (m["scale"] or "").lower()))
            continue
        if kind == "year":
            out.append(Token("period", "yearly", m.start(), m.end()))
            continue
        low = value.lower().replace("’", "'")
        if kind == "word":
            if low in _PERIOD_OF:
                out.append(Token("period", _PERIOD_OF[low], m.start(), m.end()))
                continue
            if out and (out[-1].text, low) in _UNIT_OF and not sentence[out[-1].end : m.start()].strip():
                link = out.pop()
                out.append(Token("period", _UNIT_OF[link.text, low], link.start, m.end()))
                continue
        out.append(Token(kind, low if kind != "mark" else value.upper(), m.start(), m.end()))
    return out


def number_value(text: str) -> float | None:
    """A number in English, continental or Indian style; None for figures that are grouped otherwise."""
    groups = re.split(r"[.,\s]", text)
    signs = re.findall(r"[.,\s]", text)
    decimals = ""
    if signs and (len(groups[-1]) <= 2 or (len(set(signs)) > 1 and not signs[-1].isspace() and signs.count(signs[-1]) == 1)):
        if signs[-1].isspace():
            return None
        decimals, groups, signs = groups[-1], groups[:-1], signs[:-1]
    if signs:
        sizes = [len(g) for g in groups]
        by_thousands = sizes[0] <= 3 and all(s == 3 for s in sizes[1:])
        by_lakhs = sizes[0] <= 2 and sizes[-1] == 3 and all(s == 2 for s in sizes[1:-1]) and set(signs) == {","}
        if not (by_thousands or by_lakhs):
            return None
    return float("".join(groups) + (f".{decimals}" if decimals else ""))


def amounts(low: Token, high: Token) -> tuple[float, float] | None:
    """Both amounts; a scale letter on one side only holds for the other too."""
    a, b = number_value(low.text), number_value(high.text)
    if a is None or b is None:
        return None
    return a * _SCALE[low.scale or high.scale], b * _SCALE[high.scale or low.scale]


def clear_currency(marks: list[str], hint: str | None) -> str | None:
    """The one currency that the marks name.  A bare dollar is whatever dollar stands beside it, or
    else the one that the hint names."""
    codes = {CURRENCY_MARKS.get(m) for m in marks}  # None stands for a bare dollar
    if codes == {None}:
        wish = (hint or "").strip().upper()
        return wish if wish in DOLLARS else None
    named = codes - {None}
    if len(named) != 1 or (None in codes and not named <= DOLLARS):
        return None
    return named.pop()


@dataclass(slots=True)
class Range:
    low: Token
    high: Token
    marks: list[str]
    start: int
    end: int


def ranges_of(tokens: list[Token], sentence: str) -> Iterator[Range]:
    """Two numbers with a dash or a joining word between them and marks on any side of each."""

    def kind(k: int) -> str:
        return tokens[k].kind if 0 <= k < len(tokens) else ""

    k = 0
    while k < len(tokens):
        begin = k
        marks: list[Token] = []
        numbers: list[Token] = []
        for side in range(2):
            if kind(k) == "mark":
                marks.append(tokens[k])
                k += 1
            if kind(k) != "number":
                break
            numbers.append(tokens[k])
            k += 1
            if kind(k) == "mark" and not (side == 0 and kind(k + 1) == "number"):
                marks.append(tokens[k])
                k += 1
            if side == 0:
                if not (kind(k) == "dash" or (kind(k) == "word" and tokens[k].text in JOINING_WORDS)):
                    break
                k += 1
        if len(numbers) == 2:
            start, end = tokens[begin].start, tokens[k - 1].end
            before, after = sentence[start - 1 : start], sentence[end : end + 1]
            if not re.match(r"[\w.,]", before) and not re.match(r"[\w.,]", after):
                yield Range(*numbers, [m.text for m in marks], start, end)
                continue
        k = begin + 1


def is_sensible(interval: str, low: float, high: float, currency: str) -> bool:
    least = LEAST.get(currency, {}).get(interval)
    return least is not None and least <= low < high <= LARGEST[interval] and high <= WIDEST * low


def period_beside(found: Range, tokens: list[Token]) -> Token | None:
    """The nearest period within reach, if all within reach are of one kind."""

    def gap(t: Token) -> int:
        return found.start - t.end if t.end <= found.start else t.start - found.end

    near = [t for t in tokens if t.kind == "period" and 0 <= gap(t) <= REACH]
    return min(near, key=gap) if len({t.text for t in near}) == 1 else None


def tells_of_pay(tokens: list[Token]) -> bool:
    """Whether there is a word about pay and none about other money."""
    words = [t.text.partition("'")[0] for t in tokens if t.kind == "word"]
    return (
        any(w in PAY_WORDS for w in words)
        and not any(w in OTHER_MONEY for w in words)
        and not any(pair in OTHER_MONEY_PAIRS for pair in zip(words, words[1:]))
    )


def pay_in_text(text: str | None, hint: str | None = None) -> tuple[str, float, float, str, str] | None:
    """``interval, low, high, currency, evidence`` of the first sound pay range; None if there is none."""
    for sentence in sentences(text or ""):
        if not any(c.isdigit() for c in sentence):
            continue
        tokens = tokens_of(sentence)
        for found in ranges_of(tokens, sentence):
            period = period_beside(found, tokens)
            currency = clear_currency(found.marks, hint) if found.marks else None
            values = amounts(found.low, found.high)
            if period is None or currency is None or values is None or not is_sensible(period.text, *values, currency):
                continue
            start, end = min(found.start, period.start), max(found.end, period.end)
            around = [t for t in tokens if start - CONTEXT <= t.start and t.end <= end + CONTEXT]
            if tells_of_pay(around):
                return period.text, *values, currency, " ".join(sentence[start:end].split())[:EVIDENCE]
    return None


def pay_of_phrase(phrase: str | None, least: float = 1_000, most: float = 700_000, by_year: bool = False) -> tuple[str, float, float, str] | None:
    """``interval, low, high, currency`` of a bare statement of pay such as "$20 - $30 an hour", dollars
    being US dollars; None unless both amounts by the year lie between ``least`` and ``most``."""
    got = pay_in_text(f"Salary: {phrase}", "USD")
    if got is None:
        return None
    interval, low, high, currency, _ = got
    factor = ANNUAL_FACTORS[interval]
    if not (least <= low * factor <= most and least <= high * factor <= most):
        return None
    return ("yearly", low * factor, high * factor, currency) if by_year else (interval, low, high, currency)


@F.pandas_udf(RESULT)
def infer_pay(text: pd.Series, hint: pd.Series) -> pd.DataFrame:
    found = [pay_in_text(t, h) for t, h in zip(text, hint)]
    return pd.DataFrame([f or (None,) * 5 for f in found], columns=RESULT.names)


@F.pandas_udf(RESULT)
def infer_phrase(phrase: pd.Series) -> pd.DataFrame:
    found = [pay_of_phrase(p) for p in phrase]
    return pd.DataFrame([(*f, None) if f else (None,) * 5 for f in found], columns=RESULT.names)


def parse_pay(text: Column, hint: Column) -> Column:
    """STRUCT of RESULT; null where no pay is found.  Texts without a word about pay or without a
    figure don't reach the Python workers' scan."""
    worth = text.rlike("(?iU)" + "|".join(sorted(PAY_WORDS))) & text.rlike(r"\d")
    got = infer_pay(F.when(worth, text), hint)
    return F.when(got["interval"].isNotNull(), got)


def annualized(compensation: Column) -> Column:
    """The same pay by the year; yearly, unknown and null pay as it is."""
    factor = lookup({k: str(v) for k, v in ANNUAL_FACTORS.items()}, compensation["interval"]).cast("double")
    return F.when(
        compensation.isNotNull(),
        F.struct(
            F.when(factor.isNotNull(), F.lit("yearly")).otherwise(compensation["interval"]).alias("interval"),
            (compensation["min_amount"] * F.coalesce(factor, F.lit(1.0))).alias("min_amount"),
            (compensation["max_amount"] * F.coalesce(factor, F.lit(1.0))).alias("max_amount"),
            compensation["currency"].alias("currency"),
        ),
    )


def provenance(source: Column, evidence: Column) -> Column:
    """High confidence for direct data, else medium; evidence for what a description states only."""
    return F.when(
        source.isNotNull(),
        F.struct(
            source.alias("source"),
            F.when(source == "direct_data", "high").otherwise("medium").alias("confidence"),
            F.when(source == "description", F.left(evidence, F.lit(EVIDENCE))).alias("evidence"),
        ),
    )


# Pay periods as sources name them.
PERIOD_NAMES = {
    "ANNUAL": "yearly", "YEAR": "yearly", "YEARLY": "yearly", "MONTH": "monthly", "MONTHLY": "monthly", "WEEK": "weekly",
    "WEEKLY": "weekly", "DAY": "daily", "DAILY": "daily", "HOUR": "hourly", "HOURLY": "hourly",
}
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR", "৳": "BDT"}


def period_named(text: Column) -> Column:
    return lookup(PERIOD_NAMES, F.upper(text))


def iso_currency(text: Column) -> Column:
    """Three capital letters; null for anything that isn't a currency."""
    code = F.upper(F.trim(text))
    code = F.coalesce(lookup(SYMBOLS, code), code)
    return F.when(code.rlike(r"^\p{L}{3}$"), code)


def pay(interval: Column, low: Column, high: Column, currency: Column) -> Column:
    """STRUCT<interval, min_amount, max_amount, currency>; null unless the period is known, there is
    an amount, none is negative, they are in order, and the currency is one."""
    code = iso_currency(currency)
    ordered = F.coalesce(low <= high, F.lit(True))
    positive = F.coalesce(low >= 0, F.lit(True)) & F.coalesce(high >= 0, F.lit(True))
    sound = interval.isNotNull() & code.isNotNull() & (low.isNotNull() | high.isNotNull()) & ordered & positive
    made = F.struct(
        interval.alias("interval"), low.cast("double").alias("min_amount"), high.cast("double").alias("max_amount"), code.alias("currency")
    )
    return F.when(sound, made)


def listed_number(text: Column) -> Column:
    """A number with separators of thousands and a decimal sign among its last three characters;
    letters after it are dropped, as is their meaning."""
    kept = F.regexp_replace(text, r"[^-0-9.,]", "")
    tail = F.right(kept, F.lit(3))
    head = F.regexp_replace(F.left(kept, F.length(kept) - 3), r"[.,]", "")
    whole = F.when(F.length(kept) <= 3, kept).otherwise(F.concat(head, tail))
    fixed = F.when(tail.contains("."), whole).when(tail.contains(","), F.replace(whole, F.lit(","), F.lit("."))).otherwise(whole)
    return F.round(fixed.try_cast("double"), 2)


def lakh_range(text: Column) -> tuple[Column, Column]:
    """"a - b Lacs" or "a - b Cr" in whole rupees."""
    form = r"(?i)^\s*(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*(Lacs?|Lakhs?|Cr)"
    scale = F.when(F.lower(F.regexp_extract(text, form, 3)) == "cr", 10_000_000.0).otherwise(100_000.0)
    value = lambda k: F.regexp_extract(text, form, k).try_cast("double") * scale
    return value(1), value(2)


def first_number(text: Column) -> Column:
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def card_pay(text: Column) -> Column:
    """Pay on a listing card: one or two numbers, a symbol, a period; dollars and years by default."""
    parts = F.split(text, r"\s*[-—–]\s*", 2)
    low = F.lower(text)
    interval = (
        F.when(low.rlike("/hr|hour"), "hourly").when(low.rlike("/mo|month"), "monthly").when(low.rlike("/wk|week"), "weekly")
        .when(low.rlike("/day|daily"), "daily").otherwise("yearly")
    )
    currency = F.when(text.contains("$"), "USD").when(text.contains("€"), "EUR").when(text.contains("£"), "GBP").when(text.contains("₹"), "INR").otherwise("USD")
    first, second = listed_number(F.try_element_at(parts, F.lit(1))), listed_number(F.try_element_at(parts, F.lit(2)))
    broken = first.isNull() | ((F.size(parts) > 1) & second.isNull())
    return F.when(text.isNotNull() & ~broken, pay(interval, first, second, currency))
