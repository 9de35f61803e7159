"""Queries of the general training-data operators, with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmill.functions.money import CURRENCY_SPELLINGS, PERIOD_SPELLINGS
from postmill.operators import delivery, units
from postmill.session import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = units.common_units(table(spark, folder, "job_rows"), table(spark, folder, "currency_rates"))
    return rows.select("row_id", "bound", "usd_per_year").distinct()


def p2_unit_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The changes of unit in the sources' histories that p2_found reverses."""
    silent, spoken = units.stated_bounds(table(spark, folder, "job_rows"))
    return units.unit_changes(units.in_usd_per_year(silent.unionByName(spoken), table(spark, folder, "currency_rates")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.surplus_ids(table(spark, folder, "job_log"))


def p4_exactly_once(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.exactly_once(table(spark, folder, "job_log"))


QUERIES = {
    "p2_found": p2_found,
    "p2_unit_changes": p2_unit_changes,
    "p4_found": p4_found,
    "p4_exactly_once": p4_exactly_once,
}

_NUMBER = "[0-9]+(?:[.,\u00a0\u202f][0-9]+)*"
_SCALE = "(?:[ \u00a0]?(k|m|lakhs?|lacs?|crores?|cr)\\b)?"


def _first_match(text: str, forms: dict[str, str]) -> str:
    return "case " + " ".join(f"when regexp_matches({text}, '{p}', 'i') then '{n}'" for n, p in forms.items()) + " end"


def _spelled(text: str, table: dict[str, list[str]]) -> str:
    plain = f"lower(trim(regexp_replace({text}, '[\\s\u00a0]+', ' ', 'g')))"
    return "case " + " ".join("when {} in ({}) then '{}'".format(plain, ", ".join(f"'{w}'" for w in words), n) for n, words in table.items()) + " end"


def _amount(text: str) -> str:
    bare = f"regexp_replace({text}, '[ \u00a0\u202f]', '', 'g')"
    plain = (
        f"case when regexp_matches({bare}, '\\.[0-9.]*,[0-9]*$') then replace(replace({bare}, '.', ''), ',', '.') "
        f"when regexp_matches({bare}, ',[0-9,]*\\.[0-9]*$') then replace({bare}, ',', '') "
        f"when regexp_matches({bare}, '[.,][0-9]{{3}}$|[.,][0-9]+[.,]') then regexp_replace({bare}, '[.,]', '', 'g') else replace({bare}, ',', '.') end"
    )
    return f"try_cast(nullif({plain}, '') as decimal(20, 4))"


def _scale(word: str) -> str:
    return f"case when {word} = '' then null when {word} ilike 'k' then 1000 when {word} ilike 'm' then 1000000 when {word} ilike 'la%' then 100000 else 10000000 end"


_CURRENCIES = {
    "CHF": "\\bCHF\\b", "CAD": "C\\$|CA\\$|\\bCAD\\b", "AUD": "A\\$|AU\\$|\\bAUD\\b", "INR": "₹|\\bINR\\b|\\bRs\\b", "BDT": "৳|\\bBDT\\b|\\bTk\\b", "EUR": "€|\\bEUR\\b",
    "GBP": "£|\\bGBP\\b|\\bpence\\b", "USD": "\\$|\\bUSD\\b",
}
_PERIODS = {
    "hourly": "\\bhourly\\b|(\\bper|\\ban|/) ?(hour|hr)\\b", "daily": "\\bdaily\\b|(\\bper|\\ba|/) ?day\\b", "weekly": "\\bweekly\\b|(\\bper|\\ba|/) ?(week|wk)\\b",
    "monthly": "\\bmonthly\\b|(\\bper|\\ba|/) ?(month|mo)\\b", "yearly": "\\byearly\\b|\\bannum\\b|\\bp\\.a\\.|(\\bper|\\ba|/) ?year\\b",
}

#: States the result for data without shifted stretches, which the test data are.
_PAY = f"""
    with e as (select *, coalesce(salary_evidence, '') as ev from job_rows),
    p as (select *,
        regexp_extract(ev, '^[^0-9]*({_NUMBER}){_SCALE}', 1, 'i') as a, regexp_extract(ev, '^[^0-9]*({_NUMBER}){_SCALE}', 2, 'i') as sa,
        regexp_extract(ev, '^[^0-9]*{_NUMBER}[^0-9]*?(?:-|–|\\bto\\b)[^0-9]*?({_NUMBER}){_SCALE}', 1, 'i') as b,
        regexp_extract(ev, '^[^0-9]*{_NUMBER}[^0-9]*?(?:-|–|\\bto\\b)[^0-9]*?({_NUMBER}){_SCALE}', 2, 'i') as sb,
        {_first_match("ev", _CURRENCIES)} as ec, {_first_match("ev", _PERIODS)} as ep from e),
    n as (select *, {_amount("a")} as na, {_amount("b")} as nb, {_scale("sa")} as ka, {_scale("sb")} as kb,
        case when regexp_matches(ev, '\\b(cents?|pence)\\b', 'i') then 100 else 1 end as minor from p),
    v as (select row_id, site, coalesce(ec, {_spelled("currency", CURRENCY_SPELLINGS)}) as cur, coalesce(ep, {_spelled('"interval"', PERIOD_SPELLINGS)}) as per,
        case when na is not null then case when nb is null and ev ilike '%up to%' then null else na * coalesce(ka, case when na < nb * coalesce(kb, 1) then kb end, 1) / minor end
            else cast(min_amount as decimal(20, 4)) end as low,
        case when na is not null then case when nb is not null then nb * coalesce(kb, 1) / minor when ev ilike '%from%' then null else na * coalesce(ka, 1) / minor end
            else cast(max_amount as decimal(20, 4)) end as high from n),
    w as (select row_id, 'min' as bound, low as amount, cur, per from v union all select row_id, 'max', high, cur, per from v)
    select row_id, bound, cast(floor(round(amount * case per when 'hourly' then 2080 when 'daily' then 260 when 'weekly' then 52 when 'monthly' then 12 else 1 end * usd_per_unit, 6) + 0.5) as bigint) as usd_per_year
    from w join currency_rates r on r.currency = w.cur where per is not null and amount > 0
"""

_RANKED = """
    select *, row_number() over (
        partition by lower(trim(job_key)), sequence, date_trunc('milliseconds', emitted_at)
        order by received_at nulls last, log_id) as copy_number
    from job_log
"""

ORACLES = {
    "p2_found": _PAY,
    "p4_found": f"select log_id from ({_RANKED}) where copy_number > 1",
    "p4_exactly_once": f"select * exclude (copy_number) from ({_RANKED}) where copy_number = 1",
}
