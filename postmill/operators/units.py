"""Pay recorded in different periods, currencies and scales, brought to USD per year.

1.  Each bound is read from the columns, or from ``salary_evidence`` where that states it; what
    the evidence states prevails, part by part (amounts, currency, period).
2.  Values of the columns that no evidence backs are checked against the history of their source:
    an exact penalised changepoint search (pruned dynamic programming, squared error around the
    segment mean of log10 values) cuts each history into levels, and a level that lies a known
    factor above or below the source's main level is a unit change, which is reversed.

History is not held row by row: per source and time bucket one partial aggregate (count, sum, sum
of squares) is shuffled, so a source with a third of all rows costs as many rows as it has
buckets.  The search over buckets with these weights is exact for cuts between buckets.

Defined cases: a bound without amount, or a row whose period or currency is unknown, gives no row;
amounts of zero or below, NaN and infinite ones are unknown; a null source or time of export
takes no part in the search and is left as stated.  So are the bounds of a source with fewer than
2 * MIN_ROWS that no evidence backs, and a level of fewer than MIN_ROWS: the mean of so few doesn't
tell a unit from the spread of pay.  Amounts are decimal throughout, so half is
rounded up exactly.  Nothing is ever capped.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.money import ANNUAL_FACTORS, annual_factor, currency_code, period_name, with_statement

#: Scales in which an amount may stand: cents, whole units, thousands, lakh, crore.
SCALES = (0.01, 1, 1_000, 100_000, 10_000_000)
#: Ratios between levels that are a change of unit: scales or periods mistaken for one another.
KNOWN_FACTORS = tuple(
    sorted({round(a / b, 6) for units in (SCALES, ANNUAL_FACTORS.values()) for a in units for b in units if a > b})
)

PENALTY = 12.0  # times the variance and log of the number of buckets
MIN_ROWS = 30  # rows that a level needs before it counts as one
TOLERANCE = 0.06  # of log10 between a level's offset and a known factor
BUCKET_DAYS = 1


def stated_bounds(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(silent, spoken)``: bounds that only the columns state, and bounds of rows with evidence.

    One row for each known bound: ``row_id``, ``bound``, ``amount``, ``period``, ``currency``,
    ``backed`` (by evidence), ``source`` and ``bucket``.
    """
    columns = [
        "row_id",
        F.col("site").alias("source"),
        F.floor(F.unix_date(F.to_date("exported_at")) / BUCKET_DAYS).alias("bucket"),
        period_name(F.col("interval")).alias("period"),
        currency_code(F.col("currency")).alias("currency"),
        _amount(F.col("min_amount")).alias("low"),
        _amount(F.col("max_amount")).alias("high"),
    ]
    silent = rows.where(SILENT).select(
        *columns, *[F.lit(None).cast(t).alias(f"said_{n}") for n, t in _SAID.items()]
    )
    spoken = with_statement(rows.where(f"not ({SILENT})").select(*columns, "salary_evidence"), "salary_evidence")
    return _merged(silent), _merged(spoken.drop("salary_evidence"))


def _merged(rows: DataFrame) -> DataFrame:
    """What the evidence states prevails over the columns, part by part."""
    backed = F.col("said_low").isNotNull() | F.col("said_high").isNotNull()
    merged = rows.select(
        "row_id",
        "source",
        "bucket",
        backed.alias("backed"),
        F.coalesce("said_period", "period").alias("period"),
        F.coalesce("said_currency", "currency").alias("currency"),
        F.when(backed, F.col("said_low")).otherwise(F.col("low")).alias("low"),
        F.when(backed, F.col("said_high")).otherwise(F.col("high")).alias("high"),
    ).where("period is not null and currency is not null")
    pair = F.array(
        F.struct(F.lit("min").alias("bound"), F.col("low").alias("amount")),
        F.struct(F.lit("max").alias("bound"), F.col("high").alias("amount")),
    )
    return merged.select(
        "row_id", "source", "bucket", "backed", "period", "currency", F.inline(pair)
    ).where("amount > 0")


#: Rows without evidence, and what evidence may state.
SILENT = "salary_evidence is null or length(btrim(salary_evidence)) = 0"
_SAID = {"low": "decimal(30,6)", "high": "decimal(30,6)", "currency": "string", "period": "string"}


def _amount(value: Column) -> Column:
    sound = ~F.isnan(value) & (F.abs(value) < 1e20)
    return F.when(sound, value.cast("string").try_cast("decimal(30,6)"))


def in_usd_per_year(bounds: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds ``usd`` (DECIMAL); bounds in a currency without a rate are dropped."""
    known = rates.where("currency is not null and usd_per_unit > 0").groupBy("currency").agg(
        F.max(F.col("usd_per_unit").cast("string").cast("decimal(18,9)")).alias("rate")
    )
    # a row per currency of the world at most
    joined = bounds.join(F.broadcast(known), "currency")
    per_year = F.col("amount").cast("decimal(24,6)") * annual_factor(F.col("period")).cast("decimal(4,0)")
    return joined.withColumn("usd", per_year.cast("decimal(26,6)") * F.col("rate").cast("decimal(12,6)"))


def best_cuts(count: list[float], total: list[float], square: list[float], penalty: float) -> list[int]:
    """Ends of the segments of the cheapest split of weighted buckets; exact, with pruning.

    The cost of a segment is the squared error around its mean, plus ``penalty`` for each segment.
    A start that can't be part of a best split any more is dropped, which leaves the optimum as is.
    """
    n = len(count)
    cn, cs, cq = [0.0], [0.0], [0.0]
    for a, b, c in zip(count, total, square):
        cn.append(cn[-1] + a)
        cs.append(cs[-1] + b)
        cq.append(cq[-1] + c)

    def cost(i: int, j: int) -> float:
        w = cn[j] - cn[i]
        return max(0.0, cq[j] - cq[i] - (cs[j] - cs[i]) ** 2 / w) if w else 0.0

    best, last, live = [-penalty] + [math.inf] * n, [0] * (n + 1), [0]
    for j in range(1, n + 1):
        options = [(best[i] + cost(i, j) + penalty, i) for i in live]
        best[j], last[j] = min(options)
        live = [i for value, i in options if value - penalty <= best[j]] + [j]
    ends, j = [], n
    while j:
        ends.append(j)
        j = last[j]
    return ends[::-1]


def known_factor(shift: float) -> float:
    """The factor by which a level is off, given its offset in log10; 1 if it's no known one.  The
    nearest one counts: 4.33 and 5 are closer to each other than twice the tolerance."""
    distance, factor = min((abs(abs(shift) - math.log10(f)), f) for f in KNOWN_FACTORS)
    if distance > TOLERANCE:
        return 1.0
    return factor if shift > 0 else 1 / factor


def shifted_levels(history: pd.DataFrame) -> pd.DataFrame:
    """Buckets of one source whose level is off by a known factor, with that factor."""
    h = history.sort_values("bucket")
    n, s, q = (h[c].astype(float).tolist() for c in ("n", "s", "q"))
    out = {"source": [], "bucket": [], "factor": []}
    rows = sum(n)
    if rows >= 2 * MIN_ROWS and len(n) > 1:
        within = sum(max(0.0, c - b * b / a) for a, b, c in zip(n, s, q))
        variance = max(within / max(1.0, rows - len(n)), 1e-4)
        ends = best_cuts(n, s, q, PENALTY * variance * math.log(len(n) + 1))
        levels, start = [], 0
        for end in ends:
            w = sum(n[start:end])
            levels.append((start, end, w, sum(s[start:end]) / w))
            start = end
        main = max(levels, key=lambda x: x[2])[3]
        for start, end, w, mean in levels:
            factor = known_factor(mean - main)
            if factor != 1.0 and w >= MIN_ROWS:
                for k in range(start, end):
                    out["source"].append(h["source"].iloc[k])
                    out["bucket"].append(int(h["bucket"].iloc[k]))
                    out["factor"].append(factor)
    return pd.DataFrame(out).astype({"source": "object", "bucket": "int64", "factor": "float64"})


def unit_changes(bounds: DataFrame) -> DataFrame:
    """``source, bucket, factor`` where a source's level is off; ``bounds`` has ``usd``."""
    value = F.log10(F.col("usd").cast("double"))
    history = (
        bounds.where("not backed and source is not null and bucket is not null and usd > 0")
        .select("source", "bucket", value.alias("v"))
        .groupBy("source", "bucket")
        .agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    )
    return history.groupBy("source").applyInPandas(
        shifted_levels, "source string, bucket long, factor double"
    )


def common_units(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """``row_id, bound, usd_per_year, factor``: each known bound in whole USD per year, half
    rounded up; ``factor`` is the unit change that was reversed, 1 for none."""
    silent, spoken = (in_usd_per_year(part, rates) for part in stated_bounds(rows))
    # evidence may leave the amounts to the columns: such bounds are part of the history, and are checked as well
    unbacked = silent.unionByName(spoken.where("not backed"))
    fixed = unbacked.join(unit_changes(unbacked), ["source", "bucket"], "left")
    checked = fixed.withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    every = checked.unionByName(spoken.where("backed").withColumn("factor", F.lit(1.0)))
    usd = F.when(F.col("factor") == 1.0, F.round("usd", 0).cast("bigint")).otherwise(
        F.floor(F.col("usd").cast("double") / F.col("factor") + 0.5)
    )
    return every.select("row_id", "bound", usd.alias("usd_per_year"), "factor")
