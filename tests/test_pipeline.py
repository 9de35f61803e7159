import datetime
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from postmill.functions.money import with_statement
from postmill.operators import delivery, units

ROWS = ("row_id bigint, site string, interval string, currency string, min_amount double, max_amount double, salary_evidence string, exported_at timestamp")
RATES = [("USD", 1.0), ("EUR", 1.085), ("GBP", 1.272), ("INR", 0.01195)]


def _usd(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    got = units.common_units(df, spark.createDataFrame(RATES, "currency string, usd_per_unit double"))
    return {(r.row_id, r.bound): r.usd_per_year for r in got.collect()}


def test_statements_about_pay(spark):
    cases = [
        ("Pay: $18.50 to 21.25 / hour", 18.5, 21.25, "USD", "hourly"), ("Rate: 7,22,000 - 7,40,000 INR a year", 722000, 740000, "INR", "yearly"),
        ("Wage: 2,150 – 2,200 cents (USD) /hr", 21.5, 22, "USD", "hourly"), ("Salary: from 2.000 pence an hour", 20, None, "GBP", "hourly"),
        ("Gehalt: €46k bis 50k pro Jahr", 46000, 50000, "EUR", "yearly"), ("Pay: Rs. 10.28 – 10.42 Lacs p.a.", 1028000, 1042000, "INR", "yearly"),
        ("Salary: up to EUR 990 per week", None, 990, "EUR", "weekly"), ("Pay: 17 - 18,75 EUR per hour", 17, 18.75, "EUR", "hourly"),
        ("Wage: 1 750 to 1 850 EUR a month", 1750, 1850, "EUR", "monthly"), ("Pay: C$9,825 – 10,050 /mo", 9825, 10050, "CAD", "monthly"),
        ("Pay band 47 to 66k USD yearly", 47000, 66000, "USD", "yearly"), ("no number", None, None, None, None), (None, None, None, None, None), ("", None, None, None, None),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, t string")
    got = {r.k: r for r in with_statement(df, "t").collect()}
    for k, (_, low, high, currency, period) in enumerate(cases):
        r = got[k]
        number = lambda x: None if x is None else float(x)
        assert (number(r.said_low), number(r.said_high), r.said_currency, r.said_period) == (low, high, currency, period), cases[k]


def test_the_second_amount_may_stand_behind_other_words(spark):
    cases = [
        ("Salary: 40,000 US dollars per year to 50,000 US dollars per year", 40000, 50000, "USD", "yearly"),
        ("Pay: 20 euros gross per hour of work – depending on skill up to 25 euros per hour", 20, 25, "EUR", "hourly"),
        ("Pay: between 40,000 US dollars per year and 50,000 US dollars per year", 40000, 50000, "USD", "yearly"),
        ("Salaire : de 40 000 euros bruts par an à 50 000 euros bruts par an", 40000, 50000, "EUR", "yearly"),
        ("Pay: 40,000 US dollars per year, and in addition 20 days off", 40000, 40000, "USD", "yearly"),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, t string")
    got = {r.k: r for r in with_statement(df, "t").collect()}
    for k, (_, low, high, currency, period) in enumerate(cases):
        assert (float(got[k].said_low), float(got[k].said_high), got[k].said_currency, got[k].said_period) == (low, high, currency, period), cases[k]


def test_evidence_prevails_and_unknown_units_give_nothing(spark):
    at = datetime.datetime(2025, 3, 1)
    got = _usd(spark, [
        (1, "a", "monthly", "EUR", 18000.0, 23000.0, "Salary: EUR 18000 - EUR 23000 yearly", at), (2, "a", " Hourly ", "us$", 20.5, None, None, at),
        (3, "a", None, "USD", 10.0, 20.0, None, at), (4, "a", "yearly", "???", 10.0, 20.0, None, at), (5, None, "yearly", "GBP", 1.5, 2.5, "", None),
        (6, "a", None, None, None, None, "Pay: 10.2 lakh yearly", at), (7, "a", "yearly", "INR", None, None, "Pay: from 2 lakh", at),
        (8, "a", "yearly", "USD", -5.0, float("nan"), None, at), (9, "a", "yearly", "USD", 0.0, float("inf"), None, at),
    ])
    assert got == {(1, "min"): 19530, (1, "max"): 24955, (2, "min"): 42640, (5, "min"): 2, (5, "max"): 3, (7, "min"): 2390}


def test_a_shifted_stretch_of_a_source_is_reversed(spark):
    rnd, rows, n = random.Random(1), [], 0
    for day in range(60):
        for _ in range(20):
            value = rnd.lognormvariate(10.8, 0.4)
            off = 100 if 20 <= day < 35 else 1
            rows.append((n, "s", "yearly", "USD", round(value, 2) * off, None, None, datetime.datetime(2025, 1, 1) + datetime.timedelta(days=day)))
            n += 1
    got = _usd(spark, rows)
    for row_id, *_, amount, _, _, at in ((r[0], *r[1:4], r[4], r[5], r[6], r[7]) for r in rows):
        day = (at - datetime.datetime(2025, 1, 1)).days
        want = int(amount / (100 if 20 <= day < 35 else 1) + 0.5)
        assert abs(got[(row_id, "min")] - want) <= 1


def test_bounds_that_evidence_leaves_to_the_columns_are_part_of_the_history(spark):
    rnd, rows = random.Random(2), []
    for day in range(60):
        for _ in range(20):
            amount = round(rnd.lognormvariate(10.8, 0.4), 2) * (100 if 20 <= day < 35 else 1)
            rows.append((len(rows), "s", "yearly", "USD", amount, None, "Pay as agreed, per year", datetime.datetime(2025, 1, 1) + datetime.timedelta(days=day)))
    got = _usd(spark, rows)
    assert len(got) == len(rows)
    for row_id, _, _, _, amount, _, _, at in rows:
        off = 100 if 20 <= (at - datetime.datetime(2025, 1, 1)).days < 35 else 1
        assert abs(got[(row_id, "min")] - int(amount / off + 0.5)) <= 1


@pytest.mark.parametrize("off", [40, 8, 5, 52 / 12, 260 / 12, 2080 / 12, 1e7, 1e4, 12, 52, 260, 2080, 100, 1e3, 1e5])
def test_all_ratios_of_periods_and_scales_are_known(off):
    for shift in (off, 1 / off):
        assert abs(units.known_factor(math.log10(shift)) / shift - 1) < 1e-6
    history = pd.DataFrame([("s", day, 40, 40 * v, 40 * (v * v + 0.01)) for day in range(30) for v in [4.5 + (math.log10(off) if 10 <= day < 18 else 0)]], columns=["source", "bucket", "n", "s", "q"])
    got = units.shifted_levels(history)
    assert sorted(got["bucket"]) == list(range(10, 18)) and all(abs(f / off - 1) < 1e-6 for f in got["factor"])


def test_levels_of_a_few_rows_are_left_as_stated():
    few = pd.DataFrame([("s", day, 1, v, v * v) for day in range(units.MIN_ROWS * 2 - 1) for v in [4.5 + (2 if day < 29 else 0)]], columns=["source", "bucket", "n", "s", "q"])
    assert units.shifted_levels(few).empty and units.known_factor(0.0) == 1.0 and units.known_factor(0.3) == 1.0


def test_cuts_are_the_best_of_all(spark):
    rnd = random.Random(3)
    for _ in range(20):
        values = [rnd.gauss(5 if k // 4 % 2 else 0, 1) for k in range(rnd.randrange(1, 12))]
        n, s, q = [1.0] * len(values), values, [v * v for v in values]
        penalty = 3.0

        def cost(ends):
            total, start = 0.0, 0
            for end in ends:
                part = values[start:end]
                mean = sum(part) / len(part)
                total += sum((v - mean) ** 2 for v in part) + penalty
                start = end
            return total

        best = min(cost([k for k in range(1, len(values)) if mask >> (k - 1) & 1] + [len(values)]) for mask in range(1 << (len(values) - 1)))
        assert abs(cost(units.best_cuts(n, s, q, penalty)) - best) < 1e-9


def test_empty_tables(spark):
    assert _usd(spark, []) == {}
    empty = spark.createDataFrame([], "log_id bigint, job_key string, sequence bigint, emitted_at timestamp, received_at timestamp")
    assert delivery.surplus_ids(empty).count() == 0 and delivery.exactly_once(empty).count() == 0


def test_one_copy_of_each_message_stays(spark):
    t = datetime.datetime(2025, 1, 1, 12)
    us = lambda k: t + datetime.timedelta(microseconds=k)
    rows = [
        (1, "k1", 1, us(0), us(9_000_000), "x"), (2, " K1 ", 1, us(999), us(8_000_000), "y"), (3, "k1", 1, us(1000), us(1), "z"), (4, "k1", 2, us(0), us(1), None),
        (5, None, 1, us(0), us(1), None), (6, None, 1, us(0), us(1), None), (7, "k2", 1, us(0), None, None), (8, "k2", 1, us(0), us(5), None), (9, "k2", 1, us(0), us(5), None),
    ] + [(100 + i, "hot", 1, us(0), us(i % 7), None) for i in range(500)]
    log = spark.createDataFrame(rows, "log_id bigint, job_key string, sequence bigint, emitted_at timestamp, received_at timestamp, _key string")
    surplus = {r.log_id for r in delivery.surplus_ids(log).collect()}
    assert surplus == {1, 7, 9} | {100 + i for i in range(1, 500)}
    kept = delivery.exactly_once(log)
    assert kept.columns == log.columns and kept.count() == len(rows) - len(surplus)
    assert kept.where(F.col("log_id") == 2).first()._key == "y"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_delivery_is_a_hash_aggregation(spark):
    log = spark.createDataFrame([(1, "k", 1, None, None)], "log_id bigint, job_key string, sequence bigint, emitted_at timestamp, received_at timestamp")
    for df in (delivery.surplus_ids(log), delivery.exactly_once(log)):
        assert "HashAggregate" in _plan(df) and "SortAggregate" not in _plan(df)


def test_delivery_order_holds_for_any_time_and_id(spark):
    rows = [(k, t, i) for k, (t, i) in enumerate([("0001-01-02 00:00:00", 5), ("1969-12-31 23:59:59", -(2**63)), ("1969-12-31 23:59:59", 2**63 - 1), ("2025-01-01 00:00:00", 0), ("9999-12-31 23:59:59", 1), (None, -5), (None, 7)])]
    df = spark.createDataFrame(rows, "k int, t string, i bigint").withColumn("t", F.col("t").cast("timestamp"))
    got = df.select("k", delivery.delivery_order(F.col("t"), F.col("i")).alias("o")).orderBy("o").collect()
    assert [r.k for r in got] == list(range(len(rows))) and len({r.o for r in got}) == len(rows)
