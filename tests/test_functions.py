import pytest
from pyspark.sql import functions as F

from postmill.functions import dates, failures, places, salary, text, url
from postmill.operators import listings
from postmill.vocabulary import RESULT_NAMES

#: A sound statement of each rule, in sentences of our own.
ACCEPTED = [
    ("Shift pay is $18.25 to $24.75 an hour", "USD", ("hourly", 18.25, 24.75, "USD")),
    ("Rémunération de 41 500 € à 48 250 € par an", None, ("yearly", 41_500, 48_250, "EUR")),
    ("Das Gehalt liegt zwischen 3.150 EUR bis 4.275 EUR pro Monat", None, ("monthly", 3_150, 4_275, "EUR")),
    ("Sueldo 92 € - 118 € por día", None, ("daily", 92, 118, "EUR")),
    ("We pay a salary of ₹7,45,000 – ₹11,20,000 per annum", None, ("yearly", 745_000, 1_120_000, "INR")),
    ("A bonus follows in May. Wages: GBP 610 - 745 weekly", None, ("weekly", 610, 745, "GBP")),
    ("Compensation CA$ 4 - 6k per month", None, ("monthly", 4_000, 6_000, "CAD")),
    ("Lohn: 31k€-39k€/jahr", None, ("yearly", 31_000, 39_000, "EUR")),
    ("Annual salary, NZD 71,300 to $84,900", None, ("yearly", 71_300, 84_900, "NZD")),
    ("Retribuzione da 1.350 € a 1.720 € mensual", None, ("monthly", 1_350, 1_720, "EUR")),
    ("Pay 2023 - 2024 aside, the salary is CHF 88,000 - 97,000 p.a.", None, ("yearly", 88_000, 97_000, "CHF")),
]
BORDERS = ["\n", "\r\n", "\u2028", "<br/>", "</p><p>", "</td><td>", "<h2>", ". ", "! ", "? ", "; ", "</li>", "<section id='x'>"]
REJECTED = [
    ("Good wages for good work", "USD"), ("Salary plus sign-on of USD 4,100 - 9,300 per year", None), ("The budget and pay: EUR 52 - 71 per hour", None),
    ("Pay follows the years 2019 - 2023 yearly", "USD"), ("Pay is $21 - $29", "USD"), ("Pay is $21 - $29 hourly", None), ("Pay is $21 - $29 hourly", "EUR"),
    ("Wage of $3 - $4 monthly", "USD"), ("Wage of USD 22 - 28 hourly, or a day", None), ("Salary of USD 93,000 - 81,000 yearly", None),
    ("Pay under the contract value: USD 52,000 - 71,000 yearly", None), ("Sums of USD 52,000 - 71,000 yearly", None), ("Salary of £1,150 - €2,250 monthly", None),
    ("Salary of € 31 - $ 44 hourly", "USD"), ("Salary of USD 2,000 - 90,000 yearly", None), ("Salary of EUR 1,0,0 - 2,0,0 monthly", None),
    ("Salary of USD 52,000 - 71,000, yearly", None), ("Salary of SEK 52,000 - 71,000 yearly", None), ("Salary of USD 52,000 - 71,000 and, with much luck and patience, yearly", None),
    *[(f"Salary of USD 52,000 - 71,000{b}Leave of 25 days yearly", None) for b in BORDERS],
    ("Pay of INR 55 - 90 a day", None), ("Pay of BDT 550 - 950 per month", None), ("Pay of USD 150,000,000 - 170,000,000 yearly", None), ("", None), (None, None),
]


@pytest.mark.parametrize(("said", "hint", "want"), ACCEPTED)
def test_pay_is_read(said, hint, want):
    assert salary.pay_in_text(said, hint)[:4] == want


@pytest.mark.parametrize(("said", "hint"), REJECTED)
def test_other_text_is_not_pay(said, hint):
    assert salary.pay_in_text(said, hint) is None


def test_a_bare_statement_has_bounds_by_the_year():
    assert salary.pay_of_phrase("$21 - $29 hourly") == ("hourly", 21, 29, "USD")
    assert salary.pay_of_phrase("$21 - $29 hourly", by_year=True) == ("yearly", 43_680, 60_320, "USD")
    assert salary.pay_of_phrase("$400 - $500 hourly") is None and salary.pay_of_phrase("$21 - $29 hourly", least=50_000) is None and salary.pay_of_phrase(None) is None


@pytest.mark.parametrize(("text", "value"), [("7", 7), ("1,250", 1250), ("1.250,5", 1250.5), ("12,34,567", 1234567), ("1 250", 1250), ("12.5", 12.5), ("1,2,3", None), ("1,2345", None)])
def test_numbers_in_three_styles(text, value):
    assert salary.number_value(text) == value


def _value(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells) or "x string") if cells else spark.range(1)
    return df.select(column.alias("v")).first().v


def test_canonical_url_is_one_rule_in_both_forms(spark):
    given = ["HTTPS://A.Test/x/?b=2&utm_source=q&a=1&TRK=z#f", "http://a.test", "https://a.test/p?x=%7E*é&y=", "https://a.test/p//?refId=1", " https://a.test/?q=a+b "]
    df = spark.createDataFrame([(x,) for x in given], "u string")
    got = [r.v for r in df.select(url.canonical_url(F.col("u")).alias("v")).collect()]
    assert got == [url.canonical_text(x) for x in given]
    assert got[0] == "https://a.test/x?a=1&b=2"


def test_dates(spark):
    today = F.lit("2025-07-01").cast("date")
    for said, want in [("2 weeks ago", "2025-06-17"), ("Just posted", "2025-07-01"), ("30+ days", "2025-06-01"), ("soon", None), ("5 cats", None), ("", None)]:
        got = _value(spark, dates.relative_date(F.col("s"), today), s=said)
        assert (str(got) if got else None) == want
    for said, want in [("Published: 5 Mar 2025", "2025-03-05"), ("05-Mar-2025", "2025-03-05"), ("March 5, 2025", "2025-03-05"), ("31/02/2025", None), ("Deadline: 5 Mar 2025", None)]:
        got = _value(spark, dates.published_date(F.col("s")), s=said)
        assert (str(got) if got else None) == want


def test_failures_and_waits(spark):
    now = F.lit("2025-07-01 00:00:00").cast("timestamp")
    for said, want in [("12", 12.0), ("9999", 300.0), ("-4", 0.0), ("nan", None), ("Tue, 01 Jul 2025 00:01:00 GMT", 60.0), ("soon", None)]:
        assert _value(spark, failures.retry_after_seconds(F.col("s"), now), s=said) == want
    for kind, message, want in [("SSLError", "x", "authentication_configuration"), ("ReadTimeout", "x", "transient_network"), ("ValueError", "HTTP 500", "invalid_request"),
                                ("E", "got HTTP 503", "transient_network"), ("E", "too many requests", "rate_limited"), ("E", "x", "adapter_failure")]:
        assert _value(spark, failures.exception_class(F.col("k"), F.col("m")), k=kind, m=message) == want


def test_places_and_numbers(spark):
    shown = lambda c, s, k: _value(spark, places.shown(places.place(F.col("c"), F.col("s"), F.col("k"))), c=c, s=s, k=k)
    assert shown("Austin", "TX", "USA") == "Austin, TX, USA"
    assert shown("Berlin", None, "GERMANY") == "Berlin, Germany"
    assert shown("X", None, "WORLDWIDE") == "X" and shown("Paris", "France", "France") == "Paris, France"
    for said, want in [("$1,234.50/yr", 1234.5), ("1.234,50 €", 1234.5), ("50K", 50.0), ("EUR 60.000", 60000.0), ("n/a", None)]:
        assert _value(spark, salary.listed_number(F.col("s")), s=said) == want


def test_html_to_text():
    page = '<h2>Head</h2><p>A &amp; <b>b</b></p><ul><li>x</li><li>y</li></ul><script>no</script><a href="https://u.test">link</a>'
    assert text.plain_text(page) == "Head A & b x y link"
    assert text.markdown_text(page) == "## Head\n\nA & **b**\n\n* x\n* y\n[link](https://u.test)"
    assert text.plain_text(None) is None and text.plain_text("") == "" and text.markdown_text("<p>") == ""


def test_result_table_has_its_columns_without_rows(spark):
    empty = spark.createDataFrame([], "id string, site string, company_name string, date_posted date, location struct<country:string,city:string,state:string>, job_type array<string>, "
                                      "emails array<string>, skills array<string>, salary_source string, salary_provenance struct<source:string,confidence:string,evidence:string>, "
                                      "compensation struct<interval:string,min_amount:double,max_amount:double,currency:string>")  # fmt: skip
    assert listings.result_table(empty).columns == RESULT_NAMES


def test_normalize_twice_changes_nothing(spark):
    df = spark.sql("""select 'a' as id, 'Salary: USD 50,000 - 70,000 per year' as description, cast(null as string) as salary_source,
        cast(null as struct<source:string,confidence:string,evidence:string>) as salary_provenance, cast(null as struct<interval:string,min_amount:double,max_amount:double,currency:string>) as compensation""")
    once = listings.normalize(df, annual=True, infer=True)
    assert once.first() == listings.normalize(once, annual=True, infer=True).first()
    assert once.first().salary_source == "description" and once.first().salary_provenance.evidence


def test_first_seen_and_limits_with_ties_nulls_and_hot_keys(spark):
    rows = [("a", "k", 2), ("a", "k", 1), ("a", None, 3), ("b", "k", 1)] + [("hot", str(i % 3), i) for i in range(300)]
    df = spark.createDataFrame(rows, "site string, job_key string, sequence int")
    first = {(r.site, r.job_key): r.sequence for r in listings.first_seen(df, ["site", "job_key"], ["sequence"]).collect()}
    assert first[("a", "k")] == 1 and first[("a", None)] == 3 and first[("hot", "2")] == 2 and len(first) == 6
    assert listings.per_site_limit(df, 2, ["sequence"]).count() == 5
    assert listings.per_site_limit(df, 0, ["sequence"]).count() == 0
    assert listings.skip_raw(df, 299, ["sequence"]).count() == 1


def test_places_are_those_of_the_final_order_over_all_sites_and_none(spark):
    rows = [(i, [None, "indeed", "bayt", "zip"][i % 4], None if i % 5 == 0 else f"2025-01-{i % 7 + 1:02d}") for i in range(200)]
    df = spark.createDataFrame(rows, "sequence int, site string, day string").repartition(7).selectExpr("sequence", "site", "to_date(day) as date_posted")
    day = lambda r: 0 if r[2] is None else int(r[2][-2:])
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or "", -day(r), r[0]))]
    got = sorted(listings.with_place(df).select("place", "sequence").collect())
    assert [tuple(r) for r in got] == list(enumerate(want, 1))
    assert listings.with_place(df.limit(0)).columns == ["sequence", "site", "date_posted", "place"]


def test_a_query_places_the_posts_of_all_sites(spark, tmp_path):
    from postmill.plans import catalogue

    posts = "values (1L, 'bayt', date'2025-01-01'), (2L, 'zip', date'2025-01-01'), (3L, null, date'2025-01-02'), (4L, 'bayt', null) as t(post_id, site, date_posted)"
    spark.sql(f"select * from {posts}").write.parquet(f"{tmp_path}/job_posts.parquet")
    got = {r.post_id: r.place for r in catalogue.QUERIES["result_order"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 4: 2, 2: 3, 3: 4}
