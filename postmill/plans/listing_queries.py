"""Queries of the listing operators over the test tables, each with SQL that states its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import dates, failures, places, salary, text, url
from postmill.operators import listings
from postmill.session import table
from postmill.vocabulary import BOARD_DOMAIN, COUNTRY_CURRENCY, COUNTRY_OF, COUNTRY_SHOWN, JOB_TYPE_OF, RESULT_NAMES, REVIEW_HOST, SITES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The day from which relative dates count.
AS_OF = "2025-07-01"


def query(name: str, sql: str | None = None):
    def register(make):
        QUERIES[name] = make
        if sql is not None:
            ORACLES[name] = sql
        return make

    return register


def _values(mapping: dict[str, str], key: str = "k", value: str = "v") -> str:
    quoted = ", ".join("('{}', '{}')".format(a.replace("'", "''"), b.replace("'", "''")) for a, b in mapping.items())
    return f"(values {quoted}) as m({key}, {value})"


def _posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts with an order of arrival."""
    return table(spark, folder, "job_posts").withColumn("sequence", F.col("post_id"))


def _as_of() -> Column:
    return F.lit(AS_OF).cast("date")


# -- addresses and identity -------------------------------------------------------------------------

@query(
    "canonical_url_of_dressed",
    """select post_id, 'https://jobs.example.test/' || lower(site) || '/' || post_id || '?a=1&b=2' as canonical from job_posts where site is not null""",
)
def canonical_url_of_dressed(spark, folder):
    posts = table(spark, folder, "job_posts").where("site is not null")
    dressed = F.concat(
        F.lit("  HTTPS://JOBS.example.TEST/"), F.lower("site"), F.lit("/"), F.col("post_id").cast("string"),
        F.lit("//?utm_source=x&b=2&trackingId=9&a=1&TRK=3#frag "),
    )
    return posts.select("post_id", url.canonical_url(dressed).alias("canonical"))


@query(
    "canonical_url_posts",
    r"""with p as (select post_id, regexp_replace(trim(job_url), '#.*$', '') as u from job_posts where job_url is not null),
        q as (select post_id, string_split(u, '?')[1] as front, list_sort(list_filter(list_filter(string_split(coalesce(string_split(u, '?')[2], ''), '&'), lambda x: x <> ''),
                lambda x: not regexp_matches(lower(x), '^(utm_[^=]*|trk|trackingid|refid)(=|$)'))) as kept from p)
        select post_id, lower(regexp_extract(front, '^[^/]*//[^/]*')) || case when regexp_replace(front, '^[^/]*//[^/]*|/+$', '', 'g') = '' then '/' else regexp_replace(front, '^[^/]*//[^/]*|/+$', '', 'g') end
            || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as canonical from q""",
)
def canonical_url_posts(spark, folder):
    posts = table(spark, folder, "job_posts").where("job_url is not null")
    return posts.select("post_id", url.canonical_url(F.col("job_url")).alias("canonical"))


@query("stable_identity")
def stable_identity(spark, folder):
    return listings.with_key(_posts(spark, folder)).select("post_id", "job_key")


@query(
    "identity_source",
    "select post_id, coalesce(nullif(id, ''), job_url) as known_by, sha256(site || ':' || trim(coalesce(nullif(id, ''), job_url))) as digest from job_posts",
)
def identity_source(spark, folder):
    known = url.key_source(F.col("id"), F.col("job_url"))
    return table(spark, folder, "job_posts").select("post_id", known.alias("known_by"), F.sha2(F.concat("site", F.lit(":"), F.trim(known)), 256).alias("digest"))


# -- text --------------------------------------------------------------------------------------------


@query(
    "emails_in_descriptions",
    rf"""select post_id, array_to_string(regexp_extract_all(description, '{text.EMAIL}'), ' ') as found, len(regexp_extract_all(description, '{text.EMAIL}')) as n
        from job_posts where length(description) > 0""",
)
def emails_in_descriptions(spark, folder):
    posts = table(spark, folder, "job_posts").where("length(description) > 0")
    found = text.emails_in(F.col("description"))
    return posts.select("post_id", F.array_join(found, " ").alias("found"), F.size(found).cast("long").alias("n"))


@query(
    "emails_tidied",
    rf"""with f as (select row_id, list_transform(regexp_extract_all(emails, '{text.EMAIL}'), lambda x: lower(trim(x))) as e from job_rows where length(emails) > 0)
        select row_id, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i), ', ') as emails from f where len(e) > 0""",
)
def emails_tidied(spark, folder):
    """Addresses in the free text of a column, each once in order of first sight."""
    found = text.tidy_emails(text.emails_in(F.col("emails")))
    return table(spark, folder, "job_rows").select("row_id", F.array_join(found, ", ").alias("emails")).where("emails is not null")


@query(
    "job_type_from_string",
    f"""select post_id, string_agg(v, ',' order by i) as kinds from (
            select post_id, i, m.v from (select post_id, unnest(job_type) as t, unnest(range(1, len(job_type) + 1)) as i from job_posts) x
            left join {_values(JOB_TYPE_OF)} on m.k = lower(regexp_replace(x.t, '[- ]', '', 'g'))) group by post_id having kinds is not null""",
)
def job_type_from_string(spark, folder):
    kinds = F.array_join(F.array_compact(F.transform("job_type", text.job_type_named)), ",")
    return table(spark, folder, "job_posts").select("post_id", F.nullif(kinds, F.lit("")).alias("kinds")).where("kinds is not null")


@query(
    "job_types_described",
    r"""select doc_id, concat_ws(',', case when regexp_matches(lower(text), 'full\s?time') then 'fulltime' end, case when regexp_matches(lower(text), 'part\s?time') then 'parttime' end,
            case when lower(text) like '%internship%' then 'internship' end, case when lower(text) like '%contract%' then 'contract' end) as kinds from documents where text is not null""",
)
def job_types_described(spark, folder):
    docs = table(spark, folder, "documents").where("text is not null")
    return docs.select("doc_id", F.coalesce(F.array_join(text.job_types_described(F.col("text")), ","), F.lit("")).alias("kinds"))


_REMOTE = "remote|work from home|wfh"


@query(
    "remote_flag",
    f"""select post_id, regexp_matches(lower(concat_ws(' ', title, description, location.city)), '{_REMOTE}') as by_words,
            regexp_matches(lower(concat_ws(' ', title, description)), '{_REMOTE}|home based') as by_more_words,
            coalesce(regexp_matches(lower(description), '\\b(remote|wfh)\\b'), false) as by_word from job_posts""",
)
def remote_flag(spark, folder):
    return table(spark, folder, "job_posts").select(
        "post_id",
        text.mentions_remote(F.col("title"), F.col("description"), F.col("location.city")).alias("by_words"),
        text.mentions_remote(F.col("title"), F.col("description"), more=("home based",)).alias("by_more_words"),
        text.remote_word(F.col("description")).alias("by_word"),
    )


@query(
    "office_kind",
    """select post_id, case when t like '%hybrid%' then 'Hybrid' when t like '%remote%' or t like '%work from home%' or t like '%wfh%' then 'Remote'
            when t like '%work from office%' or t like '%on-site%' or t like '%onsite%' then 'Work from office' end as kind
        from (select post_id, lower(concat_ws(' ', title, description)) as t from job_posts)""",
)
def office_kind(spark, folder):
    return table(spark, folder, "job_posts").select("post_id", text.office_kind(F.col("title"), F.col("description")).alias("kind"))


@query(
    "evidence_collapsed",
    r"""select row_id, left(trim(regexp_replace(salary_evidence, '[\s ]+', ' ', 'g')), 160) as evidence from job_rows where salary_evidence is not null""",
)
def evidence_collapsed(spark, folder):
    rows = table(spark, folder, "job_rows").where("salary_evidence is not null")
    return rows.select("row_id", text.collapse(F.col("salary_evidence"), 160).alias("evidence"))


@query(
    "skills_split",
    """select row_id, array_to_string(list_filter(list_transform(string_split(skills, ','), lambda x: trim(x)), lambda x: length(x) > 0), '|') as parts
        from job_rows where length(replace(replace(skills, ',', ''), ' ', '')) > 0""",
)
def skills_split(spark, folder):
    return table(spark, folder, "job_rows").select("row_id", F.array_join(text.split_list(F.col("skills")), "|").alias("parts")).where("parts is not null")


@query("html_to_plain")
def html_to_plain(spark, folder):
    return table(spark, folder, "job_posts").select("post_id", text.html_to_plain(F.col("description")).alias("plain"))


@query("html_to_markdown")
def html_to_markdown(spark, folder):
    return table(spark, folder, "job_posts").select("post_id", text.html_to_markdown(F.col("description")).alias("markdown"))


@query(
    "html_without_attributes",
    r"""select post_id, regexp_replace(description, '<([a-zA-Z][a-zA-Z0-9]*)\s[^<>]*?(/?)>', '<\1\2>', 'g') as bare from job_posts""",
)
def html_without_attributes(spark, folder):
    return table(spark, folder, "job_posts").select("post_id", text.without_attributes(F.col("description")).alias("bare"))


# -- money -------------------------------------------------------------------------------------------

_ISO = "case upper(trim({0})) when '$' then 'USD' when '€' then 'EUR' when '£' then 'GBP' when '₹' then 'INR' when '৳' then 'BDT' else case when regexp_matches(upper(trim({0})), '^\\p{{L}}{{3}}$') then upper(trim({0})) end end"


@query("iso_currency", f"select row_id, {_ISO.format('currency')} as code from job_rows")
def iso_currency(spark, folder):
    return table(spark, folder, "job_rows").select("row_id", salary.iso_currency(F.col("currency")).alias("code"))


@query("pay_period", f"select row_id, m.v as period from job_rows left join {_values(salary.PERIOD_NAMES)} on m.k = upper(interval)")
def pay_period(spark, folder):
    return table(spark, folder, "job_rows").select("row_id", salary.period_named(F.col("interval")).alias("period"))


_FACTOR = "case compensation.interval when 'hourly' then 2080 when 'daily' then 260 when 'weekly' then 52 when 'monthly' then 12 else 1 end"


@query(
    "annualized_pay",
    f"""select post_id, case when compensation.interval in ('hourly', 'daily', 'weekly', 'monthly', 'yearly') then 'yearly' else compensation.interval end as interval,
            round(compensation.min_amount * {_FACTOR}, 2) as low, round(compensation.max_amount * {_FACTOR}, 2) as high, compensation.currency as currency from
            (select post_id, case when post_id % 5 = 0 then struct_pack("interval" := 'per gig', min_amount := compensation.min_amount, max_amount := compensation.max_amount, currency := compensation.currency) else compensation end as compensation
             from job_posts where compensation is not null)""",
)
def annualized_pay(spark, folder):
    """Every fifth post is given a period that isn't known."""
    pay = F.col("compensation")
    odd = F.when(F.col("post_id") % 5 == 0, pay.withField("interval", F.lit("per gig"))).otherwise(pay)
    posts = table(spark, folder, "job_posts").where("compensation is not null")
    by_year = salary.annualized(odd)
    return posts.select("post_id", by_year["interval"].alias("interval"), F.round(by_year["min_amount"], 2).alias("low"), F.round(by_year["max_amount"], 2).alias("high"), by_year["currency"].alias("currency"))


@query(
    "currency_hint",
    f"""select x.k as spelling, x.v as country, m.v as currency from {_values(COUNTRY_OF).replace("as m(", "as x(")} left join {_values(COUNTRY_CURRENCY)} on m.k = x.v""",
)
def currency_hint(spark, folder):
    spellings = spark.createDataFrame([(k,) for k in COUNTRY_OF], "spelling string")
    country = places.country_named(F.col("spelling"))
    return spellings.select("spelling", country.alias("country"), places.currency_hint(country).alias("currency"))


@query(
    "listed_number",
    """select row_id, case post_form when 3 then null when 2 then round(trunc(min_amount), 2) else round(cast(round(min_amount, 2) as double), 2) end as value
        from (select *, row_id % 4 as post_form from job_rows)""",
)
def listed_number(spark, folder):
    """Amounts written in English and continental style, in thousands that lose their letter, and not at all."""
    written = F.format_number(F.round("min_amount", 2), 2)
    german = F.translate(written, ",.", ".,")
    form = F.element_at(F.array(F.concat(F.lit("EUR "), written, F.lit(" /mo")), F.concat(german, F.lit(" €")), F.concat(F.format_number(F.floor("min_amount"), 0), F.lit("K")), F.lit("on request")), (F.col("row_id") % 4 + 1).cast("int"))
    return table(spark, folder, "job_rows").select("row_id", salary.listed_number(form).alias("value"))


@query(
    "lakh_range",
    """select post_id, case post_id % 6 when 0 then 10 * 100000.0 when 1 then 10.5 * 100000.0 when 2 then 1.25 * 10000000.0 when 3 then 3 * 100000.0 end::double as low,
            case post_id % 6 when 0 then 20 * 100000.0 when 1 then 20 * 100000.0 when 2 then 2 * 10000000.0 when 3 then 3 * 100000.0 end::double as high from job_posts""",
)
def lakh_range(spark, folder):
    forms = ["10 - 20 Lacs P.A.", " 10.5-20 lakhs", "1.25 - 2 Cr.", "3 - 3 Lac", "Not disclosed", None]
    said = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("post_id") % 6 + 1).cast("int"))
    low, high = salary.lakh_range(said)
    return table(spark, folder, "job_posts").select("post_id", low.alias("low"), high.alias("high"))


#: Statements with ``{a}`` and ``{b}``, and what they come to: period, low, high and currency in terms of
#: a and b, or nothing.
_SAID = [
    ("We grow. Salary: USD {a} - {b} per year. Bonus apart.", "yearly", 1, "USD"), ("Gehalt: {a} EUR bis {b} EUR pro Jahr", "yearly", 1, "EUR"), ("Salaire : {a} € à {b} € par an", "yearly", 1, "EUR"),
    ("Sueldo {a} - {b} EUR al año", "yearly", 1, "EUR"), ("Wages of £{a} to £{b} per annum", "yearly", 1, "GBP"), ("Pay: ₹{a} – ₹{b} monthly", "monthly", 1, "INR"), ("Compensation CHF {a}—{b} p.a.", "yearly", 1, "CHF"),
    ("Salary: CA$ {a} - {b} monthly", "monthly", 1, "CAD"), ("Remuneration: A${a} to A${b} a year", "yearly", 1, "AUD"), ("Lohn {a}€-{b}€/jahr", "yearly", 1, "EUR"), ("Pay: BDT {a} - {b} per month", "monthly", 1, "BDT"),
    ("Salary: NZD {a} to ${b} annually<br>and more", "yearly", 1, "NZD"), ("Salary: USD {a}k - {b}k per year", "yearly", 1000, "USD"),
    ("Salary: USD {a} - {b}", None, 0, None), ("Salary: {a} - {b} per year", None, 0, None), ("Signing bonus beside the salary: USD {a} - {b} per year", None, 0, None), ("Budget: USD {a} - {b} per year", None, 0, None),
    ("Salary: USD {b} - {a} per year", None, 0, None), ("Salary: USD {a} - EUR {b} per year", None, 0, None), ("Salary: USD {a} - {b} per year or per month", None, 0, None), ("Salary: USD {a} - {b}\nLeave per year", None, 0, None),
    ("Salary: USD {a} - {b} per hour", None, 0, None), ("Salary: SEK {a} - {b} per year", None, 0, None), ("Contract value and pay: USD {a} - {b} per year", None, 0, None),
]


def _said_sql() -> str:
    """Rows of the statements by number."""
    rows = ", ".join(f"({k}, {repr(p) if p else 'null'}, {m}, {repr(c) if c else 'null'})" for k, (_, p, m, c) in enumerate(_SAID))
    return f"(values {rows}) as s(k, period, times, code)"


@query(
    "pay_inferred",
    f"""select post_id, period as interval, case when times > 0 then (case when times = 1 then 30000 + post_id % 1000 else 30 + post_id % 10 end * times)::double end as low,
            case when times > 0 then (case when times = 1 then 50000 + post_id % 1000 else 50 + post_id % 10 end * times)::double end as high, code as currency
        from job_posts join {_said_sql()} on s.k = post_id % {len(_SAID)}""",
)
def pay_inferred(spark, folder):
    """Sound and unsound statements of two dozen forms."""
    small = F.lit(False)
    for k, (_, _, times, _) in enumerate(_SAID):
        if times == 1000:
            small |= F.col("post_id") % len(_SAID) == k
    low = F.when(small, 30 + F.col("post_id") % 10).otherwise(30000 + F.col("post_id") % 1000).cast("string")
    high = F.when(small, 50 + F.col("post_id") % 10).otherwise(50000 + F.col("post_id") % 1000).cast("string")
    form = F.element_at(F.array(*[F.lit(t) for t, *_ in _SAID]), (F.col("post_id") % len(_SAID) + 1).cast("int"))
    got = salary.parse_pay(F.replace(F.replace(form, F.lit("{a}"), low), F.lit("{b}"), high), F.lit(None).cast("string"))
    return table(spark, folder, "job_posts").select("post_id", got["interval"].alias("interval"), got["min_amount"].alias("low"), got["max_amount"].alias("high"), got["currency"].alias("currency"))


_SIMPLE = r"^(?:Pay|Salary|Wage|Compensation): (USD|EUR|GBP|INR|CHF) ([0-9]{1,3}(?:,[0-9]{3})*|[0-9]+) (?:-|–|to) (?:USD |EUR |GBP |INR |CHF )?([0-9]{1,3}(?:,[0-9]{3})*|[0-9]+) (?:a|per|/) ?(hour|week|year)$"


@query(
    "pay_in_evidence",
    f"""select row_id, v.period as interval, low, high, cur as currency from (
            select row_id, regexp_extract(salary_evidence, '{_SIMPLE}', 1) as cur, try_cast(replace(regexp_extract(salary_evidence, '{_SIMPLE}', 2), ',', '') as double) as low,
                try_cast(replace(regexp_extract(salary_evidence, '{_SIMPLE}', 3), ',', '') as double) as high, regexp_extract(salary_evidence, '{_SIMPLE}', 4) as unit
            from job_rows where regexp_matches(salary_evidence, '{_SIMPLE}')) e
        join (values ('hour', 'hourly', 1, 10000, 40), ('week', 'weekly', 25, 500000, 1500), ('year', 'yearly', 1000, 100000000, 60000)) v(unit, period, least, most, rupees) on v.unit = e.unit
        where low < high and high <= most and high <= 20 * low and low >= case when cur = 'INR' then rupees else least end""",
)
def pay_in_evidence(spark, folder):
    """Statements of the data themselves; those of a form that SQL can read are compared."""
    rows = table(spark, folder, "job_rows").where(F.col("salary_evidence").rlike(_SIMPLE))
    got = salary.parse_pay(F.col("salary_evidence"), F.lit(None).cast("string"))
    return rows.select("row_id", got["interval"].alias("interval"), got["min_amount"].alias("low"), got["max_amount"].alias("high"), got["currency"].alias("currency")).where("interval is not null")


@query("pay_in_texts")
def pay_in_texts(spark, folder):
    """All statements about pay of the data, dollars being US dollars."""
    got = salary.parse_pay(F.col("salary_evidence"), F.lit("USD"))
    return table(spark, folder, "job_rows").select("row_id", got.alias("s")).where("s is not null").select("row_id", "s.*")


@query(
    "pay_of_phrase",
    """select post_id, case when k < 3 then case k when 0 then 'hourly' when 1 then 'yearly' else 'monthly' end end as interval, case k when 0 then 20 + post_id % 9 when 1 then 40000 + post_id % 9 when 2 then 3000 + post_id % 9 end::double as low,
            case k when 0 then 30 + post_id % 9 when 1 then 60000 + post_id % 9 when 2 then 4000 + post_id % 9 end::double as high, case when k < 3 then case k when 2 then 'EUR' else 'USD' end end as currency
        from (select post_id, post_id % 6 as k from job_posts)""",
)
def pay_of_phrase(spark, folder):
    """Bare statements; the last ones lie outside the bounds by the year, or state no period."""
    n = (F.col("post_id") % 9).cast("int")
    two = lambda a, b, form: F.format_string(form, n + a, n + b)
    said = F.array(two(20, 30, "$%d - $%d per hour"), two(40000, 60000, "$%d to %d a year"), two(3000, 4000, "EUR %d - %d monthly"), two(500, 600, "$%d - $%d per hour"), two(20, 30, "$%d - $%d"), F.lit("competitive"))
    got = salary.infer_phrase(F.element_at(said, (F.col("post_id") % 6 + 1).cast("int")))
    return table(spark, folder, "job_posts").select("post_id", got["interval"].alias("interval"), got["min_amount"].alias("low"), got["max_amount"].alias("high"), got["currency"].alias("currency"))


@query(
    "salary_provenance",
    """select post_id, coalesce(salary_source, 'direct_data') as source, case when coalesce(salary_source, 'direct_data') = 'direct_data' then 'high' else 'medium' end as confidence,
            case when salary_source = 'description' then left(salary_provenance.evidence, 160) end as evidence from job_posts where compensation is not null""",
)
def salary_provenance(spark, folder):
    posts = listings.normalize(_posts(spark, folder)).where("compensation is not null")
    return posts.select("post_id", F.col("salary_provenance.source").alias("source"), F.col("salary_provenance.confidence").alias("confidence"), F.col("salary_provenance.evidence").alias("evidence"))


# -- dates -------------------------------------------------------------------------------------------


@query(
    "relative_date",
    f"""select post_id, case post_id % 9 when 0 then date '{AS_OF}' when 1 then date '{AS_OF}' - (post_id % 13)::int when 2 then date '{AS_OF}' - (post_id % 13)::int * 7
            when 3 then date '{AS_OF}' - (post_id % 13)::int * 30 when 4 then date '{AS_OF}' when 5 then date '{AS_OF}' end as posted from job_posts""",
)
def relative_date(spark, folder):
    n = (F.col("post_id") % 13).cast("string")
    said = [F.lit("Just posted"), F.concat(n, F.lit(" days ago")), F.concat(F.lit("  "), n, F.lit(" Weeks ago")), F.concat(n, F.lit("+ MONTHS")), F.concat(n, F.lit(" minutes ago")), F.concat(n, F.lit(" hours ago")), F.concat(n, F.lit(" years ago")), F.lit("yesterday"), F.lit(None)]
    return table(spark, folder, "job_posts").select("post_id", dates.relative_date(F.element_at(F.array(*said), (F.col("post_id") % 9 + 1).cast("int")), _as_of()).alias("posted"))


@query(
    "time_stamps",
    f"""select post_id, case when post_id % 4 < 2 then date_posted end as iso, case when post_id % 4 <> 3 then date_posted end as plain, date_posted as epoch, date '{AS_OF}' - (post_id % 90)::int as aged from job_posts""",
)
def time_stamps(spark, folder):
    """ISO time stamps, plain days, milliseconds and ages; broken ones give nothing."""
    day, k = F.col("date_posted").cast("string"), F.col("post_id") % 4
    iso = F.when(k == 0, F.concat(day, F.lit("T23:59:59Z"))).when(k == 1, day).when(k == 2, F.concat(day, F.lit("T9"))).otherwise("2025-02-30")
    plain = F.when(k == 3, F.concat(day, F.lit("T00:00"))).otherwise(day)
    return table(spark, folder, "job_posts").select(
        "post_id", dates.iso_date(iso).alias("iso"), dates.plain_date(plain).alias("plain"), dates.epoch_millis_date(F.unix_millis(F.col("date_posted").cast("timestamp")) + 3_600_000).alias("epoch"),
        dates.days_ago((F.col("post_id") % 90).cast("int"), _as_of()).alias("aged"),
    )


@query("published_date", "select post_id, case when post_id % 7 > 1 then date_posted end as posted from job_posts")
def published_date(spark, folder):
    posts = table(spark, folder, "job_posts")
    forms = ["d MMM yyyy", "d-MMM-yyyy", "d MMMM yyyy", "MMMM d, yyyy", "d/M/yyyy"]
    written = F.element_at(F.array(*[F.concat(F.lit("Published: "), F.date_format("date_posted", f)) for f in forms]), (F.col("post_id") % 5 + 1).cast("int"))
    written = F.when(F.col("post_id") % 7 == 0, F.concat(F.lit("Deadline "), written)).when(F.col("post_id") % 7 == 1, F.lit("31/02/2025")).otherwise(written)
    return posts.select("post_id", dates.published_date(written).alias("posted"))


@query(
    "label_or_created",
    f"""select post_id, case when post_id % 3 = 0 then date '{AS_OF}' - (post_id % 5)::int * 7 else cast(to_timestamp(1700000000 + post_id * 1000) at time zone 'UTC' as date) end as posted from job_posts""",
)
def label_or_created(spark, folder):
    label = F.when(F.col("post_id") % 3 == 0, F.concat((F.col("post_id") % 5).cast("string"), F.lit(" Weeks Ago")))
    seconds = F.lit(1700000000) + F.col("post_id") * 1000
    created = F.when(F.col("post_id") % 2 == 0, seconds).otherwise(seconds * 1000)
    return table(spark, folder, "job_posts").select("post_id", dates.label_or_created(label, created, _as_of()).alias("posted"))


@query("posted_within", f"select post_id from job_posts where date_posted >= date '{AS_OF}' - 40")
def posted_within(spark, folder):
    return table(spark, folder, "job_posts").where(dates.posted_within(F.col("date_posted"), 950, _as_of())).select("post_id")


# -- places ------------------------------------------------------------------------------------------

_SHOWN = f"""case when location is not null then concat_ws(', ', nullif(location.city, ''), nullif(location.state, ''),
        case when coalesce(m.v, location.country) not in (coalesce(location.city, ''), coalesce(location.state, '')) and location.country not in ('US_CANADA', 'WORLDWIDE')
            then nullif(coalesce(m.v, location.country), '') end) end"""


@query("location_shown", f"select post_id, {_SHOWN} as shown from job_posts left join {_values(COUNTRY_SHOWN)} on m.k = location.country")
def location_shown(spark, folder):
    return table(spark, folder, "job_posts").select("post_id", places.shown(F.col("location")).alias("shown"))


@query(
    "location_parsed",
    """with p as (select row_id, location, list_filter(list_transform(string_split(location, ','), lambda x: trim(x)), lambda x: length(x) > 0) as parts from job_rows where length(trim(location)) > 0)
        select row_id, parts[1] as city, case when len(parts) > 2 then array_to_string(parts[2:len(parts) - 1], ', ') end as state, case when len(parts) > 1 then parts[len(parts)] else 'WORLDWIDE' end as country,
            case when len(parts) > 1 then array_to_string(parts[2:], ', ') end as rest from p where len(parts) > 0""",
)
def location_parsed(spark, folder):
    rows = table(spark, folder, "job_rows").where("length(trim(location)) > 0")
    last, rest = places.country_last(F.col("location")), places.city_then_state(F.col("location"), F.lit("INDIA"))
    return rows.select("row_id", last["city"].alias("city"), last["state"].alias("state"), last["country"].alias("country"), rest["state"].alias("rest")).where("city is not null")


@query(
    "region_or_rest",
    """with p as (select row_id, list_filter(list_transform(string_split(location, ','), lambda x: trim(x)), lambda x: length(x) > 0) as parts from job_rows where length(trim(location)) > 0)
        select row_id, parts[1] as city, case when len(parts) > 2 or (len(parts) = 2 and length(parts[2]) <= 3 and upper(parts[2]) = parts[2]) then parts[2] end as state,
            case when len(parts) > 2 then array_to_string(parts[3:], ', ') when len(parts) = 2 and not (length(parts[2]) <= 3 and upper(parts[2]) = parts[2]) then parts[2] end as country from p""",
)
def region_or_rest(spark, folder):
    rows = table(spark, folder, "job_rows").where("length(trim(location)) > 0")
    return rows.select("row_id", places.region_or_rest(F.col("location")).alias("p")).select("row_id", "p.city", "p.state", "p.country")


@query("country_from_string", f"select search_id, m.v as country_name from searches left join {_values(COUNTRY_OF)} on m.k = lower(trim(country))")
def country_from_string(spark, folder):
    return table(spark, folder, "searches").select("search_id", places.country_named(F.col("country")).alias("country_name"))


# -- failures ----------------------------------------------------------------------------------------

_STATUS = "([200, 400, 401, 403, 404, 408, 410, 425, 429, 500, 503, 599])[1 + (log_id % 12)::int]"


@query(
    "http_status_class",
    f"""select log_id, case when s = 429 then 'rate_limited' when s in (401, 403) then 'authentication_configuration' when s = 410 and log_id % 2 = 0 then 'cursor_expired'
            when s in (408, 425) or s between 500 and 599 then 'transient_network' when s between 400 and 499 then 'invalid_request' else 'adapter_failure' end as code
        from (select log_id, {_STATUS} as s from job_log)""",
)
def http_status_class(spark, folder):
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 400, 401, 403, 404, 408, 410, 425, 429, 500, 503, 599)]), (F.col("log_id") % 12 + 1).cast("int"))
    return table(spark, folder, "job_log").select("log_id", failures.status_class(status, F.col("log_id") % 2 == 0).alias("code"))


_MESSAGES = ["Continuation no longer valid", "Too many requests", "API key missing", "boom", "stale cursor", "Rate limit hit"]


@query(
    "message_class",
    """select log_id, case log_id % 6 when 0 then 'cursor_expired' when 1 then 'rate_limited' when 2 then 'authentication_configuration' when 3 then 'adapter_failure'
            when 4 then 'cursor_expired' else 'rate_limited' end as code from job_log""",
)
def message_class(spark, folder):
    said = F.element_at(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("log_id") % 6 + 1).cast("int"))
    return table(spark, folder, "job_log").select("log_id", failures.message_class(said, F.lit(True)).alias("code"))


@query(
    "retry_delay",
    """select log_id, greatest(0.5 * pow(2, log_id % 6), case log_id % 5 when 0 then least(greatest((log_id % 700 - 100)::double, 0), 300) when 1 then least((log_id % 400)::double, 300) else 0 end) as seconds from job_log""",
)
def retry_delay(spark, folder):
    """Waits asked for in seconds, as HTTP dates, unreadably and not at all."""
    now = F.lit("2025-07-01 00:00:00").cast("timestamp")
    at = F.date_format(F.timestamp_seconds(F.unix_timestamp(now) + F.col("log_id") % 400), "EEE, dd MMM yyyy HH:mm:ss")
    forms = F.array((F.col("log_id") % 700 - 100).cast("string"), F.concat(at, F.lit(" GMT")), F.lit("nan"), F.lit("soon"), F.lit(None))
    asked = failures.retry_after_seconds(F.element_at(forms, (F.col("log_id") % 5 + 1).cast("int")), now)
    return table(spark, folder, "job_log").select("log_id", failures.retry_delay((F.col("log_id") % 6).cast("double"), 0.5, asked).alias("seconds"))


_RAISED = [("SSLError", "x", "authentication_configuration"), ("ProxyError", "x", "authentication_configuration"), ("ReadTimeout", "x", "transient_network"), ("ConnectionError", "HTTP 404", "transient_network"), ("ValueError", "HTTP 500", "invalid_request"),
           ("Odd", "got http 503 back", "transient_network"), ("Odd", "HTTP 429", "rate_limited"), ("Odd", "HTTP 4290", "adapter_failure"), ("Odd", "Rate Limit reached", "rate_limited"), ("Odd", "boom", "adapter_failure")]


@query("exception_class", "select log_id, c as code from job_log join (values {}) as r(k, c) on r.k = log_id % {}".format(", ".join(f"({k}, '{c}')" for k, (_, _, c) in enumerate(_RAISED)), len(_RAISED)))
def exception_class(spark, folder):
    k = (F.col("log_id") % len(_RAISED) + 1).cast("int")
    kind, said = (F.element_at(F.array(*[F.lit(r[n]) for r in _RAISED]), k) for n in (0, 1))
    return table(spark, folder, "job_log").select("log_id", failures.exception_class(kind, said).alias("code"))


# -- dedup, limits, joins -----------------------------------------------------------------------------


@query("validity", """select post_id, case when coalesce(length(trim(title)), 0) = 0 then 'title is empty' when coalesce(length(trim(job_url)), 0) = 0 then 'job_url is empty'
            when not regexp_matches(trim(job_url), '^https?://') then 'job_url is not http'
            when compensation is not null and compensation.min_amount is null and compensation.max_amount is null then 'compensation has no amount'
            when compensation.min_amount < 0 or compensation.max_amount < 0 then 'compensation is negative' when compensation.min_amount > compensation.max_amount then 'compensation is out of order'
            when compensation is not null and ({iso}) is null then 'currency is unknown'
            when compensation is null and (salary_source is not null or salary_provenance is not null) then 'salary metadata without compensation'
            when salary_source = 'description' and salary_provenance is null then 'description salary without provenance'
            when salary_source <> salary_provenance.source then 'salary sources differ' end as invalid_reason from job_posts""".replace("{iso}", _ISO.format("compensation.currency")))
def validity(spark, folder):
    return listings.validity(table(spark, folder, "job_posts")).select("post_id", "invalid_reason")


@query(
    "first_seen",
    "select post_id, site, id from (select *, row_number() over (partition by site, coalesce(nullif(id, ''), job_url) order by fetched_at, post_id) as r from job_posts) where r = 1",
)
def first_seen(spark, folder):
    posts = table(spark, folder, "job_posts").select("post_id", "site", "id", url.key_source(F.col("id"), F.col("job_url")).alias("known_by"), "fetched_at")
    return listings.first_seen(posts, ["site", "known_by"], ["fetched_at", "post_id"]).select("post_id", "site", "id")


@query("per_site_limit", "select post_id, site from (select *, row_number() over (partition by site order by post_id) as r from job_posts) where r <= 15")
def per_site_limit(spark, folder):
    return listings.per_site_limit(table(spark, folder, "job_posts").select("post_id", "site"), 15, ["post_id"])


@query("offset_skip", "select post_id, site from (select *, row_number() over (partition by site order by post_id) as r from job_posts) where r > 25")
def offset_skip(spark, folder):
    return listings.skip_raw(table(spark, folder, "job_posts").select("post_id", "site"), 25, ["post_id"])


@query(
    "resume_anti_join",
    "select log_id, site from job_log l where not exists (select 1 from job_posts p where p.id = l.job_id and p.site = l.site and p.fetched_at < timestamp '2025-04-01')",
)
def resume_anti_join(spark, folder):
    """Messages about listings that weren't known before a day."""
    log = table(spark, folder, "job_log").select("log_id", "site", F.col("job_id").alias("id"))
    known = table(spark, folder, "job_posts").where("fetched_at < timestamp'2025-04-01'")
    return listings.unseen(log, known, ["id", "site"]).select("log_id", "site")


@query("detail_left_join", "select r.row_id, p.post_id, p.job_level as detail from job_rows r left join job_posts p on p.id = r.id")
def detail_left_join(spark, folder):
    details = table(spark, folder, "job_posts").select("id", "post_id", F.col("job_level").alias("detail"))
    return listings.with_details(table(spark, folder, "job_rows").select("row_id", "id"), details, "id").select("row_id", "post_id", "detail")


# -- rows and outcomes ---------------------------------------------------------------------------------

_FLAT = f"""select id, site, job_url, job_url_direct, title, company_name as company, {_SHOWN} as location, date_posted, nullif(array_to_string(job_type, ', '), '') as job_type,
        case when compensation is not null then coalesce(salary_source, 'direct_data') else salary_source end as salary_source,
        case when compensation is not null then case when coalesce(salary_source, 'direct_data') = 'direct_data' then 'high' else 'medium' end else salary_provenance.confidence end as salary_confidence,
        case when compensation is not null then case when salary_source = 'description' then left(salary_provenance.evidence, 160) end else salary_provenance.evidence end as salary_evidence,
        compensation.interval as interval, compensation.min_amount as min_amount, compensation.max_amount as max_amount, compensation.currency as currency, is_remote, job_level, job_function, listing_type,
        nullif(array_to_string(emails, ', '), '') as emails, description, company_industry, company_url, company_logo, banner_photo_url, company_url_direct, company_addresses, company_num_employees,
        company_revenue, company_description, nullif(array_to_string(skills, ', '), '') as skills, experience_range, company_rating, company_reviews_count, vacancy_count, work_from_home_type
    from job_posts left join {_values(COUNTRY_SHOWN)} on m.k = location.country"""


@query("result_rows_37", _FLAT)
def result_rows_37(spark, folder):
    return listings.result_table(_posts(spark, folder))


@query(
    "result_order",
    "select post_id, site, row_number() over (order by site nulls last, date_posted desc nulls last, post_id) as place from job_posts",
)
def result_order(spark, folder):
    """The place of each row of all sites, and of none, in the final order."""
    posts = _posts(spark, folder).select("post_id", "site", "date_posted", "sequence")
    return listings.with_place(posts).select("post_id", "site", "place")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "job_log")
    page = F.coalesce(F.get_json_object("resume_state", "$.page").cast("int"), F.lit(0))
    return log.groupBy("site", page.alias("page")).agg(F.count(F.lit(1)).alias("raw"), F.countDistinct("job_key").alias("emitted"))


@query(
    "progress_running",
    """select site, page, sum(raw) over w as raw_seen, sum(emitted) over w as emitted_total
        from (select site, coalesce(cast(json_extract(resume_state, '$.page') as int), 0) as page, count(*) as raw, count(distinct job_key) as emitted from job_log group by all)
        window w as (partition by site order by page)""",
)
def progress_running(spark, folder):
    return listings.progress(_pages(spark, folder)).select("site", "page", "raw_seen", "emitted_total")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("log_id") % 97 == 0, "error").when(F.col("log_id") % 89 == 0, "site_complete").otherwise("job")
    return table(spark, folder, "job_log").select("site", kind.alias("type"), F.col("log_id").alias("sequence"))


_SUMMARY = """with e as (select site, log_id, case when log_id % 97 = 0 then 'error' when log_id % 89 = 0 then 'site_complete' else 'job' end as type from job_log),
    s as (select site, count(*) filter (type = 'job') as jobs_emitted, count(*) filter (type = 'error') as failure_count,
            coalesce(arg_max(type = 'site_complete', log_id) filter (type <> 'job'), false) as completed from e group by site)"""


@query("site_summary", _SUMMARY + " select site, jobs_emitted, failure_count, completed from s union all select 'own_board', 0, 0, false")
def site_summary(spark, folder):
    """All boards, and one that the log knows nothing of."""
    return listings.site_summary(_events(spark, folder), spark.createDataFrame([(s,) for s in (*SITES, "own_board")], "site string"))


@query(
    "search_outcome",
    _SUMMARY + """ select cast(sum(jobs_emitted) as bigint) as total_jobs, cast(sum(failure_count) as bigint) as total_failures, bool_and(completed) as completed,
        case when bool_and(completed) then 'succeeded' when sum(jobs_emitted) > 0 or bool_or(completed) then 'partial' else 'failed' end as status from (select site, jobs_emitted, failure_count, completed from s union all select 'own_board', 0, 0, false) s""",
)
def search_outcome(spark, folder):
    return listings.outcome(site_summary(spark, folder))


@query("broken_invariants", _SUMMARY + " select site from s where (completed and failure_count > 0) or (not completed and failure_count = 0) union all select 'own_board'")
def broken_invariants(spark, folder):
    return listings.broken_invariants(site_summary(spark, folder)).select("site")


@query("failures_in_order", "select site, log_id as sequence, row_number() over (order by log_id) as place from job_log where log_id % 97 = 0")
def failures_in_order(spark, folder):
    return listings.failures_in_order(_events(spark, folder)).select("site", "sequence", "place")


@query("board_hosts", f"select k as spelling, d as domain, c as code, h as host from (values {', '.join(str((k, BOARD_DOMAIN[n][0], BOARD_DOMAIN[n][1], REVIEW_HOST.get(n) or '')) for k, n in COUNTRY_OF.items())}) as t(k, d, c, h)")
def board_hosts(spark, folder):
    """Domain, country code and review host of each spelling of a country."""
    spellings = spark.createDataFrame([(k,) for k in COUNTRY_OF], "spelling string")
    country = places.country_named(F.col("spelling"))
    return spellings.select("spelling", places.board_domain(country).alias("domain"), places.board_country_code(country).alias("code"), F.coalesce(places.review_host(country), F.lit("")).alias("host"))


@query(
    "normalized_with_inference",
    """select post_id, case when compensation is not null then coalesce(salary_source, 'direct_data') when post_id % 2 = 0 then 'description' else salary_source end as source,
            case when compensation is not null or post_id % 2 = 0 then 'yearly' end as interval, case when compensation is not null then round(compensation.min_amount * f, 2) when post_id % 2 = 0 then 41600.0 end as low,
            case when compensation is not null then case when salary_source = 'description' then left(salary_provenance.evidence, 160) end when post_id % 2 = 0 then '$20 - $30 per hour' else salary_provenance.evidence end as evidence
        from (select *, case compensation.interval when 'hourly' then 2080 when 'daily' then 260 when 'weekly' then 52 when 'monthly' then 12 else 1 end as f from job_posts)""",
)
def normalized_with_inference(spark, folder):
    """Pay by the year, from the description where nothing else states it."""
    said = F.when(F.col("post_id") % 2 == 0, F.lit("The pay is $20 - $30 per hour.")).otherwise("No word of it")
    posts = listings.normalize(_posts(spark, folder).withColumn("description", said), annual=True, infer=True, country="USA")
    return posts.select("post_id", F.col("salary_source").alias("source"), F.col("compensation.interval").alias("interval"), F.round("compensation.min_amount", 2).alias("low"), F.col("salary_provenance.evidence").alias("evidence"))


assert len(RESULT_NAMES) == 37
