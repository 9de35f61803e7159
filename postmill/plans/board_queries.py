"""Queries of the sources and the stream: every post is written as the payload of each board, mapped back
by that board's mapper, and compared with what SQL tells of the post itself.

The last queries record the payloads as pages in the shared checkpoint folder and run the data
sources, the search and the log over them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import api
from postmill.plans.listing_queries import AS_OF, _as_of, _values, query
from postmill.request import SearchRequest
from postmill.session import ensure_checkpoint_dir, ship_package, table
from postmill.sources.mappers import MAPPERS
from postmill.sources.registry import default_registry
from postmill.streaming.listing_stream import EventLog
from postmill.vocabulary import COUNTRY_OF, lookup

#: Days that posts of the test data may lie back.
_AGE = f"datediff(date'{AS_OF}', date_posted)"


def _js(text: Column) -> Column:
    """A text as JSON, quoted; null as null."""
    packed = F.to_json(F.array(text))
    return F.substr(packed, F.lit(2), F.length(packed) - 2)


def _html(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return F.coalesce(text, F.lit(""))


def _c(name: str) -> Column:
    return F.col(name)


_UNITS = {"hourly": "HOUR", "daily": "DAY", "weekly": "WEEK", "monthly": "MONTH", "yearly": "YEAR"}


def _unit() -> Column:
    return F.coalesce(lookup(_UNITS, _c("compensation.interval")), F.upper("compensation.interval"))


def _label() -> Column:
    """Kinds of work as boards spell them."""
    return F.transform("job_type", lambda t: F.when(t == "fulltime", F.lit("Full-Time")).when(t == "parttime", F.lit("Part time")).otherwise(t))


def _indeed() -> Column:
    base = F.struct(_unit().alias("unitOfWork"), F.struct(_c("compensation.min_amount").alias("min"), _c("compensation.max_amount").alias("max")).alias("range"))
    code = _c("compensation.currency").alias("currencyCode")
    stated = F.when(F.col("post_id") % 2 == 0, F.struct(base.alias("baseSalary"), code))
    guessed = F.when(F.col("post_id") % 2 == 1, F.struct(F.struct(base.alias("baseSalary"), code).alias("estimated")))
    paid = F.coalesce(F.to_json(F.when(_c("compensation").isNotNull(), stated)), F.to_json(F.when(_c("compensation").isNotNull(), guessed)))
    rest = F.to_json(F.struct(
        _c("post_id").cast("string").alias("key"), "title", F.unix_millis(_c("date_posted").cast("timestamp")).alias("datePublished"), F.struct(_c("description").alias("html")).alias("description"),
        F.struct(_c("location.country").alias("countryCode"), _c("location.state").alias("admin1Code"), _c("location.city").alias("city")).alias("location"),
        F.transform(_label(), lambda t: F.struct(t.alias("label"))).alias("attributes"),
        F.struct(_c("company_name").alias("name"), F.struct(F.struct(F.concat(F.lit("Iv1"), F.replace(F.upper("company_industry"), F.lit(" "), F.lit("_"))).alias("industry")).alias("employerDetails")).alias("dossier")).alias("employer"),
    ))
    return F.when(paid.isNull(), rest).otherwise(F.concat(F.lit('{"compensation":'), paid, F.lit(","), F.substr(rest, F.lit(2))))


def _zip() -> Column:
    country = F.when(_c("location.country") == "USA", "us").when(_c("location.country") == "Canada", "CA").otherwise(_c("location.country"))
    kind = F.try_element_at("job_type", F.lit(1))
    return F.to_json(F.struct(
        _c("post_id").cast("string").alias("listing_key"), _c("title").alias("name"), _c("description").alias("job_description"), F.struct(_c("company_name").alias("name")).alias("hiring_company"),
        country.alias("job_country"), _c("location.city").alias("job_city"), _c("location.state").alias("job_state"), F.when(kind == "fulltime", "full_time").when(kind == "parttime", "PART_TIME").otherwise(kind).alias("employment_type"),
        F.concat(_c("date_posted").cast("string"), F.lit("T23:30:00Z")).alias("posted_time"), F.lower(_unit()).alias("compensation_interval"), _c("compensation.min_amount").cast("string").alias("compensation_min"),
        _c("compensation.max_amount").cast("string").alias("compensation_max"), F.lower("compensation.currency").alias("compensation_currency"), _c("is_remote").alias("remote"),
    ))


def _glassdoor() -> Column:
    header = F.struct(
        _c("company_name").alias("employerNameFromSearch"), F.struct(_c("post_id").alias("id")).alias("employer"), F.concat_ws(", ", "location.city", "location.state").alias("locationName"),
        F.when(_c("is_remote"), "REMOTE").otherwise("CITY").alias("locationType"), F.expr(_AGE).alias("ageInDays"), F.when(_unit() == "YEAR", "ANNUAL").otherwise(_unit()).alias("payPeriod"),
        _c("compensation.currency").alias("payCurrency"), F.struct(_c("compensation.min_amount").alias("p10"), _c("compensation.max_amount").alias("p90")).alias("payPeriodAdjustedPay"),
        F.when(F.col("post_id") % 3 == 0, "ESTIMATED").otherwise("EMPLOYER_PROVIDED").alias("salarySource"), F.upper("listing_type").alias("adOrderSponsorshipLevel"),
    )
    return F.to_json(F.struct(F.struct(F.struct(_c("post_id").alias("listingId"), _c("title").alias("jobTitleText")).alias("job"), header.alias("header")).alias("jobview")))


def _google() -> Column:
    days = F.expr(_AGE)
    age = F.when(days == 0, "Just posted").when(days % 30 == 0, F.concat((days / 30).cast("int").cast("string"), F.lit(" months ago"))).when(days % 7 == 0, F.concat((days / 7).cast("int").cast("string"), F.lit(" WEEKS ago"))).otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    place = F.concat_ws(", ", "location.city", "location.state", "location.country")
    none = F.lit("null")
    cells = [_js(_c("title")), _js(_c("company_name")), _js(place), F.concat(F.lit("[["), _js(_c("job_url")), F.lit("]]")), *[none] * 8, _js(age), *[none] * 6, _js(_c("description")), *[none] * 8, _js(_c("post_id").cast("string"))]
    return F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]"))


def _naukri() -> Column:
    n = F.col("post_id") % 7
    pay = F.when(n == 0, "Not disclosed").when(n == 1, F.concat((n + 2).cast("string"), F.lit(".5 - 9 Cr P.A."))).otherwise(F.concat((n + 2).cast("string"), F.lit("-"), (n + 9).cast("string"), F.lit(".25 Lacs PA")))
    label = F.element_at(F.array(F.lit("Just now"), F.lit("3 Days Ago"), F.lit("2 Weeks Ago"), F.lit("1 Month Ago"), F.lit("30+ Days Ago"), F.lit("Recently"), F.lit(None)), (n + 1).cast("int"))
    marks = F.array(F.struct(F.lit("experience").alias("type"), F.lit("2-4 Yrs").alias("label")), F.struct(F.lit("salary").alias("type"), pay.alias("label")), F.struct(F.lit("location").alias("type"), F.concat_ws(", ", "location.city", "location.state").alias("label")))
    return F.to_json(F.struct(
        _c("post_id").cast("string").alias("jobId"), "title", _c("company_name").alias("companyName"), F.when(n < 3, F.concat(F.lit("//jd-"), _c("post_id").cast("string"))).alias("jdURL"), marks.alias("placeholders"), label.alias("footerPlaceholderLabel"),
        F.unix_millis(_c("date_posted").cast("timestamp")).alias("createdDate"), F.array_join("skills", " , ").alias("tagsAndSkills"), F.concat(F.format_number(F.col("post_id") * 7, 0), F.lit(" vacancies")).alias("vacancy"),
    ))


def _linkedin() -> tuple[Column, Column]:
    pay = _c("compensation")
    unit = F.when(pay["interval"] == "hourly", "/hr").when(pay["interval"] == "monthly", "/mo").when(pay["interval"] == "weekly", "/wk").when(pay["interval"] == "daily", "/day").otherwise("/yr")
    sign = F.when(pay["currency"] == "EUR", "€").when(pay["currency"] == "GBP", "£").when(pay["currency"] == "INR", "₹").otherwise("$")
    said = F.concat(sign, F.format_number(pay["min_amount"], 2), unit, F.lit(" – "), sign, F.format_number(pay["max_amount"], 2), unit)
    span = F.when(said.isNotNull(), F.concat(F.lit('<span class="job-search-card__salary-info">'), said, F.lit("</span>")))
    # an empty list tells of no place at all
    place = F.concat_ws(", ", "location.city", "location.state", "location.country")
    time = F.when(_c("date_posted").isNotNull(), F.concat(F.lit('<time class="job-search-card__listdate" datetime="'), _c("date_posted").cast("string"), F.lit('">x</time>')))
    card = F.concat(
        F.lit('<div class="base-search-card"><a class="base-card__full-link" href="https://linkedin.example/view/some-job-'), _c("post_id").cast("string"), F.lit('?trk=1"></a><span class="sr-only"> '), _html(_c("title")),
        F.lit(' </span><h4 class="base-search-card__subtitle"><a href="https://linkedin.example/cmp/1?trk=2">'), _html(_c("company_name")), F.lit("</a></h4>"), F.coalesce(span, F.lit("")),
        F.lit('<div class="base-search-card__metadata"><span class="job-search-card__location">'), _html(place), F.lit("</span>"), F.coalesce(time, F.lit("")), F.lit("</div></div>"),
    )
    kind = F.replace(F.try_element_at(_label(), F.lit(1)), F.lit(" "), F.lit("-"))
    detail = F.concat(
        F.lit("<h3>Seniority level</h3><span class='description__job-criteria-text x'> "), _html(F.initcap("job_level")), F.lit(" </span><h3>Employment type</h3><span class='description__job-criteria-text'>"), _html(kind),
        F.lit("</span><h3>Industries</h3><span class='description__job-criteria-text'>"), _html(_c("company_industry")), F.lit("</span>"),
    )
    return card, detail


def _bayt() -> Column:
    place = F.concat_ws(", ", "location.city", "location.state", "location.country")
    return F.concat(
        F.lit('<li data-js-job><h2><a href="/en/job/'), _c("post_id").cast("string"), F.lit('/"> '), _html(_c("title")), F.lit('</a></h2><div class="t-nowrap p10l x"><span>'), _html(_c("company_name")),
        F.lit('</span></div><div class="t-mute t-small">'), _html(place), F.lit("</div></li>"),
    )


_DATES = ("d MMM yyyy", "d-MMM-yyyy", "d MMMM yyyy", "MMMM d, yyyy", "d/M/yyyy")


def _bdjobs() -> tuple[Column, Column]:
    written = F.element_at(F.array(*[F.date_format("date_posted", f) for f in _DATES]), (F.col("post_id") % 5 + 1).cast("int"))
    said = F.concat(F.when(F.col("post_id") % 11 == 0, "Deadline: ").otherwise("Published: "), written)
    card = F.concat(
        F.lit('<div class="job-item"><a href="jobdetails.asp?JobID='), _c("post_id").cast("string"), F.lit('&x=1">'), _html(_c("title")), F.lit('</a><div class="comp-name-text">'), _html(_c("company_name")),
        F.lit('</div><div class="locon-text-d">'), _html(F.concat_ws(", ", "location.city", "location.state", F.lit("Bangladesh"))), F.lit('</div><span class="published">'), F.coalesce(said, F.lit("")), F.lit("</span></div>"),
    )
    detail = F.concat(F.lit("<div class='jobcontent'><script>x</script><p>"), _html(_c("title")), F.lit("</p> home based</div><span>Job type:</span><span>"), _html(F.try_element_at(_label(), F.lit(1))), F.lit("</span>"))
    return card, detail


def raw_of(site: str) -> tuple[Column, Column]:
    """``raw, detail`` of a post as that board would send it."""
    made = {"indeed": _indeed, "zip_recruiter": _zip, "glassdoor": _glassdoor, "google": _google, "naukri": _naukri, "linkedin": _linkedin, "bayt": _bayt, "bdjobs": _bdjobs}[site]()
    return made if isinstance(made, tuple) else (made, F.lit(None).cast("string"))


def _mapped(spark: SparkSession, folder: str, site: str, kind: str = "html") -> DataFrame:
    raw, detail = raw_of(site)
    sent = table(spark, folder, "job_posts").select(F.lit(site).alias("site"), F.col("post_id").alias("sequence"), raw.alias("raw"), detail.alias("detail"))
    return MAPPERS[site](sent, _as_of(), kind=kind)


def _shown(df: DataFrame, *names: str) -> DataFrame:
    """The columns that a query compares, structs taken apart."""
    parts = {
        "place": [F.col(f"location.{c}").alias(c) for c in ("city", "state", "country")],
        "pay": [F.col(f"compensation.{c}").alias(c) for c in ("interval", "min_amount", "max_amount", "currency")],
        "kinds": [F.array_join("job_type", ",").alias("kinds")],
        "skills": [F.array_join("skills", "|").alias("skills")],
    }
    return df.select(F.col("sequence").alias("post_id"), *[c for n in names for c in parts.get(n, [F.col(n)])])


# -- SQL -----------------------------------------------------------------------------------------------

_KNOWN = "('hourly', 'daily', 'weekly', 'monthly', 'yearly')"
_ISO_CODE = r"case upper(trim(compensation.currency)) when '$' then 'USD' when '€' then 'EUR' when '£' then 'GBP' when '₹' then 'INR' when '৳' then 'BDT' else case when regexp_matches(upper(trim(compensation.currency)), '^\p{L}{3}$') then upper(trim(compensation.currency)) end end"


def _pay_sql(low: str = "compensation.min_amount", high: str = "compensation.max_amount", code: str = _ISO_CODE) -> str:
    sound = f"compensation.interval in {_KNOWN} and ({code}) is not null and coalesce({low}, {high}) is not null and coalesce({low} <= {high}, true) and coalesce({low} >= 0, true) and coalesce({high} >= 0, true)"
    return f"case when {sound} then compensation.interval end as interval, case when {sound} then {low} end as min_amount, case when {sound} then {high} end as max_amount, case when {sound} then {code} end as currency, ({sound}) as _sound"


def _posts_sql(pay: str = "", more: str = "") -> str:
    return f"(select *{', ' + pay if pay else ''}{', ' + more if more else ''} from job_posts)"


_FIRST_KIND = "job_type[1]"
_LIVE = "list_filter([location.city, location.state, location.country], lambda x: x is not null)"


@query(
    "mapped_indeed",
    f"""select post_id, 'in-' || post_id as id, title, company_name, 'https://www.indeed.com/viewjob?jk=' || post_id as job_url, location.city as city, location.state as state, location.country as country, interval, min_amount, max_amount, currency,
        case when _sound then case when post_id % 2 = 0 then 'direct_data' else 'estimated' end end as salary_source, date_posted, array_to_string(coalesce(job_type, []), ',') as kinds,
        (select string_agg(upper(w[1]) || lower(w[2:]), ' ' order by i) from (select unnest(string_split(company_industry, ' ')) as w, unnest(range(1, len(string_split(company_industry, ' ')) + 1)) as i)) as company_industry,
        regexp_matches(lower(concat_ws(' ', array_to_string(job_type, ' | '), description)), 'remote|work from home|wfh') as is_remote
        from {_posts_sql(_pay_sql("trunc(compensation.min_amount)", "trunc(compensation.max_amount)"))}""",
)
def mapped_indeed(spark, folder):
    return _shown(_mapped(spark, folder, "indeed"), "id", "title", "company_name", "job_url", "place", "pay", "salary_source", "date_posted", "kinds", "company_industry", "is_remote")


@query(
    "mapped_zip_recruiter",
    f"""select post_id, 'zr-' || post_id as id, title, company_name, 'https://www.ziprecruiter.com/jobs/j?lvk=' || post_id as job_url, location.city as city, location.state as state,
        case when coalesce(location.country, '') = '' then 'WORLDWIDE' else upper(location.country) end as country, interval, min_amount, max_amount, currency, case when _sound then 'direct_data' end as salary_source, date_posted, {_FIRST_KIND} as kinds,
        coalesce(is_remote, false) or coalesce(lower(trim(description)), '') like '%remote%' as is_remote from {_posts_sql(_pay_sql())}""",
)
def mapped_zip_recruiter(spark, folder):
    return _shown(_mapped(spark, folder, "zip_recruiter"), "id", "title", "company_name", "job_url", "place", "pay", "salary_source", "date_posted", "kinds", "is_remote")


@query(
    "mapped_glassdoor",
    f"""select post_id, 'gd-' || post_id as id, title, company_name, 'https://www.glassdoor.com/job-listing/j?jl=' || post_id as job_url, 'https://www.glassdoor.com/Overview/W-EI_IE' || post_id || '.htm' as company_url,
        case when _named then n[1] end as city, case when _named and len(n) > 1 then n[2] end as state, case when _named then 'USA' end as country, interval, min_amount, max_amount, currency,
        case when _sound then case when post_id % 3 = 0 then 'estimated' else 'direct_data' end end as salary_source, date_posted, coalesce(lower(listing_type), '') as listing_type, _remote as is_remote
        from (select *, len(n) > 0 and not _remote as _named from {_posts_sql(_pay_sql(code="coalesce(" + _ISO_CODE + ", case when coalesce(compensation.currency, '') = '' then 'USD' end)"), "list_filter([location.city, location.state], lambda x: x is not null) as n, coalesce(is_remote, false) as _remote")})""",
)
def mapped_glassdoor(spark, folder):
    return _shown(_mapped(spark, folder, "glassdoor"), "id", "title", "company_name", "job_url", "company_url", "place", "pay", "salary_source", "date_posted", "listing_type", "is_remote")


@query(
    "mapped_google",
    f"""select post_id, case when job_url is not null then 'go-' || post_id end as id, title, company_name, job_url, n[1] as city, case when len(n) > 2 or (len(n) = 2 and length(n[2]) <= 3 and upper(n[2]) = n[2]) then n[2] end as state,
        case when len(n) > 2 then array_to_string(n[3:], ', ') when len(n) = 2 and not (length(n[2]) <= 3 and upper(n[2]) = n[2]) then n[2] end as country, date_posted,
        case when coalesce(description, '') <> '' then nullif(concat_ws(',', case when regexp_matches(lower(description), 'full\\s?time') then 'fulltime' end, case when regexp_matches(lower(description), 'part\\s?time') then 'parttime' end,
            case when lower(description) like '%internship%' then 'internship' end, case when lower(description) like '%contract%' then 'contract' end), '') else '' end as kinds,
        coalesce(regexp_matches(lower(description), '\\b(remote|wfh)\\b'), false) as is_remote from {_posts_sql("", _LIVE + " as n")}""",
)
def mapped_google(spark, folder):
    return _shown(_mapped(spark, folder, "google"), "id", "title", "company_name", "job_url", "place", "date_posted", "kinds", "is_remote")


@query(
    "mapped_naukri",
    f"""select post_id, 'nk-' || post_id as id, title, company_name, 'https://www.naukri.com/' || case when post_id % 7 < 3 then 'jd-' else 'job/' end || post_id as job_url, n[1] as city, n[2] as state, 'INDIA' as country,
        case when post_id % 7 > 0 then 'yearly' end as interval, case when post_id % 7 = 1 then 35000000.0 when post_id % 7 > 1 then (post_id % 7 + 2) * 100000.0 end::double as min_amount,
        case when post_id % 7 = 1 then 90000000.0 when post_id % 7 > 1 then (post_id % 7 + 9.25) * 100000.0 end::double as max_amount, case when post_id % 7 > 0 then 'INR' end as currency, case when post_id % 7 > 0 then 'direct_data' end as salary_source,
        case post_id % 7 when 0 then date '{AS_OF}' when 1 then date '{AS_OF}' - 3 when 2 then date '{AS_OF}' - 14 when 3 then date '{AS_OF}' - 30 else date_posted end as date_posted,
        nullif(array_to_string(list_filter(list_transform(string_split(array_to_string(skills, ' , '), ','), lambda x: trim(x)), lambda x: x <> ''), '|'), '') as skills, post_id * 7 as vacancy_count
        from {_posts_sql("", "list_filter([location.city, location.state], lambda x: x is not null) as n")}""",
)
def mapped_naukri(spark, folder):
    return _shown(_mapped(spark, folder, "naukri"), "id", "title", "company_name", "job_url", "place", "pay", "salary_source", "date_posted", "skills", "vacancy_count")


_SIGN_CODE = "case when compensation.currency in ('EUR', 'GBP', 'INR') then compensation.currency else 'USD' end"


@query(
    "mapped_linkedin",
    f"""select post_id, 'li-' || post_id as id, nullif(trim(title), '') as title, coalesce(trim(company_name), '') as company_name, 'https://www.linkedin.com/jobs/view/' || post_id as job_url, nullif(n[1], '') as city,
        case when len(n) > 2 or (len(n) = 2 and length(n[2]) <= 3 and upper(n[2]) = n[2]) then n[2] end as state,
        case when len(n) > 2 then coalesce(m.v, n[3]) when len(n) = 2 and not (length(n[2]) <= 3 and upper(n[2]) = n[2]) then n[2] else 'WORLDWIDE' end as country,
        case when _sound then interval end as interval, case when _sound then min_amount end as min_amount, case when _sound then max_amount end as max_amount, case when _sound then currency end as currency, case when _sound then 'direct_data' end as salary_source,
        date_posted, {_FIRST_KIND} as kinds, nullif(lower(trim(job_level)), '') as job_level, nullif(trim(company_industry), '') as company_industry
        from (select *, case when {{place}} = '' then [] else string_split({{place}}, ', ') end as n, low is not null and high is not null and low <= high and low >= 0 as _sound,
                case when compensation.interval in {_KNOWN} then compensation.interval else 'yearly' end as interval, low as min_amount, high as max_amount, {_SIGN_CODE} as currency
              from (select *, round(compensation.min_amount, 2) as low, round(compensation.max_amount, 2) as high from job_posts)) p
        left join {_values(COUNTRY_OF)} on m.k = lower(trim(n[3]))""".replace("{place}", "concat_ws(', ', location.city, location.state, location.country)"),
)
def mapped_linkedin(spark, folder):
    return _shown(_mapped(spark, folder, "linkedin"), "id", "title", "company_name", "job_url", "place", "pay", "salary_source", "date_posted", "kinds", "job_level", "company_industry")


@query(
    "mapped_bayt",
    f"""select post_id, coalesce(trim(title), '') as title, coalesce(trim(company_name), '') as company_name, 'https://www.bayt.com/en/job/' || post_id || '/' as job_url, n[1] as city, case when len(n) > 2 then array_to_string(n[2:len(n) - 1], ', ') end as state,
        case when len(n) > 1 then n[len(n)] when len(n) = 1 then 'WORLDWIDE' end as country from {_posts_sql("", _LIVE + " as n")}""",
)
def mapped_bayt(spark, folder):
    return _shown(_mapped(spark, folder, "bayt"), "title", "company_name", "job_url", "place")


@query(
    "mapped_bdjobs",
    f"""select post_id, 'bd-' || post_id as id, nullif(trim(title), '') as title, nullif(trim(company_name), '') as company_name, 'https://jobs.bdjobs.com/jobdetails.asp?JobID=' || post_id || '&x=1' as job_url, coalesce(location.city, location.state, 'Bangladesh') as city,
        case when location.city is not null then location.state end as state, 'BANGLADESH' as country, case when post_id % 11 > 0 then date_posted end as date_posted, {_FIRST_KIND} as kinds, true as is_remote from job_posts""",
)
def mapped_bdjobs(spark, folder):
    return _shown(_mapped(spark, folder, "bdjobs"), "id", "title", "company_name", "job_url", "place", "date_posted", "kinds", "is_remote")


# -- sources and streams over recorded pages ---------------------------------------------------------------

_PAGE = 40
_RECORDED = ("zip_recruiter", "indeed")
_REQUEST = SearchRequest(sites=_RECORDED, results_wanted=100, max_pages=1000, description_format="html")


def record(spark: SparkSession, folder: str) -> str:
    """Posts of two boards as recorded pages in the shared folder, each post twice in a row."""
    target = f"{ensure_checkpoint_dir(spark).rstrip('/')}/recorded-{uuid.uuid4().hex}"
    for site in _RECORDED:
        posts = table(spark, folder, "job_posts").where(F.col("site") == site)
        page = F.floor(F.col("post_id") / _PAGE).cast("int") + 1
        sent = posts.select("post_id", page.alias("page"), F.struct(raw_of(site)[0].alias("raw")).alias("item"))
        # a page of a board is a row; its size is bounded
        pages = sent.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("post_id", "item"))).alias("i"))
        doubled = F.flatten(F.transform("i", lambda x: F.array(x["item"], x["item"])))
        line = F.to_json(F.struct("page", doubled.alias("items"), F.concat(F.lit("after-"), F.col("page").cast("string")).alias("cursor")))
        pages.repartitionByRange(3, "page").sortWithinPartitions("page").select(line.alias("value")).write.text(f"{target}/{site}.jsonl")
    return target


_SOUND = "length(trim(title)) > 0"
_OF_BOARDS = "job_posts where site in ('zip_recruiter', 'indeed')"


@query("replayed_pages", f"select site, post_id // {_PAGE} + 1 as page, count(*) * 2 as items from {_OF_BOARDS} group by all")
def replayed_pages(spark, folder):
    ship_package(spark)
    default_registry().install(spark)
    rows = spark.read.format("listing_replay").option("path", record(spark, folder)).load()
    return rows.where("kind = 'listing'").groupBy("site", F.col("page").cast("long").alias("page")).agg(F.countDistinct("sequence").alias("items"))


_FIRST = f"""select site, post_id from (select site, post_id, row_number() over (partition by site order by post_id) as r from {_OF_BOARDS} and {_SOUND}) where r <= 100"""


@query("search_offline", f"select site, case when site = 'indeed' then 'in-' else 'zr-' end || post_id as id from ({_FIRST})")
def search_offline(spark, folder):
    """The first hundred listings of each board, each once, through source, mapper, check, identity and limit."""
    return api.search(spark, _REQUEST, record(spark, folder), AS_OF).select("site", "id")


@query(
    "log_of_stream",
    f"""select site, type, count(*) as events from (
            select site, 'job' as type from ({_FIRST}) union all select site, 'progress' from (select distinct site, post_id // {_PAGE} from {_OF_BOARDS})
            union all select site, 'warning' from {_OF_BOARDS} and not coalesce({_SOUND}, false) union all select site, 'warning' from {_OF_BOARDS} and not coalesce({_SOUND}, false)) group by all""",
)
def log_of_stream(spark, folder):
    """Events of a stream that was run to its end, by site and type."""
    recorded = record(spark, folder)
    api.stream_to_log(spark, recorded, f"{recorded}-run", AS_OF, _REQUEST)
    return EventLog(spark, f"{recorded}-run/log").read().groupBy("site", "type").agg(F.count(F.lit(1)).alias("events"))


@query("collected_outcome", f"select site, count(*) as jobs_emitted, true as completed from ({_FIRST}) group by site")
def collected_outcome(spark, folder):
    """The outcome of a search whose events were acknowledged one by one."""
    got = api.collect_jobs(spark, record(spark, folder), AS_OF, _REQUEST)
    return spark.createDataFrame([(s.site, s.jobs_emitted, s.completed) for s in got.sites], "site string, jobs_emitted long, completed boolean")


@query(
    "filters_not_supported",
    f"""select site, 'filters not supported: ' || missing as warning from {_values({
        "indeed": "", "linkedin": "country", "zip_recruiter": "country", "glassdoor": "distance", "google": "country, distance, easy_apply", "bayt": "country, distance, easy_apply, hours_old, is_remote, job_type, location",
        "naukri": "country, distance, easy_apply, job_type", "bdjobs": "country, distance, easy_apply, hours_old, is_remote, job_type, location"}, "site", "missing")} where missing <> ''""",
)
def filters_not_supported(spark, folder):
    """What each board can't filter by, of a request that asks for all."""
    asked = SearchRequest(search_term="cook", location="Lyon", country="france", distance=9, is_remote=True, job_type="fulltime", easy_apply=True, hours_old=9, offset=3)
    return spark.createDataFrame(sorted(api.warnings_of(asked, default_registry()).items()), "site string, warning string")

