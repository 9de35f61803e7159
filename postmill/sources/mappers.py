"""Raw payloads of the eight boards to listings.

Each ``from_<board>`` takes a frame with a column ``raw`` (JSON text, or HTML for boards that send
pages) and gives the fields of POST_SCHEMA with ``site``.  JSON is parsed with a fixed schema and
mapped by native columns; HTML cards are taken apart in Arrow batches, and mapped natively from
there on.  A payload that can't be read gives a row in which ``title`` or ``job_url`` is null, for
``validity`` to sort out; it never fails the batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import dates, places, salary, text, url
from postmill.sources.cards import bayt_card, bdjobs_card, bdjobs_detail, linkedin_card, linkedin_detail
from postmill.vocabulary import POST_SCHEMA

POST_FIELDS = [tuple(part.strip().split(" ", 1)) for part in re.split(r",\s*(?![^<]*>)", POST_SCHEMA)]


def _post(df: DataFrame, site: str, keep: tuple[str, ...] = ("sequence", "meta"), **fields: Column) -> DataFrame:
    """All fields of a listing, those not given as null."""
    columns = [fields.get(n, F.lit(None)).cast(k).alias(n) for n, k in POST_FIELDS]
    return df.select(F.lit(site).alias("site"), *columns, *[c for c in keep if c in df.columns])


def _html_fields(description: Column) -> dict[str, Column]:
    return {"description": description, "emails": text.tidy_emails(text.emails_in(description))}


# What the boards' payloads hold.
INDEED = (
    "key string, title string, datePublished double, description struct<html:string>, "
    "location struct<countryCode:string,admin1Code:string,city:string,formatted:struct<short:string,long:string>>, "
    "compensation struct<estimated:struct<currencyCode:string,baseSalary:struct<unitOfWork:string,range:struct<min:double,max:double>>>,"
    "baseSalary:struct<unitOfWork:string,range:struct<min:double,max:double>>,currencyCode:string>, "
    "attributes array<struct<key:string,label:string>>, "
    "employer struct<relativeCompanyPageUrl:string,name:string,dossier:struct<employerDetails:struct<addresses:array<string>,"
    "industry:string,employeesLocalizedLabel:string,revenueLocalizedLabel:string,briefDescription:string>,"
    "images:struct<headerImageUrl:string,squareLogoUrl:string>,links:struct<corporateWebsite:string>>>, recruit struct<viewJobUrl:string>"
)


def from_indeed(df: DataFrame, as_of: Column, kind: str = "markdown", base: str = "https://www.indeed.com", **_) -> DataFrame:
    j = df.withColumn("j", F.from_json("raw", INDEED))
    c, d = F.col("j.compensation"), F.col("j.employer.dossier")
    said = F.coalesce(c["baseSalary"], c["estimated"]["baseSalary"])
    whole = lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))
    known = F.upper(said["unitOfWork"]).isin("DAY", "YEAR", "HOUR", "WEEK", "MONTH")
    pay = salary.pay(
        F.when(known, salary.period_named(said["unitOfWork"])), whole(said["range"]["min"]), whole(said["range"]["max"]),
        F.coalesce(F.nullif(c["estimated"]["currencyCode"], F.lit("")), c["currencyCode"]),
    )
    description = text.formatted(F.coalesce(F.col("j.description.html"), F.lit("")), kind)
    labels = F.transform(F.col("j.attributes"), lambda a: a["label"])
    j = j.withColumn("text", description).withColumn("pay", pay)
    industry = F.trim(F.initcap(F.replace(F.replace(d["employerDetails"]["industry"], F.lit("Iv1"), F.lit("")), F.lit("_"), F.lit(" "))))
    return _post(
        j, "indeed",
        id=F.concat(F.lit("in-"), F.col("j.key")), title=F.col("j.title"), company_name=F.col("j.employer.name"),
        job_url=F.concat(F.lit(f"{base}/viewjob?jk="), F.col("j.key")),
        job_url_direct=F.col("j.recruit.viewJobUrl"),
        location=places.place(F.col("j.location.city"), F.col("j.location.admin1Code"), F.col("j.location.countryCode")),
        company_url=F.concat(F.lit(base), F.nullif(F.col("j.employer.relativeCompanyPageUrl"), F.lit(""))),
        company_url_direct=d["links"]["corporateWebsite"],
        job_type=F.coalesce(F.array_compact(F.transform(labels, text.job_type_named)), F.array()),
        compensation=F.col("pay"),
        salary_source=F.when(F.col("pay").isNotNull(), F.when(c["baseSalary"].isNotNull(), "direct_data").otherwise("estimated")),
        date_posted=dates.epoch_millis_date(F.col("j.datePublished")),
        is_remote=text.mentions_remote(F.array_join(labels, " | "), F.col("text"), F.col("j.location.formatted.long")),
        company_industry=F.nullif(industry, F.lit("")), company_addresses=F.try_element_at(d["employerDetails"]["addresses"], F.lit(1)),
        company_num_employees=d["employerDetails"]["employeesLocalizedLabel"], company_revenue=d["employerDetails"]["revenueLocalizedLabel"],
        company_description=d["employerDetails"]["briefDescription"], company_logo=d["images"]["squareLogoUrl"],
        banner_photo_url=d["images"]["headerImageUrl"], **_html_fields(F.col("text")),
    )


ZIP = (
    "listing_key string, name string, job_description string, buyer_type string, hiring_company struct<name:string>, "
    "job_country string, job_city string, job_state string, employment_type string, posted_time string, "
    "compensation_interval string, compensation_min string, compensation_max string, compensation_currency string, "
    "remote boolean, full_description string, job_url_direct string"
)


def from_zip_recruiter(df: DataFrame, as_of: Column, kind: str = "markdown", base: str = "https://www.ziprecruiter.com", **_) -> DataFrame:
    """The full description of the detail page, where there is one, replaces the short one."""
    j = df.withColumn("j", F.from_json("raw", ZIP))
    raw = F.coalesce(F.nullif(F.col("j.full_description"), F.lit("")), F.trim(F.coalesce("j.job_description", F.lit(""))))
    code = F.upper(F.coalesce("j.job_country", F.lit("")))
    country = F.when(code == "US", "USA").when(code == "CA", "CANADA").when(code == "", "WORLDWIDE").otherwise(code)
    pay = salary.pay(
        salary.period_named(F.col("j.compensation_interval")), F.col("j.compensation_min").try_cast("double"),
        F.col("j.compensation_max").try_cast("double"), F.col("j.compensation_currency"),
    )
    named = text.job_type_exact(F.lower(F.replace(F.col("j.employment_type"), F.lit("_"), F.lit(""))))
    j = j.withColumn("text", text.formatted(raw, kind)).withColumn("pay", pay)
    return _post(
        j, "zip_recruiter",
        id=F.concat(F.lit("zr-"), F.nullif(F.col("j.listing_key"), F.lit(""))), title=F.col("j.name"), company_name=F.col("j.hiring_company.name"),
        job_url=F.concat(F.lit(f"{base}/jobs/j?lvk="), F.nullif(F.col("j.listing_key"), F.lit(""))), job_url_direct=F.col("j.job_url_direct"),
        location=places.place(F.col("j.job_city"), F.col("j.job_state"), country), job_type=F.when(named.isNotNull(), F.array(named)),
        compensation=F.col("pay"), salary_source=F.when(F.col("pay").isNotNull(), "direct_data"),
        date_posted=dates.iso_date(F.col("j.posted_time")), listing_type=F.coalesce("j.buyer_type", F.lit("")),
        is_remote=F.coalesce("j.remote", F.lit(False)) | F.lower("text").contains("remote"), **_html_fields(F.col("text")),
    )


GLASSDOOR = (
    "jobview struct<job:struct<listingId:bigint,jobTitleText:string>,header:struct<employerNameFromSearch:string,"
    "employer:struct<id:bigint>,locationName:string,locationType:string,ageInDays:int,payPeriod:string,payCurrency:string,"
    "payPeriodAdjustedPay:struct<p10:double,p90:double>,salarySource:string,adOrderSponsorshipLevel:string>,"
    "overview:struct<squareLogoUrl:string>>, description string"
)


def from_glassdoor(df: DataFrame, as_of: Column, kind: str = "markdown", base: str = "https://www.glassdoor.com/", country: str = "USA", **_) -> DataFrame:
    j = df.withColumn("j", F.from_json("raw", GLASSDOOR)).withColumn("h", F.col("j.jobview.header"))
    h = F.col("h")
    name = F.coalesce(h["locationName"], F.lit(""))
    remote = (F.lower(F.trim(name)) == "remote") | F.coalesce(h["locationType"] == "REMOTE", F.lit(False))
    pay = salary.pay(
        salary.period_named(h["payPeriod"]), h["payPeriodAdjustedPay"]["p10"], h["payPeriodAdjustedPay"]["p90"],
        F.coalesce(F.nullif(h["payCurrency"], F.lit("")), F.lit("USD")),
    )
    j = j.withColumn("text", text.formatted(F.col("j.description"), kind)).withColumn("pay", pay)
    ident = F.col("j.jobview.job.listingId").cast("string")
    return _post(
        j, "glassdoor",
        id=F.concat(F.lit("gd-"), ident), title=F.col("j.jobview.job.jobTitleText"), company_name=h["employerNameFromSearch"],
        job_url=F.concat(F.lit(f"{base}job-listing/j?jl="), ident),
        company_url=F.when(h["employer"]["id"] != 0, F.concat(F.lit(f"{base}Overview/W-EI_IE"), h["employer"]["id"].cast("string"), F.lit(".htm"))),
        location=F.when(~remote, places.by_comma_blank(name, F.lit(country))), is_remote=remote, compensation=F.col("pay"),
        salary_source=F.when(F.col("pay").isNotNull(), F.when(F.lower(h["salarySource"]).contains("estimate"), "estimated").otherwise("direct_data")),
        date_posted=dates.days_ago(h["ageInDays"], as_of), company_logo=F.col("j.jobview.overview.squareLogoUrl"),
        listing_type=F.lower(F.coalesce(h["adOrderSponsorshipLevel"], F.lit(""))), **_html_fields(F.col("text")),
    )


def from_google(df: DataFrame, as_of: Column, **_) -> DataFrame:
    """Rows by position: 0 title, 1 employer, 2 place, 3 addresses, 12 age, 19 description, 28 id."""
    v = df.withColumn("v", F.try_parse_json("raw"))
    get = lambda path: F.try_variant_get("v", path, "string")
    is_text = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant")) == "STRING"
    string_at = lambda path: F.when(is_text(path), get(path))
    long_enough = F.try_variant_get("v", "$[19]", "variant").isNotNull()
    link = string_at("$[3][0][0]")
    v = v.select("*", F.when(long_enough, string_at("$[0]")).alias("t"), F.when(long_enough, link).alias("u"), F.coalesce(string_at("$[19]"), F.lit("")).alias("text"))
    ident = F.coalesce(F.concat(F.lit("go-"), F.nullif(get("$[28]"), F.lit(""))), url.stable_id(F.lit("google"), F.col("u")))
    return _post(
        v, "google",
        id=F.when(F.col("u").isNotNull(), ident), title=F.col("t"), job_url=F.col("u"), company_name=string_at("$[1]"),
        location=places.region_or_rest(string_at("$[2]")), date_posted=dates.relative_date(string_at("$[12]"), as_of),
        is_remote=text.remote_word(F.col("text")), description=F.nullif(F.col("text"), F.lit("")),
        emails=text.tidy_emails(text.emails_in(F.col("text"))), job_type=text.job_types_described(F.col("text")),
    )


NAUKRI = (
    "jobId string, title string, companyName string, jdURL string, staticUrl string, jobDescription string, "
    "placeholders array<struct<type:string,label:string>>, footerPlaceholderLabel string, createdDate bigint, "
    "ambitionBoxData struct<AggregateRating:string,ReviewsCount:string>, vacancy string, tagsAndSkills string, "
    "logoPathV3 string, logoPath string, experienceText string"
)


def _by_class(source: Column, tag_class: str) -> Column:
    inner = F.regexp_extract(source, rf'(?s)<span[^<>]*class="{tag_class}"[^<>]*>(.*?)</span>', 1)
    return F.nullif(F.trim(F.regexp_replace(inner, "<[^<>]*>", "")), F.lit(""))


def from_naukri(df: DataFrame, as_of: Column, kind: str = "markdown", **_) -> DataFrame:
    j = df.withColumn("j", F.from_json("raw", NAUKRI))
    label = lambda what: F.try_element_at(F.filter(F.col("j.placeholders"), lambda p: p["type"] == what), F.lit(1))["label"]
    raw = F.coalesce("j.jobDescription", F.lit(""))
    low, high = salary.lakh_range(F.trim(label("salary")))
    pay = F.when(low.isNotNull(), salary.pay(F.lit("yearly"), low, high, F.lit("INR")))
    j = j.withColumn("text", text.formatted(raw, kind)).withColumn("pay", pay)
    path = F.coalesce(F.nullif(F.col("j.jdURL"), F.lit("")), F.nullif(F.col("j.staticUrl"), F.lit("")), F.concat(F.lit("job/"), F.col("j.jobId")))
    link = F.when(path.rlike("^https?://"), path).otherwise(F.concat(F.lit("https://www.naukri.com/"), F.regexp_replace(path, "^/+", "")))
    place = places.city_then_state(label("location"), F.lit("INDIA"))
    named = text.job_type_exact(F.replace(F.lower(_by_class(raw, "job-type")), F.lit("-"), F.lit("")))
    return _post(
        j, "naukri",
        id=F.concat(F.lit("nk-"), F.col("j.jobId")), title=F.when(F.length(F.trim("j.title")) > 0, F.col("j.title")),
        company_name=F.col("j.companyName"), job_url=link, location=place, compensation=F.col("pay"),
        salary_source=F.when(F.col("pay").isNotNull(), "direct_data"),
        is_remote=text.mentions_remote(F.col("j.title"), F.col("text"), places.shown(place)),
        date_posted=dates.label_or_created(F.col("j.footerPlaceholderLabel"), F.col("j.createdDate"), as_of),
        job_type=F.when(named.isNotNull(), F.array(named)), company_industry=_by_class(raw, "industry"),
        company_logo=F.coalesce(F.nullif(F.col("j.logoPathV3"), F.lit("")), F.col("j.logoPath")), skills=text.split_list(F.col("j.tagsAndSkills")),
        experience_range=F.col("j.experienceText"), company_rating=salary.first_number(F.col("j.ambitionBoxData.AggregateRating")),
        company_reviews_count=salary.first_number(F.col("j.ambitionBoxData.ReviewsCount")).cast("bigint"),
        vacancy_count=salary.first_number(F.col("j.vacancy")).cast("bigint"),
        work_from_home_type=text.office_kind(label("location"), F.col("j.title"), F.col("text")),
        description=F.nullif(F.col("text"), F.lit("")), emails=text.tidy_emails(text.emails_in(F.col("text"))),
    )


# -- boards that send pages --------------------------------------------------------------------------


def _cards(df: DataFrame, read: Callable[[str], dict], fields: tuple[str, ...], detail: Callable | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Adds STRUCT ``c`` (and ``d``) of what a card (and its detail page) says, in Arrow batches."""
    schema = ", ".join(f"{f} string" for f in fields + tuple(f"d_{m}" for m in more))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for card, page in batches:
            rows = []
            for c, p in zip(card, page):
                got = read(c) if c else {}
                extra = detail(p) if detail else {}
                rows.append([got.get(f) for f in fields] + [extra.get(m) for m in more])
            yield pd.DataFrame(rows, columns=[*fields, *(f"d_{m}" for m in more)], dtype="object")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(run, schema)
    page = F.col("detail") if "detail" in df.columns else F.lit(None).cast("string")
    return df.withColumn("c", udf(F.col("raw"), page))


def from_linkedin(df: DataFrame, as_of: Column, country: str = "WORLDWIDE", base: str = "https://www.linkedin.com", **_) -> DataFrame:
    more = ("level", "function", "industry", "type", "direct", "logo", "description")
    j = _cards(df, linkedin_card, ("key", "title", "company", "link", "place", "date", "pay"), linkedin_detail, more)
    place = places.region_or_country(F.col("c.place"), F.lit(country))
    named = text.job_type_exact(F.col("c.d_type"))
    j = j.withColumn("paid", salary.card_pay(F.col("c.pay")))
    about = F.concat_ws(" ", F.col("c.title"), F.coalesce("c.d_description", F.lit("None")), places.shown(place))
    return _post(
        j, "linkedin",
        id=F.concat(F.lit("li-"), F.col("c.key")), title=F.col("c.title"), company_name=F.col("c.company"), company_url=F.col("c.link"),
        job_url=F.concat(F.lit(f"{base}/jobs/view/"), F.col("c.key")), location=place, date_posted=dates.plain_date(F.col("c.date")),
        is_remote=text.mentions_remote(about), compensation=F.col("paid"), salary_source=F.when(F.col("paid").isNotNull(), "direct_data"),
        job_type=F.when(named.isNotNull(), F.array(named)), job_level=F.col("c.d_level"), company_industry=F.col("c.d_industry"),
        job_url_direct=F.col("c.d_direct"), company_logo=F.col("c.d_logo"), job_function=F.col("c.d_function"), **_html_fields(F.col("c.d_description")),
    )


def from_bayt(df: DataFrame, as_of: Column, **_) -> DataFrame:
    j = _cards(df, bayt_card, ("title", "company", "place", "link"))
    return _post(
        j, "bayt",
        id=url.stable_id(F.lit("bayt"), F.col("c.link")), title=F.col("c.title"), company_name=F.col("c.company"),
        job_url=F.col("c.link"), location=places.country_last(F.col("c.place")),
    )


def from_bdjobs(df: DataFrame, as_of: Column, **_) -> DataFrame:
    j = _cards(df, bdjobs_card, ("title", "link", "company", "place", "date"), bdjobs_detail, ("description", "type", "industry"))
    place = places.without_country(F.col("c.place"))
    number = F.nullif(F.regexp_extract("c.link", r"(?i)[?&]jobid=([^&#]+)", 1), F.lit(""))
    ident = F.coalesce(F.concat(F.lit("bd-"), number), url.stable_id(F.lit("bdjobs"), F.col("c.link")))
    named = text.job_type_named(F.col("c.d_type"))
    return _post(
        j, "bdjobs",
        id=F.when(F.col("c.link").isNotNull(), ident), title=F.col("c.title"), company_name=F.col("c.company"), job_url=F.col("c.link"),
        location=place, date_posted=dates.published_date(F.col("c.date")), job_type=F.when(named.isNotNull(), F.array(named)),
        is_remote=text.mentions_remote(F.col("c.title"), F.col("c.d_description"), places.shown(place), more=("home based",)),
        company_industry=F.col("c.d_industry"), **_html_fields(F.col("c.d_description")),
    )


MAPPERS: dict[str, Callable[..., DataFrame]] = {
    "indeed": from_indeed, "linkedin": from_linkedin, "zip_recruiter": from_zip_recruiter, "glassdoor": from_glassdoor,
    "google": from_google, "bayt": from_bayt, "naukri": from_naukri, "bdjobs": from_bdjobs,
}


def map_raw(raw: DataFrame, as_of: Column, sites: list[str] | None = None, **how) -> DataFrame:
    """Listings of all sites in a frame with ``site``, ``raw`` and, for some, ``detail``."""
    out = None
    for site in sites or list(MAPPERS):
        part = MAPPERS[site](raw.where(F.col("site") == site), as_of, **how)
        out = part if out is None else out.unionByName(part)
    return out
