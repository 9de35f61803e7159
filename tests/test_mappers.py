import json

from pyspark.sql import functions as F

from postmill.functions.url import identity_of
from postmill.sources import cards as card_pages
from postmill.sources.mappers import MAPPERS, POST_FIELDS, map_raw


def _as_of():
    return F.lit("2025-07-01").cast("date")


def _one(spark, site, raw, detail=None, **how):
    df = spark.createDataFrame([(site, 1, raw if isinstance(raw, str) else json.dumps(raw), detail)], "site string, sequence bigint, raw string, detail string")
    return MAPPERS[site](df, _as_of(), **how).first()


def test_indeed_pay_source_and_place(spark):
    raw = {
        "key": "k1", "title": "Cook", "datePublished": 1735689600000, "description": {"html": "<p>Work from home</p> a@b.test"},
        "location": {"countryCode": "US", "admin1Code": "TX", "city": "Casper Mills", "formatted": {"long": "Casper Mills, TX"}},
        "compensation": {"estimated": {"currencyCode": "USD", "baseSalary": {"unitOfWork": "HOUR", "range": {"min": 20.9, "max": 30.2}}}},
        "attributes": [{"label": "Full-time"}, {"label": "odd"}],
        "employer": {"name": "Acme", "relativeCompanyPageUrl": "/cmp/acme", "dossier": {"employerDetails": {"industry": "Iv1FOOD_AND_DRINK", "addresses": ["1 Way", "2 Way"]}}},
    }
    r = _one(spark, "indeed", raw, kind="plain")
    assert (r.id, r.salary_source, r.compensation.min_amount, r.compensation.max_amount, r.compensation.interval) == ("in-k1", "estimated", 20.0, 30.0, "hourly")
    assert r.is_remote and r.job_type == ["fulltime"] and r.emails == ["a@b.test"] and str(r.date_posted) == "2025-01-01"
    assert (r.company_industry, r.company_addresses, r.company_url) == ("Food And Drink", "1 Way", "https://www.indeed.com/cmp/acme")
    assert r.description == "Work from home a@b.test"


def test_zip_country_codes_and_bad_numbers(spark):
    raw = {"listing_key": "z", "name": "Nurse", "job_country": "ca", "employment_type": "full_time", "posted_time": "2025-03-04T23:30:00Z",
           "compensation_interval": "hour", "compensation_min": "", "compensation_max": "40", "compensation_currency": "cad", "remote": True}
    r = _one(spark, "zip_recruiter", raw)
    assert (r.location.country, r.job_type, r.compensation.min_amount, r.compensation.max_amount, r.compensation.currency) == ("CANADA", ["fulltime"], None, 40.0, "CAD")
    assert str(r.date_posted) == "2025-03-04" and r.is_remote
    assert _one(spark, "zip_recruiter", {"name": "x"}).job_url is None


def test_glassdoor_age_estimates_and_remote(spark):
    header = {"employerNameFromSearch": "Acme", "employer": {"id": 7}, "locationName": "Berlin, Germany", "ageInDays": 5, "payPeriod": "ANNUAL", "payCurrency": "EUR",
              "payPeriodAdjustedPay": {"p10": 61500, "p90": 78250}, "salarySource": "EMPLOYER_ESTIMATED", "adOrderSponsorshipLevel": "SPONSORED"}
    raw = {"jobview": {"job": {"listingId": 417, "jobTitleText": "Dev"}, "header": header}}
    r = _one(spark, "glassdoor", raw)
    assert (r.id, r.location.city, r.location.state, str(r.date_posted), r.salary_source, r.listing_type) == ("gd-417", "Berlin", "Germany", "2025-06-26", "estimated", "sponsored")
    header["locationType"] = "REMOTE"
    assert _one(spark, "glassdoor", raw).location is None


def test_google_positions_and_hashed_id(spark):
    row = ["Dev", "Acme", "Austin, TX", [["https://x.test/a?b=1"]], *[None] * 8, "3 weeks ago", *[None] * 6, "full time, WFH", *[None] * 8, None]
    r = _one(spark, "google", row)
    assert r.id == identity_of("google", "https://x.test/a?b=1") and r.is_remote and r.job_type == ["fulltime"]
    assert (r.location.city, r.location.state, r.location.country, str(r.date_posted)) == ("Austin", "TX", None, "2025-06-10")
    assert _one(spark, "google", ["short"]).title is None and _one(spark, "google", "no json").title is None


def test_naukri_lakh_numbers_and_office(spark):
    raw = {"jobId": "5", "title": "Dev", "companyName": "Acme", "jdURL": "/jd-5", "jobDescription": '<span class="job-type">Full-Time</span> Hybrid',
           "placeholders": [{"type": "salary", "label": "12-15 Lacs PA"}, {"type": "location", "label": "Pune, Mahar, West"}],
           "footerPlaceholderLabel": "1 Week Ago", "ambitionBoxData": {"AggregateRating": "4.1", "ReviewsCount": "1,234 reviews"}, "vacancy": "3", "tagsAndSkills": "sql, , spark"}
    r = _one(spark, "naukri", raw)
    assert (r.compensation.min_amount, r.compensation.max_amount, r.compensation.currency) == (1_200_000, 1_500_000, "INR")
    assert (r.location.city, r.location.state, r.location.country) == ("Pune", "Mahar, West", "INDIA")
    assert (r.job_url, r.company_rating, r.company_reviews_count, r.skills, r.work_from_home_type) == ("https://www.naukri.com/jd-5", 4.1, 1234, ["sql", "spark"], "Hybrid")
    assert str(r.date_posted) == "2025-06-24" and r.job_type == ["fulltime"]


def test_linkedin_card_and_detail(spark):
    card = """<div class="base-search-card"><a class="base-card__full-link" href="https://l.test/view/dev-at-acme-42?x=1"></a><span class="sr-only"> Dev </span>
      <h4 class="base-search-card__subtitle"><a href="https://l.test/acme?trk=1">Acme</a></h4><span class="job-search-card__salary-info">$20.00/hr - $30.00/hr</span>
      <div class="base-search-card__metadata"><span class="job-search-card__location">Lyon, Rhone, France</span><time class="job-search-card__listdate" datetime="2025-02-03">x</time></div></div>"""
    detail = """<div class="show-more-less-html__markup x"><p>Work from home</p></div><h3 class="description__job-criteria-subheader">Seniority level</h3>
      <span class="description__job-criteria-text description__job-criteria-text--criteria"> Mid-Senior </span><h3>Employment type</h3>
      <span class="description__job-criteria-text description__job-criteria-text--criteria">Full-time</span><code id="applyUrl">"https://l.test/a?url=https%3A%2F%2Facme.test%2Fjob"</code>"""
    r = _one(spark, "linkedin", card, detail)
    assert (r.id, r.title, r.company_name, r.company_url, str(r.date_posted)) == ("li-42", "Dev", "Acme", "https://l.test/acme", "2025-02-03")
    assert (r.location.city, r.location.state, r.location.country) == ("Lyon", "Rhone", "FRANCE")
    assert (r.compensation.interval, r.compensation.min_amount, r.compensation.max_amount) == ("hourly", 20.0, 30.0)
    assert (r.job_level, r.job_type, r.job_url_direct, r.is_remote) == ("mid-senior", ["fulltime"], "https://acme.test/job", True)


def test_bayt_id_is_the_hash_of_the_address(spark):
    card = """<li data-js-job><h2><a href="/en/job/1/"> Cook </a></h2><div class="t-nowrap p10l"><span>Acme</span></div><div class="t-mute t-small">Dubai, Jumeirah, UAE</div></li>"""
    r = _one(spark, "bayt", card)
    assert r.id == identity_of("bayt", "https://www.bayt.com/en/job/1/") and (r.title, r.company_name) == ("Cook", "Acme")
    assert (r.location.city, r.location.state, r.location.country) == ("Dubai", "Jumeirah", "UAE")
    assert identity_of("bayt", "https://example.test/jobs/1") == "bayt-a8a440e5823115f1ce822c35e654d047"


def test_bdjobs_cards_dates_and_details(spark):
    page = """<div class="job-item"><a href="jobdetails.asp?JobID=77">Officer</a><div class="comp-name-text">Acme</div><div class="locon-text-d">Dhaka, Gulshan, Bangladesh</div>
      <span class="published">Published: 5 Mar 2025</span></div><div class="job-item"><a href="jobdetails.asp?x=1">Clerk</a></div>"""
    cards = card_pages.bdjobs_cards(page)
    assert len(cards) == 2
    r = _one(spark, "bdjobs", cards[0], '<div class="jobcontent"><script>x</script><p>Mail hr@acme.test</p></div><span>Job type</span><span>Full-time</span>')
    assert (r.id, r.title, r.company_name, str(r.date_posted), r.emails, r.job_type) == ("bd-77", "Officer", "Acme", "2025-03-05", ["hr@acme.test"], ["fulltime"])
    assert (r.location.city, r.location.state, r.location.country) == ("Dhaka", "Gulshan", "BANGLADESH")
    assert _one(spark, "bdjobs", cards[1]).id.startswith("bdjobs-")


def test_nulls_and_empty_frames_never_fail(spark):
    empty = spark.createDataFrame([], "site string, sequence bigint, raw string, detail string")
    assert map_raw(empty, _as_of()).count() == 0
    rows = [(s, 1, raw, None) for s in MAPPERS for raw in (None, "", "{}", "<p>")]
    got = map_raw(spark.createDataFrame(rows, empty.schema), _as_of())
    assert got.count() == len(rows) and set(n for n, _ in POST_FIELDS) <= set(got.columns)
