"""Fixed values of the listing domain: sites, job types, countries, and the order of columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

SITES = ("linkedin", "indeed", "zip_recruiter", "glassdoor", "google", "bayt", "naukri", "bdjobs")
SITE_ALIASES = {"ziprecruiter": "zip_recruiter"}

# Spellings of job types, lower case without blanks and hyphens; the first is canonical.
JOB_TYPES = {
    "FULL_TIME": "fulltime períodointegral cunormăîntreagă tiempocompleto vollzeit voltijds tempointegral 全职 plnýúvazek fuldtid "
    "دوامكامل kokopäivätyö tempsplein πλήρηςαπασχόληση teljesmunkaidő tempopieno heltid jornadacompleta pełnyetat 정규직 100% 全職 "
    "งานประจำ tamzamanlı повназайнятість toànthờigian",
    "PART_TIME": "parttime teilzeit částečnýúvazek deltid",
    "CONTRACT": "contract contractor",
    "TEMPORARY": "temporary",
    "INTERNSHIP": "internship prácticas estágio/trainee ojt(onthejobtraining) praktikum praktik",
    "PER_DIEM": "perdiem",
    "NIGHTS": "nights",
    "OTHER": "other",
    "SUMMER": "summer",
    "VOLUNTEER": "volunteer",
}
JOB_TYPE_OF = {spelling: words.split()[0] for words in JOB_TYPES.values() for spelling in words.split()}

# A country's name, accepted spellings, code of the listing board, and domain of the
# review board where it has one.
COUNTRIES = """
ARGENTINA|argentina|ar|com.ar
AUSTRALIA|australia|au|com.au
AUSTRIA|austria|at|at
BAHRAIN|bahrain|bh|
BANGLADESH|bangladesh|bd|
BELGIUM|belgium|be|fr:be
BULGARIA|bulgaria|bg|
BRAZIL|brazil|br|com.br
CANADA|canada|ca|ca
CHILE|chile|cl|
CHINA|china|cn|
COLOMBIA|colombia|co|
COSTARICA|costa rica|cr|
CROATIA|croatia|hr|
CYPRUS|cyprus|cy|
CZECHREPUBLIC|czech republic,czechia|cz|
DENMARK|denmark|dk|
ECUADOR|ecuador|ec|
EGYPT|egypt|eg|
ESTONIA|estonia|ee|
FINLAND|finland|fi|
FRANCE|france|fr|fr
GERMANY|germany|de|de
GREECE|greece|gr|
HONGKONG|hong kong|hk|com.hk
HUNGARY|hungary|hu|
INDIA|india|in|co.in
INDONESIA|indonesia|id|
IRELAND|ireland|ie|ie
ISRAEL|israel|il|
ITALY|italy|it|it
JAPAN|japan|jp|
KUWAIT|kuwait|kw|
LATVIA|latvia|lv|
LITHUANIA|lithuania|lt|
LUXEMBOURG|luxembourg|lu|
MALAYSIA|malaysia|malaysia:my|com
MALTA|malta|malta:mt|mt
MEXICO|mexico|mx|com.mx
MOROCCO|morocco|ma|
NETHERLANDS|netherlands|nl|nl
NEWZEALAND|new zealand|nz|co.nz
NIGERIA|nigeria|ng|
NORWAY|norway|no|
OMAN|oman|om|
PAKISTAN|pakistan|pk|
PANAMA|panama|pa|
PERU|peru|pe|
PHILIPPINES|philippines|ph|
POLAND|poland|pl|
PORTUGAL|portugal|pt|
QATAR|qatar|qa|
ROMANIA|romania|ro|
SAUDIARABIA|saudi arabia|sa|
SINGAPORE|singapore|sg|sg
SLOVAKIA|slovakia|sk|
SLOVENIA|slovenia|sl|
SOUTHAFRICA|south africa|za|
SOUTHKOREA|south korea|kr|
SPAIN|spain|es|es
SWEDEN|sweden|se|
SWITZERLAND|switzerland|ch|de:ch
TAIWAN|taiwan|tw|
THAILAND|thailand|th|
TURKEY|türkiye,turkey|tr|
UKRAINE|ukraine|ua|
UNITEDARABEMIRATES|united arab emirates|ae|
UK|uk,united kingdom|uk:gb|co.uk
USA|usa,us,united states|www:us|com
URUGUAY|uruguay|uy|
VENEZUELA|venezuela|ve|
VIETNAM|vietnam|vn|com
US_CANADA|usa/ca|www|
WORLDWIDE|worldwide|www|
"""
_ROWS = [line.split("|") for line in COUNTRIES.strip().splitlines()]
COUNTRY_OF = {alias: name for name, aliases, _, _ in _ROWS for alias in aliases.split(",")}
#: What is shown for a country; the two that name no place show nothing.
COUNTRY_SHOWN = {
    name: (first.upper() if first in ("usa", "uk") else first.title())
    for name, aliases, _, _ in _ROWS
    if name not in ("US_CANADA", "WORLDWIDE")
    for first in [aliases.split(",")[0]]
}
BOARD_DOMAIN = {name: (code.partition(":")[0], (code.partition(":")[2] or code).upper()) for name, _, code, _ in _ROWS}
REVIEW_HOST = {
    name: (f"{d.partition(':')[0]}.glassdoor.{d.partition(':')[2]}" if ":" in d else f"www.glassdoor.{d}") for name, _, _, d in _ROWS if d
}

# Currencies of countries.
EURO_COUNTRIES = (
    "AUSTRIA BELGIUM CYPRUS ESTONIA FINLAND FRANCE GERMANY GREECE IRELAND ITALY LATVIA LITHUANIA LUXEMBOURG MALTA "
    "NETHERLANDS PORTUGAL SLOVAKIA SLOVENIA SPAIN"
).split()
COUNTRY_CURRENCY = {c: "EUR" for c in EURO_COUNTRIES} | {
    "USA": "USD", "CANADA": "CAD", "AUSTRALIA": "AUD", "NEWZEALAND": "NZD", "UK": "GBP", "INDIA": "INR",
    "BANGLADESH": "BDT", "SWITZERLAND": "CHF",
}

#: The 37 columns of the result table, in order.
RESULT_COLUMNS = (
    "id string, site string, job_url string, job_url_direct string, title string, company string, location string, "
    "date_posted date, job_type string, salary_source string, salary_confidence string, salary_evidence string, "
    "interval string, min_amount double, max_amount double, currency string, is_remote boolean, job_level string, "
    "job_function string, listing_type string, emails string, description string, company_industry string, "
    "company_url string, company_logo string, banner_photo_url string, company_url_direct string, "
    "company_addresses string, company_num_employees string, company_revenue string, company_description string, "
    "skills string, experience_range string, company_rating double, company_reviews_count bigint, "
    "vacancy_count bigint, work_from_home_type string"
)
RESULT_FIELDS = [tuple(part.split(" ")) for part in RESULT_COLUMNS.split(", ")]
RESULT_NAMES = [name for name, _ in RESULT_FIELDS]

#: A listing before it is flattened.
POST_SCHEMA = (
    "id string, title string, company_name string, job_url string, job_url_direct string, "
    "location struct<country:string,city:string,state:string>, description string, company_url string, "
    "company_url_direct string, job_type array<string>, "
    "compensation struct<interval:string,min_amount:double,max_amount:double,currency:string>, salary_source string, "
    "salary_provenance struct<source:string,confidence:string,evidence:string>, date_posted date, "
    "emails array<string>, is_remote boolean, listing_type string, job_level string, company_industry string, "
    "company_addresses string, company_num_employees string, company_revenue string, company_description string, "
    "company_logo string, banner_photo_url string, job_function string, skills array<string>, "
    "experience_range string, company_rating double, company_reviews_count bigint, vacancy_count bigint, "
    "work_from_home_type string"
)


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of ``key`` in a fixed table, null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)
