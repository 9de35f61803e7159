"""A request in the words of each board, for sources that hand filters on to a provider."""

from __future__ import annotations

from postmill.request import SearchRequest

# The boards' codes for kinds of work.
LINKEDIN_TYPES = {"fulltime": "F", "parttime": "P", "internship": "I", "contract": "C", "temporary": "T"}
ZIP_TYPES = {"fulltime": "full_time", "parttime": "part_time"}

#: The filters that each board can be asked for.
SUPPORTED = {
    "indeed": frozenset("search_term location distance is_remote job_type easy_apply offset hours_old description_format country".split()),
    "linkedin": frozenset("search_term location distance is_remote job_type easy_apply offset hours_old description_format company_ids".split()),
    "zip_recruiter": frozenset("search_term location distance is_remote job_type easy_apply offset hours_old description_format".split()),
    "glassdoor": frozenset("search_term location is_remote job_type easy_apply offset hours_old description_format country".split()),
    "google": frozenset("search_term location is_remote job_type offset hours_old".split()),
    "bayt": frozenset("search_term offset".split()),
    "naukri": frozenset("search_term location is_remote offset hours_old description_format".split()),
    "bdjobs": frozenset("search_term offset description_format".split()),
}

# The kinds of work that boards can be asked for; a board that isn't named takes any.
JOB_TYPES = {
    "indeed": frozenset("fulltime parttime contract internship".split()),
    "linkedin": frozenset(LINKEDIN_TYPES),
    "google": frozenset("fulltime parttime internship contract".split()),
}


def whole_days(hours: int) -> int:
    return max(-(-hours // 24), 1)


def posted_bucket(hours: int) -> str:
    """The coarse ages that one board knows."""
    return next((name for most, name in ((24, "since yesterday"), (72, "in the last 3 days"), (168, "in the last week")) if hours <= most), "in the last month")


def one_of(request: SearchRequest) -> tuple[str | None, list[str]]:
    """One board takes a single one of age, easy application, and kind or remote: the first in this
    order; and those that are dropped for it."""
    asked = [n for n, on in (("hours_old", request.hours_old is not None), ("easy_apply", bool(request.easy_apply)), ("job_type", request.job_type is not None or request.is_remote)) if on]
    return (asked[0] if asked else None), asked[1:]


def exclusive_warning(site: str, request: SearchRequest) -> str | None:
    """What a board that takes a single filter leaves out."""
    chosen, dropped = one_of(request)
    return f"{site} filters by {chosen} only; left out: {', '.join(dropped)}" if site == "indeed" and dropped else None


def glassdoor_location(found: list[dict] | None, remote: bool) -> tuple[int, str]:
    """Id and kind of the place that a search is for, out of what the board's place lookup gave."""
    if remote:
        return 11047, "STATE"  # fixed values: the board's place for remote work
    if not found:
        raise ValueError("the board doesn't know the place")
    kind = found[0]["locationType"]
    return int(found[0]["locationId"]), {"C": "CITY", "S": "STATE", "N": "COUNTRY"}.get(kind, kind)


def params(site: str, request: SearchRequest) -> dict[str, object]:
    """The query of a board; what isn't asked for is left out."""
    days = whole_days(request.hours_old) if request.hours_old is not None else None
    made: dict[str, object | None]
    if site == "linkedin":
        made = {
            "keywords": request.search_term, "location": request.location, "distance": request.distance, "f_JT": LINKEDIN_TYPES.get(request.job_type or ""),
            "f_WT": 2 if request.is_remote else None, "f_TPR": f"r{request.hours_old * 3600}" if request.hours_old is not None else None, "f_AL": "true" if request.easy_apply else None,
            "f_C": ",".join(map(str, request.company_ids)) or None,
        }
    elif site == "zip_recruiter":
        kind = ZIP_TYPES.get(request.job_type or "", request.job_type)
        made = {"search": request.search_term, "location": request.location, "days": days, "employment_type": kind, "zipapply": 1 if request.easy_apply else None,
                "remote": 1 if request.is_remote else None, "radius": request.distance}
    elif site == "indeed":
        chosen, _ = one_of(request)
        made = {"what": request.search_term, "where": request.location, "radius": request.distance if request.location else None,
                "age": f"{request.hours_old}h" if chosen == "hours_old" else None, "easy_apply": True if chosen == "easy_apply" else None,
                "job_type": request.job_type if chosen == "job_type" else None, "remote": True if chosen == "job_type" and request.is_remote else None}
    elif site == "glassdoor":
        made = {"keyword": request.search_term, "fromAge": days, "applicationType": 1 if request.easy_apply else None, "jobType": request.job_type}
    elif site == "google":
        words = [request.search_term, request.job_type, f"near {request.location}" if request.location else None,
                 posted_bucket(request.hours_old) if request.hours_old is not None else None, "remote" if request.is_remote else None]
        made = {"q": " ".join(w for w in words if w) or None}
    elif site == "naukri":
        made = {"keyword": request.search_term, "location": request.location, "wfhType": 2 if request.is_remote else None,
                "days": -(-request.hours_old // 24) if request.hours_old is not None else None}
    else:
        made = {"q": request.search_term}
    return {k: v for k, v in made.items() if v is not None}
