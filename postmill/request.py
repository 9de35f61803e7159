"""What a search asks for, and what a source can do with it."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, replace

from postmill.vocabulary import COUNTRY_OF, JOB_TYPE_OF, SITE_ALIASES, SITES

#: What a search can ask a source to filter by.
FILTERS = frozenset(
    "search_term location distance is_remote job_type easy_apply offset hours_old description_format company_ids country".split()
)
FORMATS = ("markdown", "html", "plain")


def site_name(text: str) -> str:
    name = text.strip().lower().replace("-", "_")
    return SITE_ALIASES.get(name, name)


SOURCE_NAME = re.compile(r"[a-z][a-z0-9_]{0,63}")


def source_name(text: str) -> str:
    """The name of a board or of a source of one's own, evened out: letters, digits and underscores, 64
    at most, beginning with a letter."""
    name = site_name(text)
    if not SOURCE_NAME.fullmatch(name):
        raise ValueError(f"not the name of a source: {text!r}")
    return name


@dataclass(frozen=True)
class SearchRequest:
    """A search; all values are checked and evened out when it is made."""

    sites: tuple[str, ...] = SITES
    search_term: str | None = None
    location: str | None = None
    country: str = "USA"
    distance: int = 50
    is_remote: bool = False
    job_type: str | None = None
    easy_apply: bool | None = None
    results_wanted: int = 15
    offset: int = 0
    hours_old: int | None = None
    description_format: str = "markdown"
    max_pages: int = 50
    company_ids: tuple[int, ...] = ()
    annual_salary: bool = False
    infer_salary: bool = False
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    def __post_init__(self) -> None:
        sites = tuple(dict.fromkeys(source_name(s) for s in self.sites))
        if not sites:
            raise ValueError("a search needs a site")
        object.__setattr__(self, "sites", sites)
        object.__setattr__(self, "company_ids", tuple(self.company_ids or ()))
        country = COUNTRY_OF.get(self.country.strip().lower(), self.country.strip().upper())
        if country not in COUNTRY_OF.values():
            raise ValueError(f"unknown country: {self.country!r}")
        object.__setattr__(self, "country", country)
        if self.job_type is not None:
            named = JOB_TYPE_OF.get(self.job_type.replace("-", "").replace(" ", "").replace("_", "").lower())
            if named is None:
                raise ValueError(f"unknown job type: {self.job_type!r}")
            object.__setattr__(self, "job_type", named)
        if self.description_format not in FORMATS:
            raise ValueError(f"unknown format: {self.description_format!r}")
        if self.results_wanted < 0 or self.offset < 0 or not 1 <= self.max_pages <= 1000:
            raise ValueError("results_wanted and offset can't be negative, max_pages is 1 to 1000")

    def fingerprint(self) -> str:
        """SHA-256 over the request in a fixed form: equal requests have equal fingerprints."""
        plain = {k: v for k, v in asdict(self).items() if k != "extra"}
        return hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def asked(self) -> frozenset[str]:
        """The filters that this search makes use of."""
        default = SearchRequest()
        names = {f for f in FILTERS if hasattr(self, f) and getattr(self, f) != getattr(default, f)}
        return frozenset(names)

    def for_sites(self, *sites: str) -> SearchRequest:
        return replace(self, sites=sites)


def unsupported(request: SearchRequest, supported: frozenset[str]) -> str | None:
    """One warning that names what a source can't filter by; None if it can do all."""
    missing = sorted(request.asked() - supported)
    return f"filters not supported: {', '.join(missing)}" if missing else None
