"""How each board pages: where a search starts, what its resume state holds, and when it ends.

A state is a small dictionary that travels with every event of a board.  Boards that are resumed by
page give all listings of a page the state of its start: a restart reads the page again, and the
keys that were acknowledged suppress what was delivered.  Boards that are resumed by listing say
how much of the page is done.
"""

from __future__ import annotations

from dataclasses import dataclass

from postmill.sources.translate import JOB_TYPES, SUPPORTED
from postmill.sources.wire import rounded_start


@dataclass(frozen=True)
class Capabilities:
    """What a source can filter by and how it is resumed; ``cursor_version`` 0 stands for no resume."""

    filters: frozenset[str] = frozenset()
    job_types: frozenset[str] | None = None
    granularity: str = "page"
    cursor_version: int = 1

    def __post_init__(self) -> None:
        shape = self.granularity.strip().lower().replace("-", "_").replace(" ", "_")
        if shape not in ("page", "listing", "none"):
            raise ValueError(f"unknown granularity: {self.granularity!r}")
        object.__setattr__(self, "granularity", shape)
        if self.job_types is not None and "job_type" not in self.filters:
            raise ValueError("kinds of work can only be named by a source that filters by job_type")
        if isinstance(self.cursor_version, bool) or not isinstance(self.cursor_version, int) or self.cursor_version < 0:
            raise ValueError("the version of a cursor is a positive number, or 0 for none")

    @property
    def resumes(self) -> bool:
        return self.cursor_version > 0


class Board:
    """A board whose pages are numbered and whose next page is named by a cursor."""

    site = ""
    page_size: int | None = None
    #: Pages that the board gives at most, and results.
    most_pages: int | None = None
    most_results: int | None = None
    granularity = "page"
    #: Whether skipped listings are counted in the state; else their place tells.
    counts_skipped = False
    cursor_field = "cursor"

    @property
    def capabilities(self) -> Capabilities:
        return Capabilities(SUPPORTED[self.site], JOB_TYPES.get(self.site), self.granularity, 1)

    def first(self, offset: int) -> dict:
        raise NotImplementedError

    def page(self, state: dict) -> int:
        """The number of the page that comes next."""
        return int(state.get("page", 1))

    def fetched(self, state: dict) -> int:
        """Pages done so far."""
        return self.page(state) - 1

    def may_fetch(self, state: dict, max_pages: int) -> bool:
        return self.fetched(state) < min(max_pages, self.most_pages or max_pages)

    def position(self, state: dict, index: int) -> int | None:
        """The place among all raw listings of the one at ``index`` of the page; None if unknown."""
        seen = state.get("raw_seen")
        return None if seen is None else int(seen) + index

    def at_listing(self, state: dict, index: int) -> dict:
        return state

    def after(self, state: dict, count: int, cursor: str | None) -> dict:
        raise NotImplementedError

    def ends(self, count: int, cursor: str | None) -> bool:
        """Whether the page with ``count`` listings and that cursor of the next one was the last."""
        return count == 0

    def has_more(self, count: int, cursor: str | None) -> bool | None:
        return None

    @staticmethod
    def _seen(state: dict, count: int) -> int | None:
        return None if state.get("raw_seen") is None else int(state["raw_seen"]) + count


class _ByCursor(Board):
    def ends(self, count: int, cursor: str | None) -> bool:
        return count == 0 or not cursor

    def has_more(self, count: int, cursor: str | None) -> bool | None:
        return bool(cursor)


class Indeed(_ByCursor):
    site, page_size, counts_skipped = "indeed", 100, True

    def first(self, offset: int) -> dict:
        return {"cursor": None, "page": 1, "skipped": 0, "raw_seen": 0}

    def after(self, state: dict, count: int, cursor: str | None) -> dict:
        return {**state, "cursor": cursor, "page": self.page(state) + 1, "raw_seen": self._seen(state, count)}


class ZipRecruiter(_ByCursor):
    site, counts_skipped, cursor_field = "zip_recruiter", True, "continue_token"

    def first(self, offset: int) -> dict:
        return {"continue_token": None, "page": 1, "skipped": 0, "raw_seen": 0}

    def after(self, state: dict, count: int, cursor: str | None) -> dict:
        return {**state, "continue_token": cursor, "page": self.page(state) + 1, "raw_seen": self._seen(state, count)}


class Glassdoor(_ByCursor):
    """Starts at the page that the offset lies on; the budget counts pages fetched."""

    site, page_size, most_pages = "glassdoor", 30, 30

    def first(self, offset: int) -> dict:
        page = 1 + offset // self.page_size
        return {"page": page, "cursor": None, "pages_fetched": 0, "raw_seen": 0}

    def fetched(self, state: dict) -> int:
        return int(state.get("pages_fetched", 0))

    def may_fetch(self, state: dict, max_pages: int) -> bool:
        return super().may_fetch(state, max_pages) and self.page(state) <= self.most_pages

    def position(self, state: dict, index: int) -> int:
        return (self.page(state) - 1) * self.page_size + index

    def after(self, state: dict, count: int, cursor: str | None) -> dict:
        return {"page": self.page(state) + 1, "cursor": cursor, "pages_fetched": self.fetched(state) + 1, "raw_seen": self._seen(state, count)}


class Google(_ByCursor):
    site, page_size, most_results, granularity = "google", 10, 900, "listing"

    def first(self, offset: int) -> dict:
        return {"phase": "initial", "cursor": None, "page": 1, "page_skip": 0, "raw_seen": 0}

    def position(self, state: dict, index: int) -> int:
        return max(0, int(state.get("raw_seen", 0)) - int(state.get("page_skip", 0))) + index

    def at_listing(self, state: dict, index: int) -> dict:
        return {**state, "page_skip": index + 1, "raw_seen": self.position(state, index) + 1}

    def after(self, state: dict, count: int, cursor: str | None) -> dict:
        return {"phase": "next", "cursor": cursor, "page": self.page(state) + 1, "page_skip": 0, "raw_seen": self.position(state, count)}


class Bayt(Board):
    site, granularity = "bayt", "listing"
    position, at_listing = Google.position, Google.at_listing

    def first(self, offset: int) -> dict:
        return {"page": 1, "page_skip": 0, "raw_seen": 0}

    def after(self, state: dict, count: int, cursor: str | None) -> dict:
        return {"page": self.page(state) + 1, "page_skip": 0, "raw_seen": self.position(state, count)}


class Naukri(Board):
    """Starts at the page that the offset lies on; a page that isn't full is the last."""

    site, page_size, granularity = "naukri", 20, "listing"
    position, at_listing = Google.position, Google.at_listing

    def first(self, offset: int) -> dict:
        page, skip = 1 + offset // self.page_size, offset % self.page_size
        return {"page": page, "page_skip": skip, "raw_seen": (page - 1) * self.page_size + skip, "pages_fetched": 0}

    def fetched(self, state: dict) -> int:
        return int(state.get("pages_fetched", 0))

    def after(self, state: dict, count: int, cursor: str | None) -> dict:
        return {"page": self.page(state) + 1, "page_skip": 0, "raw_seen": self.position(state, count), "pages_fetched": self.fetched(state) + 1}

    def ends(self, count: int, cursor: str | None) -> bool:
        return count < self.page_size

    def has_more(self, count: int, cursor: str | None) -> bool | None:
        return False if count < self.page_size else None


class BDJobs(Board):
    site = "bdjobs"

    def first(self, offset: int) -> dict:
        return {"page": 1, "raw_seen": 0}

    def after(self, state: dict, count: int, cursor: str | None) -> dict:
        return {"page": self.page(state) + 1, "raw_seen": self._seen(state, count)}


class LinkedIn(Board):
    """Asked for listings from a place on, which is a multiple of ten at first."""

    site, page_size = "linkedin", 25
    #: Places from which on the board gives nothing.
    most_start = 1000

    def first(self, offset: int) -> dict:
        return {"start": rounded_start(offset)[0], "pages_completed": 0, "raw_seen": 0}

    def fetched(self, state: dict) -> int:
        return int(state.get("pages_completed", 0))

    def may_fetch(self, state: dict, max_pages: int) -> bool:
        return super().may_fetch(state, max_pages) and int(state["start"]) < self.most_start

    def position(self, state: dict, index: int) -> int:
        return int(state["start"]) + index

    def after(self, state: dict, count: int, cursor: str | None) -> dict:
        return {"start": int(state["start"]) + count, "pages_completed": self.fetched(state) + 1, "raw_seen": self._seen(state, count)}


BOARDS: dict[str, Board] = {b.site: b for b in (LinkedIn(), Indeed(), ZipRecruiter(), Glassdoor(), Google(), Bayt(), Naukri(), BDJobs())}
