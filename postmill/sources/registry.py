"""Sources by site: those of the boards, and those that users bring along."""

from __future__ import annotations

import inspect
import threading
import warnings
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import SparkSession

from postmill.request import SOURCE_NAME, SearchRequest, source_name
from postmill.sources.boards import BOARDS, Capabilities


@runtime_checkable
class Source(Protocol):
    """What a source is: a site, what it can do, and a way to scrape.  Listings are emitted through the
    context as they are found; what ``scrape`` returns is emitted too, if it wasn't yet."""

    site: str
    capabilities: Capabilities

    def scrape(self, request: SearchRequest, context: Any = None) -> Iterable[Mapping[str, Any]] | None: ...


Factory = Callable[[], Source]


def takes_context(source: Source) -> bool:
    try:
        names = inspect.signature(source.scrape).parameters
    except (TypeError, ValueError):
        return True
    return "context" in names or any(p.kind is p.VAR_KEYWORD for p in names.values())


class _Contextless:
    """A source whose ``scrape`` knows no context: its listings come at the end, and it isn't resumed."""

    def __init__(self, inner: Any) -> None:
        self._inner, self.site = inner, inner.site
        given = getattr(inner, "capabilities", None) or Capabilities()
        self.capabilities = replace(given, granularity="none", cursor_version=0)

    def scrape(self, request: SearchRequest, context: Any = None) -> list[Mapping[str, Any]]:
        return list(self._inner.scrape(request) or ())


def legacy_source(factory: Callable[[], Any]) -> Factory:
    """A factory of sources without context, for ``Registry.register``."""
    return lambda: _Contextless(factory())


def check_source(source: Any, site: str | None = None) -> None:
    """TypeError unless ``source`` is one; the contract that own sources are tested with."""
    name = getattr(source, "site", None)
    if not isinstance(name, str) or not SOURCE_NAME.fullmatch(name) or (site is not None and name != site):
        raise TypeError(f"a source names its site, {site or 'in lower case'}; this one has {name!r}")
    if not isinstance(getattr(source, "capabilities", None), Capabilities):
        raise TypeError(f"{name}: capabilities are missing")
    if not callable(getattr(source, "scrape", None)):
        raise TypeError(f"{name}: scrape can't be called")


def check_listings(found: Any) -> None:
    """TypeError unless ``found`` is what a scrape may return."""
    if found is None:
        return
    if isinstance(found, (str, bytes, Mapping)) or not isinstance(found, Iterable):
        raise TypeError("scrape returns listings or nothing")
    for job in found:
        if not isinstance(job, Mapping) or not job.get("title") or not job.get("job_url"):
            raise TypeError("a listing is a mapping with a title and an address")


@dataclass(frozen=True)
class _Entry:
    factory: Factory
    capabilities: Capabilities | None
    cursor_version: int | None


class Registry:
    """A site is registered once, unless it is replaced on purpose.  Capabilities that are declared have
    to be those of what the factory makes; those that aren't are learnt from the first one made."""

    def __init__(self) -> None:
        self._entries: dict[str, _Entry] = {}
        self._lock = threading.Lock()
        self._spark_sources: dict[str, type] = {}

    def register(self, site: str, factory: Factory, capabilities: Capabilities | None = None, cursor_version: int | None = None, replace: bool = False) -> None:
        name = source_name(site)
        if not callable(factory):
            raise TypeError("a factory makes sources when it is called")
        if cursor_version is not None and (isinstance(cursor_version, bool) or not isinstance(cursor_version, int) or cursor_version < 1):
            raise ValueError("the version of a cursor is a positive number")
        if capabilities is not None and cursor_version is not None and capabilities.cursor_version != cursor_version:
            raise ValueError("the declared capabilities have another version of the cursor")
        with self._lock:
            if name in self._entries and not replace:
                raise ValueError(f"a source for {name!r} is registered already")
            self._entries[name] = _Entry(factory, capabilities, cursor_version)

    def _entry(self, site: str) -> tuple[str, _Entry]:
        name = source_name(site)
        if name not in self._entries:
            raise ValueError(f"no source for {name!r}")
        return name, self._entries[name]

    def create(self, site: str) -> Source:
        name, entry = self._entry(site)
        made = entry.factory()
        if callable(getattr(made, "scrape", None)) and not takes_context(made):
            warnings.warn(f"{name}: scrape takes no context; register it through legacy_source", DeprecationWarning, stacklevel=2)
            made = _Contextless(made)
        check_source(made, name)
        with self._lock:  # of several that come at once, one settles what the source can do
            held = self._entries[name]
            if held.capabilities is not None and held.capabilities != made.capabilities:
                raise TypeError(f"{name}: the source can't do what was declared")
            if held.cursor_version is not None and made.capabilities.resumes and held.cursor_version != made.capabilities.cursor_version:
                raise TypeError(f"{name}: the source has another version of the cursor than was declared")
            if held.capabilities is None and held is self._entries[name]:
                self._entries[name] = _Entry(held.factory, made.capabilities, held.cursor_version)
        return made

    def capabilities(self, site: str) -> Capabilities:
        name, entry = self._entry(site)
        return entry.capabilities or self.create(name).capabilities

    def cursor_version(self, site: str) -> int:
        name, entry = self._entry(site)
        return entry.cursor_version if entry.cursor_version is not None else self.capabilities(name).cursor_version

    def sites(self) -> tuple[str, ...]:
        return tuple(self._entries)

    def add_spark_source(self, source: type, replace: bool = False) -> None:
        """A Spark data source that ``install`` makes known to a session."""
        if source.name() in self._spark_sources and not replace:
            raise ValueError(f"a data source named {source.name()!r} is registered already")
        self._spark_sources[source.name()] = source

    def install(self, spark: SparkSession) -> None:
        for source in self._spark_sources.values():
            spark.dataSource.register(source)

    def copy(self) -> Registry:
        other = Registry()
        other._entries, other._spark_sources = dict(self._entries), dict(self._spark_sources)
        return other


def default_registry(path: str = "", as_of: str = "1970-01-01", steps: int = 4) -> Registry:
    """The eight boards over their recorded pages below ``path``; ``steps`` pages are read by one Spark job,
    and delivered page by page."""
    from postmill.sources.replay import BOARD_SOURCES, ListingReplay
    from postmill.streaming.search import RecordedBoard

    made = Registry()
    made.add_spark_source(ListingReplay)
    for site, board in BOARDS.items():
        made.register(site, lambda site=site: RecordedBoard(site, path, as_of, steps), board.capabilities)
        made.add_spark_source(BOARD_SOURCES[site])
    return made
