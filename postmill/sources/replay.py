"""Recorded pages as Spark data sources, for batches and streams.

A site's file is ``<site>.jsonl`` below the folder of option ``path``, or all files in a folder of that
name, one recorded page a line:

    {"page": 1, "items": [{"raw": ..., "detail": ...}, ...], "cursor": "..."}

``cursor`` names the next page.  Instead of ``items`` a page may hold the ``body`` that the board
sent, which is taken apart here.  ``failures`` lists failures that were recorded ahead of the page
(``{"status": 503, "message": ..., "retry_after": ...}``): attempt k of a reader meets the k-th.

``listing_replay`` reads all sites, a partition for each SPLIT bytes of a file; as a stream, offsets are
byte positions, counted through a site's files, so a restart begins at the first byte not yet taken.
``replay_<site>`` reads one site page by page, from a resume state on, by that board's rules.

Folders may be on any file system that pyarrow can open.  The order of listings of a site
(``sequence``) is their page's position in the file plus their place in the page: a page takes more
bytes than it has listings, so numbers never meet, however long a page is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from postmill.sources import mappers, wire
from postmill.sources.boards import BOARDS, Board

SCHEMA = (
    "site string, kind string, page int, sequence bigint, raw string, detail string, position bigint, state string, "
    "has_more boolean, units int, byte bigint"
)


def _open(path: str):
    """A file system and the path on it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://") else "file://" + path[5:])


#: Bytes of a file that a partition of a batch reads.
SPLIT = 64 << 20

#: A file of a site: its path, the bytes of the files ahead of it, and its size.
Part = tuple[str, int, int]


def _files(options: dict) -> dict[str, list[Part]]:
    """The files of each wanted site: ``<site>.jsonl``, or all files in a folder of that name."""
    from pyarrow import fs

    system, folder = _open(options["path"])
    wanted = [s for s in options.get("sites", "").split(",") if s]
    found: dict[str, list[Part]] = {}
    for entry in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        site = entry.base_name.removesuffix(".jsonl")
        if site == entry.base_name or (wanted and site not in wanted):
            continue
        inner = system.get_file_info(fs.FileSelector(entry.path)) if entry.type == fs.FileType.Directory else [entry]
        base = 0
        for file in sorted((f for f in inner if f.base_name[0] not in "._" and f.type == fs.FileType.File), key=lambda f: f.base_name):
            found.setdefault(site, []).append((file.path, base, file.size))
            base += file.size
    return dict(sorted(found.items()))


def _size(parts: list[Part]) -> int:
    return sum(size for _, _, size in parts)


def _lines(options: dict, path: str, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, int, dict]]:
    """``start, end, page`` of each recorded page that starts between two byte positions of a file."""
    system, _ = _open(options["path"])
    with system.open_input_file(path) as raw:
        # a line that began ahead of the range belongs to the one before
        raw.seek(max(0, begin - 1))
        at, rest, inside = max(0, begin - 1), b"", begin == 0
        while end is None or at < end:
            chunk = raw.read(1 << 20)
            *whole, rest = (rest + chunk).split(b"\n") if chunk else (rest, b"")
            for line in whole:
                if end is not None and at >= end:
                    return
                if inside and line.strip():
                    yield at, at + len(line) + 1, json.loads(line)
                at += len(line) + 1
                inside = True
            if not chunk:
                return


def _site_lines(options: dict, parts: list[Part], begin: int = 0) -> Iterator[tuple[int, int, dict]]:
    """The same over all files of a site, positions counted through."""
    for path, base, size in parts:
        if base + size > begin:
            yield from ((base + a, base + b, page) for a, b, page in _lines(options, path, max(0, begin - base)))


def listings_in(site: str, page: dict) -> list[tuple[str | None, str | None]]:
    """``raw, detail`` of each listing of a recorded page."""
    if "items" not in page:
        return [(raw, None) for raw in wire.listings_in_body(site, page.get("body"))]
    out = []
    for item in page["items"] or []:
        raw, detail = (item.get("raw"), item.get("detail")) if isinstance(item, dict) and "raw" in item else (item, None)
        out.append((raw if isinstance(raw, str) or raw is None else json.dumps(raw, ensure_ascii=False), detail))
    return out


def _cursor(site: str, page: dict) -> str | None:
    return page.get("cursor") or (wire.cursor_in_body(page["body"]) if "body" in page and site == "google" else None)


class SiteRange(InputPartition):
    def __init__(self, site: str, path: str = "", base: int = 0, begin: int = 0, end: int | None = None) -> None:
        super().__init__(site)
        self.site, self.path, self.base, self.begin, self.end = site, path, base, begin, end


def _ranges(site: str, parts: list[Part], begin: int, end: int, most: int) -> list[SiteRange]:
    """The bytes from ``begin`` to ``end`` of a site, in partitions of at most ``most`` bytes of a file."""
    out = []
    for path, base, size in parts:
        first, last = max(0, begin - base), min(size, end - base)
        out.extend(SiteRange(site, path, base, k, min(k + most, last)) for k in range(first, last, most))
    return out


def _all_rows(options: dict, part: SiteRange, max_pages: int | None = None) -> Iterator[tuple]:
    for number, (start, end, page) in enumerate(_lines(options, part.path, part.begin, part.end)):
        # pages that don't say their number are counted, which a part of a file can only do by itself
        named = int(page.get("page", number + 1))
        if max_pages is not None and named > max_pages:
            continue
        for k, (raw, detail) in enumerate(listings_in(part.site, page)):
            yield part.site, "listing", named, part.base + start + k, raw, detail, None, None, None, None, part.base + start
        yield part.site, "progress", named, part.base + end - 1, None, None, None, None, None, named, part.base + end


class ReplayReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.files = options, _files(options)

    def partitions(self) -> list[InputPartition]:
        found = [r for s, parts in self.files.items() for r in _ranges(s, parts, 0, _size(parts), SPLIT)]
        # a split for no site stands in for an empty folder
        return found or [SiteRange("")]

    def read(self, partition: SiteRange) -> Iterator[tuple]:
        if partition.site:
            yield from _all_rows(self.options, partition, int(self.options.get("max_pages", 1_000_000)))


class ReplayStream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {site: _size(parts) for site, parts in _files(self.options).items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = _files(self.options)
        return [r for s, upto in end.items() for r in _ranges(s, files[s], start.get(s, 0), upto, SPLIT)]

    def read(self, partition: SiteRange) -> Iterator[tuple]:
        yield from _all_rows(self.options, partition)

    def commit(self, end: dict) -> None:
        pass


class ListingReplay(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing_replay"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ReplayReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ReplayStream(self.options)


# -- page by page ------------------------------------------------------------------------------------


def _failed(board: Board, page: int, failure: dict) -> tuple:
    return board.site, "error", page, -1, json.dumps(failure), None, None, None, None, None, None


def walk(board: Board, options: dict, parts: list[Part]) -> Iterator[tuple]:
    """Rows of the next ``steps`` pages from ``state`` on, each page ended by its progress.

    ``byte`` and ``before`` tell where the page begins in the file and how many listings and pages
    lie ahead of it; without them the file is read from its start.
    """
    state = json.loads(options["state"]) if options.get("state") else board.first(int(options.get("offset", 0)))
    steps, attempt = int(options.get("steps", 1)), int(options.get("attempt", 0))
    max_pages = int(options.get("max_pages", 50))
    ahead_pages, ahead_items = (int(x) for x in options.get("before", "0,0").split(","))
    by_place = "start" in state
    cursor = None
    if not board.may_fetch(state, max_pages):
        return
    for start, end, page in _site_lines(options, parts, int(options.get("byte", 0))):
        items = listings_in(board.site, page)
        first = int(state["start"]) - ahead_items if by_place else 0
        here = first < len(items) if by_place else ahead_pages + 1 >= board.page(state)
        ahead_pages, ahead_items = ahead_pages + 1, ahead_items + len(items)
        if not here:
            cursor = _cursor(board.site, page)
            continue
        asked = state.get(board.cursor_field)
        if asked and cursor is not None and asked != cursor:
            yield _failed(board, ahead_pages, {"status": 410, "message": "cursor expired", "cursor": True})
            return
        if attempt < len(page.get("failures", ())):
            yield _failed(board, ahead_pages, {**page["failures"][attempt], "cursor": bool(asked) or board.fetched(state) > 0})
            return
        cursor = _cursor(board.site, page)
        shown = items[first:]
        for k, (raw, detail) in enumerate(shown):
            then = json.dumps(board.at_listing(state, k))
            yield board.site, "listing", ahead_pages, start + k, raw, detail, board.position(state, k), then, None, None, start
        if not shown:
            return
        ended = board.ends(len(shown), cursor)
        state = board.after(state, len(shown), cursor)
        more = board.has_more(len(shown), cursor)
        note = json.dumps({"before": f"{ahead_pages},{ahead_items}", "ended": ended})
        yield board.site, "progress", ahead_pages, end - 1, note, None, state.get("raw_seen"), json.dumps(state), more, board.fetched(state), end
        steps -= 1
        if ended or steps <= 0 or not board.may_fetch(state, max_pages):
            return


class BoardReader(DataSourceReader):
    def __init__(self, board: Board, options: dict) -> None:
        self.board, self.options = board, options
        self.parts = _files({**options, "sites": board.site}).get(board.site, [])

    def partitions(self) -> list[InputPartition]:
        return [SiteRange(self.board.site)]

    def read(self, partition: SiteRange) -> Iterator[tuple]:
        if self.parts:
            yield from walk(self.board, self.options, self.parts)
        else:
            yield _failed(self.board, 0, {"status": 404, "message": "nothing is recorded"})


class BoardReplay(DataSource):
    """One board, page by page; the classes below name it."""

    board: Board

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BoardReader(BOARDS[self.name().removeprefix("replay_")], self.options)


def _source_of(site: str) -> type[DataSource]:
    return type(f"Replay_{site}", (BoardReplay,), {"name": classmethod(lambda cls: f"replay_{site}")})


BOARD_SOURCES: dict[str, type[DataSource]] = {site: _source_of(site) for site in BOARDS}
assert set(BOARD_SOURCES) == set(mappers.MAPPERS)
