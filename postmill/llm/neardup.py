"""Near-duplicate records: an exact set-similarity join over runs of words, without all pairs.

Records become sets of hashed word runs.  Two records are linked if the Jaccard similarity of
their sets reaches the threshold.

1.  Copies.  Records with the same set form a class; one representative each goes on.
2.  Order.  Runs are ordered by how many records hold them, rare ones first.  The counts fill a
    table that grows with the corpus, from 2**COUNT_BITS cells to 2**MOST_BITS; what is sent of it is a
    byte for each cell, exact for small counts.  Colliding runs share a cell, which moves a run in
    the order but never loses a link, as any total order is valid.
3.  Index, split by run.  A linked pair shares a run within the first ``|x| - alpha + 1`` runs of
    both, alpha being the overlap that the threshold asks for.  Each record sends those runs, with
    their position, the size of the set and a parity sketch of the whole set, to the part of the
    index that owns the run.
4.  Index-level skipping.  An index list is sorted by size.  The position of a run in a record bounds
    the size of the partners that it can still reach alpha with; behind that size the rest of the
    list is skipped as a block.  What is left is tested against the partner's own position, and
    then against the sketches: the bits in which two
    parity sketches differ can't outnumber the runs in which the sets differ, so a pair with too
    many is dropped and no link is lost.
5.  Answer-level skipping, for exact copies only.  Pairs that survive are checked on the exact sets
    of the representatives; the answers of a class's other members are derived from their
    representative's answers.  A set that differs by one run is probed and checked from scratch:
    deriving its answers from a similar set's isn't built.

Lists of runs that many records share (more than LIST_ROWS) are cut into pieces, and each pair of
pieces is worked off on its own, so no task ever holds a whole hot list.

Defined cases: records without text, or with fewer words than a run, have empty sets and are
linked to nothing; a repeated id with the same text is one record; ids must not be null.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.words import run_sets as text_sets
from postmill.session import cut_lineage, ensure_checkpoint_dir

COUNT_BITS, MOST_BITS = 22, 25
CELL_RUNS = 8  # runs for each cell, about, as long as the table may grow
RECORD_RUNS = 170  # runs of a record, about
LIST_ROWS = 65_536
INDEX_RECORDS = 20_000  # records for each part of the index
MIN_PARTS = 8
MAX_ROWS = 50_000  # records packed together; fits the row number of an entry
BROADCAST_IDS = 1_000_000  # ids that may be broadcast; more are joined by shuffle

_ENTRY = np.dtype([("run", "<u4"), ("row", "<u2"), ("pos", "<u2")])
_HEAD = np.dtype([("id", "<i8"), ("size", "<u4"), ("words", "<u4")])


def _records(df: DataFrame, key: str, text: Column) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), text.alias("text")).where("id is not null and text is not null")


# -- order -----------------------------------------------------------------------------------------


def count_bits(records: int) -> int:
    """Bits of the table of counts for so many records."""
    wanted = int(np.ceil(np.log2(max(1, records) * RECORD_RUNS / CELL_RUNS)))
    return min(MOST_BITS, max(COUNT_BITS, wanted))


def _cells(runs: np.ndarray, bits: int) -> np.ndarray:
    return (runs >> np.uint64(64 - bits)).astype(np.int64)


_EXACT, _STEPS = 100, 6  # counts that are exact in a byte, and steps for each doubling beyond


def to_byte(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes, in the same order: exact up to _EXACT, then by steps."""
    beyond = _EXACT + np.floor(_STEPS * np.log2(np.maximum(counts, _EXACT) / _EXACT))
    return np.where(counts < _EXACT, counts, np.minimum(beyond, 255)).astype(np.uint8)


def from_byte(codes: np.ndarray) -> np.ndarray:
    """The largest count that a byte stands for."""
    c = codes.astype(np.int64)
    return np.where(c < _EXACT, c, np.ceil(_EXACT * 2.0 ** ((c - _EXACT + 1) / _STEPS)).astype(np.int64))


def _survey(records: DataFrame, length: int, bits: int) -> DataFrame:
    """One pass over the texts: ``kind, page, body``.

    Kind 0 packs ids and fingerprints of records with a set; kind 1 has the counts of a page of
    1024 cells, as far as this task has seen them.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int32)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            prints = np.zeros(len(ids), dtype=_PRINT)
            count = 0
            for ident, runs in zip(ids, text_sets(texts, length)):
                if len(runs):
                    total[_cells(runs, bits)] += 1
                    prints[count] = (ident, *_fingerprint(runs))
                    count += 1
            yield _rows([0], [0], [prints[:count].tobytes()])
        pages = np.flatnonzero(total.reshape(-1, 1024).any(axis=1))
        bodies = []
        for page in pages:
            cells = total[page * 1024 : (page + 1) * 1024]
            at = np.flatnonzero(cells)
            body = np.empty(len(at), dtype=_CELL)
            body["cell"], body["n"] = at, np.minimum(cells[at], 2_000_000_000)
            bodies.append(body.tobytes())
        if bodies:
            yield _rows([1] * len(bodies), pages, bodies)

    return records.mapInArrow(scan, "kind int, page long, body binary")


_CELL = np.dtype([("cell", "<u2"), ("n", "<u4")])
_PRINT = np.dtype([("id", "<i8"), ("p1", "<i8"), ("p2", "<i8"), ("size", "<i8")])


def _rows(kinds, pages, bodies) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(pages, pa.int64()), pa.array(bodies, pa.binary())], ["kind", "page", "body"]
    )


def _fingerprint(runs: np.ndarray) -> tuple[int, int, int]:
    """128 bits and the size: alike for equal sets only."""
    first = int(np.bitwise_xor.reduce(runs * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64))
    second = int(np.add.reduce((runs ^ (runs >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)).astype(np.int64))
    return first, second, len(runs)


def run_counts(survey: DataFrame, bits: int) -> np.ndarray:
    """How many records hold a run of each cell, as bytes; 2**MOST_BITS of them at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, cells = None, np.zeros(1024, dtype=np.int64)
        for batch in batches:
            for p, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != page:
                    if page is not None:
                        yield _page(page, cells)
                    page, cells = p, np.zeros(1024, dtype=np.int64)
                part = np.frombuffer(body, dtype=_CELL)
                cells[part["cell"]] += part["n"]
        if page is not None:
            yield _page(page, cells)

    pages = survey.where("kind = 1").select("page", "body").repartition("page").sortWithinPartitions("page")
    out = np.zeros(1 << bits, dtype=np.uint8)
    # 2**MOST_BITS / 1024 rows at most
    for row in pages.mapInArrow(add, "page long, body binary").toLocalIterator():
        out[row.page * 1024 : (row.page + 1) * 1024] = np.frombuffer(row.body, dtype="u1")
    return out


def _page(page: int, cells: np.ndarray) -> pa.RecordBatch:
    body = to_byte(cells).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([body], pa.binary())], ["page", "body"])


def _prints(survey: DataFrame) -> DataFrame:
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0).to_pylist():
                part = np.frombuffer(body, dtype=_PRINT)
                yield pa.RecordBatch.from_arrays([pa.array(part[c]) for c in ("id", "p1", "p2", "size")], ["id", "p1", "p2", "size"])

    return survey.where("kind = 0").select("body").mapInArrow(unpack, "id long, p1 long, p2 long, size long")


# -- sketches --------------------------------------------------------------------------------------


def sketch_bits(size: int) -> int:
    """Bits of the sketch of a set: a power of two that is large beside the allowed difference."""
    return max(256, 1 << int(np.ceil(np.log2(max(1.0, 1.75 * size)))))


def parity_sketch(runs: np.ndarray) -> np.ndarray:
    """A bit for each residue of the runs, telling whether an odd number of runs falls on it."""
    bits = sketch_bits(len(runs))
    mixed = (runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    odd = np.bincount((mixed & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


SKETCHED_BITS = 1 << 24  # bits of sketches that are made at a time


def _sketches(runs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(words, flat)``: the parity sketches of many sets that lie one behind the other, and their lengths."""
    bits = np.array([sketch_bits(k) for k in range(int(sizes.max()) + 1)])[sizes]
    words = bits // 64
    place = ((runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64)
    first, end = np.cumsum(bits) - bits, np.cumsum(sizes)
    out, begin = [], 0
    while begin < len(sizes):
        upto = max(begin + 1, int(np.searchsorted(first + bits, first[begin] + SKETCHED_BITS, "right")))
        own = slice(end[begin] - sizes[begin], end[upto - 1])
        width, start = (np.repeat(x[begin:upto], sizes[begin:upto]) for x in (bits, first - first[begin]))
        odd = np.bincount((place[own] & (width - 1)) + start, minlength=int(bits[begin:upto].sum())).astype(np.uint8) & 1
        out.append(np.packbits(odd, bitorder="little").view("<u8"))
        begin = upto
    return words, np.concatenate(out)


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch that the same set has with fewer bits."""
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


# -- index -----------------------------------------------------------------------------------------


def _index_entries(records: DataFrame, counts, length: int, threshold: float, parts: int, share: float = 1.0, folder: str | None = None) -> DataFrame:
    """``part, entries, head, sketches, file``: packed index entries of many records, by part of the index.

    ``share``: of the records that were counted, those that are indexed.  With a ``folder``, heads and
    sketches are written there once for each batch, and ``head`` has the rows of ``file`` that a part needs.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = counts.value, int(np.log2(len(counts.value)))
        for batch in (b.slice(k, MAX_ROWS) for b in batches for k in range(0, b.num_rows, MAX_ROWS)):
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sets = text_sets(texts, length)
            sizes = np.array([len(r) for r in sets], dtype=np.int64)
            if not sizes.sum():
                continue
            runs, rows = np.concatenate(sets), np.repeat(np.arange(len(ids), dtype=np.uint16), sizes)
            words, flat = _sketches(runs, sizes)
            offset = np.concatenate([[0], np.cumsum(words)])
            held = table[_cells(runs, bits)]
            # the runs of a set are sorted, and stay so where counts are the same
            order = np.lexsort((held, rows))
            pos = np.arange(len(runs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            # the shortest partner asks for the least overlap
            reach = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
            live = np.flatnonzero((pos < np.repeat(reach, sizes)) & (held[order] > 1))
            order, pos = order[live], pos[live]
            runs, rows, n = runs[order], rows[order].astype(np.int64), from_byte(held[order]) * share
            which, place = _places(runs, n, ids[rows], parts)
            # the low half of a run: a chance match of halves makes a candidate, never a link
            keys = np.where(place < parts, runs[which], _mixed(runs[which] ^ _mixed(place.astype(np.uint64)))) & np.uint64(0xFFFFFFFF)
            every = np.empty(len(ids), dtype=_HEAD)
            every["id"], every["size"], every["words"] = ids, sizes, words
            file = _written(folder, every, flat) if folder else None
            for part, at in _by_part(place % parts):
                chosen = which[at]
                used, local = np.unique(rows[chosen], return_inverse=True)
                entries = np.empty(len(chosen), dtype=_ENTRY)
                entries["run"], entries["row"], entries["pos"] = keys[at], local, np.minimum(pos[chosen], 65_535)
                head, body = (used.astype("<u4").tobytes(), b"") if file else (every[used].tobytes(), _bodies(flat, offset, words, used).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int64()), pa.array([entries.tobytes()], pa.binary()), pa.array([head], pa.binary()),
                     pa.array([body], pa.binary()), pa.array([file], pa.string())],
                    ["part", "entries", "head", "sketches", "file"],
                )

    return records.mapInArrow(build, "part long, entries binary, head binary, sketches binary, file string")


def _bodies(flat: np.ndarray, offset: np.ndarray, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sketches of some records, one behind the other."""
    span = words[rows].astype(np.int64)
    return flat[np.repeat(offset[rows] - (np.cumsum(span) - span), span) + np.arange(span.sum())]


def _shared_folder(spark) -> str | None:
    """A folder of its own beside the checkpoints, if Python workers can open files there."""
    held = urlsplit(ensure_checkpoint_dir(spark))
    return f"{held.path}/sketches-{uuid.uuid4().hex}" if held.scheme in ("", "file") else None


def _written(folder: str, heads: np.ndarray, flat: np.ndarray) -> str:
    """A new file with the number of records, their heads and their sketches; its name."""
    os.makedirs(folder, exist_ok=True)
    name = f"{folder}/{uuid.uuid4().hex}"
    with open(name, "wb") as out:
        for part in (np.array([len(heads)], dtype="<u8"), heads, flat):
            out.write(part.tobytes())
    return name


def _read(file: str, rows: bytes) -> tuple[bytes, bytes]:
    """Heads and sketches of some rows of a file."""
    data = np.memmap(file, dtype="<u8", mode="r")
    begin = 1 + int(data[0]) * _HEAD.itemsize // 8
    heads, rows = np.array(data[1:begin]).view(_HEAD), np.frombuffer(rows, dtype="<u4")
    words = heads["words"].astype(np.int64)
    return heads[rows].tobytes(), _bodies(data[begin:], np.cumsum(words) - words, words, rows).tobytes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _places(runs: np.ndarray, n: np.ndarray, ids: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """``(which, place)``: which entry goes to which place; the place of a whole list is the part that owns its run.

    A run held by more than LIST_ROWS records is cut into pieces by record; an entry goes to every
    pair of pieces that its own piece is in, each pair having a place of its own from ``parts`` on.
    """
    owner = ((runs >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
    hot = n > LIST_ROWS
    cold, hot = np.flatnonzero(~hot), np.flatnonzero(hot)
    if not len(hot):
        return cold, owner
    pieces = np.ceil(n[hot] / LIST_ROWS).astype(np.int64)
    mine = ((_mixed(ids[hot].astype(np.int64).view(np.uint64)) >> np.uint64(20)) % pieces.astype(np.uint64)).astype(np.int64)
    which, mine = np.repeat(hot, pieces), np.repeat(mine, pieces)
    other = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    pair = np.minimum(mine, other) << 20 | np.maximum(mine, other)
    place = (_mixed(runs[which] ^ _mixed(pair.astype(np.uint64) + np.uint64(1))) >> np.uint64(3)).astype(np.int64)
    return np.concatenate([cold, which]), np.concatenate([owner[cold], parts + place])


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(at):
            yield int(part[at[0]]), at


def _split(runs: np.ndarray, n: np.ndarray, ids: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Entries by place."""
    which, place = _places(runs, n, ids, parts)
    for k, at in _by_part(place):
        yield k, which[at]


BLOCK_PAIRS = 1_000_000  # pairs that are tested at a time


def _ranges(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (k, first[k] + 0, 1, ... count[k] - 1) over all k."""
    upto = np.cumsum(count)
    begin = 0
    while begin < len(count):
        done = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + BLOCK_PAIRS, "right")))
        part = count[begin:end]
        which = np.repeat(np.arange(begin, end), part)
        shift = np.repeat(first[begin:end] - (upto[begin:end] - part - done), part)
        yield which, shift + np.arange(len(which))
        begin = end


def _ones(bits: np.ndarray) -> np.ndarray:
    """The number of ones in each row of a matrix of words."""
    counted = np.bitwise_count(bits)
    if counted.shape[1] != 4:
        return counted.sum(axis=1, dtype=np.int32)
    four = counted.view("<u4")[:, 0]
    two = (four & 0x00FF00FF) + ((four >> 8) & 0x00FF00FF)
    return ((two & 0xFFFF) + (two >> 16)).astype(np.int32)


def candidate_pairs(runs, size, pos, ident, sketches, words, doc, threshold: float) -> Iterator[np.ndarray]:
    """Pairs of ids, each with a run in common, that no bound rules out; blocks of (a, b) with a < b.

    The arguments are parallel arrays over index entries; ``sketches`` holds, by number of words,
    the matrix of the documents' sketches at that width, and ``doc`` an entry's row in them.

    With r runs from its position on, an entry can reach the overlap with a partner if both sizes
    together are at most r (1 + t) / t.  So it has a largest size of partners, ``most``.  An entry
    is strong if that is no less than its own size.  Of a pair the smaller is always strong, and
    two strong entries fulfil the larger one's bound by themselves: in a list sorted by size the
    partners of a strong entry are one stretch, and all behind it is skipped.  Other entries pair
    with smaller strong ones only, again a stretch.
    """
    ratio = threshold / (1 + threshold)
    size, pos = size.astype(np.int64), pos.astype(np.int64)
    most = np.floor((size - pos + 1e-9) / ratio).astype(np.int64) - size
    order = np.lexsort((size, runs))
    runs, size, most, ident, doc = (x[order] for x in (runs, size, most, ident, doc))
    if not len(runs):
        return
    group = np.cumsum(np.append(0, runs[1:] != runs[:-1]))
    span = int(size.max()) + 1
    strong = np.flatnonzero(most >= size)
    weak = np.flatnonzero((most < size) & (most > 0))
    key = group[strong] * span + size[strong]
    end = np.searchsorted(key, group[strong] * span + np.minimum(most[strong], span - 1), "right")
    own = np.arange(len(strong))
    low = np.searchsorted(key, group[weak] * span, "left")
    high = np.searchsorted(key, group[weak] * span + np.minimum(most[weak], span - 1), "right")
    for entry, first, last in ((strong, own + 1, end), (weak, low, high)):
        tests = last - first
        long = np.bincount(group[entry], tests)[group[entry]] >= LONG_TESTS if len(entry) else np.empty(0, dtype=bool)
        short = np.flatnonzero(~long)
        for which, other in _ranges(first[short], tests[short]):
            x, y = strong[other], entry[short[which]]
            fit = most[x] >= size[y]
            yield from _tested(x[fit], y[fit], size, ident, sketches, words, doc, ratio)
        long = np.flatnonzero(long)
        for at in np.split(long, np.flatnonzero(np.diff(group[entry[long]])) + 1):
            for which, other in _near(entry[at], first[at], last[at], strong, size, sketches, words, doc, ratio):
                x, y = strong[other], entry[at[which]]
                fit = most[x] >= size[y]
                yield from _tested(x[fit], y[fit], size, ident, sketches, words, doc, ratio)


LONG_TESTS = 10_000  # tests of a list that is worked off in tiles
TILE = 64, 512


def _near(entry, first, last, strong, size, sketches, words, doc, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of one list the pairs (k, m), ``first[k] <= m < last[k]``, whose sketches aren't far apart in most of their words.

    Tiles of entry[k] by strong[m]; the limit of a tile is that of its largest sizes, so none is lost.
    """
    order = np.argsort(last, kind="stable")
    for rows in np.split(order, range(TILE[0], len(order), TILE[0])):
        x = entry[rows]
        begin, end = int(first[rows].min(initial=len(strong))), int(last[rows].max(initial=0))
        for start in range(begin, end, TILE[1]):
            y = strong[start : min(end, start + TILE[1])]
            width = int(min(words[doc[x]].min(), words[doc[y]].min()))
            used = width if width < 8 else width * 3 // 4
            halves = sketches[width]
            a, b = (np.concatenate([halves[0][doc[z]], halves[1][doc[z]]], axis=1)[:, :used].T.copy() for z in (x, y))
            differ = np.zeros((len(x), len(y)), dtype=np.uint16 if used < 1_000 else np.int64)
            for one, two in zip(a, b):
                differ += np.bitwise_count(one[:, None] ^ two[None, :])
            near = np.flatnonzero(differ <= int((size[x].max() + size[y].max()) * (1 - 2 * ratio) + 1e-6))
            k, m = rows[near // len(y)], start + near % len(y)
            apart = (m >= first[k]) & (m < last[k])
            yield k[apart], m[apart]


def _tested(x, y, size, ident, sketches, words, doc, ratio: float) -> Iterator[np.ndarray]:
    """The pairs whose sketches don't tell that the sets differ too much."""
    if not len(x):
        return
    both = size[x] + size[y]
    allowed = (both - 2 * np.ceil(both * ratio - 1e-9).astype(np.int64)).astype(np.int32)
    dx, dy = doc[x], doc[y]
    width = np.minimum(words[dx], words[dy])
    for w in np.unique(width):
        at = slice(None) if width.min() == width.max() else np.flatnonzero(width == w)
        a, b, limit = dx[at], dy[at], allowed[at]
        # one half of the sketch rules out nearly all pairs
        half = sketches[w][0]
        differ = _ones(half[a] ^ half[b])
        keep = np.flatnonzero(differ <= limit)
        if not len(keep):
            continue
        a, b, limit, differ = a[keep], b[keep], limit[keep], differ[keep]
        half = sketches[w][1]
        keep = keep[differ + _ones(half[a] ^ half[b]) <= limit]
        ia, ib = ident[x[at][keep]], ident[y[at][keep]]
        apart = ia != ib
        if apart.any():
            yield np.stack([np.minimum(ia, ib)[apart], np.maximum(ia, ib)[apart]], axis=1)


def _part_pairs(blobs: list[tuple[bytes, bytes, bytes]], threshold: float) -> np.ndarray:
    """All surviving pairs of one part of the index."""
    heads = [np.frombuffer(h, dtype=_HEAD) for _, h, _ in blobs]
    entries = [np.frombuffer(e, dtype=_ENTRY) for e, _, _ in blobs]
    base = np.concatenate([[0], np.cumsum([len(h) for h in heads])])
    head = np.concatenate(heads)
    row = np.concatenate([e["row"].astype(np.int64) + base[k] for k, e in enumerate(entries)])
    runs = np.concatenate([e["run"] for e in entries])
    pos = np.concatenate([e["pos"] for e in entries])
    # runs that occur once have no partner
    _, inverse, times = np.unique(runs, return_inverse=True, return_counts=True)
    shared = times[inverse] > 1
    runs, row, pos = runs[shared], row[shared], pos[shared]
    if not len(runs):
        return np.empty((0, 2), dtype=np.int64)
    words = head["words"].astype(np.int64)
    flat = np.concatenate([np.frombuffer(s, dtype="<u8") for _, _, s in blobs])
    offset = np.concatenate([[0], np.cumsum(words)])
    sketches = {}
    for w in np.unique(words):
        matrix = np.zeros((len(head), w), dtype=np.uint64)
        for v in np.unique(words[words >= w]):
            at = np.flatnonzero(words == v)
            block = flat[offset[at][:, None] + np.arange(v)[None, :]]
            while block.shape[1] > w:
                half = block.shape[1] // 2
                block = block[:, :half] ^ block[:, half:]
            matrix[at] = block
        sketches[int(w)] = (np.ascontiguousarray(matrix[:, : w // 2]), np.ascontiguousarray(matrix[:, w // 2 :]))
    found = list(candidate_pairs(runs, head["size"][row], pos, head["id"][row], sketches, words, row, threshold))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), dtype=np.int64)


def _join_parts(index: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: candidate pairs over all parts of the index; a pair may come from several parts."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            pairs = _part_pairs(held, threshold)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            for p, e, h, s, file in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if p != part and held:
                    yield from flush()
                    held = []
                part = p
                held.append((e, *_read(file, h)) if file else (e, h, s))
        if held:
            yield from flush()

    ordered = index.select("part", "entries", "head", "sketches", "file")
    return ordered.mapInArrow(join, "a long, b long")


# -- sets and classes --------------------------------------------------------------------------------


def run_sets(records: DataFrame, length: int) -> DataFrame:
    """``id, runs``: the set of a record as sorted packed hashes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [r.astype("<u8").tobytes() for r in text_sets(batch.column(1).to_pylist(), length)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.binary())], ["id", "runs"])

    return records.mapInArrow(build, "id long, runs binary")


def _sized(ids: DataFrame, count: int) -> DataFrame:
    """``ids``, to be broadcast if their counted number is small, else joined by shuffle."""
    return F.broadcast(ids) if count <= BROADCAST_IDS else ids


def link_classes(
    df: DataFrame, key: str, text: Column, length: int = 5, threshold: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: ``members`` has ``id, class_id`` for each record with a set, copies
    sharing the class of their smallest id; ``links`` has ``a, b, overlap, size_a, size_b`` for
    each linked pair of class representatives, a < b.

    The texts are read and hashed anew for the survey, the index and the check instead of being
    stored in between: the sets are several times larger than the texts.
    """
    spark = df.sparkSession
    records = _records(df, key, text)
    bits = count_bits(records.count())
    survey = cut_lineage(_survey(records, length, bits))
    prints = _prints(survey)
    heads = prints.groupBy("p1", "p2", "size").agg(F.min("id").alias("class_id"), F.count("id").alias("n"))
    # most classes have one member, and need no join
    shared = heads.where("n > 1").select("p1", "p2", "size", "class_id")
    members = cut_lineage(
        prints.join(shared, ["p1", "p2", "size"], "left").select("id", F.coalesce("class_id", "id").alias("class_id")).distinct()
    )
    copies = members.where("id <> class_id").select("id")
    total, copied = members.agg(F.count("id"), F.count_if(F.col("id") != F.col("class_id"))).first()
    representatives = records.join(_sized(copies, copied), "id", "left_anti") if copied else records
    counts = spark.sparkContext.broadcast(run_counts(survey, bits))
    parts = max(MIN_PARTS, -(-(total - copied) // INDEX_RECORDS))
    folder = _shared_folder(spark)
    index = _index_entries(representatives, counts, length, threshold, parts, (total - copied) / max(1, total), folder)
    placed = index.repartition(parts, F.col("part")).sortWithinPartitions("part")
    candidates = _join_parts(placed, threshold).distinct()
    try:
        return members, cut_lineage(_verified(candidates, records, length, threshold))
    finally:
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


def _verified(pairs: DataFrame, records: DataFrame, length: int, threshold: float) -> DataFrame:
    """Pairs with the overlap of their exact sets, where that reaches the threshold."""
    pairs = cut_lineage(pairs)
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    small = run_sets(records.join(_sized(needed, 2 * pairs.count()), "id", "left_semi"), length)
    left = small.select(F.col("id").alias("a"), F.col("runs").alias("ra"))
    right = small.select(F.col("id").alias("b"), F.col("runs").alias("rb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, ra, rb in zip(*(batch.column(k).to_pylist() for k in range(4))):
                x, y = np.frombuffer(ra, dtype="<u8"), np.frombuffer(rb, dtype="<u8")
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                overlap = int((y[at] == x).sum())
                if overlap >= threshold * (len(x) + len(y) - overlap) - 1e-9:
                    out.append((a, b, overlap, len(x), len(y)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "overlap", "size_a", "size_b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "rb")
    return joined.mapInArrow(check, "a long, b long, overlap long, size_a long, size_b long").distinct()


PLACE_ROWS = 1_000  # members of a class that are paired in one place


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``a, b``: every linked pair of records, a < b, the answers of a class's members derived from
    those of its representative; copies are linked to one another.

    On one side the members of a class are spread over as many places as its size asks for, on the other
    they go to each of them, so no task pairs a whole class of very many copies.
    """
    sizes = members.groupBy("class_id").agg(F.ceil(F.count("id") / PLACE_ROWS).cast("int").alias("places"), F.count("id").alias("n"))
    sized = members.join(sizes, "class_id")
    spread = sized.withColumn("place", F.pmod(F.xxhash64("id"), F.col("places")).cast("int"))
    everywhere = sized.where("n > 1").withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1)))
    within = spread.where("n > 1").alias("x").join(everywhere.alias("y"), ["class_id", "place"]).where("x.id < y.id").select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b")
    )
    # a link meets the members of its one class in their places, and then all of the other
    ends = links.select(F.col("a").alias("ca"), F.col("b").alias("cb"))
    placed = ends.join(sizes.select(F.col("class_id").alias("ca"), "places"), "ca").withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1)))
    across = (
        placed.join(spread.select(F.col("class_id").alias("ca"), "place", F.col("id").alias("ia")), ["ca", "place"])
        .join(members.select(F.col("class_id").alias("cb"), F.col("id").alias("ib")), "cb")
        .select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
    )
    return within.union(across)


def membership(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id, class_id, class_size, links``: a row per record; ``links`` counts the other classes
    that its class is linked to."""
    sizes = members.groupBy("class_id").agg(F.count("id").alias("class_size"))
    ends = links.select(F.col("a").alias("class_id")).union(links.select(F.col("b").alias("class_id")))
    counted = ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    return (
        members.join(sizes, "class_id")
        .join(counted, "class_id", "left")
        .select("id", "class_id", "class_size", F.coalesce("links", F.lit(0)).alias("links"))
    )
