"""Evaluation items that leak into a corpus.

One Aho-Corasick automaton holds every run of MIN_WORDS consecutive words of the items (as a
sequence of word numbers); each text is scanned once, and the ends of the matches are mapped back
to character offsets of the original text.

The automaton is built from the items alone.  Their text is summed up before anything is sent:
up to BLOCK_CHARS of item text make one automaton; a larger set of items is worked off in blocks
of that size, each a pass over the corpus, so what goes to the executors has a fixed bound.

Defined cases: null, empty or short texts and items of fewer than MIN_WORDS words match nothing;
items with the same text are all reported; repeated rows of a document give one result row.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.words import WORD, words_of

MIN_WORDS = 12
BLOCK_CHARS = 8_000_000

SCHEMA = "doc_id long, item_id long, part string, words int, start_char int, end_char int"


class LeakScanner:
    """The automaton over word numbers; 0 stands for every word that no item has."""

    def __init__(self, passages: list[tuple[int, str, str]], length: int = MIN_WORDS) -> None:
        self.length = length
        self.numbers: dict[str, int] = {}
        self.owners: list[tuple[int, str]] = []
        runs: dict[tuple[int, ...], set[int]] = {}
        for item_id, part, text in passages:
            numbered = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text))
            owner = len(self.owners)
            self.owners.append((item_id, part))
            for k in range(len(numbered) - length + 1):
                runs.setdefault(numbered[k : k + length], set()).add(owner)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for run, owners in runs.items():
            self.automaton.add_word(run, tuple(sorted(owners)))
        self.empty = not runs
        if runs:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> list[tuple[int, str, int, int, int]]:
        """``item_id, part, words, start, end`` of the longest matched stretch of each item."""
        if not text or self.empty:
            return []
        low = text.lower()
        number = self.numbers.get
        seen = tuple([number(w, 0) for w in WORD.findall(low)])
        if len(seen) < self.length or len(seen) - seen.count(0) < self.length:
            return []
        ends: dict[int, list[int]] = {}
        for end, owners in self.automaton.iter(seen):
            for owner in owners:
                ends.setdefault(owner, []).append(end)
        if not ends:
            return []
        spans = _spans(text, low)
        out = []
        for owner, places in ends.items():
            best = first = last = places[0]
            size = 0
            for place in places:
                if place > last + 1:
                    first = place
                last = place
                if last - first >= size:
                    size, best = last - first, first
            begin = best - self.length + 1
            out.append((*self.owners[owner], size + self.length, spans[begin][0], spans[best + size][1]))
        return out


def _spans(text: str, low: str) -> list[tuple[int, int]]:
    """Offsets of the words in the original text, also where lower case changes the length."""
    if len(low) == len(text):
        return [m.span() for m in WORD.finditer(low)]
    origin = [k for k, ch in enumerate(text) for _ in ch.lower()]
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in WORD.finditer(low)]


_SCANNERS: dict[int, LeakScanner] = {}


def _scanner(passages: list[tuple[int, str, str]], length: int) -> LeakScanner:
    """One automaton per worker process."""
    key = hash((length, tuple(passages)))
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = LeakScanner(passages, length)
    return _SCANNERS[key]


def _blocks(passages: Iterator[tuple[int, str, str]], size: int) -> Iterator[list[tuple[int, str, str]]]:
    block, held = [], 0
    for passage in passages:
        if block and held + len(passage[2]) > size:
            yield block
            block, held = [], 0
        block.append(passage)
        held += len(passage[2])
    if block:
        yield block


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    parts: tuple[str, ...] = ("item_text", "answer"),
    min_words: int = MIN_WORDS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``doc_id, item_id, part, words, start_char, end_char``: for each document and part of an
    item that share at least ``min_words`` consecutive words, the longest such stretch."""
    spark = documents.sparkSession
    passages = items.select(
        "item_id", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("text")) for p in parts])).alias("p")
    ).where("item_id is not null and p.text is not null").select("item_id", "p.part", "p.text")
    texts = documents.where("text is not null and doc_id is not null").select("doc_id", "text")
    out = None
    rows = ((r.item_id, r.part, r.text) for r in passages.orderBy("item_id", "part").toLocalIterator())
    for block in _blocks(rows, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(shared.value, min_words)
            for batch in batches:
                found = [
                    (doc, *hit)
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for hit in scanner.scan(text)
                ]
                if found:
                    yield _batch(found)

        part = texts.mapInArrow(scan, SCHEMA)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], SCHEMA)
    return out.dropDuplicates(["doc_id", "item_id", "part"])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    frame = pd.DataFrame(rows, columns=["doc_id", "item_id", "part", "words", "start_char", "end_char"])
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays(
        [pa.array(frame[c], type=t) for c, t in zip(frame.columns, kinds)], names=list(frame.columns)
    )
