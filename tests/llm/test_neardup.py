import random
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from postmill.llm import neardup
from postmill.llm.words import run_hashes, run_sets, word_hashes, words_of

WORDS = [f"w{k}" for k in range(40)]


def _texts(seed, count=120):
    """Texts of a small vocabulary, some of them edited copies of others."""
    rnd, out = random.Random(seed), []
    for _ in range(count):
        if out and rnd.random() < 0.5:
            words = rnd.choice(out).split()
            for _ in range(rnd.randrange(4)):
                words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        else:
            words = [rnd.choice(WORDS) for _ in range(rnd.randrange(3, 60))]
        out.append(" ".join(words))
    return out


def _brute(texts, length, threshold):
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[k : k + length]) for k in range(len(w) - length + 1)})
    pairs = set()
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12:
                pairs.add((a, b))
    return pairs


def _links(spark, rows, length, threshold):
    df = spark.createDataFrame(rows, "id bigint, text string, class_id string")
    return neardup.link_classes(df, "id", F.col("text"), length, threshold)


def test_links_are_those_of_brute_force(spark):
    for seed, length, threshold in ((1, 3, 0.6), (2, 5, 0.8), (3, 1, 0.5)):
        texts = _texts(seed)
        members, links = _links(spark, [(k, t, "clash") for k, t in enumerate(texts)], length, threshold)
        got = {(r.a, r.b) for r in neardup.all_pairs(members, links).collect()}
        assert got == _brute(texts, length, threshold), (seed, length, threshold)


def test_hot_runs_are_cut_into_pieces_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LIST_ROWS", 5)
    rnd = np.random.default_rng(1)
    n = 40
    ids = np.arange(n)
    sizes = rnd.integers(8, 14, n)
    common = rnd.integers(1, 2**60, 9).astype(np.uint64)
    sets = [np.unique(np.concatenate([common[: 6 + k % 4], rnd.integers(1, 2**60, max(0, int(sizes[k]) - 6 - k % 4)).astype(np.uint64)])) for k in range(n)]
    pairs = set()
    runs = np.concatenate(sets)
    rows = np.repeat(ids, [len(s) for s in sets])
    count = np.array([sum((s == r).any() for s in sets) for r in runs])
    for _, chosen in neardup._split(runs, count, ids[rows], 4):
        mine = rows[chosen]
        for a in range(len(chosen)):
            for b in range(a + 1, len(chosen)):
                if runs[chosen[a]] == runs[chosen[b]]:
                    pairs.add((min(mine[a], mine[b]), max(mine[a], mine[b])))
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if np.intersect1d(sets[a], sets[b]).size}
    assert pairs == want


def test_a_third_of_all_records_may_be_copies(spark):
    texts = ["a b c d e f g h"] * 200 + _texts(5, 100) + [None, "", "  ", "one two"]
    members, links = _links(spark, [(k, t, None) for k, t in enumerate(texts)], 5, 0.8)
    got = {r.id: r for r in neardup.membership(members, links).collect()}
    assert got[0].class_size == 200 and got[199].class_id == 0
    assert not {300, 301, 302, 303} & set(got)


def test_empty_tables_and_repeated_rows(spark):
    members, links = _links(spark, [], 3, 0.6)
    assert members.count() == 0 and neardup.all_pairs(members, links).count() == 0
    text = " ".join(WORDS[:20])
    members, links = _links(spark, [(1, text, None), (1, text, None), (2, text + " x", None)], 3, 0.6)
    assert [(r.a, r.b) for r in neardup.all_pairs(members, links).collect()] == [(1, 2)]


def test_sketches_never_differ_in_more_bits_than_the_sets_in_runs():
    rnd = np.random.default_rng(0)
    for size in (3, 50, 150, 400, 3000):
        a = np.unique(rnd.integers(1, 2**63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: size // 2], rnd.integers(1, 2**63, size).astype(np.uint64)]))
        x, y = neardup.parity_sketch(a), neardup.parity_sketch(b)
        w = min(len(x), len(y))
        differ = int(np.bitwise_count(neardup._folded(x, w) ^ neardup._folded(y, w)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_words_and_runs_match_the_plain_definition():
    texts = ["Ärger, Straße_x  ß² İx", "", None, "a-b c", "日本 語 42nd", "x" * 5000, "Σας ΣΑΣ"]
    plain = [words_of(t) for t in texts]
    hashed = word_hashes(texts)
    assert [len(h) for h in hashed] == [len(p) for p in plain]
    known = {}
    for p, h in zip(plain, hashed):
        for w, v in zip(p, h.tolist()):
            assert known.setdefault(w, v) == v
    assert len(set(known.values())) == len(known)
    for own, h in zip(run_sets(texts, 2), hashed):
        assert own.tolist() == sorted(set(run_hashes(h, 2).tolist()))


def test_counts_as_bytes_keep_their_order():
    counts = np.unique(np.concatenate([np.arange(2000), (1.3 ** np.arange(90)).astype(np.int64)]))
    codes = neardup.to_byte(counts)
    assert (np.diff(codes.astype(int)) >= 0).all() and (codes[:100] == counts[:100]).all()
    known = counts <= 5_000_000_000
    assert (neardup.from_byte(codes[known]) >= counts[known]).all() and (neardup.from_byte(codes[known]) <= counts[known] * 1.3 + 1).all()
    assert neardup.count_bits(0) == neardup.count_bits(120_000) == neardup.COUNT_BITS < neardup.count_bits(600_000) and neardup.count_bits(10**12) == neardup.MOST_BITS


def test_classes_of_many_copies_are_paired_in_places(spark, monkeypatch):
    texts = ["a b c d e f g h i j k l m n o p"] * 30 + ["a b c d e f g h i j k l m n o q"] * 25 + ["x " * 9] * 2
    got = {}
    for rows in (1_000, 4):
        monkeypatch.setattr(neardup, "PLACE_ROWS", rows)
        members, links = _links(spark, [(k, t, None) for k, t in enumerate(texts)], 3, 0.6)
        pairs = [(r.a, r.b) for r in neardup.all_pairs(members, links).collect()]
        assert len(pairs) == len(set(pairs))
        got[rows] = set(pairs)
    assert got[4] == got[1_000] == {(a, b) for a in range(55) for b in range(a + 1, 55)} | {(55, 56)}


class _Batches:
    """Stands in for a DataFrame of one batch of records."""

    def __init__(self, texts):
        self.batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])

    def mapInArrow(self, scan, schema):
        return list(scan(iter([self.batch])))


def _index(texts, held, parts):
    counts = types.SimpleNamespace(value=neardup.to_byte(np.full(1 << 12, held)))
    rows = neardup._index_entries(_Batches(texts), counts, 3, 0.6, parts)
    return [tuple(b.column(k)[0].as_py() for k in range(4)) for b in rows]


def test_runs_of_very_many_records_stay_in_the_parts_of_the_index():
    texts = _texts(7, 200)
    most = neardup.LIST_ROWS * 12
    index = _index(texts, most, 8)
    assert len(index) <= 8 and {row[0] for row in index} <= set(range(8))
    pairs = {tuple(p) for k in range(8) for p in neardup._part_pairs([row[1:] for row in index if row[0] == k], 0.6).tolist()}
    links = {(a, b) for a, b in _brute(texts, 3, 0.6) if set(words_of(texts[a])) and texts[a] != texts[b]}
    assert links <= pairs
    # lists of 40,000 records are worked off whole: an entry for each run of a prefix
    entries = sum(len(row[1]) for row in _index(texts, 40_000, 8)) // neardup._ENTRY.itemsize
    assert entries <= sum(len(s) for s in run_sets(texts, 3))


def test_long_lists_worked_off_in_tiles_give_the_same_pairs(monkeypatch):
    texts = _texts(11, 300) + [" ".join(WORDS[k % 7 :] * 9) + f" z{k}" for k in range(60)]
    index = [row[1:] for row in _index(texts, 50, 1)]
    got = []
    for least, tile in ((10**9, (64, 2_048)), (0, (3, 5)), (0, (64, 2_048))):
        monkeypatch.setattr(neardup, "LONG_TESTS", least)
        monkeypatch.setattr(neardup, "TILE", tile)
        got.append(neardup._part_pairs(index, 0.6).tolist())
    assert got[0] == got[1] == got[2] and len(got[0]) > 60


def test_a_sketch_is_stored_once_however_many_parts_need_it(tmp_path):
    texts = _texts(13, 200)
    held = types.SimpleNamespace(value=neardup.to_byte(np.full(1 << 12, 50)))
    plain = neardup._index_entries(_Batches(texts), held, 3, 0.6, 64)
    index = neardup._index_entries(_Batches(texts), held, 3, 0.6, 64, 1.0, str(tmp_path / "s"))
    size = lambda rows: sum(len(b.column(k)[0].as_py()) for b in rows for k in (2, 3))
    assert len(list((tmp_path / "s").iterdir())) == 1 and size(index) * 10 < size(plain)
    for a, b in zip(plain, index):
        assert a.column(1) == b.column(1) and neardup._read(b.column(4)[0].as_py(), b.column(2)[0].as_py()) == (a.column(2)[0].as_py(), a.column(3)[0].as_py())
