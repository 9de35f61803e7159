import random

import pytest

from postmill.llm import names

SAME = [
    ("Acmeval Norton Foods Ltd", "ACMEVAL NORTON FOODS"), ("Acmeval Norton Foods", "Foods of Norton Acmeval"), ("Bolradtim Services Dental", "Bolradtim Services Dntl."),
    ("Wilvornel Technologies GmbH", "Wilvörnel Technolgies - Careers"), ("Peggy Lomrandil & Sons", "Margaret Lomrandil and Sons (Townford)"), ("Kortalben Health Care", "The Kortalben Healthcare"),
    ("Vulmar Tendol Insurance", "VulmarTendol Ins."), ("Vulmar Tendol Insurance", "Vulmar Tednol Insurance"), ("Drosk Financial Services", "Drosk Fin. Svcs"),
]


def _linked(spark, spellings):
    df = spark.createDataFrame([(s,) for s in spellings], "name string")
    return {r.name: r.employer for r in names.link_names(df).collect()}


@pytest.fixture(scope="module")
def linked(spark):
    other = ["Acmeval Norton Dental", "Hentovic", "Hentovic Logistics SA", "Jurmal Foods", "Jurmal Legal", "Jurmal", None, "", "N/A", "Confidential", "Ltd", "-"]
    return _linked(spark, [s for pair in SAME for s in pair] + other)


@pytest.mark.parametrize(("a", "b"), SAME)
def test_spellings_of_one_employer_are_linked(linked, a, b):
    assert linked[a] == linked[b]


def test_lines_of_business_keep_employers_apart(linked):
    assert linked["Acmeval Norton Foods Ltd"] != linked["Acmeval Norton Dental"]
    assert linked["Hentovic"] == linked["Hentovic Logistics SA"]
    assert len({linked["Jurmal Foods"], linked["Jurmal Legal"], linked["Jurmal"]}) == 3


def test_placeholders_are_no_employer(linked):
    assert not {None, "", "N/A", "Confidential", "Ltd", "-"} & set(linked)


def test_pairs_and_empty_input(spark):
    assert _linked(spark, []) == {}
    df = spark.createDataFrame([("b x foods",), ("B X Foods",), ("B X Foods",)], "name string")
    got = [(r.name_a, r.name_b) for r in names.name_pairs(names.link_names(df)).collect()]
    assert got == [("B X Foods", "b x foods")]


def test_average_linkage_joins_by_mean_similarity(spark):
    weights = spark.createDataFrame([(1, 10), (2, 1), (3, 1), (4, 10)], "id bigint, weight bigint")
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.9), (1, 4, 0.05)], "a bigint, b bigint, sim double")
    got = {r.id: r.group for r in names.average_linkage(weights, edges, link=0.3).collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[1] != got[4]


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "abc", 0), ("abc", "acb", 1), ("abcd", "abxd", 1), ("abcdef", "abdcfe", 2), ("abc", "xyz", 3), ("abcdef", "ab", 3)])
def test_swaps_are_one_error(a, b, want):
    assert names._swap_distance(a, b, 2) == want


def test_the_index_loses_no_pair_above_the_threshold(spark):
    rnd = random.Random(5)
    cores = sorted({"".join(rnd.choice("ab") if rnd.random() < 0.8 else rnd.choice("cd") for _ in range(rnd.randrange(3, 13))) for _ in range(250)})
    vectors = {r.id: {x.gram: x.w for x in r.v} for r in names.node_vectors(_nodes(spark, cores)).collect()}
    keys = {}
    for r in names._index(names.node_vectors(_nodes(spark, cores))).select("id", "gram").collect():
        keys.setdefault(r.id, set()).add(r.gram)
    assert sum(map(len, keys.values())) < sum(map(len, vectors.values()))
    near = 0
    for a in vectors:
        for b in range(a):
            if sum(w * vectors[b].get(g, 0.0) for g, w in vectors[a].items()) >= names.COSINE:
                near += 1
                assert keys[a] & keys[b]
    assert near > 100


def _nodes(spark, cores, lines=("",)):
    rows = [(k, c, c, lines[k % len(lines)], "", names._grams([c]), names._letters(c)) for k, c in enumerate(cores)]
    return spark.createDataFrame(rows, "id bigint, core string, turned string, line string, first string, grams array<string>, letters bigint")


def _cores(seed, count):
    rnd = random.Random(seed)
    cores = set()
    while len(cores) < count:
        core = "".join(rnd.choice(["ral", "tum", "vek", "lor", "sin", "pad"]) for _ in range(3))
        at = rnd.randrange(len(core))
        cores |= {core, core[:at] + rnd.choice("xyz") + core[at + 1 :]}
    return sorted(cores)


def test_long_lists_are_cut_into_blocks_without_losing_a_pair(spark, monkeypatch):
    nodes = _nodes(spark, _cores(3, 220), ("", "foods", "legal"))
    got = {}
    for most in (10**6, 7):
        monkeypatch.setattr(names, "LIST_ROWS", most)
        got[most] = sorted((r.a, r.b, round(r.sim, 9)) for r in names.partners(nodes).collect())
    assert got[7] == got[10**6] and len(got[7]) > 100
    linked = spark.createDataFrame([(f"n{k}", k // 40) for k in range(100)], "name string, employer int")
    pairs = [(r.name_a, r.name_b) for r in names.name_pairs(linked).collect()]
    assert len(pairs) == len(set(pairs)) == 2 * 40 * 39 // 2 + 20 * 19 // 2


def test_threshold_and_linkage_decide(spark, monkeypatch):
    nodes = _nodes(spark, _cores(4, 160))
    base = names.partners(nodes)
    pairs = {(r.a, r.b) for r in base.collect()}
    monkeypatch.setattr(names, "COSINE", 0.0)
    more = {(r.a, r.b) for r in names.partners(nodes).collect()}
    assert pairs < more
    # far spellings are held together by near ones; without the mean, chains join what the linkage keeps apart
    weights = nodes.selectExpr("id", "1L as weight")
    grouped = lambda link: len({r.group for r in names.average_linkage(weights, base, link=link).collect()})
    assert grouped(0.0) < grouped(names.LINK) < grouped(0.9)


def test_top_partners_and_all_sure_ones_are_kept(spark, monkeypatch):
    monkeypatch.setattr(names, "TOP", 2)
    rows = [(0, k, 0.3 + k / 100) for k in range(1, 15)] + [(k, 0, 0.9) for k in range(20, 30)] + [(k, 50 + k, 0.26) for k in range(1, 5)]
    got = {(r.x_id, r.y_id) for r in names.best_partners(spark.createDataFrame(rows, "x_id bigint, y_id bigint, sim double")).collect()}
    assert {(k, 0) for k in range(20, 30)} <= got and {(0, 14), (0, 13)} <= got and {(k, 50 + k) for k in range(1, 5)} <= got


def test_lines_of_business_are_learnt_from_their_use(spark, monkeypatch):
    monkeypatch.setattr(names, "LINE_NODES", 10)
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(4))
    made = [f"{word().title()} {line}" for _ in range(30) for line in ("Plumbing", "Bakery")]
    counted = spark.createDataFrame([(n,) for n in made + ["Kelbro Plumbing", "Kelbro Bakery", "Kelbro"]], "name string")
    assert names.learnt_lines(counted) == {"plumbing", "bakery"}
    linked = _linked(spark, made + ["Kelbro Plumbing", "KELBRO PLUMBING Ltd", "Kelbro Bakery", "Kelbro"])
    assert linked["Kelbro Plumbing"] == linked["KELBRO PLUMBING Ltd"] != linked["Kelbro Bakery"] and len({linked[n] for n in ("Kelbro", "Kelbro Plumbing", "Kelbro Bakery")}) == 3
