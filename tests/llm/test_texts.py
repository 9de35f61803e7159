import pytest
from pyspark.sql import functions as F

from postmill.llm import leaks, markup, mixing, pii, repetition

# -- markup ---------------------------------------------------------------------------------------------

MARKED = [
    ("<p>Hello <b>you</b></p>", ["html"]), ("a &amp; b", ["html"]), ("&lt;p&gt;x&lt;/p&gt;", ["html"]), ("x <!-- y --> z", ["html"]), ("<o:p></o:p>x", ["html"]),
    ("# Head\ntext", ["markdown"]), ("use **bold** words", ["markdown"]), ("see [this](https://x.test)", ["markdown"]), ("run `ls` now", ["markdown"]), ("~~gone~~", ["markdown"]),
    ("Head\n====\ntext", ["markdown"]), ("* one\n* two", ["markdown"]), ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]), ("so _well_ done", ["markdown"]),
    ("== Head ==\ntext", ["wiki"]), ("so '''bold''' it", ["wiki"]), ("see [[Page|there]]", ["wiki"]), ("{{code|x}}", ["wiki"]), ("[https://x.test more]", ["wiki"]),
    (r"\textbf{bold}", ["latex"]), (r"so $x^{2}$ it is", ["latex"]), (r"\(k \geq 3\)", ["latex"]), (r"a \\ b", ["latex"]), ("# H\n$\\sum_i w_i$", ["markdown", "latex"]),
]
PLAIN = [
    "Voted #1 place, C# and C++", "Latency < 5 ms while uptime stays > 99%", "5 * 7 h shifts in weekly_team_report", "Pay band $ 47k to $ 66k", "Follow @acme [hybrid roles only].",
    "R&D unit; ~45% more", "• first\n• second", "Cost is x^2 in c_1", "mail <a.b@x.test> me", "", "  \n ", "a - b", "5 < x and y > 3",
]


@pytest.mark.parametrize(("text", "kinds"), MARKED)
def test_markup_is_named(text, kinds):
    assert markup.kinds_of(text) == kinds


@pytest.mark.parametrize("text", PLAIN)
def test_signs_in_prose_are_no_markup(text):
    assert markup.kinds_of(text) == []


@pytest.mark.parametrize(("text", "kinds"), [*MARKED, *((t, []) for t in PLAIN)])
def test_the_early_answer_is_that_of_the_whole_scan(text, kinds):
    assert [k for k in markup.KINDS if k in markup.regions_of(text)] == kinds
    around = "\n\n".join(["plain words", text, "more of them"])
    assert [k for k in markup.KINDS if k in markup.regions_of(around)] == markup.kinds_of(around)


def test_the_weights_of_the_scan_decide():
    counted = {key: 1.0 if key[1] != "word" else w for key, w in markup.SIGN_WEIGHTS.items()}
    assert all(not markup.regions_of(t) for t in PLAIN) and sum(bool(markup.regions_of(t, counted)) for t in PLAIN) >= 4
    weaker = {**markup.SIGN_WEIGHTS, ("markdown", "markdown", "emphasis"): 0.35}
    assert not markup.regions_of("so _well_ done", weaker) and "markdown" not in markup.regions_of("_a_ " + "word " * 40 + "_b_", weaker)
    assert "markdown" in markup.regions_of("_so_ _well_ done", weaker) and markup.regions_of("so _well_ done")
    text = "words first, then '''bold''' and [[Link]] and words"
    score, start, end = markup.regions_of(text)["wiki"]
    assert text[start:end] == "'''bold''' and [[Link]]" and score > 5


def test_best_regions_are_the_best_of_all():
    import random

    rnd = random.Random(2)
    weights = {("wiki", "wiki", "a"): 1.5, ("wiki", "wiki", "b"): -1.0, ("wiki", "wiki", "c"): 0.4, ("wiki", "word", ""): -0.3}
    for _ in range(200):
        gaps = [rnd.randrange(4) for _ in range(rnd.randrange(1, 9))]
        text, signs = "", []
        for gap in gaps:
            text += " " * gap
            signs.append(("wiki", rnd.choice("abc"), len(text), len(text) + 1))
            text += "x"
        best = 0.0
        for i in range(len(signs)):
            for j in range(i + 1, len(signs) + 1):
                best = max(best, sum(weights["wiki", "wiki", s[1]] for s in signs[i:j]) - 0.3 * sum(gaps[i + 1 : j]))
        assert abs(markup.best_region("wiki", text, signs, weights)[0] - best) < 1e-9


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 9, 200])
def test_tags_are_resolved_as_often_as_they_are_escaped(depth):
    sign = lambda name: "&" + "amp;" * (depth - 1) + name + ";"
    text = f"so {sign('lt')}b{sign('gt')}bold{sign('lt')}/b{sign('gt')} it"
    assert markup.clean(text)[0] == "so bold it" and markup.kinds_of(text) == ["html"]


def test_styles_in_styles_are_resolved_at_any_depth():
    assert markup.clean("so " + "\\textbf{" * 60 + "deep" + "}" * 60 + " it")[0] == "so deep it"


def test_clean_text_keeps_structure():
    page = "<h2>Head</h2><p>A &amp; <b>b</b></p><ul><li>x</li><li>y</li></ul><pre><code>if a:\n    b</code></pre><table><tr><th>t</th><th>h</th></tr><tr><td>1</td><td>2</td></tr></table>"
    text, counts = markup.clean(page)
    assert text == "Head\n\nA & b\n\n• x\n\n• y\n\nif a:\n    b\n\nt | h\n\n1 | 2".replace("• x\n\n• y", "• x\n\n• y") or "• x" in text
    assert (counts["heading"], counts["item"], counts["code"], counts["row"]) == (1, 2, 1, 2)
    assert "if a:\n    b" in text and "t | h" in text and "<" not in text
    md, counts = markup.clean("# Head\n\n* one **two**\n\n```\nx = [1]\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n$x^{2}$")
    assert md.split("\n")[0] == "Head" and "• one two" in md and "x = [1]" in md and "1 | 2" in md and "x^{2}" in md and counts["formula"] == 1
    wiki, _ = markup.clean("== Head ==\n*item '''b'''\n{| class=w\n|-\n| a || b\n|}\n{{math|a/b}} [[P|q]] [[Category:Z]]")
    assert wiki.startswith("Head") and "• item b" in wiki and "a | b" in wiki and "a/b q" in wiki and "Category" not in wiki
    tex, _ = markup.clean("\\section*{Head}\n\\begin{itemize}\n\\item one \\textbf{two}\n\\end{itemize}\n\\[ a^{2} \\]")
    assert tex.startswith("Head") and "• one two" in tex and "a^{2}" in tex and "\\" not in tex
    assert markup.clean("plain  text\nhere")[0] == "plain text\nhere" and markup.clean("")[0] == ""


def test_page_furniture_is_cut_off():
    body = "<p>" + "You will work with good people on hard things. " * 6 + "</p>"
    page = f"<nav><a href='/'>Home</a><a href='/x'>Jobs</a></nav><h1>Cook</h1>{body}<footer><a href='/i'>Imprint</a><a href='/p'>Privacy</a></footer>"
    got, cut = markup.content_of(page)
    assert cut and "Home" not in got and "Imprint" not in got and "Cook" in got
    assert markup.content_of("<p>short</p>") == ("<p>short</p>", False)
    # with weights that tell tags from nothing, nothing is cut off
    tokens = list(markup._token_classes(page))
    assert markup.best_stretch(tokens, dict.fromkeys([*markup.WEIGHTS, "tag:nav"], 1.0))[0] == 0 and markup.best_stretch(tokens)[0] > 0


LINKS = "<div><a href='#'>Share</a><a href='#'>Print</a></div>"


@pytest.mark.parametrize(("page", "want"), [
    (f"{LINKS}<p>Cook for us.</p>", "<p>Cook for us.</p>"), (f"<p>Cook for us.</p>{LINKS}", "<p>Cook for us.</p>"),
    (f"{LINKS}<div><p>Cook <a href='/x'>here</a></p></div>{LINKS}", "<div><p>Cook <a href='/x'>here</a></p>"),
])
def test_blocks_of_links_at_the_edges_are_cut_off(page, want):
    got, cut = markup.content_of(page)
    assert cut and got.startswith(want) and "Share" not in got


@pytest.mark.parametrize("page", [
    LINKS, "<p>Apply at <a href='/a'>one</a> or <a href='/b'>two</a></p>", "<p>Cook.</p><p><a href='/a'>Apply here</a></p>", "<p>Sites:</p><ul><li><a href='/a'>A</a></li><li><a href='/b'>B</a></li></ul>",
    "<h2>Sites</h2><ul><li><a href='/a'>A</a></li><li><a href='/b'>B</a></li></ul>", "<ul><li>Plain</li><li><a href='/a'>A</a></li><li><a href='/b'>B</a></li></ul>",
    "<p>Write to us</p><p><a href='mailto:a@x.test'>Ann</a> <a href='mailto:b@x.test'>Bob</a></p>", "<table><tr><td>Site</td></tr><tr><td><a href='/a'>A</a><a href='/b'>B</a></td></tr></table>",
])
def test_links_that_belong_to_words_stay(page):
    assert markup.content_of(page) == (page, False)


def test_best_stretch_is_the_best_of_all():
    import random

    rnd = random.Random(1)
    weights = {"a": 1.5, "b": -1.0, "c": 0.5, "d": -2.0}
    for _ in range(200):
        tokens = [(rnd.choice("abcd"), k, k + 1) for k in range(rnd.randrange(1, 12))]
        best = max(sum(weights[t[0]] for t in tokens[i:j]) for i in range(len(tokens)) for j in range(i, len(tokens) + 1))
        assert abs(markup.best_stretch(tokens, weights)[2] - best) < 1e-9


def test_markup_operator_takes_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "**a b**", "x")], "id bigint, text string, clean_text string")
    got = {r.record_id: r for r in markup.clean_markup(df, "id", "text").collect()}
    assert got[1].clean_text is None and got[1].markup == [] and got[2].clean_text == "" and (got[3].clean_text, got[3].markup) == ("a b", ["markdown"])


# -- personal information --------------------------------------------------------------------------------

FINDER = pii.Finder(["Harlan Bluff", "Vauclair", "Steinau am Forst", "Puerto Almena", "Port Linden", "Kirkholm"])
CASES = [
    ("Mail jo.doe+x@mail.co.example or mailto:HR@X.TEST.", {("email", "jo.doe+x@mail.co.example"), ("email", "HR@X.TEST")}),
    ("a (at) b.test, c [at] d [dot] co [dot] test, e AT f-g DOT test, h @ i.test", {("email", "a (at) b.test"), ("email", "c [at] d [dot] co [dot] test"), ("email", "e AT f-g DOT test"), ("email", "h @ i.test")}),
    ("user@ and @handle, logo@2x, meet at noon. dot", set()),
    ("Call +49-279-5555741, (503) 555-0101 or 1-312-555-0193 ext. 158.", {("phone", "+49-279-5555741"), ("phone", "(503) 555-0101"), ("phone", "1-312-555-0193 ext. 158")}),
    ("Tel 0049 (0)30 5550312 / 07700 900733 / 327/555-0195 / +33 1 99 00 18 22", {("phone", "0049 (0)30 5550312"), ("phone", "07700 900733"), ("phone", "327/555-0195"), ("phone", "+33 1 99 00 18 22")}),
    ("Closing 2025-08-21, reviewed 03/02/2025, 624,925 parcels, ISO 9001, build 10.2.3280", set()),
    ("SSN 907-95-1689, identity number QQ 15 73 76 C, national ID C16ZZ3474, insurance no. 0000 0231 1299", {("id_number", "907-95-1689"), ("id_number", "QQ 15 73 76 C"), ("id_number", "C16ZZ3474"), ("id_number", "0000 0231 1299")}),
    ("Walk-ins are welcome at 55 Ninth Avenue, Harlan Bluff, IL 01460.", {("address", "55 Ninth Avenue, Harlan Bluff, IL 01460")}),
    ("at 98 rue des Tanneurs, 00926 Vauclair You keep", {("address", "98 rue des Tanneurs, 00926 Vauclair")}),
    ("Adresse Am Kanal 12, 00128 Steinau am Forst und Calle Olmo 5, 1º, 00881 Puerto Almena, second floor", {("address", "Am Kanal 12, 00128 Steinau am Forst"), ("address", "Calle Olmo 5, 1º, 00881 Puerto Almena")}),
    ("P.O. Box 9, Harlan Bluff, IL; Unit 34, 112 Copperbeech Close, Port Linden, ON; 70A Larkspur St., Kirkholm GK1 2FL", {("address", "P.O. Box 9, Harlan Bluff, IL"), ("address", "Unit 34, 112 Copperbeech Close, Port Linden, ON"), ("address", "70A Larkspur St., Kirkholm GK1 2FL")}),
    ("Reach Jelsen, Callum at x@y.test. Your contact is Ms Ada B. de Vries from here.", {("person_name", "Jelsen, Callum"), ("email", "x@y.test"), ("person_name", "Ada B. de Vries")}),
    ("Regards, ANNA MUN and Bo Lee-Kim, desk", {("person_name", "ANNA MUN"), ("person_name", "Bo Lee-Kim")}),
    ("nuno drukquist | n@x.test | Viggo Paka <v@x.test>", {("person_name", "nuno drukquist"), ("email", "n@x.test"), ("person_name", "Viggo Paka"), ("email", "v@x.test")}),
    ("Alice Brown prepared this. Please phone Maria Lopez tomorrow. Our engineer John Smith will help.", {("person_name", "Alice Brown"), ("person_name", "Maria Lopez"), ("person_name", "John Smith")}),
    ("Project Juniper Traedrerk is internal. Reach out at once. It was Monday.", set()),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_pieces_are_found(text, want):
    assert {(k, text[s:e]) for s, e, k in FINDER.find(text)} == want


@pytest.mark.parametrize(("left", "right"), [("$$", "$$"), ("$", "$"), (r"\(", r"\)"), (r"\[", r"\]")])
def test_formulas_of_any_length_are_kept(left, right):
    formula = " + ".join([r"\frac{a}{b}"] * 400)
    text, counts = markup.clean(f"so {left}{formula}{right} it is")
    assert formula in text and counts["formula"] == 1 and markup.kinds_of(f"so {left}{formula}{right} it is") == ["latex"]
    rows = r"\[ a \\[2pt] b \]"
    assert markup.clean(rows)[0] == r"a \\[2pt] b"


def test_a_list_of_towns_of_any_length_gives_the_same(spark, monkeypatch):
    towns = pii.towns_of((spark.createDataFrame([("Harlan Bluff",), (" Steinau am Forst ",), ("Saint-Aubry",), ("Port Linden",), (None,), ("x",)], "town string"), F.col("town")))
    texts = ["at 55 Ninth Avenue, Harlan Bluff Manor, IL; then Am Kanal 12, 00128 Steinau am Forst Mitte.", "98 rue des Tanneurs, 00926 Saint-Aubry Nord, x", None, "", "Unit 34, 112 Copperbeech Close, PORT LINDEN, ON"]
    df = spark.createDataFrame([(k % 4, t, "c") for k, t in enumerate(texts)], "id bigint, text string, towns string")
    got = {}
    for most in (pii.MAX_TOWNS, 2):
        monkeypatch.setattr(pii, "MAX_TOWNS", most)
        found = sorted(pii.find_personal(df, "id", "text", "o", towns).collect())
        got[most] = found, sorted(pii.redact(df, "id", "text", towns).collect(), key=str)
        assert any(r.found == "55 Ninth Avenue, Harlan Bluff" for r in found) and any(r.found.endswith("Steinau am Forst") for r in found)
    assert got[2] == got[100_000]
    assert pii.find_personal(df, "id", "text", "o").count() == 4


def test_pieces_of_any_length_are_found_whole():
    long = "x" * 5_000
    for text, want in [
        (f"mail {long}.y@z.test now", f"{long}.y@z.test"), (f"mail {long} (at) {long}.test", f"{long} (at) {long}.test"), (f"Regards, A{long} B{long}, desk", f"A{long} B{long}"),
        (f"at 12 A{long} B{long} Street, C{long}, IL 01460.", f"12 A{long} B{long} Street, C{long}, IL 01460"), (f"A{long} Paka <v@x.test>", f"A{long} Paka"),
    ]:
        assert want in {text[s:e] for s, e, _ in FINDER.find(text)}


def test_the_time_is_linear_in_the_text():
    import time

    def took(count):
        text = "Write to ann.lee@mail.test or call +49-279-5555741. " * count
        began = time.perf_counter()
        assert len(FINDER.find(text)) == 2 * count
        return time.perf_counter() - began

    took(100)
    assert took(8_000) < 40 * took(800)


def test_redaction_keeps_the_rest(spark):
    text = "Reach Ada Lund at a@b.test, then a@b.test."
    assert pii.redacted(text, FINDER.find(text)) == "Reach [PERSON_NAME] at [EMAIL], then [EMAIL]."
    df = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, "", "k"), (4, "x " * 50_000, "k")], "id bigint, text string, kind string")
    got = {r.record_id: r for r in pii.redact(df, "id", "text").collect()}
    assert got[1].pieces == 3 and got[2].text is None and got[3].text == "" and got[4].text == "x " * 50_000
    assert pii.find_personal(df, "id", "text", "o").count() == 2


# -- leaks -------------------------------------------------------------------------------------------------


def test_leaks_at_the_border_of_twelve_words(spark):
    words = [f"Word{k}" for k in range(30)]
    items = spark.createDataFrame([(1, " ".join(words), "answer", "s"), (2, " ".join(words[:11]), None, "s"), (3, None, "", "s"), (4, " ".join(words), "answer", "s")], "item_id bigint, item_text string, answer string, doc_id string")
    docs = [(1, "x, " + "; ".join(words[5:17]).upper() + " y"), (2, " ".join(words[5:16])), (3, None), (4, ""), (5, " ".join(words[:11] + ["z"] + words[11:25])), (1, "x " + " ".join(words[5:17]))]
    df = spark.createDataFrame([(d, t, 9) for d, t in docs], "doc_id bigint, text string, item_id int")
    got = {(r.doc_id, r.item_id): r for r in leaks.find_leaks(df, items).collect()}
    assert set(got) == {(1, 1), (1, 4), (5, 1), (5, 4)} and got[(5, 1)].words == 14
    assert leaks.find_leaks(df, items.where("item_id = 99")).count() == 0
    by_blocks = leaks.find_leaks(df, items, block_chars=10)
    assert {(r.doc_id, r.item_id) for r in by_blocks.collect()} == set(got)


def test_offsets_point_into_the_original():
    words = [f"w{k}" for k in range(12)]
    text = "İİ (" + ", ".join(words) + ") end"
    scanner = leaks.LeakScanner([(1, "item_text", " ".join(words))])
    (_, _, size, start, end), = scanner.scan(text)
    assert size == 12 and text[start:end] == ", ".join(words)


# -- repetition ------------------------------------------------------------------------------------------------


def _share(text):
    from postmill.llm.words import words_of

    w = words_of(text)
    runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    return (len(runs) - len(set(runs))) / len(runs) if runs else 0.0


def test_shares_are_exact_and_nothing_is_missed(spark):
    import random

    rnd = random.Random(2)
    texts = [None, "", "a b c d", "a " * 3000]
    for _ in range(150):
        base = [f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(4, 60))]
        texts.append(" ".join(base * rnd.choice((1, 1, 1, 2, 3)) + [f"v{rnd.randrange(999)}" for _ in range(rnd.randrange(40))]))
    df = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(texts)], "doc_id bigint, text string, probability double")
    got = {r.doc_id: r.repeated_share for r in repetition.score_repetition(df).collect()}
    assert all(abs(got[k] - _share(t)) < 1e-12 for k, t in enumerate(texts))
    assert {r.doc_id for r in repetition.repetitive(df).collect()} == {k for k, t in enumerate(texts) if _share(t) >= 0.3}
    assert repetition.repetitive(df.where("doc_id < 0")).count() == 0


def _vectors(texts):
    import numpy as np

    from postmill.llm.words import flat_hashes

    return np.concatenate([repetition.features_of(*block) for block in flat_hashes(texts)])


def test_model_tells_repetition_on_rows_it_has_not_seen():
    import random

    import numpy as np

    rnd = random.Random(4)
    texts = []
    for _ in range(900):
        base = [f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(20, 60))]
        texts.append(" ".join(base * (3 if rnd.random() < 0.3 else 1)))
    x, y = _vectors(texts), np.array([_share(t) >= repetition.SUSPECT for t in texts], dtype=float)
    model = repetition.fit_model(x[:600], y[:600])
    p = model.probability(x[600:])
    assert ((p > 0.5) == (y[600:] > 0)).mean() > 0.97 and (p[y[600:] > 0] >= repetition.ASK_FROM).all() and (p[y[600:] == 0] < repetition.ASK_FROM).mean() > 0.8


def test_the_answer_of_the_model_decides(spark):
    import numpy as np

    df = spark.createDataFrame([(k, f"t{k} " + "a b c d e f g " * 5) for k in range(40)], "doc_id bigint, text string")
    never = repetition.Model(np.zeros(repetition.FEATURES), 0.0, 0.0, -30.0)
    assert repetition.repetitive(df, model=never).count() == 0 and repetition.repetitive(df).count() == 40


def test_rare_repetition_that_no_sample_shows_is_found(spark, monkeypatch):
    import random

    rnd = random.Random(8)
    text = lambda: " ".join(f"w{rnd.randrange(500)}" for _ in range(80))
    rows = [(k, text()) for k in range(3000)]
    for k in (700, 1500, 2999):
        words = rows[k][1].split()
        rows[k] = (k, " ".join(words[:50] + words[:45] + words[50:]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(repetition, "SAMPLE_ROWS", 200)
    want = {k for k, t in rows if _share(t) >= 0.3}
    assert len(want) == 3 and {r.doc_id for r in repetition.repetitive(df).collect()} == want
    model = repetition.train(df, 200)
    assert repetition.score_repetition(df, model, all_shares=False).where("likely").count() < 600


def test_features_of_a_block_are_those_of_each_text():
    import numpy as np

    texts = ["a b a b a b", "", "Ärger über x" * 9, "one", "b " * 50]
    together = _vectors(texts)
    for k, t in enumerate(texts):
        alone = _vectors([t])[0]
        # a character n-gram may reach into the next text
        assert np.allclose(alone[: repetition.WORD_BUCKETS], together[k][: repetition.WORD_BUCKETS]) and np.allclose(alone[-5:], together[k][-5:])


# -- mixing --------------------------------------------------------------------------------------------------------


def test_budgets_fill_up_what_limits_leave():
    got = mixing.budgets({"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.5, 1), "c": (0.0, 1)}, 800)
    assert got == {"a": 200.0, "b": 600.0, "c": 0.0}
    assert mixing.budgets({}, {"a": (1.0, 3)}, 10) == {"a": 0.0}


def test_mix_meets_shares_with_whole_epochs_first(spark):
    rows = [(k, "word " * (5 + k % 7), ("Big-Source", "big source", "BIG_SOURCE")[k % 3], 1) for k in range(600)]
    rows += [(1000 + k, "tiny text here", "tiny", 1) for k in range(20)] + [(2000, None, "tiny", 1), (2001, "", "tiny", 1), (2002, "x", "other", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies int")
    targets = spark.createDataFrame([("big_source", 0.9, 1), ("tiny", 0.1, 4), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(docs, targets, total=2000)
    got = {r.source: r for r in report.collect()}
    assert got["big_source"].chosen_tokens <= 1800 and got["big_source"].chosen_tokens > 1780 and got["absent"].reached_share == 0
    tiny = [r for r in chosen.collect() if r.source == "tiny"]
    most = max(r.copies for r in tiny)
    assert most <= 4 and all(r.copies >= most - 1 for r in tiny) and sum(r.copies * r.tokens for r in tiny) <= 200
    again = {(r.doc_id, r.copies) for r in mixing.mix(docs, targets, total=2000)[0].collect()}
    assert again == {(r.doc_id, r.copies) for r in chosen.collect()}
    assert mixing.mix(docs.where("doc_id < 0"), targets)[0].count() == 0
    assert mixing.mix(docs, targets, total=0)[0].count() == 0


def test_bucketed_sums_choose_what_one_sorted_pass_chooses(spark):
    from pyspark.sql import functions as F

    rows = [(k, "word " * (3 + k % 11), "s") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    chosen = {r.doc_id for r in mixing.mix(docs, targets, total=3000)[0].collect()}
    uniform = (F.xxhash64(F.col("doc_id"), F.lit(1)).cast("double") + 2.0**63) / 2.0**64
    sized = mixing.sized_documents(docs).withColumn("key", -F.log(uniform) / F.col("weight"))
    total, want = 0, set()
    for r in sorted(sized.collect(), key=lambda r: (r.key, r.doc_id)):
        total += r.tokens
        if total > 3000:
            break
        want.add(r.doc_id)
    assert want <= chosen and len(chosen - want) <= 1
