"""Variant spellings of employers' names, linked to the employer they mean.

1.  Each distinct spelling is taken apart: case, accents, legal form, branch town, article, order
    of parts and nicknames are evened out; what remains is the proper part (``core``), the stated
    line of business (``line``) and a person's first name (``first``).  Equal parts make one node.
    Lines of business are those of a list, with the ways in which they are shortened, and those that
    the corpus shows: words that stand beside very many different cores.
2.  The words of a core become a vector of character n-grams of two lengths, weighted by tf-idf over all
    nodes, whatever the order of the words.  A sparse cosine join finds partners over an index of
    n-grams, rare ones first: the most frequent n-grams of a node, as far as they can't lift a pair to
    the threshold by themselves, aren't indexed, and no pair is lost by that.  Nodes with different
    lines of business never meet, as the line is part of the index key; nodes without one meet all.
3.  Pairs below COSINE are dropped; of the others each node keeps its TOP best, and whatever is above
    SURE, so no list of partners that matters to the linkage is cut.  An exact check follows: the edit
    distance, which typing errors keep small and another name doesn't.
4.  Average linkage, weighted by how often a spelling occurs, groups the nodes of one line: the
    mean similarity of two groups, pairs that aren't partners counting as 0, must reach LINK.
    In each round every group joins its best heavier partner, unless that one leaves itself; rounds
    go on until no group moves.
5.  A node without a line joins the one employer that its core means; if that could be several, it
    stays by itself.

Everything runs as joins and aggregations over distinct spellings; a spelling that a third of all
rows have is one row.  Lists of the index longer than LIST_ROWS are cut into blocks, and each two
blocks meet in a place of their own; no list is collected.

Defined cases: null, blank and placeholder names are no employer; a name of nothing but a line of
business or legal form has no core and is no employer; repeated rows count once per spelling.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.session import cut_lineage

GRAMS = (2, 3)
COSINE = 0.25  # of two cores
TOP = 30  # partners that a node keeps, beside those above SURE
SURE = 0.5
LINK = 0.2  # mean similarity at which groups join
#: A word is a line of business of its own if it stands in this share of all spellings (and in so many at
#: least), with as many different words beside it.
LINE_SHARE = 0.005
LINE_NODES = 40
LIST_ROWS = 1_000  # entries of an index list that are joined in one place
EDITS = 2  # typing errors in a core; a swap of neighbours is one

# Words around a name.
PLACEHOLDERS = frozenset(
    "- -- . ? n/a na none null unknown confidential anonymous undisclosed private various tbd nil "
    "private_advertiser private_employer private_company company_not_disclosed company_confidential not_disclosed "
    "not_specified not_available employer_not_disclosed name_withheld confidential_employer confidential_company "
    "undisclosed_company undisclosed_employer unnamed company employer client our_client hiring_company "
    "company_name_withheld not_stated keine_angabe k._a. k.a. anonyme".split()
)
LEGAL_FORMS = frozenset(
    "ltd limited inc incorporated corp corporation llc llp lp plc gmbh ag kg ohg ug se sa sas sarl sl slu srl spa bv nv "
    "ab as oy pty pvt private co company pte kk".split()
)
EXTRA_WORDS = frozenset("the of careers jobs recruiting hiring a".split())

#: Lines of business with the ways in which they are shortened.
LINES = {
    "accounting": "accounting acct acctg accountg accountants",
    "associates": "associates assoc assocs assc associate",
    "catering": "catering cater catrg",
    "construction": "construction constr const constrn",
    "consulting": "consulting cons conslt consult consltg consultg",
    "dental": "dental dent dntl",
    "education": "education educ edu educn",
    "electronics": "electronics elec electr electron elex",
    "engineering": "engineering eng engg engrg engr engng",
    "financialservices": "financialservices finsvcs finserv financialsvcs finservices finsvc financialserv",
    "foods": "foods fds food",
    "group": "group grp gruppe",
    "healthcare": "healthcare hlthcare hlthcr healthcr",
    "hospitality": "hospitality hosp hospit hsptlty",
    "insurance": "insurance ins insur insce",
    "international": "international int intl internat intern",
    "laboratories": "laboratories lab labs labor laboratory",
    "legal": "legal lgl",
    "logistics": "logistics log lgstcs logist logis",
    "management": "management mgmt mgt mngmt mgnt",
    "manufacturing": "manufacturing mfg manuf manufact mfrg",
    "partners": "partners ptnrs prtnrs",
    "pharmaceuticals": "pharmaceuticals pharm pharma pharmac pharmaceutical",
    "roofing": "roofing roof rfg",
    "solutions": "solutions soln solns sols sol",
    "sons": "sons son",
    "staffing": "staffing staff stfg",
    "technologies": "technologies tech techs technol technology",
    "transport": "transport trnsprt transp trans trnspt",
}
LINE_OF = {short: line for line, words in LINES.items() for short in words.split()}
LONG_LINES = sorted({w for w in LINE_OF if len(w) >= 5})

#: First names with their short forms.
FIRST_NAMES = {
    "alexander": "alex sandy alec xander lex", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny",
    "charles": "charlie chuck chas", "christopher": "chris topher", "daniel": "dan danny", "david": "dave davy",
    "edward": "ed eddie ned ted_edward", "elizabeth": "liz beth eliza lizzie betty bess betsy libby", "francisco": "paco pancho fran kiko curro",
    "frederick": "fred freddie", "george": "geo", "gregory": "greg", "henry": "harry hank", "jacob": "jake",
    "james": "jim jas jimmy jamie", "johannes": "hans joh johann", "john": "jack johnny jno", "jonathan": "jon", "joseph": "joe jos joey",
    "katherine": "kate kathy catherine katie kathryn kath kitty", "lawrence": "larry", "margaret": "peggy maggie meg marge madge",
    "matthew": "matt", "michael": "mike mick", "nicholas": "nick nicky", "patricia": "pat patty tricia", "patrick": "paddy",
    "peter": "pete", "philip": "phil", "rebecca": "becky", "richard": "dick rich rick richd ricky", "robert": "bob rob robt bobby robbie bert",
    "samuel": "sam", "stephen": "steve", "susannah": "sue susan susanna suzy susie susana", "theodore": "ted theo teddy",
    "thomas": "tom thos tommy", "timothy": "tim", "victoria": "vicky", "william": "bill will wm billy liam willy",
}
FIRST_OF = {s: n for n, shorts in FIRST_NAMES.items() for s in [n, *shorts.split()]}
LONG_FIRST = sorted(n for n in FIRST_OF if len(n) >= 5)
PERSON_LINES = frozenset("accounting catering dental legal roofing staffing sons partners associates consulting".split())

_PAREN = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_DASHED = re.compile(r"\s+[-–—|:]\s+(?:careers|jobs|recruiting|recruitment|hiring|karriere)\s*$")
_DOTTED = re.compile(r"\b(?:[a-z]\.){2,}[a-z]?\b\.?")
_TWO_WORDS = {("health", "care"): "healthcare", ("financial", "services"): "financialservices"}
_FIN = {"financial", "fin", "finance"}
_SVC = {"services", "svcs", "serv", "svc", "srvcs", "servs", "service"}


def _one_error(a: str, b: str) -> bool:
    """Whether one insertion, deletion, replacement or swap of neighbours makes ``b`` of ``a``."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def _fold(name: str) -> str:
    text = unicodedata.normalize("NFKD", name)
    text = "".join(c for c in text if not unicodedata.combining(c)).lower().replace("ß", "ss").replace("ø", "o").replace("ł", "l")
    return text.replace("’", "'")


def parts_of(name: str | None, more_lines: frozenset[str] = frozenset()) -> tuple[str, str, str] | None:
    """``(core, line, first)``; empty where not stated, None for what is no employer.  ``more_lines`` are
    words that are lines of business beside those of the list."""
    if name is None:
        return None
    text = _fold(name).strip()
    if not text or re.sub(r"\s+", "_", text) in PLACEHOLDERS or not any(c.isalpha() for c in text):
        return None
    text = _DASHED.sub("", _PAREN.sub(" ", text))
    text = _DOTTED.sub(lambda m: m.group().replace(".", "") + " ", text)
    text = re.sub(r"\b(int|nat)'l\b", r"\1l", text)
    text = re.sub(r"'s\b", "", text).replace("&", " and ")
    words = re.findall(r"[^\W_]+\.?", text)
    core: list[str] = []
    lines: list[str] = []
    first = ""
    exact = any(w.rstrip(".") in LINE_OF or w.rstrip(".") in more_lines for w in words)
    k = 0
    while k < len(words):
        word = words[k].rstrip(".")
        after = words[k + 1].rstrip(".") if k + 1 < len(words) else ""
        if (word, after) in _TWO_WORDS:
            lines.append(_TWO_WORDS[word, after])
            k += 2
            continue
        if (word in _FIN or _any_close(word, ("financial",))) and (after in _SVC or _any_close(after, ("services",))):
            lines.append("financialservices")
            k += 2
            continue
        k += 1
        if word in LEGAL_FORMS or word in EXTRA_WORDS or word == "and":
            continue
        if word in LINE_OF:
            lines.append(LINE_OF[word])
        elif word in more_lines:
            lines.append(word)
        elif not exact and len(word) >= 5 and (close := _any_close(word, LONG_LINES)):
            lines.append(LINE_OF[close])
        else:
            core.append(words[k - 1])
    line = "+".join(sorted(set(lines)))
    if len(core) > 1 and (not lines or set(lines) & PERSON_LINES):
        core, first = _first_name(core)
    core = [w.rstrip(".") for w in core]
    if not core:
        return None
    return " ".join(core), line, first


def _any_close(word: str, options) -> str:
    if len(word) < 5:
        return ""
    return next((o for o in options if abs(len(o) - len(word)) <= 1 and _one_error(word, o)), "")


def _first_name(core: list[str]) -> tuple[list[str], str]:
    """A person's first name or initial among the words, and the other words."""
    for k, raw in enumerate(core):
        word = raw.rstrip(".")
        if word in FIRST_OF:
            return core[:k] + core[k + 1 :], FIRST_OF[word]
        if len(word) == 1:
            return core[:k] + core[k + 1 :], word
    for k, raw in enumerate(core):
        if close := _any_close(raw.rstrip("."), LONG_FIRST):
            return core[:k] + core[k + 1 :], FIRST_OF[close]
    return core, ""


def _grams(words: list[str]) -> list[str]:
    """The n-grams of words, whose ends are marked."""
    marked = [f"^{w}$" for w in words]
    return sorted({w[k : k + n] for w in marked for n in GRAMS for k in range(max(1, len(w) - n + 1))})


def _letters(core: str) -> int:
    """A bit for each letter that occurs an odd number of times; an edit changes two bits at most."""
    mask = 0
    for c in core:
        mask ^= 1 << (ord(c) % 61)
    return mask


PARTS = "name string, core string, turned string, line string, first string, grams array<string>, letters long"


def learnt_lines(names: DataFrame) -> frozenset[str]:
    """Words of the spellings (``name``, distinct) that are lines of business by their use: in LINE_SHARE of
    the spellings, beside as many different cores.  At most as many as LINE_SHARE of the words leave room
    for reach that share, so the list that goes to the workers is bounded."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                core = got[0].split() if (got := parts_of(name)) else []
                rows.extend((w, " ".join(core[:k] + core[k + 1 :])) for k, w in enumerate(core) if len(core) > 1 and len(w) > 2 and w not in FIRST_OF)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["word", "rest"])

    least = max(LINE_NODES, LINE_SHARE * names.count())
    used = names.select("name").mapInArrow(words, "word string, rest string").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("rest").alias("cores"))
    return frozenset(r.word for r in used.where((F.col("n") >= least) & (F.col("cores") >= 0.8 * least)).select("word").collect())


def take_apart(names: DataFrame, more_lines: frozenset[str] = frozenset()) -> DataFrame:
    """Adds the parts to spellings in column ``name``; spellings of no employer are left out.

    ``core`` is the proper part without blanks, ``turned`` the same with its words turned round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                got = parts_of(name, more_lines)
                if got:
                    words = got[0].split()
                    rows.append((name, "".join(words), "".join(words[::-1]), got[1], got[2], _grams(words), _letters("".join(words))))
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.string()) for c in columns[:5]), pa.array(columns[5], pa.list_(pa.string())), pa.array(columns[6], pa.int64())],
                    ["name", "core", "turned", "line", "first", "grams", "letters"],
                )

    return names.select("name").mapInArrow(run, PARTS)


def _node_id() -> Column:
    return F.xxhash64("core", "line", "first")


def node_vectors(nodes: DataFrame) -> DataFrame:
    """``id, v``: the unit vector of each node, as an array of n-gram and weight, rare n-grams first."""
    grams = nodes.select("id", F.explode("grams").alias("gram"))
    total = nodes.count()
    held = grams.groupBy("gram").agg(F.count("id").alias("df"))
    # n-grams of letters: their number is bounded by the alphabet, not by the data; checked all the same
    held = F.broadcast(held) if held.count() <= 2_000_000 else held
    weighted = grams.join(held, "gram").withColumn("w", F.log(F.lit(1.0 + total) / F.col("df")) + 1.0)
    packed = weighted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("w", "gram")), asc=False).alias("v"))
    normed = packed.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.w * x.w)))
    return normed.select("id", F.transform("v", lambda x: F.struct(x.gram.alias("gram"), (x.w / F.col("norm")).alias("w"))).alias("v"))


def _index(vectors: DataFrame) -> DataFrame:
    """The n-grams under which vectors (``id, v``) are found, a row for each.

    All vectors have their n-grams in one order.  Of a pair take the first n-gram that both have: were it
    among those from which on the rest of one vector is shorter than COSINE, all that the two share would
    lie in that rest, and their product would be below COSINE.  So that rest isn't indexed.
    """
    rest = lambda i: F.aggregate(F.slice("v", i + 1, F.size("v")), F.lit(0.0), lambda s, x: s + x.w * x.w)
    kept = F.filter("v", lambda x, i: rest(i) >= COSINE * COSINE - 1e-9)
    return vectors.withColumn("gram", F.explode(F.transform(kept, lambda x: x.gram)))


def _cosine(weights: Column, other: Column) -> Column:
    """The product of two unit vectors, one as a map of weights, one as an array of entries."""
    return F.aggregate(other, F.lit(0.0), lambda s, x: s + x.w * F.coalesce(F.try_element_at(weights, x.gram), F.lit(0.0)))


def _swap_distance(a: str, b: str, most: int) -> int:
    """Edit distance in which a swap of neighbours is one edit; ``most + 1`` if above ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return min(row[-1], most + 1)


@F.pandas_udf(T.IntegerType())
def _errors(a: pd.Series, ta: pd.Series, b: pd.Series, tb: pd.Series) -> pd.Series:
    """Typing errors between two cores, the words of either in any order."""
    return pd.Series(
        [
            min(_swap_distance(w, y, EDITS), _swap_distance(w, z, EDITS), _swap_distance(x, y, EDITS))
            for w, x, y, z in zip(a, ta, b, tb)
        ],
        dtype="int32",
    )


def _may_be_near() -> Column:
    """What any pair within EDITS fulfils: a swap is two plain edits at most."""
    near = lambda a, b: F.levenshtein(a, b, 2 * EDITS) >= 0
    return near(F.col("x.core"), F.col("y.core")) | near(F.col("x.core"), F.col("y.turned")) | near(F.col("x.turned"), F.col("y.core"))


def _in_blocks(entries: DataFrame, keys: list[str], spread: bool) -> DataFrame:
    """Index entries with the places (``lo, hi``) where they meet others of their list, and their own block.

    A list of LIST_ROWS entries or less has one place.  A longer one is cut into blocks by id; with
    ``spread`` each two blocks have a place, else each block has one.
    """
    long = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LIST_ROWS)
    counted = entries.join(long, keys, "left").withColumn("_b", F.coalesce(F.ceil(F.col("_n") / LIST_ROWS), F.lit(1)).cast("int"))
    own = counted.withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("_b")).cast("int"))
    if not spread:
        return own.withColumn("lo", F.col("own")).drop("_n")
    met = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return met.withColumns({"lo": F.least("own", "_other"), "hi": F.greatest("own", "_other")}).drop("_n", "_b", "_other")


def _meeting(slim: DataFrame, likely: Column) -> tuple[DataFrame, DataFrame]:
    """Pairs of entries ``x, y``: of one line, and with ``x`` stating none."""
    spread = _in_blocks(slim, ["gram", "line"], spread=True)
    place = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("gram", "line", "lo", "hi")]
    # of two entries that meet in several places, the one of their own blocks counts
    theirs = (F.least("x.own", "y.own") == F.col("x.lo")) & (F.greatest("x.own", "y.own") == F.col("x.hi"))
    same = spread.alias("x").join(spread.alias("y"), place[0] & place[1] & place[2] & place[3] & theirs & (F.col("x.id") < F.col("y.id")) & likely)
    # nodes that state no line go to every block of those that do
    lined = _in_blocks(slim.where("line <> ''"), ["gram"], spread=False)
    blocks = lined.groupBy("gram").agg(F.max("_b").alias("_b"))
    silent = slim.where("line = ''").join(blocks, "gram").withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("_b") - 1))).drop("_b")
    other = silent.alias("x").join(lined.drop("_b").alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.lo") == F.col("y.lo")) & likely)
    return same, other


def partners(nodes: DataFrame) -> DataFrame:
    """``a, b, sim, edits``: nodes whose cores are alike and whose first names agree, a < b, of one
    line or with one of them stating none."""
    vectors = cut_lineage(node_vectors(nodes))
    kept = ["id", "core", "turned", "line", "first", "letters"]
    slim = cut_lineage(_index(vectors.join(nodes.select(*kept), "id")).select("gram", *kept))
    agree = (
        (F.col("x.first") == F.col("y.first"))
        | (F.col("x.first") == "")
        | (F.col("y.first") == "")
        | ((F.length("x.first") == 1) & F.col("y.first").startswith(F.col("x.first")))
        | ((F.length("y.first") == 1) & F.col("x.first").startswith(F.col("y.first")))
    )
    # bounds of the exact check that cost next to nothing come first
    near = (F.bit_count(F.col("x.letters").bitwiseXOR(F.col("y.letters"))) <= 2 * EDITS) & (
        F.abs(F.length("x.core") - F.length("y.core")) <= EDITS
    )
    # in this order: the edit distance is worked out for what all cheaper bounds let pass
    same, other = _meeting(slim, near & agree & _may_be_near())
    columns = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "xy" for c in ("id", "core", "turned")]
    pairs = cut_lineage(same.select(*columns).unionByName(other.select(*columns)).dropDuplicates(["x_id", "y_id"]))
    # the map is made once for each node, ahead of the join
    mapped = F.map_from_arrays(F.transform("v", lambda x: x.gram), F.transform("v", lambda x: x.w))
    scored = (
        pairs.join(vectors.select(F.col("id").alias("x_id"), mapped.alias("ma")), "x_id")
        .join(vectors.select(F.col("id").alias("y_id"), F.col("v").alias("vb")), "y_id")
        .withColumn("sim", _cosine(F.col("ma"), F.col("vb")))
        .where(F.col("sim") >= COSINE)
        .drop("ma", "vb")
    )
    found = (
        best_partners(scored)
        .withColumn("edits", _errors("x_core", "x_turned", "y_core", "y_turned"))
        .where((F.col("edits") <= EDITS) & ((F.length("x_core") >= 7) | (F.col("edits") <= 1)))
    )
    return found.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), "sim", "edits")


def best_partners(scored: DataFrame) -> DataFrame:
    """Pairs (``x_id, y_id, sim``) that are among the TOP of either node, or above SURE."""
    rank = lambda side, other: F.row_number().over(Window.partitionBy(side).orderBy(F.col("sim").desc(), other))
    ranked = scored.withColumn("_x", rank("x_id", "y_id")).withColumn("_y", rank("y_id", "x_id"))
    return ranked.where((F.col("_x") <= TOP) | (F.col("_y") <= TOP) | (F.col("sim") >= SURE)).drop("_x", "_y")


def average_linkage(weights: DataFrame, edges: DataFrame, link: float = LINK) -> DataFrame:
    """``id, group``: groups of nodes by weighted average linkage.  ``weights`` has ``id, weight``,
    ``edges`` ``a, b, sim``.  Every round but the last takes at least one group away, so they end."""
    assigned = cut_lineage(weights.select("id", F.col("id").alias("group"), F.col("weight").cast("double")))
    links = cut_lineage(
        edges.join(assigned.select(F.col("id").alias("a"), F.col("weight").alias("wa")), "a")
        .join(assigned.select(F.col("id").alias("b"), F.col("weight").alias("wb")), "b")
        .select("a", "b", (F.col("sim") * F.col("wa") * F.col("wb")).alias("s"))
    )
    # only nodes with an edge can ever move
    moving = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    live = cut_lineage(assigned.join(moving, "id", "left_semi"))
    while True:
        mass = live.groupBy("group").agg(F.sum("weight").alias("w"))
        means = (
            links.join(mass.select(F.col("group").alias("a"), F.col("w").alias("wa")), "a")
            .join(mass.select(F.col("group").alias("b"), F.col("w").alias("wb")), "b")
            .withColumn("mean", F.col("s") / (F.col("wa") * F.col("wb")))
            .where(F.col("mean") >= link)
        )
        ends = means.select("a", "b", "mean", "wa", "wb").union(means.select("b", "a", "mean", "wb", "wa"))
        best = ends.groupBy("a").agg(F.max_by(F.struct("b", "wa", "wb"), F.struct("mean", "wb", "b")).alias("to"))
        leaving = best.where("to.wb > to.wa or (to.wb = to.wa and to.b < a)").select(F.col("a").alias("group"), F.col("to.b").alias("into"))
        staying = leaving.join(leaving.select(F.col("group").alias("into")), "into", "left_anti")
        moves = cut_lineage(staying.select("group", "into"))
        if moves.isEmpty():
            break
        live = cut_lineage(
            live.join(moves, "group", "left").select("id", F.coalesce("into", "group").alias("group"), "weight")
        )
        renamed = links
        for end in ("a", "b"):
            renamed = (
                renamed.join(moves.select(F.col("group").alias(end), F.col("into").alias(f"{end}_into")), end, "left")
                .withColumn(end, F.coalesce(f"{end}_into", end))
                .drop(f"{end}_into")
            )
        links = cut_lineage(
            renamed.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s"))
        )
    moved = live.select("id", F.col("group").alias("into"))
    return assigned.join(moved, "id", "left").select("id", F.coalesce("into", "group").alias("group"))


def link_names(names: DataFrame) -> DataFrame:
    """``name, employer``: an id of the employer for each distinct spelling that names one.

    ``names`` has a column ``name``, one row for each occurrence.
    """
    counted = names.where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    parts = take_apart(counted, learnt_lines(counted)).withColumn("id", _node_id())
    spelled = cut_lineage(parts.join(counted, "name"))
    nodes = cut_lineage(
        spelled.groupBy("id").agg(
            *[F.min(c).alias(c) for c in ("core", "turned", "line", "first", "grams", "letters")], F.sum("n").alias("weight")
        )
    )
    edges = cut_lineage(partners(nodes))
    line = nodes.select("id", "line")
    lined = edges.join(line.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").join(
        line.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b"
    )
    groups = cut_lineage(average_linkage(nodes, lined.where("la = lb")))
    # nodes without a line, and the groups with one that they could mean
    silent = lined.where("la <> lb").select(
        F.when(F.col("la") == "", F.col("a")).otherwise(F.col("b")).alias("id"),
        F.when(F.col("la") == "", F.col("b")).otherwise(F.col("a")).alias("other"),
        "edits",
    )
    own = groups.select("id", F.col("group").alias("own"))
    meant = (
        silent.join(own, "id")
        .join(groups.select(F.col("id").alias("other"), F.col("group").alias("target")), "other")
        .groupBy("own", "target")
        .agg(F.min("edits").alias("edits"))
    )
    exact = (
        meant.groupBy("own")
        .agg(
            F.count_if(F.col("edits") == 0).alias("hits"),
            F.count(F.lit(1)).alias("near"),
            F.min_by("target", F.struct("edits", "target")).alias("target"),
        )
        .where("hits = 1 or (hits = 0 and near = 1)")
    )
    joined = own.join(exact.select("own", "target"), "own", "left").select("id", F.coalesce("target", "own").alias("employer"))
    return spelled.select("name", "id").join(joined, "id").select("name", "employer")


def name_pairs(linked: DataFrame) -> DataFrame:
    """``name_a, name_b``: each two spellings of one employer, the smaller by code point first.  The
    spellings of an employer that has very many are spread over several places on one side."""
    sizes = linked.groupBy("employer").agg(F.count("name").alias("n")).where("n > 1")
    rows = linked.join(sizes, "employer").withColumn("_b", F.ceil(F.col("n") / LIST_ROWS).cast("int"))
    left = rows.withColumn("_p", F.pmod(F.xxhash64("name"), F.col("_b")).cast("int"))
    right = rows.withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return (
        left.alias("x")
        .join(right.alias("y"), ["employer", "_p"])
        .where("x.name < y.name")
        .select(F.col("x.name").alias("name_a"), F.col("y.name").alias("name_b"))
    )
