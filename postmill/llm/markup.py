"""Markup residue in text: which kinds there are, and clean text that keeps the structure.

Both answers come from maximum-scoring stretches, found by one linear scan each, with weights fitted on
labelled pages and texts as log odds.

Kinds.  A text is cut into words and signs; a sign belongs to a class, such as a known tag, a heading, a
link between brackets, a command, or a number sign in prose.  For each kind of markup its signs score
by how much more often they stand in texts labelled with the kind than in others, so that signs as
prose uses them score below zero, as words do.  The kind is there if its best stretch reaches LEAST.

Content.  Words score positive, tags negative, words inside links below other words; the best stretch
is the content of a page.  Its ends are moved to the borders of the blocks that they lie in, and only
page furniture or blocks of links are cut off: links that share a block with other words stay, as do
mail addresses, telephone numbers, and what a heading or a colon introduces.

The content is written out without markup: headings stand on lines of their own, items of lists begin
with a bullet, cells of a table row are divided by a bar, and code and formulas keep their text.

Defined cases: null stays null, with no kinds; empty and blank texts become empty; escaped tags are
resolved, as often as they are escaped, and count as HTML; unclosed and truncated tags are
dropped; a text without markup keeps its lines, with blanks collapsed.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.labelled_pages import PAGES, TEXTS

KINDS = ("html", "markdown", "wiki", "latex")

# Names of HTML elements.
TAGS = frozenset(
    "a abbr acronym address area article aside audio b base bdi bdo big blockquote body br button canvas caption center "
    "cite code col colgroup data dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer "
    "form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map "
    "mark marquee meta meter nav nobr noframes noscript object ol optgroup option output p param picture pre progress q "
    "rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td "
    "template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
DROPPED = frozenset("script style noscript template iframe object svg head title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "header hr html main nav ol p pre section summary table tbody tfoot thead ul br".split()
)
#: Blocks whose ends part links from other words; rows and entries belong to their table or list.
BORDERS = frozenset("address article blockquote center div dl fieldset figure main menu ol p section table ul".split())
FURNITURE = frozenset("nav footer header aside form button select input script style iframe".split())

EDGES = BORDERS | FURNITURE

TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*(?::[A-Za-z][A-Za-z0-9]*)?)((?:\s[^<>]*)?|/)>|<(/?)([A-Za-z][A-Za-z0-9]*)(?:\s+[\w:-]+\s*=[^<>]*)?$")
COMMENT = re.compile(r"<!--.*?(?:-->|$)|<![A-Za-z][^>]*>|<\?[a-z][^>]*\?>", re.S)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")

# Markdown, by line and inside a line.
MD_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*$", re.M)
MD_RULE = re.compile(r"^ {0,3}(?:={3,}|-{3,}|\*{3,}|_{3,})[ \t]*$", re.M)
MD_LIST = re.compile(r"^([ \t]*)(?:[*+-]|\d{1,3}[.)])[ \t]+(?=\S)", re.M)
MD_QUOTE = re.compile(r"^ {0,3}>[ \t]?(?=\S)", re.M)
MD_TABLE = re.compile(r"^[ \t]*\|.*\|[ \t]*$", re.M)
MD_TABLE_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*$")
MD_FENCE = re.compile(r"^ {0,3}(?:```|~~~)[^\n`]*$", re.M)
MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\(([^()\s]+)(?:[ \t]+\"[^\"\n]*\")?\)")
MD_STRONG = re.compile(r"(?<![\\*])\*\*(?=[^\s*])([^*\n]*?[^\s*])\*\*(?!\*)|(?<![\w_])__(?=[^\s_])([^\n]*?[^\s_])__(?![\w_])")
MD_EM = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*?[^\s*\\])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])([^_\n]*?[^\s_])_(?![\w_])")
MD_STRIKE = re.compile(r"~~(?=\S)([^~\n]*?\S)~~")
MD_CODE = re.compile(r"(?<!`)`([^`\n]+)`(?!`)")

WIKI_HEADING = re.compile(r"^[ \t]*(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$", re.M)
WIKI_STRONG = re.compile(r"'''(?=\S)([^\n]*?\S)'''(?!')")
WIKI_EM = re.compile(r"(?<!')''(?=[^'\s])([^\n]*?[^'\s])''(?!')")
WIKI_LINK = re.compile(r"\[\[([^\[\]\n|]+)(?:\|([^\[\]\n]*))?\]\]")
WIKI_URL = re.compile(r"\[((?:https?|ftp|mailto):[^\s\]]+)(?:[ \t]+([^\]\n]+))?\](?!\()")
WIKI_TEMPLATE = re.compile(r"\{\{\s*([A-Za-z#][^{}|]*)((?:\|[^{}]*)?)\}\}")
WIKI_TABLE = re.compile(r"^[ \t]*(?:\{\|[^\n]*|\|\}|\|-[^\n]*)$", re.M)
WIKI_ITEM = re.compile(r"^([*#:;]+)(?=[^\s*#:;])", re.M)

TEX_COMMAND = re.compile(r"\\(?:[A-Za-z]{2,}\*?(?![A-Za-z])|[%&#_{}$](?=\s|\w|$))")
# Formulas of any length: possessive runs stop at the next delimiter, so the scan for it is linear.
TEX_MATH = re.compile(r"\$\$([^$]++)\$\$|(?<![\\$\w])\$(?=[^\s$])(?=[^$\n<>\\^_{]*+[\\^_{])([^$\n<>]++)(?<![\s\\])\$(?![\w$])")
TEX_DISPLAY = re.compile(r"(?<!(?<!\\)\\)(?:\\\[((?:[^\\]|\\[^\[\]])++)\\\]|\\\(((?:[^\\]|\\[^()])++)\\\))")
TEX_BREAK = re.compile(r"\\\\(?:\[[^\]\n]*\])?")
TEX_STYLE = re.compile(r"\\(?:textbf|textit|emph|texttt|underline|textsc|text|mbox|textrm|textsf|textsl)\s*\{([^{}]*)\}")
TEX_HEADING = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|title)\*?\s*\{([^{}]*)\}")
TEX_BEGIN = re.compile(r"\\begin\s*\{([a-zA-Z*]+)\}((?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?)")
TEX_END = re.compile(r"\\end\s*\{([a-zA-Z*]+)\}")
TEX_ITEM = re.compile(r"\\item(?:\s*\[([^\]\n]*)\])?[ \t]*")
TEX_HREF = re.compile(r"\\href\s*\{[^{}]*\}\s*\{([^{}]*)\}|\\url\s*\{([^{}]*)\}")
TEX_VERBATIM = re.compile(r"\\begin\s*\{(verbatim|lstlisting|minted)\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?\n?(.*?)\\end\s*\{\1\}", re.S)

#: A text without any of these has no construct.
SIGNS = re.compile(r"[<>&#*_`~|\[\]{}\\$]|''|==|^[ \t]*(?:[-+]|\d{1,3}[.)])[ \t]|^-{3,}", re.M)


def _is_tag(name: str) -> bool:
    """Elements of HTML, and those with a prefix that office programs write."""
    return name in TAGS or ":" in name


# -- weights and the content scan --------------------------------------------------------------------


def _token_classes(text: str) -> Iterator[tuple[str, int, int]]:
    """Classes with offsets: ``word``, ``linked word`` and ``tag:name``."""
    at, linked = 0, 0
    for m in TAG.finditer(text):
        name = (m.group(2) or m.group(5)).lower()
        if not _is_tag(name):
            continue
        for w in _WORD.finditer(text, at, m.start()):
            yield ("linked word" if linked else "word"), *w.span()
        yield f"tag:{name}", *m.span()
        if name == "a":
            linked = max(0, linked + (-1 if m.group(1) or m.group(4) else 1))
        at = m.end()
    for w in _WORD.finditer(text, at):
        yield ("linked word" if linked else "word"), *w.span()


_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def fit_weights(pages: list[list[tuple[str, str]]] = PAGES, smooth: float = 0.5) -> dict[str, float]:
    """Log odds of each class inside content against outside; a tag's is kept at or below zero and
    a word's above it, so that words can only add to a stretch and tags only take away."""
    inside, outside = Counter(), Counter()
    for page in pages:
        for label, part in page:
            (inside if label == "c" else outside).update(c for c, _, _ in _token_classes(part))
    a, b = sum(inside.values()), sum(outside.values())
    names = {*inside, *outside}
    odds = {n: log((inside[n] + smooth) / (a + smooth * len(names))) - log((outside[n] + smooth) / (b + smooth * len(names))) for n in names}
    word = max(0.25, odds.get("word", 1.0))
    out = {"word": word, "linked word": min(odds.get("linked word", -1.0), word / 4)}
    for n, v in odds.items():
        if n.startswith("tag:"):
            out[n] = min(-0.05, v - 0.3)
    return out


WEIGHTS = fit_weights()
UNKNOWN_TAG = -0.3


def best_stretch(tokens: list[tuple[str, int, int]], weights: dict[str, float] = WEIGHTS) -> tuple[int, int, float]:
    """Offsets and score of the contiguous stretch of tokens with the largest sum; the longest of
    equal ones.  One pass: a sum that falls below zero can't begin a best stretch."""
    best, best_from, best_to = 0.0, 0, 0
    total, begin = 0.0, None
    for name, start, end in tokens:
        if begin is None or total < 0:
            total, begin = 0.0, start
        total += weights.get(name, UNKNOWN_TAG)
        if total > best:
            best, best_from, best_to = total, begin, end
    return best_from, best_to, best


def content_of(text: str) -> tuple[str, bool]:
    """The content of a page, and whether anything was cut off around it."""
    tokens = list(_outside_dropped(list(_token_classes(text))))
    if not any(n.startswith("tag:") for n, _, _ in tokens):
        return text, False
    start, end, _ = best_stretch(tokens)
    if end <= start:
        return text, False
    begin, stop = _block_start(text, tokens, start), _block_end(text, tokens, end)
    if not _is_around(text, tokens, 0, begin):
        begin = 0
    if not _is_around(text, tokens, stop, len(text)) or _INTRODUCES.match(text, end):
        stop = len(text)
    return text[begin:stop], begin > 0 or stop < len(text)


_INTRODUCES = re.compile(r"(?:\s|</\w+>)*?(?::|</[hH][1-6])(?!(?:\s|</\w+>)*<(?:nav|footer|aside|form)\b)")
_ADDRESS = re.compile(r"href\s*=\s*[\"']?\s*(?:mailto|tel):", re.I)


def _block_start(text: str, tokens: list[tuple[str, int, int]], start: int) -> int:
    """Where the block begins in which a stretch starts, with the blocks that open right before it."""
    begin = 0
    for n, s, e in reversed([t for t in tokens if t[2] <= start and t[0][4:] in EDGES and t[0].startswith("tag:")]):
        if text[s + 1] == "/" or n[4:] in FURNITURE or (begin and text[e:begin].strip()):
            return begin or e
        begin = s
    return begin


def _block_end(text: str, tokens: list[tuple[str, int, int]], end: int) -> int:
    """Where the block ends in which a stretch ends."""
    for n, s, e in tokens:
        if s >= end and n.startswith("tag:") and n[4:] in EDGES:
            return e if text[s + 1] == "/" and n[4:] not in FURNITURE else s
    return len(text)


def _is_around(text: str, tokens: list[tuple[str, int, int]], begin: int, stop: int) -> bool:
    """Whether a stretch of a page lies around its content: it has furniture, or nothing but two links or
    more."""
    part = [t for t in tokens if begin <= t[1] < stop]
    names = {n for n, _, _ in part}
    if any(n.startswith("tag:") and n[4:] in FURNITURE for n in names):
        return True
    links = sum(n == "tag:a" and text[s + 1] != "/" for n, s, _ in part)
    return links >= 2 and "linked word" in names and "word" not in names and not _ADDRESS.search(text, begin, stop)


def _outside_dropped(tokens: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    depth: str | None = None
    for token in tokens:
        name = token[0]
        if depth is None:
            yield token
            if name.startswith("tag:") and name[4:] in DROPPED:
                depth = name
        elif name == depth:
            depth = None
            yield token


# -- kinds -------------------------------------------------------------------------------------------

#: Ampersands that were escaped again and again, ahead of an entity.
_AGAIN = re.compile(r"&(?:amp;)+(?=(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});)")


def unescaped(text: str) -> str:
    """The text without escapes, however often it was escaped."""
    return html.unescape(_AGAIN.sub("&", text)) if "&" in text else text


#: Signs by class: the kind of markup, what a text has to contain, and the form.  Signs of the class
#: ``line`` are those of wiki texts too.
SIGNS_OF = [
    ("markdown", "code", "`", MD_CODE), ("markdown", "fence", "`", MD_FENCE), ("markdown", "fence", "~~~", MD_FENCE), ("markdown", "strike", "~~", MD_STRIKE), ("markdown", "link", "](", MD_LINK),
    ("markdown", "strong", "**", MD_STRONG), ("markdown", "strong", "__", MD_STRONG), ("markdown", "emphasis", "*", MD_EM), ("markdown", "emphasis", "_", MD_EM), ("markdown", "heading", "#", MD_HEADING),
    ("wiki", "strong", "'''", WIKI_STRONG), ("wiki", "emphasis", "''", WIKI_EM), ("wiki", "link", "[[", WIKI_LINK), ("wiki", "template", "{{", WIKI_TEMPLATE), ("wiki", "heading", "==", WIKI_HEADING),
    ("wiki", "table", "{|", WIKI_TABLE), ("wiki", "table", "|}", WIKI_TABLE), ("wiki", "address", "[", WIKI_URL),
    ("latex", "command", "\\", TEX_COMMAND), ("latex", "display", "\\", TEX_DISPLAY), ("latex", "break", "\\\\", TEX_BREAK), ("latex", "math", "$", TEX_MATH),
    # as prose uses the same signs
    ("markdown", "number", "#", re.compile(r"#\w|\w#")), ("markdown", "times", "*", re.compile(r"\d ?\* ?\d")), ("markdown", "joined", "_", re.compile(r"\w_\w")), ("markdown", "about", "~", re.compile(r"~ ?\d")),
    ("wiki", "aside", "[", re.compile(r"(?<!\[)\[(?!https?:|\[)[^\[\]\n]*\](?![\[(\]])")), ("wiki", "equals", "==", re.compile(r"(?<=\S )==>?(?= \S)")), ("wiki", "quote", "'", re.compile(r"(?<!')'(?!')")),
    ("latex", "amount", "$", re.compile(r"\$ ?\d")), ("latex", "power", "^", re.compile(r"\w\^\w")), ("latex", "slash", "\\", re.compile(r"(?<!\\)\\(?:\s|\w\b)")),
]
Sign = tuple[str, str, int, int]  # kind, class, start, end


def _html_signs(text: str, stop: bool = False) -> list[Sign]:
    """Signs of HTML; with ``stop`` only as many as it takes to find a tag or an entity that is one."""
    out: list[Sign] = []
    if stop:
        for form, known in ((TAG, lambda m: _is_tag((m.group(2) or m.group(5)).lower())), (ENTITY, _is_entity), (COMMENT, lambda m: True)):
            hit = next((m for m in form.finditer(text) if known(m)), None)
            if hit:
                return [("html", {TAG: "tag", ENTITY: "entity", COMMENT: "comment"}[form], *hit.span())]
        return []
    if "<" in text:
        out += [("html", "tag" if _is_tag((m.group(2) or m.group(5)).lower()) else "angle", *m.span()) for m in TAG.finditer(text)]
        out += [("html", "comment", *m.span()) for m in COMMENT.finditer(text)]
        out += [("html", "less", *m.span()) for m in _LESS.finditer(text)]
    if "&" in text:
        out += [("html", "entity" if _is_entity(m) else "and", *m.span()) for m in ENTITY.finditer(text)]
    return out


def _is_entity(m: re.Match) -> bool:
    return m.group().startswith("&#") or m.group()[1:] in html.entities.html5


_LESS = re.compile(r"<(?=[\s\d])")


def _line_signs(text: str, page: bool) -> list[Sign]:
    """Signs that take a line, or the start of one."""
    out: list[Sign] = [("line", "item", *m.span()) for m in MD_LIST.finditer(text)]
    if ">" in text and not page:
        out += [("markdown", "quote", *m.span()) for m in MD_QUOTE.finditer(text)]
    if "---" in text or "===" in text or "***" in text or "___" in text:
        at, before = 0, ""
        for line in text.split("\n"):
            if MD_TABLE.match(before) and MD_TABLE_RULE.match(line):
                out.append(("line", "table", at, at + len(line)))
            elif before.strip() and MD_RULE.match(line):
                out.append(("line", "rule", at, at + len(line)))
            at, before = at + len(line) + 1, line
    return out


def signs_of(text: str) -> tuple[str, list[Sign], list[Sign]]:
    """The text without HTML, the signs of HTML in the text as it is, and all other signs in the rest."""
    tags = _html_signs(text)
    page = any(c in ("tag", "comment", "entity") for _, c, _, _ in tags)
    bare = unescaped(text) if page else text
    if "<" in bare:
        bare = TAG.sub(lambda m: "\n" if (m.group(2) or m.group(5)).lower() in BLOCKS else "", bare)
    found: list[Sign] = []
    for kind, name, part, form in SIGNS_OF:
        if part in bare:
            found.extend((kind, name, *m.span()) for m in form.finditer(bare))
    return bare, tags, found + _line_signs(bare, page)


def fit_signs(texts: list[tuple[str, str]] = TEXTS, smooth: float = 0.5) -> dict[tuple[str, str, str], float]:
    """Log odds of each class of signs, by kind: in texts labelled with the kind against all others, each
    class once for a text.  Words score by how much rarer they are among the tokens of marked texts."""
    marked, plain, words = Counter(), Counter(), {}
    of_kind = Counter(k for label, _ in texts for k in label.split())
    for label, text in texts:
        bare, tags, others = signs_of(text)
        count = len(_WORD.findall(bare))
        for kind in KINDS:
            inside = kind in label.split()
            signs = {(k, c) for k, c, _, _ in (tags if kind == "html" else others) if k in (kind, "line")}
            for sign in signs:
                (marked if inside else plain)[kind, *sign] += 1
            share = words.setdefault((kind, inside), [0, 0])
            share[0] += count
            share[1] += count + sum(k in (kind, "line") for k, _, _, _ in (tags if kind == "html" else others))
    out: dict[tuple[str, str, str], float] = {}
    rare = smooth / max(1, len(texts))
    for kind, *sign in {*marked, *plain}:
        a, b = marked[kind, *sign] / max(1, of_kind[kind]), plain[kind, *sign] / max(1, len(texts) - of_kind[kind])
        out[kind, *sign] = log(a + rare) - log(b + rare)
    for kind in KINDS:
        (a, b), (c, d) = words[kind, True], words[kind, False]
        out[kind, "word", ""] = min(-0.01, log(a / b) - log(c / d))
    return out


SIGN_WEIGHTS = fit_signs()
#: The score of a stretch from which on its kind of markup is there.
LEAST = 0.4


def best_region(kind: str, text: str, signs: list[Sign], weights: dict[tuple[str, str, str], float]) -> tuple[float, int, int]:
    """Score and offsets of the stretch of signs and words that tells most of a kind."""
    word = weights[kind, "word", ""]
    best, best_from, best_to = 0.0, 0, 0
    total, begin, last = 0.0, 0, 0
    for k, name, start, end in sorted(signs, key=lambda x: x[2]):
        weight = weights.get((kind, k, name))
        if weight is None:
            continue
        if total > 0:
            total += word * text.count(" ", last, start)  # as many words as blanks
        if total <= 0:
            total, begin = 0.0, start
        total += weight
        last = max(last, end)
        if total > best:
            best, best_from, best_to = total, begin, end
    return best, best_from, best_to


def regions_of(text: str, weights: dict[tuple[str, str, str], float] | None = None) -> dict[str, tuple[float, int, int]]:
    """For each kind of markup in a text its best region: score and offsets, for HTML in the text as it is,
    for the others in the text without HTML."""
    if not SIGNS.search(text):
        return {}
    weights = SIGN_WEIGHTS if weights is None else weights
    bare, tags, signs = signs_of(text)
    out = {}
    for kind in ("html", "wiki", "latex", "markdown"):
        if kind == "markdown" and "wiki" in out:
            signs = [s for s in signs if s[0] != "line"]  # list signs, rules and bars of a wiki text are wiki's own
        # a list sign alone tells nothing of wiki
        own = tags if kind == "html" else [s for s in signs if s[0] == kind or (s[0] == "line" and kind == "markdown")]
        if own:
            region = best_region(kind, text if kind == "html" else bare, own, weights)
            if region[0] >= LEAST:
                out[kind] = region
    return out


def kinds_of(text: str) -> list[str]:
    """The kinds of markup in a text, tags that are escaped included: those of ``regions_of``.

    Here the scan stops where its answer is known: one sign that scores LEAST is a stretch that reaches it,
    and only a text without such a sign is scanned to its end.
    """
    if not SIGNS.search(text):
        return []
    found, bare = [], text
    if ("<" in text or "&" in text) and any(SIGN_WEIGHTS.get(("html", k, c), 0.0) >= LEAST for k, c, _, _ in _html_signs(text, stop=True)):
        found.append("html")
        bare = unescaped(bare)
    if "<" in bare:
        bare = TAG.sub(lambda m: "\n" if (m.group(2) or m.group(5)).lower() in BLOCKS else "", bare)
    for kind in ("wiki", "latex", "markdown"):
        clear, faint = STRONG_SIGNS[kind]
        if any(part in bare and form.search(bare) for part, form in clear):
            found.append(kind)
            continue
        if kind == "markdown":
            lines = _line_signs(bare, "html" in found)
            if "wiki" in found:
                lines = [x for x in lines if x[0] != "line"]
            if any(SIGN_WEIGHTS.get((kind, k, c), 0.0) >= LEAST for k, c, _, _ in lines):
                found.append(kind)
                continue
        if any(part in bare for part, _ in faint) and kind in regions_of(text):
            found.append(kind)
    return [k for k in KINDS if k in found]


def _by_strength(weights: dict[tuple[str, str, str], float]) -> dict[str, tuple[list, list]]:
    """For each kind its signs that reach LEAST by themselves, and those that only do so together."""
    out: dict[str, tuple[list, list]] = {k: ([], []) for k in KINDS}
    for kind, name, part, form in SIGNS_OF:
        weight = weights.get((kind, kind, name), 0.0)
        if weight > 0:
            out[kind][weight < LEAST].append((part, form))
    return out


STRONG_SIGNS = _by_strength(SIGN_WEIGHTS)


# -- clean text --------------------------------------------------------------------------------------

_KEEP = "\ue000{}\ue001"  # stands for a piece of code or a formula until the end
_KEPT = re.compile("\ue000(\\d+)\ue001")
_HEAD, _ITEM = "\ue002", "\ue003"


class Structure:
    """Clean text in the making, with what its structure has."""

    def __init__(self) -> None:
        self.kept: list[str] = []
        self.counts = Counter()

    def keep(self, text: str, what: str) -> str:
        self.counts[what] += 1
        self.kept.append(text.strip("\n"))
        return _KEEP.format(len(self.kept) - 1)

    def block(self, text: str, what: str) -> str:
        return f"\n{self.keep(text, what)}\n"

    def restore(self, text: str) -> str:
        while _KEPT.search(text):
            text = _KEPT.sub(lambda m: self.kept[int(m.group(1))], text)
        return text


_ESCAPED = re.compile(r"&(?:amp;)*lt;/?[A-Za-z!][^\n]*?&(?:amp;)*gt;")


def clean(text: str) -> tuple[str, Counter]:
    """The clean text and the counts of its headings, items, rows, code pieces and formulas."""
    out = Structure()
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = "".join(" " if "\ue000" <= c <= "\ue003" else c for c in text) if re.search("[\ue000-\ue003]", text) else text
    if SIGNS.search(text):
        page = "<" in text or "&" in text
        if "&" in text and _ESCAPED.search(text):
            text = unescaped(text)
        text = _from_latex(_code_first(text, out), out)
        text = _from_wiki(text, out)
        text = _from_markdown(text, out)
        if page:
            text = _from_html(text, out)
    return _tidy(text, out), out.counts


def _code_first(text: str, out: Structure) -> str:
    if "```" in text or "~~~" in text:
        lines, held, kept = text.split("\n"), None, []
        for line in lines:
            if MD_FENCE.match(line):
                if held is None:
                    held = []
                else:
                    kept.append(out.block("\n".join(held), "code"))
                    held = None
            elif held is None:
                kept.append(line)
            else:
                held.append(line)
        if held:
            kept.append(out.block("\n".join(held), "code"))
        text = "\n".join(kept)
    if "`" in text:
        text = MD_CODE.sub(lambda m: out.keep(m.group(1), "code"), text)
    if "\\begin" in text:
        text = TEX_VERBATIM.sub(lambda m: out.block(m.group(2), "code"), text)
    if "<pre" in text.lower() or "<code" in text.lower():
        text = re.sub(
            r"<pre\b[^<>]*>\s*(?:<code\b[^<>]*>)?(.*?)(?:</code>\s*)?(?:</pre>|$)|<code\b[^<>]*>(.*?)</code>",
            lambda m: out.block(_plain(m.group(1)), "code") if m.group(1) is not None else out.keep(_plain(m.group(2)), "code"),
            text, flags=re.S | re.I,
        )
    return text


def _plain(text: str) -> str:
    return html.unescape(TAG.sub("", text))


def _from_latex(text: str, out: Structure) -> str:
    if "$" in text:
        text = TEX_MATH.sub(lambda m: out.keep((m.group(1) or m.group(2)).strip(), "formula"), text)
    if "\\" not in text:
        return text
    text = TEX_DISPLAY.sub(lambda m: out.keep((m.group(1) or m.group(2)).strip(), "formula"), text)
    text = re.sub(r"\\begin\s*\{(equation|align|displaymath|math|gather)\*?\}(.*?)\\end\s*\{\1\*?\}", lambda m: out.block(m.group(2).strip(), "formula"), text, flags=re.S)
    count = 1
    while count:  # from the inside out
        text, count = TEX_STYLE.subn(r"\1", text)
    text = TEX_HEADING.sub(lambda m: f"\n{_HEAD}{m.group(1)}\n", text)
    text = re.sub(r"\\begin\s*\{(tabular[x*]?)\}(?:\{[^{}\n]*\})*(.*?)\\end\s*\{\1\}", lambda m: _tex_rows(m.group(2), out), text, flags=re.S)
    text = TEX_HREF.sub(lambda m: m.group(1) or m.group(2), text)
    text = TEX_BEGIN.sub("\n", text)
    text = TEX_END.sub("\n", text)
    text = TEX_ITEM.sub(lambda m: f"\n{_ITEM}" + (f"{m.group(1)} " if m.group(1) else ""), text)
    text = re.sub(r"\\(?:ldots|dots)\b(?:\{\})?", "…", text)
    text = TEX_BREAK.sub("\n" if "\n" in text else " ", text)
    text = re.sub(r"\\([%&#_{}$])", r"\1", text)
    text = re.sub(r"\\(?:noindent|hline|centering|maketitle|newpage|par|bigskip|medskip|smallskip|quad|qquad|label\{[^{}]*\}|vspace\*?\{[^{}]*\}|hspace\*?\{[^{}]*\})\s?", "", text)
    return re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?:\{([^{}]*)\})?", lambda m: m.group(1) or "", text)


def _tex_rows(body: str, out: Structure) -> str:
    rows = []
    for row in re.split(r"\\\\(?:\[[^\]]*\])?", body):
        cells = [c.strip() for c in re.sub(r"\\hline|\\(?:top|mid|bottom)rule", "", row).split("&")]
        if any(cells):
            out.counts["row"] += 1
            rows.append(" | ".join(cells))
    return "\n" + "\n".join(rows) + "\n"


def _from_wiki(text: str, out: Structure) -> str:
    if not any(part in text and form.search(text) for kind, _, part, form in SIGNS_OF[:18] if kind == "wiki"):
        return text
    text = re.sub(r"\{\{\s*(?:code|syntaxhighlight|pre)\s*\|([^{}]*)\}\}", lambda m: out.block(m.group(1), "code") if "\n" in m.group(1) else out.keep(m.group(1), "code"), text, flags=re.I)
    text = re.sub(r"\{\{\s*math\s*\|([^{}]*)\}\}", lambda m: out.keep(m.group(1).strip(), "formula"), text, flags=re.I)
    text = WIKI_TEMPLATE.sub("", text)
    text = WIKI_HEADING.sub(lambda m: f"\n{_HEAD}{m.group(2)}\n", text)
    text = WIKI_STRONG.sub(r"\1", text)
    text = WIKI_EM.sub(r"\1", text)
    text = re.sub(r"\[\[(?:Category|File|Image|Kategorie|Datei)\s*:[^\[\]\n]*\]\]", "", text)
    text = WIKI_LINK.sub(lambda m: m.group(2) or m.group(1), text)
    text = WIKI_URL.sub(lambda m: m.group(2) or m.group(1), text)
    text = WIKI_ITEM.sub(_ITEM, text)
    if "{|" in text:
        text = re.sub(r"^[ \t]*\{\|[^\n]*\n(.*?)(?:^[ \t]*\|\}[^\n]*|\Z)", lambda m: _wiki_rows(m.group(1), out), text, flags=re.S | re.M)
    return text


def _wiki_rows(body: str, out: Structure) -> str:
    rows = []
    for part in re.split(r"^[ \t]*\|-[^\n]*$", body, flags=re.M):
        cells = [c.strip() for line in part.strip().split("\n") for c in re.split(r"\|\||!!", re.sub(r"^[ \t]*[|!]\+?", "", line))]
        if any(cells):
            out.counts["row"] += 1
            rows.append(" | ".join(cells))
    return "\n" + "\n".join(rows) + "\n"


def _from_markdown(text: str, out: Structure) -> str:
    lines, made = text.split("\n"), []
    for k, line in enumerate(lines):
        after = lines[k + 1] if k + 1 < len(lines) else ""
        if MD_RULE.match(line) or ("-" in line and "|" in line and MD_TABLE_RULE.match(line)):
            continue
        if m := MD_HEADING.match(line):
            made.append(f"{_HEAD}{m.group(2)}")
        elif line.strip() and re.match(r"^ {0,3}(?:={3,}|-{3,})[ \t]*$", after) and "|" not in line:
            made.append(f"{_HEAD}{line.strip()}")
        elif MD_TABLE.match(line):
            out.counts["row"] += 1
            made.append(" | ".join(c.strip() for c in line.strip().strip("|").split("|")))
        else:
            line = MD_QUOTE.sub("", line) if line.lstrip().startswith(">") else line
            made.append(MD_LIST.sub(_ITEM, line, count=1))
    text = "\n".join(made)
    if "](" in text:
        text = MD_LINK.sub(r"\1", text)
    for form in (MD_STRONG, MD_EM):
        text = form.sub(lambda m: m.group(1) or m.group(2), text)
    return MD_STRIKE.sub(r"\1", text) if "~~" in text else text


def _from_html(text: str, out: Structure) -> str:
    text = COMMENT.sub("", text)
    parts, at, dropped, cells = [], 0, None, False
    for m in TAG.finditer(text):
        name = (m.group(2) or m.group(5)).lower()
        if not _is_tag(name):
            continue
        closing = bool(m.group(1) or m.group(4))
        if dropped is None:
            parts.append(text[at : m.start()])
        at = m.end()
        if name in DROPPED:
            dropped = None if closing else (dropped or name)
            continue
        if dropped is not None:
            continue
        if re.fullmatch("h[1-6]", name):
            parts.append("\n" if closing else f"\n{_HEAD}")
        elif name == "li":
            parts.append("\n" if closing else f"\n{_ITEM}")
        elif name == "tr":
            out.counts["row"] += not closing
            parts.append("\n")
            cells = False
        elif name in ("td", "th"):
            if not closing:
                parts.append(" | " if cells else "")
                cells = True
        elif name in BLOCKS:
            parts.append("\n")
    if dropped is None:
        parts.append(text[at:])
    return html.unescape("".join(parts))


def _tidy(text: str, out: Structure) -> str:
    made: list[str] = []
    for line in text.split("\n"):
        head, item = _HEAD in line, _ITEM in line
        line = re.sub(r"[^\S\n]+", " ", line.replace(_HEAD, "").replace(_ITEM, "")).strip()
        if not line:
            if made and made[-1]:
                made.append("")
            continue
        if head:
            out.counts["heading"] += 1
            if made and made[-1]:
                made.append("")
        if item:
            out.counts["item"] += 1
            line = f"• {line}"
        made.append(line)
    return out.restore("\n".join(made)).strip()


# -- operator ----------------------------------------------------------------------------------------

CLEANED = (
    "record_id long, clean_text string, markup array<string>, headings int, items int, table_rows int, "
    "code_pieces int, formulas int, trimmed boolean"
)


def find_markup(df: DataFrame, key: str, text: str) -> DataFrame:
    """``record_id, markup``: a row per record with the kinds of markup in its text; nothing is cleaned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [kinds_of(value) if value else [] for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.list_(pa.string()))], ["record_id", "markup"])

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, "record_id long, markup array<string>")


def clean_markup(df: DataFrame, key: str, text: str) -> DataFrame:
    """``record_id, clean_text, markup, headings, items, table_rows, code_pieces, formulas,
    trimmed``: a row per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str | None] = []
            kinds: list[list[str]] = []
            counted: list[Counter] = []
            trimmed: list[bool] = []
            for value in batch.column(1).to_pylist():
                found = kinds_of(value) if value else []
                cut = False
                if value is None:
                    texts.append(None), counted.append(Counter())
                else:
                    if "html" in found:
                        value, cut = content_of(value)
                    done, counts = clean(value)
                    texts.append(done), counted.append(counts)
                kinds.append(found)
                trimmed.append(cut)
            numbers = [pa.array([c[n] for c in counted], pa.int32()) for n in ("heading", "item", "row", "code", "formula")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string())), *numbers, pa.array(trimmed, pa.bool_())],
                ["record_id", "clean_text", "markup", "headings", "items", "table_rows", "code_pieces", "formulas", "trimmed"],
            )

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, CLEANED)
