"""Personal information in free text: found, typed, and replaced by placeholders.

One Aho-Corasick automaton finds anchors in a single scan: at-signs and their spelled-out forms,
digits and plus signs, cues of identity numbers, words of streets and boxes, and phrases that
introduce or follow a person's name.  Each anchor starts a local parser that expands to both
sides, validates the piece and fixes its boundaries.  A piece may be of any length: a parser goes on
as long as its characters do, or for as many words as its form has, so the time is linear in the
text.

Towns known from structured data settle where an address ends.  A list of at most MAX_TOWNS is
broadcast; a longer one is joined to the records by the words at which their addresses ask for a
town, with the same result.

Pieces may not overlap; the kinds are tried in the order e-mail, identity number, address,
phone, name.

Defined cases: null and empty texts have no pieces; equal pieces at several places are each
replaced, and reported once per record; text between markup is treated like text after a blank.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "person_name")
PLACEHOLDERS = {kind: f"[{kind.upper()}]" for kind in KINDS}

FOUND = "origin string, record_id long, kind string, found string"

# What introduces each kind of information, in lower case.
EMAIL_ANCHORS = ["@", "(at)", "[at]", "{at}", " at "]
ID_CUES = ["national id", "identity number", "ssn", "insurance no", "passport", "social security", "id number",
           "tax id", "personnel number", "identity card", "dni", "nie "]
STREET_WORDS = ["street", "st.", " st,", " st ", "road", " rd", "lane", " row", "blvd", "boulevard", "avenue", " ave",
                "close", "drive", "court", "terrace", "square", "crescent"]
PLACE_ANCHORS = ["rue ", "avenue ", "boulevard ", "calle ", "avenida ", "plaza ", "weg ", "str. ", "straße ", "strasse ",
                 "gasse ", "platz ", "allee ", "am ", "p.o. box", "po box", "p. o. box", "postfach ", "apartado "]
NAME_BEFORE = ["reach ", "ask for ", "on behalf of ", "contact is ", "request for ", "regards, ", "contacto: ",
               "it was ", "speak to ", "speak with ", "talk to ", "phone ", "call ", "prepared by ", "written by ",
               "recruiter: ", "hiring manager: ", "our engineer ", "our recruiter ", "our manager ", "your recruiter ", "ansprechpartner: ", "ansprechpartnerin: ", "signed ", "interlocuteur : ", "interlocuteur: ",
               "interlocutrice : ", "sincerely, ", "yours, ", "contact person: ", "attn: ", "attention: "]
NAME_AFTER = [" leads the unit", ") lives at", " lives at", ") arranges the trial", " arranges the trial", " prepared this", " wrote this",
              " will help", " will interview", " will call", " will contact", " looks forward to", " is your contact", " is the contact", " is your recruiter", " | ", " <", " &lt;"]

_GAP = r"(?:[  ]|&nbsp;)"
_LOCAL = r"[A-Za-z0-9À-ɏ](?:[A-Za-z0-9À-ɏ._%+'\-]*[A-Za-z0-9À-ɏ_%+\-])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"

LOCAL = re.compile(_LOCAL)
_LOCAL_CHARS = re.compile(r"[A-Za-z0-9À-ɏ._%+'\-]")
DOMAIN = re.compile(rf"{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,24}}(?![A-Za-z0-9-]*@)")
SPELLED_DOMAIN = re.compile(
    rf"{_LABEL}(?:(?:\.| ?[\[({{]dot[\])}}] ?| dot ){_LABEL})*(?:\.| ?[\[({{]dot[\])}}] ?| dot )[A-Za-z]{{2,24}}(?![A-Za-z0-9])", re.I
)

PHONE = re.compile(
    r"""(?<![\w.,/+\-])(?:
      (?:\+|00)[1-9]\d{0,2}(?:[ \-./]?\(0\))?[ \-./]?(?:\(\d{1,5}\)[ \-./]?)?\d{1,10}(?:[ \-./]\d{2,8}){0,6}
    | (?:1[-. ])?\(\d{3}\)[ ]?\d{3}[-. ]\d{4}
    | (?:1[-. ])?\d{3}[-./]\d{3}[-.]\d{4}
    | 0[1-9]\d{2,4}[ \-/]\d{3}[ ]?\d{3,5}
    )(?:,?[ ](?:ext\.?|extension|x|app\.|poste|Durchwahl)[ ]?\d{1,6})?(?![\w\-]|[.,]\d)""",
    re.X | re.I,
)

_ID_FORMS = r"\d{3}[- ]\d{2}[- ]\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{4}[ -]\d{4}[ -]\d{4}|[XYZ]-?\d{7}-?[A-Z]?|\d{8}-?[A-Z]|[A-Z]\d{2}[A-Z]{2}\d{4,5}"
IDENTITY = re.compile(rf"(?<![\w\-])(?:{_ID_FORMS})(?![\w]|-\d)", re.I)
#: Forms that nothing but an identity number has, with or without a cue.
PLAIN_IDENTITY = re.compile(r"(?<![\w\-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w]|-\d)")
CUE_GAP = re.compile(r"[\s:.#()]*(?:(?:is|no|nr|number|code)\b[\s:.#]*)?(?:/ ?ID[\s:.#]*)?", re.I)

_UP = r"[A-ZÀ-ÞĀ-Ž]"
_TOWN_WORD = rf"{_UP}[\w'’]*(?:-(?:{_UP}|[a-z]+-{_UP})[\w'’]*)*"
_STREET_NAME = rf"(?:{_UP}[\w'’\-]*{_GAP}){{1,4}}"
_TYPES = "Street St Road Rd Lane Ln Row Blvd Boulevard Avenue Ave Close Drive Dr Way Court Ct Place Pl Square Sq Terrace Crescent".split()
_STREET_TYPE = "(?:" + "|".join(sorted({*_TYPES, *(t.upper() for t in _TYPES)}, key=len, reverse=True)) + r")\.?"
_UNIT = rf"(?:(?i:Suite|Unit|Apt\.?|Apartment|Flat|Room|Floor|Ste\.?){_GAP}\d+[A-Za-z]?,?{_GAP})?"
STREET = re.compile(rf"(?<![\w\-/]){_UNIT}\d{{1,5}}[A-Za-z]?{_GAP}{_STREET_NAME}{_STREET_TYPE}(?![\w])")
RUE = re.compile(rf"(?<![\w\-/])\d{{1,5}}(?:{_GAP}?(?:bis|ter))?,?{_GAP}(?i:rue|avenue|boulevard|place|allée|chemin|quai){_GAP}(?:(?:(?i:de la|de|du|des|la|le|les){_GAP})|(?i:d'|de l'|l'))?{_TOWN_WORD}(?:{_GAP}{_TOWN_WORD}){{0,3}}")
CALLE = re.compile(rf"\b(?i:Calle|Avenida|Plaza|Paseo){_GAP}(?:(?i:de la|de los|de las|del|de){_GAP})?{_TOWN_WORD}(?:{_GAP}{_TOWN_WORD}){{0,3}},?{_GAP}\d{{1,5}}(?:,{_GAP}\d{{1,2}}[ºª°])?")
WEG = re.compile(rf"\b(?:Am|An der|Im|Zur|Zum|AM|IM){_GAP}{_TOWN_WORD}{_GAP}\d{{1,5}}[a-z]?\b|(?<![\w\-]){_UP}[\w\-]*(?i:weg|str\.|straße|strasse|gasse|platz|allee){_GAP}\d{{1,5}}[a-z]?\b")
BOX = re.compile(rf"\b(?i:P\. ?O\. ?|PO{_GAP}|Post{_GAP}Office{_GAP})(?i:Box){_GAP}\d{{1,6}}|\b(?i:Postfach){_GAP}\d[\d ]*|\b(?i:Apartado){_GAP}\d+")
_POST_CODE = r"(?:\d{4,5}(?:-\d{4})?)"
_UK_CODE = r"(?:[A-Z]{1,2}\d[A-Z\d]?[  ]?\d[A-Z]{2})"
_CA_CODE = r"(?:[A-Z]\d[A-Z][  ]?\d[A-Z]\d)"
CODE_FIRST = re.compile(rf",?{_GAP}{_POST_CODE}{_GAP}")
TOWN_GAP = re.compile(rf",{_GAP}|{_GAP}")
AFTER_TOWN = re.compile(rf",?{_GAP}(?:[A-Z]{{2,3}}{_GAP}(?:{_POST_CODE}|{_CA_CODE})|{_UK_CODE}|{_POST_CODE})(?![\w])|,{_GAP}[A-Z]{{2,3}}(?![\w])")
FREE_TOWN = re.compile(rf"{_TOWN_WORD}(?:{_GAP}(?:am|an der|sur|sous|le|la|de|del|upon|on|in){_GAP}{_TOWN_WORD})?")
ALL_CAPS_TOWN = re.compile(rf"(?:{_UP}[{_UP[1:-1]}'’\-]+)(?:{_GAP}{_UP}[{_UP[1:-1]}'’\-]+){{0,2}}(?![\w])")
MORE_TOWN = re.compile(rf"(?:{_GAP}{_TOWN_WORD}){{1,2}}(?=[,.;<|/]|\s*$|\s*\n|{_GAP}•|&lt;|\s\|)")

_ONE_TITLE = rf"(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra|Señor|Señora)\.?{_GAP})"
_TITLE = f"{_ONE_TITLE}*+"  # taken whole: a title is never part of a name
_CAP = rf"{_UP}[\w'’]+"
_DOUBLE = rf"{_CAP}(?:-{_CAP})*"
_PARTICLE = rf"(?:(?:de la|de los|van der|van den|von der|de|del|della|di|da|dos|van|von|zu|al|el|bin|ben|la|le|du){_GAP})"
_FIRST = rf"{_DOUBLE}(?:{_GAP}{_UP}\.){{0,2}}"
_LAST = rf"{_PARTICLE}?{_DOUBLE}"
_NAME = rf"(?:{_LAST},{_GAP}{_FIRST}|{_FIRST}{_GAP}{_LAST}|(?:{_UP}\.{_GAP}?){{1,2}}{_LAST})"
NAME_HERE = re.compile(rf"{_GAP}*(?:<[^<>]{{0,80}}>)*{_TITLE}(?P<name>{_NAME})(?![\w])")
SINGLE_HERE = re.compile(rf"{_GAP}*{_TITLE}(?P<name>{_LAST})(?![\w])")
TITLED_HERE = re.compile(rf"{_GAP}*{_ONE_TITLE}++(?P<name>{_LAST})(?![\w])")
LEADING_TITLE = re.compile(_TITLE)
NAME_END = re.compile(rf"(?<![\w\-@.])(?P<name>{_NAME})$")
SINGLE_END = re.compile(rf"(?:^|[\n>;:.!?•*|\-]{_GAP}*|[\]}})]{_GAP}*)(?P<name>{_LAST})$")
LOWER_END = re.compile(rf"(?:^|[\n>;:.!?•*|\-}}]){_GAP}*(?P<name>[a-zà-ž'’]+(?:{_GAP}[a-z]\.)?{_GAP}(?:{_PARTICLE})?[a-zà-ž'’]{{2,}}(?:-[a-zà-ž'’]+)?)$")
AND_NAME = re.compile(rf"{_GAP}(?:and|und|et|y|&|&amp;){_GAP}(?=.)")
#: What has to come behind a name that a phrase introduces: the phrase's second half or an end.
AFTER_NAME = {
    "reach ": re.compile(rf"{_GAP}(?:at|on|via|under){_GAP}"),
    "ask for ": re.compile(rf"{_GAP}(?:at|in|on){_GAP}|[.,;!]|$"),
    "it was ": re.compile(rf"{_GAP}(?:who|that){_GAP}"),
    "request for ": re.compile(r","),
    "signed ": re.compile(r"(?:[\s.,;|<&•\\]|$)"),
}
WORDS_NO_NAME = frozenset(
    "the our your a an this that these those it we you he she they in on at for to of and or with please contact".split()
)


def _anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    groups = {
        "email": EMAIL_ANCHORS,
        "id": ID_CUES,
        "street": STREET_WORDS,
        "place": PLACE_ANCHORS,
        "before": NAME_BEFORE,
        "after": NAME_AFTER,
        "digit": [*"0123456789+"],
    }
    held: dict[str, list[str]] = {}
    for group, words in groups.items():
        for word in words:
            held.setdefault(word, []).append(group)
    for word, owners in held.items():
        automaton.add_word(word, (word, tuple(owners)))
    automaton.make_automaton()
    return automaton


_SHARED: list[ahocorasick.Automaton] = []


def _automaton() -> ahocorasick.Automaton:
    if not _SHARED:
        _SHARED.append(_anchors())
    return _SHARED[0]


#: Words that a street, a place behind its kind, and a name with all its parts can have.
STREET_WORDS_AHEAD, STREET_WORDS_BEHIND, NAME_WORDS = 9, 9, 14


def _words_back(text: str, at: int, count: int) -> int:
    """Where the ``count`` words ahead of ``at`` begin, words of any length."""
    while at > 0 and count >= 0:
        blank = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at), text.rfind("\u00a0", 0, at))
        if blank < 0:
            return 0
        at, count = blank, count - 1
    return at


def _words_on(text: str, at: int, count: int) -> int:
    """Where the ``count`` words behind ``at`` end."""
    for _ in range(count):
        m = _NEXT_BLANK.search(text, at)
        if m is None:
            return len(text)
        at = m.end()
    return at


_NEXT_BLANK = re.compile(r"[ \n\u00a0]")
_FIRST_WORD = re.compile(r"[^\s\-,.;/|<\u00a0]*")


def first_word(low: str, at: int = 0) -> str:
    """The word by which a town is looked up."""
    return _FIRST_WORD.match(low, at).group()


def _lower_same_length(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


class Finder:
    """Finds the pieces of one text.  ``towns`` are names of towns known from structured data; they
    settle where a town of several words ends if no punctuation does."""

    def __init__(self, towns: Iterable[str] | None = None) -> None:
        self.know(towns or ())
        self.asked: list[str] | None = None  # words at which a town was asked for, if they are wanted

    def know(self, towns: Iterable[str]) -> None:
        """Make these the known towns."""
        self.towns: dict[str, list[str]] = {}
        for town in sorted({t.strip().lower() for t in towns if t and t.strip()}, key=lambda t: (-len(t), t)):
            self.towns.setdefault(first_word(town), []).append(town)

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        """``start, end, kind`` of each piece, in order, without overlaps."""
        if not text:
            return []
        low = _lower_same_length(text)
        by: dict[str, list[tuple[int, int, str]]] = {}
        digit = -2
        for end, (word, groups) in _automaton().iter(low):
            for group in groups:
                if group == "digit":
                    if end > digit + 1:
                        by.setdefault("digit", []).append((end - len(word) + 1, end + 1, word))
                    digit = end
                else:
                    by.setdefault(group, []).append((end - len(word) + 1, end + 1, word))
        taken: list[tuple[int, int, str]] = []
        self._emails(text, low, by, taken)
        self._identities(text, by, taken)
        self._addresses(text, low, by, taken)
        self._phones(text, by, taken)
        self._names(text, low, by, taken)
        return taken

    @staticmethod
    def _add(taken: list[tuple[int, int, str]], start: int, end: int, kind: str) -> bool:
        """Put a piece in its place among the pieces so far, unless it meets one."""
        k = bisect_left(taken, (start,))
        if (k and taken[k - 1][1] > start) or (k < len(taken) and taken[k][0] < end):
            return False
        taken.insert(k, (start, end, kind))
        return True

    def _emails(self, text: str, low: str, by: dict, taken: list) -> None:
        for start, end, word in by.get("email", ()):
            if word == " at ":
                # only the upper-case form is an address, and only with a spelled-out dot
                domain = SPELLED_DOMAIN.match(text, end) if text[start:end] == " AT " else None
                if domain is None or " DOT " not in domain.group():
                    continue
                stop = start
            elif word == "@":
                stop = start - (text[start - 1 : start] == " ")
                after = end + (text[end : end + 1] == " ")
                if text[stop - 1 : stop] == " " or (stop < start) != (after > end):
                    continue
                domain = DOMAIN.match(text, after)
            else:
                stop = start
                while text[stop - 1 : stop] == " ":
                    stop -= 1
                domain = SPELLED_DOMAIN.match(text, end + (text[end : end + 1] == " "))
            if domain is None:
                continue
            first = stop
            while first and _LOCAL_CHARS.match(text, first - 1):
                first -= 1
            # the part may begin with signs that no address begins with
            while first < stop and not text[first].isalnum():
                first += 1
            if first < stop and LOCAL.fullmatch(text, first, stop):
                self._add(taken, first, domain.end(), "email")

    def _identities(self, text: str, by: dict, taken: list) -> None:
        for _, end, _ in by.get("id", ()):
            gap = CUE_GAP.match(text, end)
            m = IDENTITY.match(text, gap.end() if gap else end)
            if m:
                self._add(taken, *m.span(), "id_number")
        for start, end, word in by.get("after", ()):
            if word == ") lives at":
                opened = text.rfind("(", max(0, start - 30), start)
                if opened >= 0 and (m := IDENTITY.fullmatch(text, opened + 1, start)):
                    self._add(taken, *m.span(), "id_number")
        for start, _, _ in by.get("digit", ()):
            m = PLAIN_IDENTITY.match(text, start)
            if m:
                self._add(taken, *m.span(), "id_number")

    def _town(self, text: str, low: str, at: int) -> int:
        """The end of the name of a town that begins at ``at``; -1 if none does."""
        if not text[at : at + 1].isupper():
            return -1
        key = first_word(low, at)
        if self.asked is not None:
            self.asked.append(key)
        for town in self.towns.get(key, ()):
            if low.startswith(town, at) and not low[at + len(town) : at + len(town) + 1].isalnum():
                return at + len(town)
        if caps := ALL_CAPS_TOWN.match(text, at):
            return caps.end()
        free = FREE_TOWN.match(text, at)
        if not free:
            return -1
        more = MORE_TOWN.match(text, free.end())
        return more.end() if more else free.end()

    def _tail(self, text: str, low: str, at: int) -> int:
        """The end of postal code, town and state behind the street."""
        code = CODE_FIRST.match(text, at)
        if code:
            town = self._town(text, low, code.end())
            return town if town > 0 else code.end() - 1
        gap = TOWN_GAP.match(text, at)
        if not gap:
            return at
        town = self._town(text, low, gap.end())
        if town < 0 or ("," not in gap.group() and not AFTER_TOWN.match(text, town)):
            return at
        more = AFTER_TOWN.match(text, town)
        return more.end() if more else town

    def _addresses(self, text: str, low: str, by: dict, taken: list) -> None:
        seen = -1
        even = low.replace("\u00a0", " ")
        spots = sorted({(s, e) for g in ("street", "place") for s, e, _ in by.get(g, ())})
        for start, end in spots:
            if start < seen and self.asked is None:
                continue
            begin, stop = _words_back(text, start, STREET_WORDS_AHEAD), _words_on(text, end, STREET_WORDS_BEHIND)
            for form in (BOX, STREET, RUE, CALLE, WEG):
                hit = next((m for m in form.finditer(text, begin, stop) if m.start() <= end and m.end() >= start), None)
                if hit:
                    last = self._tail(text, even, hit.end())
                    if last > hit.end() and self._add(taken, hit.start(), last, "address"):
                        seen = last
                    break

    def _phones(self, text: str, by: dict, taken: list) -> None:
        for start, _, _ in by.get("digit", ()):
            for at in (start - 1, start) if start and text[start - 1] == "(" else (start,):
                m = PHONE.match(text, at)
                if m and 9 <= sum(c.isdigit() for c in m.group()) <= 21:
                    self._add(taken, *m.span(), "phone")
                    break

    @staticmethod
    def _sound(name: str) -> bool:
        words = re.split(r"[\s,.\-]+", name.lower())
        return not any(w in WORDS_NO_NAME for w in words)

    def _names(self, text: str, low: str, by: dict, taken: list) -> None:
        emails = {s: e for s, e, k in taken if k == "email"}
        for start, end, word in by.get("before", ()):
            if start and low[start - 1].isalnum():
                continue
            at = end
            while True:
                m = NAME_HERE.match(text, at)
                need = AFTER_NAME.get(word)
                if m and need and not need.match(text, m.end("name")):
                    m = None
                if not m and need and at == end:
                    m = SINGLE_HERE.match(text, at)
                    if m and not need.match(text, m.end("name")):
                        m = None
                m = m or TITLED_HERE.match(text, at)
                if not m or not self._sound(m.group("name")):
                    break
                self._add(taken, *m.span("name"), "person_name")
                also = AND_NAME.match(text, m.end("name"))
                if word != "regards, " or not also:
                    break
                at = also.end()
        for start, _, word in by.get("after", ()):
            if word in (" | ", " <", " &lt;"):
                behind = start + len(word)
                behind += 7 if low.startswith("mailto:", behind) else 0
                if behind not in emails:
                    continue
            window_from = _words_back(text, start, NAME_WORDS)
            window = text[window_from:start]
            if word.startswith(")"):
                opened = window.rfind("(")
                if opened < 0:
                    continue
                if window[:opened].rstrip().endswith("("):
                    opened = window[:opened].rfind("(")
                inner = window[opened + 1 :]
                if inner.count(")") > inner.count("("):
                    opened = window.rfind("(", 0, opened)
                window = window[: max(opened, 0)]
            window = re.sub(rf"{_GAP}+$", "", window)
            window = re.sub(r"(?:<[^<>]*>)+$", lambda g: "" if word[0] == ")" else g.group(), window)
            m = NAME_END.search(window)
            if not m and word.startswith(")"):
                m = SINGLE_END.search(window)
            if not m and word in (" | ", " <", " &lt;"):
                m = LOWER_END.search(window) or SINGLE_END.search(window)
            if m and self._sound(m.group("name")):
                skip = LEADING_TITLE.match(m.group("name")).end()
                self._add(taken, window_from + m.start("name") + skip, window_from + m.end("name"), "person_name")


def redacted(text: str, pieces: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder for each piece."""
    out, at = [], 0
    for start, end, kind in pieces:
        out.append(text[at:start])
        out.append(PLACEHOLDERS[kind])
        at = end
    out.append(text[at:])
    return "".join(out)


#: Towns that are broadcast; more are joined by the words that ask for them.
MAX_TOWNS = 100_000

_FINDERS: dict[tuple[str, ...], Finder] = {}


def _finder(towns: tuple[str, ...]) -> Finder:
    if towns not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[towns] = Finder(towns)
    return _FINDERS[towns]


def towns_of(*columns: tuple[DataFrame, Column]) -> DataFrame:
    """``town``: distinct names of towns in structured columns; all of them, however many."""
    names = None
    for df, column in columns:
        part = df.select(F.lower(F.btrim(column)).alias("town")).where("length(town) >= 2")
        names = part if names is None else names.union(part)
    return names.distinct()


class _Towns:
    """The known towns of a run: one list for all records, or a list with each."""

    def __init__(self, rows: DataFrame, towns: DataFrame | None) -> None:
        spark = rows.sparkSession
        # one more than may be broadcast tells whether there are more
        got = [r.town for r in towns.limit(MAX_TOWNS + 1).collect()] if towns is not None else []
        self.many = len(got) > MAX_TOWNS
        self.shared = spark.sparkContext.broadcast(() if self.many else tuple(sorted(got)))
        self.rows = _with_own_towns(rows, towns) if self.many else rows

    def finders(self, batch: pa.RecordBatch) -> Iterator[Finder]:
        """The finder for each record of a batch."""
        finder = _finder(self.shared.value)
        if batch.num_columns == 2:
            yield from (finder for _ in range(batch.num_rows))
            return
        for towns in batch.column(2).to_pylist():
            finder.know(towns or ())
            yield finder


def _with_own_towns(rows: DataFrame, towns: DataFrame) -> DataFrame:
    """Adds the known towns that begin with a word at which the record's addresses ask for one."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            keys, words = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                finder.asked = []
                finder.find(text)
                for word in set(finder.asked):
                    keys.append(key), words.append(word)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.string())], ["k", "word"])

    asked = rows.mapInArrow(ask, "k long, word string").distinct()
    first = F.regexp_extract("town", _FIRST_WORD.pattern, 0)
    # the towns of a record are those that its own addresses ask for
    own = asked.join(towns.select(first.alias("word"), "town"), "word").groupBy("k").agg(F.collect_set("town").alias("towns"))
    return rows.join(own, "k", "left").select("k", "t", "towns")


def find_personal(df: DataFrame, key: str, text: str, origin: str, towns: DataFrame | None = None) -> DataFrame:
    """``origin, record_id, kind, found``: a row for each distinct piece of each record."""
    known = _Towns(df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("length(t) > 0"), towns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, found = [], [], []
            for ident, value, finder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), known.finders(batch)):
                for kind, piece in dict.fromkeys((k, value[s:e]) for s, e, k in finder.find(value)):
                    ids.append(ident), kinds.append(kind), found.append(piece)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([origin] * len(ids)), pa.array(ids, pa.int64()), pa.array(kinds), pa.array(found)],
                    ["origin", "record_id", "kind", "found"],
                )

    return _run(known, scan, FOUND)


def _run(known: _Towns, scan, schema: str) -> DataFrame:
    """``scan`` over the records of ``known``, which goes to the workers without its DataFrame."""
    rows, known.rows = known.rows, None
    return rows.mapInArrow(scan, schema)


def redact(df: DataFrame, key: str, text: str, towns: DataFrame | None = None) -> DataFrame:
    """``record_id, text, pieces``: each record's text with placeholders, and how many it has."""
    known = _Towns(df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), towns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for value, finder in zip(batch.column(1).to_pylist(), known.finders(batch)):
                pieces = finder.find(value)
                texts.append(redacted(value, pieces) if value is not None else None)
                counts.append(len(pieces))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["record_id", "text", "pieces"]
            )

    return _run(known, scan, "record_id long, text string, pieces int")
