"""Text of listings: contacts, kinds of work, remote work, and HTML to text.

All are native columns, but for the walk through HTML, which no built-in function does.
"""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.vocabulary import JOB_TYPE_OF, lookup

# Fixed value.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def emails_in(text: Column) -> Column:
    """All addresses as found, in order; null for null and empty texts."""
    return F.when(F.length(text) > 0, F.regexp_extract_all(text, F.lit(EMAIL), 0))


def tidy_emails(emails: Column) -> Column:
    """Addresses trimmed, in lower case, each once in order of first sight; null if none is left."""
    clean = F.array_distinct(F.filter(F.transform(emails, lambda e: F.lower(F.trim(e))), lambda e: F.length(e) > 0))
    return F.when(F.size(clean) > 0, clean)


def job_type_named(text: Column) -> Column:
    """The job type that a spelling names, hyphens, blanks and case ignored; null if none."""
    return lookup(JOB_TYPE_OF, F.lower(F.regexp_replace(text, "[- ]", "")))


def job_type_exact(text: Column) -> Column:
    """The job type of a spelling that is already evened out."""
    return lookup(JOB_TYPE_OF, text)


# What in a description tells the kind of work.
DESCRIBED = {"fulltime": r"full\s?time", "parttime": r"part\s?time", "internship": "internship", "contract": "contract"}


def job_types_described(text: Column) -> Column:
    """Kinds of work that a description mentions: an empty array for null and empty texts, null
    where none is mentioned."""
    found = F.array_compact(F.array(*[F.when(text.rlike(f"(?iU){p}"), F.lit(n)) for n, p in DESCRIBED.items()]))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).when(F.size(found) > 0, found)


# Fixed values.
REMOTE_WORDS = ("remote", "work from home", "wfh")


def mentions_remote(*texts: Column, more: tuple[str, ...] = ()) -> Column:
    """Whether one of the texts, joined by blanks, has a word of remote work in it."""
    joined = F.lower(F.concat_ws(" ", *texts))
    return joined.rlike("|".join((*REMOTE_WORDS, *more)))


def remote_word(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?iU)\b(remote|wfh)\b"), F.lit(False))


def office_kind(*texts: Column) -> Column:
    """Hybrid before Remote before Work from office; null if nothing tells."""
    joined = F.lower(F.concat_ws(" ", *texts))
    return (
        F.when(joined.contains("hybrid"), "Hybrid")
        .when(joined.rlike("|".join(REMOTE_WORDS)), "Remote")
        .when(joined.rlike("work from office|on-site|onsite"), "Work from office")
    )


def collapse(text: Column, most: int | None = None) -> Column:
    """White space collapsed and trimmed; cut to ``most`` characters."""
    flat = F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))
    return flat if most is None else F.left(flat, F.lit(most))


def split_list(text: Column) -> Column:
    """The parts between commas, trimmed, empty ones left out; null if none is left."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    return F.when(F.size(parts) > 0, parts)


def join_list(parts: Column) -> Column:
    return F.when(F.size(parts) > 0, F.array_join(parts, ", "))


# -- HTML --------------------------------------------------------------------------------------------

_SILENT = {"script", "style"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track"}
_BLOCK = {"p", "div", "section", "article", "ul", "ol", "table", "tr", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}


class _Words(HTMLParser):
    """Collects the text nodes; what scripts and styles hold is left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in _SILENT

    def handle_endtag(self, tag):
        self.silent -= tag in _SILENT and self.silent > 0

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


class _Marked(HTMLParser):
    """Writes Markdown: headings with signs, lists, emphasis, links and code."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[list] = []
        self.hrefs: list[str] = []
        self.silent = self.code = 0

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1:]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "* "))
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a":
            self.hrefs.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "pre":
            self.code += 1
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.code:
            self.out.append("`")
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in _BLOCK:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a" and self.hrefs:
            self.out.append(f"]({self.hrefs.pop()})")
        elif tag == "pre":
            self.code = max(0, self.code - 1)
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.code:
            self.out.append("`")
        elif tag in _BLOCK:
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data if self.code else re.sub(r"\s+", " ", data))


def plain_text(source: str | None) -> str | None:
    if source is None:
        return None
    if "<" not in source:
        return re.sub(r"\s+", " ", html.unescape(source)).strip()
    walk = _Words()
    walk.feed(source)
    walk.close()
    return re.sub(r"\s+", " ", " ".join(walk.parts)).strip()


def markdown_text(source: str | None) -> str | None:
    if source is None:
        return None
    walk = _Marked()
    walk.feed(source)
    walk.close()
    text = re.sub(r"[ \t]+\n(?!\n)", lambda m: "  \n" if m.group().startswith("  ") else "\n", "".join(walk.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


@F.pandas_udf(T.StringType())
def html_to_plain(source: pd.Series) -> pd.Series:
    return source.map(plain_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def html_to_markdown(source: pd.Series) -> pd.Series:
    return source.map(markdown_text, na_action="ignore")


def without_attributes(source: Column) -> Column:
    """HTML whose tags have lost their attributes."""
    return F.regexp_replace(source, r"<([a-zA-Z][a-zA-Z0-9]*)\s[^<>]*?(/?)>", "<$1$2>")


def formatted(source: Column, kind: str) -> Column:
    """A description as ``html``, ``markdown`` or ``plain``."""
    if kind == "plain":
        return html_to_plain(source)
    return html_to_markdown(source) if kind == "markdown" else source
