"""Cards and detail pages of the boards that send HTML, taken apart with the standard parser."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin


class _Tree(HTMLParser):
    """A flat list of elements, each with its text, attributes and the span of its descendants."""

    VOID = frozenset("br hr img input meta link wbr area base col embed source track".split())

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.texts: list[str] = []
        self.feed(page)
        self.close()
        for k in self.open:
            self._shut(k)

    def _shut(self, k: int) -> None:
        self.nodes[k]["end"], self.nodes[k]["until"] = len(self.nodes), len(self.texts)

    def _opened(self, tag: str, attrs: list, end: int) -> None:
        at = len(self.texts)
        self.nodes.append({"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "from": at, "until": at, "end": end})

    def handle_starttag(self, tag, attrs):
        self._opened(tag, attrs, len(self.nodes) + 1)
        if tag not in self.VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self._opened(tag, attrs, len(self.nodes) + 1)

    def handle_endtag(self, tag):
        if any(self.nodes[k]["tag"] == tag for k in self.open):
            while self.open:
                k = self.open.pop()
                self._shut(k)
                if self.nodes[k]["tag"] == tag:
                    break

    def handle_data(self, data):
        if self.open and self.nodes[self.open[-1]]["tag"] in ("script", "style"):
            return
        self.texts.append(data)

    def text(self, k: int) -> list[str]:
        """The texts inside an element: a stretch of those of the page, so none is stored twice."""
        return self.texts[self.nodes[k]["from"] : self.nodes[k]["until"]]

    def find(self, test: Callable[[dict], bool], start: int = 0, end: int | None = None) -> int | None:
        return next((k for k in range(start, len(self.nodes) if end is None else end) if test(self.nodes[k])), None)

    def parent(self, k: int) -> int:
        """The element around an element; itself at the top."""
        return next((p for p in range(k - 1, -1, -1) if self.nodes[p]["end"] > k), k)

    def all(self, test: Callable[[dict], bool]) -> list[int]:
        return [k for k, n in enumerate(self.nodes) if test(n)]

    def said(self, k: int | None, glue: str = "") -> str | None:
        return None if k is None else glue.join(t.strip() for t in self.text(k) if t.strip())


def _has(tag: str | tuple[str, ...], *classes: str) -> Callable[[dict], bool]:
    tags = (tag,) if isinstance(tag, str) else tag
    return lambda n: n["tag"] in tags and all(c in n["attrs"].get("class", "").split() for c in classes)


def _marked(tags: tuple[str, ...], markers: tuple[str, ...]) -> Callable[[dict], bool]:
    return lambda n: n["tag"] in tags and any(m in n["attrs"].get("class", "").lower() for m in markers)


def linkedin_card(page: str) -> dict:
    t = _Tree(page)
    link = t.find(_has("a", "base-card__full-link"))
    href = t.nodes[link]["attrs"].get("href", "").split("?")[0] if link is not None else ""
    sub = t.find(_has("h4", "base-search-card__subtitle"))
    anchor = t.find(lambda n: n["tag"] == "a", sub, t.nodes[sub]["end"]) if sub is not None else None
    meta = t.find(_has("div", "base-search-card__metadata"))
    inside = (meta, t.nodes[meta]["end"]) if meta is not None else (0, 0)
    time = t.find(_has("time", "job-search-card__listdate"), *inside)
    time = time if time is not None else t.find(_has("time", "job-search-card__listdate--new"), *inside)
    return {
        "key": href.rsplit("-", 1)[-1] if href else None,
        "title": t.said(t.find(_has("span", "sr-only"))) or None,
        "company": t.said(anchor if anchor is not None else sub),
        "link": t.nodes[anchor]["attrs"].get("href", "").split("?")[0] or None if anchor is not None else None,
        "place": t.said(t.find(_has("span", "job-search-card__location"), *inside)) if meta is not None else None,
        "date": t.nodes[time]["attrs"].get("datetime") if time is not None else None,
        "pay": t.said(t.find(_has("span", "job-search-card__salary-info")), " "),
    }


def linkedin_detail(page: str | None) -> dict:
    """Criteria, logo, direct address and description of a detail page."""
    if not page:
        return {}
    t = _Tree(page)

    def criterion(name: str) -> str | None:
        head = next((k for k in t.all(lambda n: n["tag"] == "h3") if name in "".join(t.text(k))), None)
        value = t.find(_has("span", "description__job-criteria-text"), head) if head is not None else None
        return t.said(value) or None

    code = t.find(lambda n: n["tag"] == "code" and n["attrs"].get("id") == "applyUrl")
    applied = re.search(r"[?&]url=([^\"'&]+)", page[page.find("applyUrl") :]) if code is not None else None
    logo = t.find(_has("img", "artdeco-entity-image"))
    body = t.find(_has("div", "show-more-less-html__markup"))
    return {
        "level": (criterion("Seniority level") or "").lower() or None, "function": criterion("Job function"),
        "industry": criterion("Industries"), "type": (criterion("Employment type") or "").lower().replace("-", "") or None,
        "direct": unquote(applied.group(1)) if applied else None,
        "logo": t.nodes[logo]["attrs"].get("data-delayed-url") if logo is not None else None,
        "description": t.said(body, " "),
    }


def bayt_card(page: str) -> dict:
    t = _Tree(page)
    head = t.find(lambda n: n["tag"] == "h2")
    anchor = t.find(lambda n: n["tag"] == "a" and "href" in n["attrs"], head, t.nodes[head]["end"]) if head is not None else None
    box = t.find(_has("div", "t-nowrap", "p10l"))
    span = t.find(lambda n: n["tag"] == "span", box, t.nodes[box]["end"]) if box is not None else None
    return {
        "title": t.said(head), "company": t.said(span), "place": t.said(t.find(_has("div", "t-mute", "t-small"))),
        "link": urljoin("https://www.bayt.com", t.nodes[anchor]["attrs"]["href"].strip()) if anchor is not None else None,
    }


def bdjobs_card(page: str) -> dict:
    t = _Tree(page)
    link = t.find(lambda n: n["tag"] == "a" and "jobdetail" in n["attrs"].get("href", "").lower())
    href = urljoin("https://jobs.bdjobs.com/jobsearch.asp", t.nodes[link]["attrs"]["href"]) if link is not None else None
    both = ("span", "div")
    return {
        "title": t.said(link) or None, "link": href,
        "company": t.said(t.find(_marked(both, ("comp-name-text", "company", "org", "comp-name")))) or None,
        "place": t.said(t.find(_marked(both, ("locon-text-d", "location", "area", "locon")))),
        "date": t.said(t.find(_marked(both, ("published",)))),
    }


def bdjobs_detail(page: str | None) -> dict:
    if not page:
        return {}
    t = _Tree(page)
    both = ("span", "div")

    def after(*words: str) -> str | None:
        said = ((k, "".join(t.text(k)).lower()) for k in t.all(lambda n: n["tag"] in both))
        head = next((k for k, label in said if any(w in label for w in words) and len(label) < 40), None)
        value = t.find(lambda n: n["tag"] in both, head + 1) if head is not None else None
        return t.said(value) or None

    body = t.find(_has("div", "jobcontent"))
    body = body if body is not None else t.find(_marked(("div", "section"), ("job-description", "details", "requirements")))
    return {"description": t.said(body, " "), "type": after("job type", "employment type"), "industry": after("industry")}


def _split(page: str, *tests: Callable[[dict], bool]) -> list[str]:
    """The elements of a page that pass the first test that any passes, as HTML again."""
    t = _Tree(page)
    for test in tests:
        if found := t.all(test):
            return [_render(t, k) for k in found]
    return []


def _to_detail(n: dict) -> bool:
    return n["tag"] == "a" and "jobdetail" in n["attrs"].get("href", "").lower()


def bdjobs_cards(page: str) -> list[str]:
    """The cards of a search page: by the first class that any element has, or else the elements
    around links to details."""
    t = _Tree(page)
    for name in ("job-item", "sout-jobs-wrapper", "norm-jobs-wrapper", "featured-wrap"):
        if found := t.all(_has("div", name)):
            return [_render(t, k) for k in found]
    return [_render(t, t.parent(k)) for k in t.all(_to_detail)]


def linkedin_cards(page: str) -> list[str]:
    return _split(page, _has("div", "base-search-card"))


def bayt_cards(page: str) -> list[str]:
    return _split(page, lambda n: n["tag"] == "li" and "data-js-job" in n["attrs"])


SPLITTERS = {"linkedin": linkedin_cards, "bayt": bayt_cards, "bdjobs": bdjobs_cards}


def _render(t: _Tree, k: int) -> str:
    """An element and what is in it, as HTML again."""
    parts: list[str] = []
    stack: list[int] = []
    said = t.nodes[k]["from"]

    def texts(until: int) -> None:
        nonlocal said
        parts.extend(html.escape(x, quote=False) for x in t.texts[said:until])
        said = max(said, until)

    def close() -> None:
        n = t.nodes[stack.pop()]
        texts(n["until"])
        if n["tag"] not in t.VOID:
            parts.append(f"</{n['tag']}>")

    for i in range(k, t.nodes[k]["end"]):
        while stack and i >= t.nodes[stack[-1]]["end"]:
            close()
        n = t.nodes[i]
        texts(n["from"])
        parts.append(f"<{n['tag']}" + "".join(f' {a}="{html.escape(v)}"' for a, v in n["attrs"].items()) + ">")
        stack.append(i)
    while stack:
        close()
    return "".join(parts)
