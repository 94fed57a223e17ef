"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element. Each line weighs the characters it has outside links, or nothing
where an ancestor is page furniture (navigation, page header, footer, aside, form, dialog, or a class or id that says
so) or hidden. A class or id says so by its last word (``main-sidebar``), or by its first where only words of
layout follow (``nav-list``); ``has-sidebar`` and ``social-policy`` don't, and a form around a marked article is no
furniture. Weights are summed over a sliding window of lines; text surges where a window's sum passes SURGE, and dives
where, going outwards, the sum falls to DIVE (nothing) or a line has no weight of its own. Between two surges, STRETCH lines
in a row without any weight (a list of links) are a dive and a surge of their own and go. The text is every other line from
the first surge's stretch to the last dive that is no furniture, however short. Inside a marked article the class or id of an
element of running text (a paragraph, heading or quotation) is too weak a sign: only words that mean nothing else count there. Where the page marks its article, the mark is a
weight: each line inside ``article`` gets SURGE + 1 on top, and so does one inside ``main`` or role=main that has text
outside links. Windows don't reach across a mark's border, so text outside the mark is kept if it surges by itself.

One pass over each page, row by row in Arrow batches: no shuffle, and memory is one batch.

Defined results: null or empty html gives the empty text and 0 characters; unclosed and stray tags follow the HTML
rules as far as blocks are concerned; an unclosed comment, script or style runs to the end of the page; a page of
furniture only gives the empty text; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 60
DIVE = 0
STRETCH = 2

# Element names of HTML by role.
RAW = frozenset("script style title textarea noscript iframe template svg math object audio video canvas select button noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split()
)
SPACE = frozenset("br td th".split())
FURNITURE = frozenset("nav aside footer form dialog menu fieldset search head".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar rail widget footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments reply replies respond disqus form search pagination pager skip toolbar "
    "copyright disclaimer".split()
)
#: Of these, the words that say furniture even on a paragraph or heading of a marked article.
PLAIN_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsored breadcrumb breadcrumbs navbar cookie cookies consent gdpr newsletter notice notices pagination pager copyright disclaimer comment comments".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dt dd figcaption caption".split())
#: Words of layout: after a word of furniture they leave it furniture.
LAYOUT_WORDS = frozenset(
    "active area bar block body bottom box btn button buttons center col column container content contents count group head heading hidden icon icons "
    "inline inner item items left link links list main outer panel primary right row secondary section slot thread title top unit widget widgets wrap wrapper".split()
)
#: A name that begins with one of these speaks of the page's state.
STATE_WORDS = frozenset("has have with without no not is hide show".split())
PAGE_HEADER_WORDS = frozenset("header masthead topbar".split())
ARTICLE = frozenset("article main".split())
#: Furniture that a marked article inside ends.
FORM = 1
#: A start tag of these ends an open p.
CLOSES_P = BLOCK - {"option", "caption", "tbody", "tfoot", "thead", "tr", "legend"}
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "option": ()}

TAG = re.compile(r"<(?:!--(?P<comment>.*?(?:--!?>|\Z))|(?P<odd>[!?][^>]*+>?)|/(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>?|(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>?)", re.S)
ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?(?=[\s/>\"']|$)", re.I)
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


def named(value: str, words: frozenset[str]) -> bool:
    """Whether a class or id attribute has a name that means one of ``words`` rather than merely containing it."""
    for name in value.split():
        parts = [w.lower() for w in WORDS.findall(name) if len(w) > 1]
        if not parts or parts[0] in STATE_WORDS:
            continue
        while len(parts) > 1 and parts[-1] in LAYOUT_WORDS and parts[-1] not in words:
            parts.pop()
        if parts[-1] in words or (parts[0] in words and all(w in LAYOUT_WORDS for w in parts[1:])):
            return True
    return False


class Page:
    """Lines of one page: text, weight, whether it may be kept at all, the mark it lies in: 2 article, 1 main, 0 none."""

    def __init__(self, source: str):
        self.lines: list[tuple[str, int, bool, int]] = []
        self._parts: list[str] = []
        self._linked = 0
        self._link_depth = 0
        self._stack: list[tuple[str, int, int]] = []  # name, furniture (0: none), mark
        self._parse(source)
        self._flush()

    def _state(self) -> tuple[int, int]:
        return self._stack[-1][1:] if self._stack else (0, 0)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(html.unescape("".join(self._parts)).split())
            if text:
                furniture, article = self._state()
                weight = 0 if furniture else max(0, len(text) - self._linked)
                self.lines.append((text, weight, not furniture, article))
            self._parts = []
        self._linked = 0

    def _text(self, s: str) -> None:
        self._parts.append(s)
        if self._link_depth:
            self._linked += len(s)

    def _furniture(self, name: str, attrs: str, inside: bool) -> bool:
        if name in FURNITURE:
            return True
        if name == "header" and not inside:
            return True
        if not attrs or name in ("html", "body") or name in ARTICLE:
            return False
        for m in ATTR.finditer(attrs):
            key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
            if key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true"):
                return True
            if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
            if key == "role" and value.strip().lower() in FURNITURE_ROLES:
                return True
            if key in ("class", "id"):
                if named(value, PLAIN_WORDS if inside and name in RUNNING else FURNITURE_WORDS) or (not inside and named(value, PAGE_HEADER_WORDS)):
                    return True
        return False

    def _pop(self, name: str, within: tuple[str, ...] = ()) -> None:
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == name:
                del self._stack[i:]
                return
            if self._stack[i][0] in within:
                return

    def _parse(self, s: str) -> None:
        at, find = 0, TAG.search
        while (m := find(s, at)) is not None:
            if m.start() > at:
                self._text(s[at : m.start()])
            at = m.end()
            if m["start"]:
                at = self._open(s, at, m["start"].lower(), m["attrs"] or "")
            elif m["end"]:
                self._close(m["end"].lower())
        if at < len(s):
            self._text(s[at:])

    def _open(self, s: str, at: int, name: str, attrs: str) -> int:
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(s, at)
            self._text(" ") if name in ("select", "button", "textarea") else None
            if attrs.rstrip().endswith("/") and name in ("svg", "math"):
                return at
            return end.end() if end else len(s)
        if name == "a":
            self._link_depth = 1
        elif name in SPACE:
            self._text(" ")
        if name not in BLOCK:
            return at
        self._flush()
        self._link_depth = 0
        if name in CLOSES_P and any(x[0] == "p" for x in self._stack[-3:]):
            self._pop("p", ("div", "article", "section", "main", "li", "td"))
        if name in SIBLINGS:
            self._pop(name, SIBLINGS[name])
        if name in VOID:
            return at
        furniture, article = self._state()
        marked = name in ARTICLE or "role" in attrs and re.search(r"role\s*=\s*[\"']?main\b", attrs, re.I) is not None
        article = max(article, 2 if name == "article" else int(marked))
        if marked and furniture == FORM:
            furniture = 0
        if self._furniture(name, attrs, article > 0):
            furniture = max(furniture, FORM if name == "form" else FORM + 1)
        self._stack.append((name, furniture, article))
        return at

    def _close(self, name: str) -> None:
        if name == "a":
            self._link_depth = 0
        if name in BLOCK:
            self._flush()
            self._pop(name)


def main_lines(page: Page, window: int = WINDOW, surge: int = SURGE, dive: int = DIVE) -> list[str]:
    lines, half = page.lines, window // 2
    # a mark is a weight: enough to surge for a line of an article, and for one of main that has text outside links
    marked = [allowed and article > 0 for _, _, allowed, article in lines]
    lifted = [m and (article > 1 or weight > 0) for m, (_, weight, _, article) in zip(marked, lines, strict=True)]
    weights = [weight + (surge + 1 if up else 0) for up, (_, weight, _, _) in zip(lifted, lines, strict=True)]
    # windows don't reach across a mark's border, so that text outside has to surge by itself
    sums = [sum(weights[j] for j in range(max(0, i - half), min(len(lines), i + half + 1)) if marked[j] == marked[i]) for i in range(len(lines))]
    limit = surge if any(lifted) else min(surge, max(sums, default=0) // 2)
    up = [i for i, x in enumerate(sums) if x > limit and weights[i]]
    if not up:
        return []
    first, last = up[0], up[-1]
    while first and weights[first - 1] and sums[first - 1] > dive and marked[first - 1] == marked[first]:
        first -= 1
    while last + 1 < len(lines) and weights[last + 1] and sums[last + 1] > dive and marked[last + 1] == marked[last]:
        last += 1
    light = [w == 0 for w in weights]
    dives, at = set(), first
    while at <= last:
        end = at
        while end <= last and light[end]:
            end += 1
        if end - at >= STRETCH:
            dives.update(range(at, end))
        at = end + 1
    return [lines[i][0] for i in range(first, last + 1) if lines[i][2] and i not in dives]


def main_text(source: str | None) -> str:
    return "\n".join(main_lines(Page(source))) if source else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars for every page."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                yield pd.DataFrame({"id": part["id"], "url": part["url"], "text": [main_text(x) for x in part["html"]]})

    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInPandas(run, "id string, url string, text string")
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def op4_html_extract(spark, sf_dir: str) -> DataFrame:
    """Every row of ``pages``: page_id, url, text, n_chars."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
