"""Wiki HTML to Markdown, and links between imported pages, as Arrow column functions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that go with all they hold, and classes of note boxes.
DROPPED = frozenset("script style iframe form object embed noscript".split())
NOTES = ("info", "note", "warning", "tip")
HEADINGS = {f"h{i}": "#" * i for i in range(1, 7)}
PARAGRAPHS = frozenset("p div section article table tr ul ol blockquote pre".split())
VOID = frozenset("br img hr input meta link col area base source track wbr embed".split())


class Writer(HTMLParser):
    """Writes Markdown while elements open and close; each open element remembers how to close."""

    def __init__(self, base_url: str):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.open, self.skipping, self.code, self.lists = base_url, [], [], 0, 0, []

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        classes = (at.get("class") or "").split()
        if self.skipping or tag in DROPPED or "page-metadata" in classes:
            if tag not in VOID:
                self.skipping += 1
                self.open.append((tag, None))
            return
        if tag == "br":
            self.out.append("\n")
        elif tag == "img":
            src = urljoin(self.base, at.get("src") or "")
            if urlsplit(src).scheme in ("http", "https"):
                self.out.append(f"![{at.get('alt') or ''}]({src})")
        elif tag not in VOID:
            self.open.append((tag, self._begin(tag, at, classes)))

    def _begin(self, tag, at, classes) -> tuple[int, str, str]:
        """(where its text begins, kind, argument)"""
        if tag in HEADINGS:
            self.out.append("\n\n" + HEADINGS[tag] + " ")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + ("- " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n" if len(self.lists) > 1 else "\n\n")
        elif tag == "pre":
            self.code += 1
            self.out.append("\n\n```" + next((c.removeprefix("language-") for c in classes if c.startswith("language-")), "") + "\n")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "code" and not self.code:
            self.out.append("`")
        elif tag in PARAGRAPHS:
            self.out.append("\n\n")
        if any(n in c for c in classes for n in NOTES) and tag == "div":
            return len(self.out), "note", ""
        if tag == "a":
            href = urljoin(self.base, at.get("href") or "") if at.get("href") else ""
            return len(self.out), "link", href if urlsplit(href).scheme in ("http", "https") else ""
        return len(self.out), "", ""

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            name, how = self.open.pop()
            if how is None:
                self.skipping -= 1
            else:
                self._end(name, *how)
            if name == tag:
                return

    def _end(self, tag: str, start: int, kind: str, arg: str) -> None:
        if kind == "link" and arg:
            text = "".join(self.out[start:]).strip()
            self.out[start:] = [f"[{text}]({arg})"] if text else []
        elif kind == "note":
            body = re.sub(r"\n{2,}", "\n\n", "".join(self.out[start:]).strip())
            self.out[start:] = ["\n".join("> " + x if x else ">" for x in body.split("\n")), "\n\n"]
        elif tag in ("ul", "ol"):
            self.lists and self.lists.pop()
            self.out.append("\n" if self.lists else "\n\n")
        elif tag == "pre":
            self.code -= 1
            self.out.append("\n```\n\n")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "code" and not self.code:
            self.out.append("`")
        elif tag in PARAGRAPHS or tag in HEADINGS:
            self.out.append("\n\n")
        elif tag in ("td", "th"):
            self.out.append(" ")

    def handle_data(self, data):
        if not self.skipping:
            self.out.append(data if self.code else re.sub(r"\s+", " ", data))


def to_markdown(html: str | None, base_url: str = "") -> str:
    w = Writer(base_url or "")
    w.feed(html or "")
    w.close()
    text = re.sub(r"[ \t]+\n", "\n", "".join(w.out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n +(?=\S)(?![-\d])", "\n", text)).strip()


def markdown_of(html: Column, base_url: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def convert(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages, bases in batches:
            yield pd.Series([to_markdown(p, b) for p, b in zip(pages, bases, strict=True)], dtype=object)

    return convert(html, base_url)


LINK = re.compile(r"(?<!!)\[([^\]]*)\]\(([^)\s]+)\)")
PAGE = re.compile(r"[?&]pageId=(\d+)|/pages/(\d+)")


def relinked(markdown: str, jobs: dict[str, str]) -> str:
    """Links to imported pages point at their jobs; images and other links stay."""

    def one(m: re.Match) -> str:
        page = PAGE.search(m[2])
        job = jobs.get(page[1] or page[2]) if page else None
        return f"[{m[1]}](/jobs/{job})" if job else m[0]

    return LINK.sub(one, markdown)


def relink(markdown: Column, jobs: Column) -> Column:
    """``jobs``: map of page id to job id, bounded by the links of one page."""

    @F.pandas_udf(T.StringType())
    def change(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, maps in batches:
            yield pd.Series([relinked(t or "", dict(m or {})) for t, m in zip(texts, maps, strict=True)], dtype=object)

    return change(markdown, jobs)
