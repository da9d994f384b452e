"""HTML pages as text, by an event parser in Arrow batches, and code blocks by expressions."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that hold no content, and those that end a line.
NOISE = ("script", "style", "nav", "footer", "header", "aside", "noscript", "iframe")
NOISE_CLASSES = ("ad", "sidebar", "cookie-banner")
BLOCKS = ("p", "div", "section", "article", "main", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr")
MARKS = {"b": "**", "strong": "**", "em": "_", "i": "_", "code": "`"}
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Reader(HTMLParser):
    def __init__(self, markdown: bool):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.markdown = [], 0, markdown
        self.chars = self.links = self.headings = 0
        self.open: list[tuple[str, bool]] = []
        self.counts: list[int | None] = []  # of the items of each open list; None: not numbered
        self.hrefs: list[tuple[int, str]] = []  # of open links, with their depth

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        noise = tag in NOISE or bool({*(a.get("class") or "").split()} & {*NOISE_CLASSES})
        if tag in VOID:
            if tag == "br" and not self.skip:
                self.out.append("\n")
            return
        self.open.append((tag, noise))
        self.skip += noise
        if self.skip:
            return
        if re.fullmatch("h[1-6]", tag):
            self.headings += 1
            self.out.append("\n" + ("#" * int(tag[1]) + " ") * self.markdown)
        elif not self.markdown:
            return
        elif tag in ("ul", "ol"):
            self.counts.append(0 if tag == "ol" else None)
        elif tag == "li":
            nth = self.counts[-1] if self.counts else None
            if nth is not None:
                nth = self.counts[-1] = nth + 1
            self.out.append("\n- " if nth is None else f"\n{nth}. ")
        elif tag in MARKS and not (tag == "code" and self._inside("pre")):
            self.out.append(MARKS[tag])
        elif tag == "a" and a.get("href"):
            self.hrefs.append((len(self.open), a["href"]))
            self.out.append("[")
        elif tag == "pre":
            self.out.append("\n```\n")
        elif tag in ("td", "th"):
            self.out.append("| ")

    def _inside(self, tag: str) -> bool:
        return any(t == tag for t, _ in self.open)

    def handle_endtag(self, tag):
        if tag not in [t for t, _ in self.open]:
            return
        while self.open:
            t, noise = self.open.pop()
            was, self.skip = self.skip, self.skip - noise
            if not was:
                if self.markdown:
                    self._close(t)
                if t in BLOCKS:
                    self.out.append("\n")
            if t == tag:
                break

    def _close(self, tag: str) -> None:
        if tag in MARKS and not (tag == "code" and self._inside("pre")):
            self.out.append(MARKS[tag])
        elif tag == "pre":
            self.out.append("\n```\n")
        elif tag in ("ul", "ol") and self.counts:
            self.counts.pop()
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag == "tr":
            self.out.append("|")
        elif tag == "a" and self.hrefs and self.hrefs[-1][0] == len(self.open) + 1:
            self.out.append(f"]({self.hrefs.pop()[1]})")

    def handle_data(self, data):
        if not self.skip and not any(t in ("head", "title") for t, _ in self.open):
            self.out.append(data)
            self.chars += len(data.strip())
            if any(t == "a" for t, _ in self.open):
                self.links += len(data.strip())


def read_page(html: str | None, markdown: bool = False) -> dict:
    r = _Reader(markdown)
    r.feed(html or "")
    r.close()
    rows = [re.sub(r"[ \t\f\v]+", " ", x).strip() for x in "".join(r.out).split("\n")]
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(rows)).strip()
    return {"text": text, "text_ratio": r.chars / len(html) if html else 0.0, "link_density": min(1.0, r.links / r.chars) if r.chars else 1.0, "headings": r.headings}


def page_text(html: Column, markdown: bool = False) -> Column:
    """STRUCT(text, text_ratio, link_density, headings)."""

    @F.pandas_udf("text string, text_ratio double, link_density double, headings int")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_page(x, markdown) for x in s], columns=["text", "text_ratio", "link_density", "headings"])

    return run(html)


def density(page: Column) -> Column:
    """ratio * (1 - links) * log10(length + 10), and up to 0.3 for headings."""
    return page["text_ratio"] * (1 - page["link_density"]) * F.log10(F.length(page["text"]) + 10) + F.least(F.lit(0.3), 0.03 * page["headings"])


def strip_tags(html: Column) -> Column:
    x = F.regexp_replace(html, r"<[^>]*>", "")
    for name, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(c))
    return F.trim(x)
