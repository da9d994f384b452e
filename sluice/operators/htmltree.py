"""HTML as element trees: result pages of search engines, DOM snapshots, the densest element.

A page is one value and is parsed whole, in Arrow batches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from .webtext import NOISE, NOISE_CLASSES, VOID

# Elements that end an open one of their kind.
CLOSES = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = ("ul", "ol", "dl", "table", "div", "section", "article", "main", "select", "body")


class Node:
    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        if parent is not None:
            parent.kids.append(self)

    def walk(self) -> Iterator[Node]:
        """The nodes below, in document order."""
        stack = list(reversed(self.kids))
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                yield n
                stack += reversed(n.kids)

    def text(self) -> str:
        out, stack = [], list(reversed(self.kids))
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                stack += reversed(n.kids)
            else:
                out.append(n)
        return "".join(out)

    def size(self) -> int:
        """Characters of the element written out."""
        own = lambda n: 2 * len(n.tag) + 5 + sum(len(k) + len(v) + 4 for k, v in n.attrs.items()) + sum(len(k) for k in n.kids if isinstance(k, str))
        return own(self) + sum(map(own, self.walk()))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        n = self.at
        while n.parent is not None and n.tag not in SCOPES:
            if n.tag in CLOSES.get(tag, ()):
                self.at = n.parent
            n = n.parent
        new = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        if tag not in VOID:
            self.at = new

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


_PART = re.compile(r"([a-z][a-z0-9]*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:(\*?=)\"?([^\]\"]*)\"?)?\]")


def _fits(n: Node, simple: str) -> bool:
    for tag, cls, ident, attr, op, value in _PART.findall(simple):
        ok = (
            n.tag == tag if tag
            else cls in n.attrs.get("class", "").split() if cls
            else n.attrs.get("id") == ident if ident
            else attr in n.attrs and (not op or n.attrs[attr] == value or op == "*=" and value in n.attrs[attr])
        )
        if not ok:
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Nodes below root that fit; a selector has parts by commas, each a chain of ancestors by spaces."""
    chains = [re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", c) for c in re.split(r",(?![^\[]*\])", selector)]

    def fits(n: Node, chain: list[str]) -> bool:
        if not _fits(n, chain[-1]):
            return False
        for simple in reversed(chain[:-1]):
            n = n.parent
            while n is not None and not _fits(n, simple):
                n = n.parent
            if n is None:
                return False
        return True

    return [n for n in root.walk() if any(fits(n, c) for c in chains)]


def drop(root: Node, selector: str) -> None:
    for n in select(root, selector):
        n.parent.kids = [k for k in n.parent.kids if k is not n]


def squeeze(text: str) -> str:
    return " ".join(text.split())


# --- result pages --------------------------------------------------------------------------------------

# Where each engine's result page holds results, titles and snippets.
RESULTS = {
    "baidu": ("#content_left .result, #content_left .c-container", ("h3 a",), (".c-abstract, .c-span-last",)),
    "bing": ("#b_results .b_algo", ("h2 a",), ("p", ".b_caption p")),
    "sogou": (".rb, .vrwrap", ("h3.pt a", "h3.vr-title a"), (".str_info, .space-txt, .str-text-info",)),
}


def read_results(engine: str, html: str | None, most: int = 10) -> list[dict]:
    items, titles, snippets = RESULTS[engine]
    out: list[dict] = []
    for n in select(parse(html), items):
        link = next((x for s in titles for x in select(n, s)), None)
        if link is None or len(out) == most:
            continue
        title = link.text().strip()
        href = link.attrs.get("data-url") if engine == "sogou" else None
        href = href or link.attrs.get("href", "")
        if engine == "sogou" and href.startswith("/link?url="):
            href = "https://www.sogou.com" + href
        if title and href:
            told = next((t for s in snippets for x in select(n, s)[:1] if (t := x.text().strip())), title)
            out.append({"position": len(out) + 1, "title": title, "url": href, "snippet": told})
    return out


def results(pages: DataFrame, query: str = "query", engine: str = "engine", body: str = "body", most: int = 10) -> DataFrame:
    """(query, engine, body) -> hits, at most ``most`` a page; pages of other engines give none."""

    @F.pandas_udf("array<struct<position: int, title: string, url: string, snippet: string>>")
    def run(engines: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([read_results(e, b, most) if e in RESULTS else [] for e, b in zip(engines, bodies)])

    hits = pages.select(query, engine, F.explode(run(F.lower(engine), F.col(body))).alias("h")).select(query, engine, "h.*")
    return hits.withColumn("url", F.when(F.lower(F.col(engine)) == "bing", U.decode_redirect(F.col("url"))).otherwise(F.col("url")))


# --- DOM snapshots ----------------------------------------------------------------------------------------

# What a snapshot leaves out, and its main content.
HIDDEN = (
    'script, style, noscript, template, nav, header, footer, aside, [role="navigation"], [role="banner"], [role="contentinfo"], '
    '[role="complementary"], [aria-hidden="true"], [hidden], [style*="display: none"], [style*="display:none"], [style*="visibility: hidden"], '
    '[style*="visibility:hidden"], .ad, .ads, .advertisement, [class*="ad-"], [class*="ads-"], [id*="ad-"], [id*="ads-"], [data-ad], [data-ads], '
    'iframe[src*="ad"], iframe[src*="doubleclick"], iframe[src*="googlesyndication"], .cookie-banner, .cookie-consent, [class*="cookie"], .popup, '
    ".modal-backdrop, .overlay, svg, path, canvas"
)
HIDDEN_CLASS = re.compile(r"\b(hidden|invisible|sr-only|visually-hidden)\b", re.I)
MAIN = 'main, [role="main"], article, .content, #content, .main, #main'
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
TEXTS = ("p", "li", "td", "th", "dd", "dt", "blockquote")
CONTROLS = ("input", "select", "textarea", "button")


def _control(n: Node) -> str:
    a = n.attrs.get
    kind, name = a("type", ""), a("name") or a("id") or ""
    out = f"[{n.tag}" + (f":{kind}" if kind else "")
    shown = (("name", name), ("placeholder", a("placeholder")), ("label", a("aria-label")), ("value", a("value") if kind != "password" else ""))
    out += "".join(f' {k}="{v}"' for k, v in shown if v)
    if n.tag == "select" and (options := [x.text().strip() for x in select(n, "option")][:5]):
        out += f" options=[{', '.join(options)}]"
    elif n.tag in ("button", "textarea") and (text := squeeze(n.text())):
        out += f' "{text[:50]}..."' if n.tag == "textarea" and len(text) > 50 else f' "{text}"'
    return out + "]"


def read_snapshot(html: str | None) -> str:
    root = parse(html)
    drop(root, HIDDEN)
    for n in [x for x in root.walk() if HIDDEN_CLASS.search(x.attrs.get("class", ""))]:
        n.parent.kids = [k for k in n.parent.kids if k is not n]
    top = next(iter(select(root, MAIN) or select(root, "body")), root)
    heads, texts, links, controls, told = [], [], [], [], set()
    for n in top.walk():
        t = squeeze(n.text()) if n.tag in (*HEADINGS, *TEXTS, "a") else ""
        if n.tag in HEADINGS and t:
            heads.append("#" * int(n.tag[1]) + " " + t)
        elif n.tag in TEXTS and len(t) > 2:
            texts.append(t)
            told |= {squeeze(x.text()).lower() for x in select(n, "a")}
        elif n.tag == "a" and t and n.attrs.get("href") and not n.attrs["href"].startswith(("#", "javascript:")):
            links.append((t, n.attrs["href"]))
        elif n.tag in CONTROLS:
            controls.append(_control(n))
    every = heads + texts + [f"[{t}]({h})" for t, h in links if t.lower() not in told] + controls
    return "\n".join({x.lower().strip(): x for x in reversed(every)}[k] for k in dict.fromkeys(x.lower().strip() for x in every))


def snapshot(html: Column) -> Column:
    """Headings, texts, links not yet told, and form controls, each line once (case aside); null: empty."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(read_snapshot)

    return run(html)


# --- the densest element --------------------------------------------------------------------------------------


def fixed3(x: float) -> str:
    """Three decimals, rounded half up from the exact binary value."""
    return str(Decimal(x).quantize(Decimal("0.001"), ROUND_HALF_UP))


def read_densest(html: str | None) -> dict:
    """The element with most text for its size; links and headings count over the whole page."""
    root = parse(html)
    drop(root, ",".join([*NOISE, *(f".{c}" for c in NOISE_CLASSES)]))
    links = len(squeeze(" ".join(x.text() for x in select(root, "a"))))
    heads = len(select(root, ",".join(HEADINGS)))
    best = {"text": "", "text_ratio": 0.0, "link_density": 1.0, "headings": heads, "composite": None}
    for n in select(root, "article,main,section,div") or select(root, "body") or [root]:
        text = squeeze(n.text())
        if not text or len(text) < 60 and not select(n, ",".join(HEADINGS)):
            continue
        ratio, density = len(text) / max(1, n.size()), links / len(text)
        score = ratio * (1 - min(1, density)) * math.log10(len(text) + 10) + min(0.3, 0.03 * heads)
        if best["composite"] is None or (score, len(text)) > (best["composite"], len(best["text"])):
            best = {"text": text, "text_ratio": ratio, "link_density": density, "headings": heads, "composite": score}
    ratio, density = fixed3(best["text_ratio"]), fixed3(best["link_density"])
    return best | {"score_line": f"--- score: textRatio={ratio} linkDensity={density} headingCount={heads} ---"}


DENSEST = "text string, text_ratio double, link_density double, headings int, composite double, score_line string"


def densest(html: Column) -> Column:
    """STRUCT(text, text_ratio, link_density, headings, composite, score_line); composite is null where no element has text enough."""

    @F.pandas_udf(DENSEST)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(map(read_densest, s)), columns=[c.split()[0] for c in DENSEST.split(", ")]).astype({"composite": "Float64"})

    return run(html)


def read_code(html: str | None) -> list[str]:
    root = parse(html)
    pre = [x.text().replace("\r\n", "\n").strip("\n") for x in select(root, "pre")]
    inner = {id(x) for x in select(root, "pre code")}
    code = [x.text().replace("\r\n", "\n").strip() for x in select(root, "code") if id(x) not in inner]
    return [x for x in pre + code if x.strip()]


def code_of(html: Column) -> Column:
    """The texts of ``pre`` elements, then of ``code`` outside them; empty ones go."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(read_code)

    return run(html)
