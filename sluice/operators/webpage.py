"""Which text of a page is taken: its own, its densest element's, its snapshot's, its code, or what is between tags."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import htmltree
from .webtext import read_page

#: Characters of a page from which on only its densest element's text is taken.
LARGE = 5_000_000
MODES = ("auto", "page", "dense", "snapshot", "code")


def read_one(html: str | None, markdown: bool = True, mode: str = "auto", score: bool = False) -> dict:
    """{text, source, score_line} of a page by one of MODES; source: what the text was taken from."""
    html, dense = html or "", None
    if score or mode == "dense":
        dense = htmltree.read_densest(html)
    line = dense["score_line"] if score else None
    if mode == "snapshot":
        return {"text": htmltree.read_snapshot(html), "source": "snapshot", "score_line": line}
    if mode == "code":
        return {"text": "\n\n".join(f"```\n{c}\n```" for c in htmltree.read_code(html)), "source": "code", "score_line": line}
    if mode == "dense":
        return {"text": dense["text"], "source": "dense", "score_line": line}
    large = len(html) > LARGE
    try:
        if mode == "page" or not large:
            text = read_page(html, markdown)["text"]
            if mode == "page" or text.strip():
                return {"text": text, "source": "page", "score_line": line}
        text = (dense or htmltree.read_densest(html))["text"]
        if text.strip():
            return {"text": text, "source": "large" if large else "dense", "score_line": line}
    except RecursionError:  # a nest too deep for the parsers: what is between the tags
        pass
    return {"text": " ".join(re.sub(r"<[^>]+>", " ", html).split()), "source": "raw", "score_line": line}


def read_as(html: Column, markdown: bool = True, mode: str = "auto", score: bool = False) -> Column:
    """STRUCT(text, source, score_line)."""
    if mode not in MODES:
        raise ValueError(f"mode: {mode}")

    @F.pandas_udf("text string, source string, score_line string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_one(x, markdown, mode, score) for x in s], columns=["text", "source", "score_line"])

    return run(html)
