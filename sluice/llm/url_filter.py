"""URL filter: host and path rules, and gradient-boosted trees for the urls that no rule fits.

The trees are trained from labelled urls on lexical features: lengths, depth,
digit ratio, entropy, parameter counts, and statistics of the host's suffixes
(its last two and last three labels) over all labelled urls; those of a url
that is learned from leave out its own label.  Labels come from a table of
(url, block) if one is given; without one, urls that a rule fits are labelled
by it, and of the others those whose host has a word of BAIT are labelled block.

Defined results.  A null url, or one without ``://``, has an empty host and
path, fits no rule and is judged by the trees.  Without any labelled url, or
with labels of one kind only, the verdict of the trees is that label, or allow.
Null ids are passed through, repeated rows judged alike, empty tables give
empty results.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: (host and path, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Labelled urls to train from: the bound of the sample.
TRAIN_ROWS = 20_000
#: Words of hosts that label a url without a rule.
BAIT = ("bet", "bets", "casino", "jackpot", "lottery", "pills", "poker", "porn", "slots", "viagra", "xxx")
#: Buckets of host suffixes with statistics, for each length of suffix.
SUFFIXES = 4096
LABELS = (2, 3)
TREES, DEPTH, RATE, BINS = 40, 4, 0.2, 32


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return lower_ascii(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as its text; else null."""
    out = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: len(r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


def _suffix(host: Column, labels: int) -> Column:
    """The bucket of the host's last labels."""
    last = F.substring_index(host, ".", -labels)
    return (F.pmod(F.xxhash64(last), F.lit(SUFFIXES)) + labels * SUFFIXES).cast("int")


def baited(host: Column) -> Column:
    return host.rlike(r"(^|[.\-])(" + "|".join(BAIT) + r")([.\-]|$)")


def suffix_features(suffix: np.ndarray, stats: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Share of blocked urls and size of each suffix; own: the urls' labels, which are taken out of the counts."""
    out = []
    for col in suffix.T:
        blocked, n = stats[col].T
        if own is not None:
            blocked, n = blocked - own, n - 1
        out += [(blocked + 1) / (n + 2), np.log1p(n)]
    return np.column_stack(out)


def features(urls: list, hosts: list, paths: list, suffix: np.ndarray) -> np.ndarray:
    rows = []
    for u, h, p in zip(urls, hosts, paths):
        u = u or ""
        b = np.frombuffer(u.encode(), np.uint8)
        c = np.bincount(b, minlength=1)
        q = c[c > 0] / max(1, len(b))
        query = u.partition("?")[2].partition("#")[0]
        digits = sum(x.isdigit() for x in u)
        rows.append((
            len(u), len(h), len(p), h.count("."), p.count("/"), digits / max(1, len(u)), float(-(q * np.log2(q)).sum()),
            query.count("=") + query.count("&"), len(query), u.count("-"), u.count("#"), max(map(len, h.split("."))),
            sum(x.isdigit() for x in h), u.startswith("https"), len(p.split("/")[1]) if p else 0, p.endswith("/"),
        ))
    x = np.array(rows, np.float64).reshape(len(rows), 16)
    return np.column_stack([x, suffix])


class Boosted:
    """Gradient-boosted depth-limited trees for log-loss on binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = self._bin(x)
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.trees = []
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            score += RATE * self._leaf(tree, binned)
        return self

    def _bin(self, x):
        return np.column_stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)])

    @staticmethod
    def _grow(b, g, h):
        """Arrays by node (heap order): split feature (-1: leaf), bin, value."""
        size = 2 ** (DEPTH + 1)
        feat, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        node = np.ones(len(g), int)
        for k in range(1, size):
            at = np.flatnonzero(node == k)
            if not len(at):
                continue
            gs, hs = g[at].sum(), h[at].sum()
            value[k] = gs / (hs + 1)
            if k >= size // 2 or len(at) < 20:
                continue
            best = (1e-3, -1, 0)
            for f in range(b.shape[1]):
                cg = np.cumsum(np.bincount(b[at, f], g[at], BINS))[:-1]
                ch = np.cumsum(np.bincount(b[at, f], h[at], BINS))[:-1]
                gain = cg**2 / (ch + 1) + (gs - cg) ** 2 / (hs - ch + 1) - gs**2 / (hs + 1)
                if gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
            if best[1] >= 0:
                feat[k], cut[k] = best[1:]
                node[at] = 2 * k + (b[at, feat[k]] > cut[k])
        return feat, cut, value

    @staticmethod
    def _leaf(tree, b):
        feat, cut, value = tree
        node = np.ones(len(b), int)
        for _ in range(DEPTH):
            f = feat[node]
            node = np.where(f >= 0, 2 * node + (b[np.arange(len(b)), f] > cut[node]), node)
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return 1 / (1 + np.exp(-(self.base + RATE * sum(self._leaf(t, b) for t in self.trees))))


def _parted(urls: DataFrame) -> DataFrame:
    """urls (.., url) with host, path and suffixes."""
    host, path = parts(F.col("url"))
    out = urls.withColumns({"host": host, "path": path})
    return out.withColumn("suffix", F.array(*[_suffix(F.col("host"), k) for k in LABELS]))


def self_labelled(split: DataFrame, rules=RULES) -> DataFrame:
    """(url, host, path, suffix, y) of the urls that rules or bait words label."""
    blocked = F.col("rule").isin([r for r, v in rules if v == "block"])
    y = F.when(F.col("rule").isNotNull(), blocked).when(baited(F.col("host")), F.lit(True))
    return split.select("url", "host", "path", "suffix", y.cast("int").alias("y")).filter("y is not null")


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS):
    """(model, suffix statistics): the statistics count all labelled urls, the trees see at most ``rows`` of them."""
    stats = np.zeros((SUFFIXES * (max(LABELS) + 1), 2))
    counted = labelled.select(F.explode("suffix").alias("s"), "y").groupBy("s").agg(F.sum("y").alias("b"), F.count("*").alias("n"))
    for r in counted.collect():  # SUFFIXES rows a length at most
        stats[r["s"]] = r["b"], r["n"]
    x, y = [], []
    # one bounded row of numbers a url comes to the driver, not the url itself
    first = labelled.select("url", "host", "path", "suffix", "y", F.xxhash64("url").alias("h"))
    last = first.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return 0.0, stats
    picked = first.filter(F.col("h") <= F.lit(last)).mapInArrow(_lexical, "h long, y int, suffix array<int>, x array<double>")
    got = picked.orderBy("h", "y", "x").limit(rows).collect()
    y = np.array([r["y"] for r in got], float)
    if y.min() == y.max():
        return float(y[0]), stats
    x, suffix = np.array([r["x"] for r in got]), np.array([r["suffix"] for r in got])
    return Boosted().fit(np.column_stack([x, suffix_features(suffix, stats, y)]), y), stats


def _suffixes(b: pa.RecordBatch) -> np.ndarray:
    return np.array(b["suffix"].to_pylist(), np.int64).reshape(b.num_rows, len(LABELS))


def _lexical(batches):
    for b in batches:
        x = features(*(b[c].to_pylist() for c in ("url", "host", "path")), np.zeros((b.num_rows, 0)))
        yield pa.RecordBatch.from_arrays([b["h"], b["y"], b["suffix"], pa.array(x.tolist(), pa.list_(pa.float64()))], ["h", "y", "suffix", "x"])


def _judge(batches, sent):
    model, stats = sent.value
    for b in batches:
        if isinstance(model, float):
            p = np.full(b.num_rows, model)
        else:
            p = model.predict(features(*(b[c].to_pylist() for c in ("url", "host", "path")), suffix_features(_suffixes(b), stats)))
        yield pa.RecordBatch.from_arrays([b["id"], b["host"], b["path"], b["rule"], pa.array(p, pa.float64())], ["id", "host", "path", "rule", "score"])


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """Per row: id, host, path, rule, verdict, score (the trees' probability of block).

    labelled: (url, block) to train from; a null url or label there is left out.
    """
    split = _parted(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")))
    split = split.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = self_labelled(split, rules)
    else:
        known = _parted(labelled.select("url", F.col("block").cast("int").alias("y"))).filter("url is not null and y is not null")
    sent = pages.sparkSession.sparkContext.broadcast(fit(known))
    kind = split.schema["id"].dataType.simpleString()
    judged = split.mapInArrow(partial(_judge, sent=sent), f"id {kind}, host string, path string, rule string, score double")
    verdict = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    for text, v in rules:
        verdict = F.when(F.col("rule") == text, F.lit(v)).otherwise(verdict)
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
