"""Quality rules kept as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document; the ledger stores the measurements
and one failure bit per rule.  A policy is a versioned bitmask over the rules:
applying one, or asking what a policy would do without one of its rules, reads
the bits and never the texts again.

Defined results.  Null text: no words, every measurement 0, the base rule
fails.  Empty text: the same.  A null id is passed through.  Repeated rows give
one ledger row each.  An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, words, written

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements


RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 14 * n_words"),
    Rule(6, "shouting", "2 * n_upper > word_chars"),
    Rule(7, "digits", "10 * n_digits > 4 * word_chars"),
    Rule(8, "exclamation", "5 * n_exclaim > n_words"),
)
BASE_MASK = 0b11

#: Versioned policies: which rules reject.  By the ablations the first rule alone rejects clean documents (all of them
#: short ones): the corpus keeps those.
POLICIES = {"v1": BASE_MASK, "v2": 0b000111111, "v3": 0b111111111, "corpus": 0b111111110}
PRODUCTION, CORPUS = "v3", "corpus"


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


ROW = "_row"


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row a document: the id (carry: all its columns, as the struct ``_row``) and the measurements the rules read."""
    if carry:
        key, id_col = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), ROW
    else:
        key = F.col(id_col)
    base = docs.select(key.alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("_w", words(F.col("_t")))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("_w")
    windows = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    staged = base.select(
        id_col, "_t", n.cast("long").alias("n_words"), lines.alias("_l"), windows.alias("_h")
    ).withColumn("_some", F.size(F.array_distinct("_h")) < F.size("_h"))
    # (hash, place) pairs in order: a window repeats where a neighbour has its hash.
    staged = staged.withColumn(
        "_s",
        F.when(
            F.col("_some"),
            F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    same = lambda x, i, d: x["h"] == F.get("_s", i + d)["h"]
    staged = staged.withColumn(
        "_p",
        F.when(
            F.col("_some"),
            F.sort_array(
                F.transform(
                    F.filter(
                        "_s",
                        lambda x, i: F.coalesce(F.when(i > 0, same(x, i, -1)), F.lit(False))
                        | F.coalesce(same(x, i, 1), F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        ),
    )
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    t = F.col("_t")
    long = lambda c: c.cast("long")
    size = F.length(t)
    return staged.select(
        id_col,
        "n_words",
        long(_without(t, SPACES)).alias("word_chars"),
        long(size - _without(t, SYMBOLS)).alias("n_symbols"),
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        long(F.size("_l")).alias("n_lines"),
        long(size - _without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_upper"),
        long(size - _without(t, "0123456789")).alias("n_digits"),
        long(size - _without(t, "!")).alias("n_exclaim"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """The measurements and ``fail_bits``: bit k is set where rule k fails."""
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, id_col, text_col, carry).withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """``base_failed``, and ``kept``: no rule of the policy fails; reads fail_bits only."""
    fails = F.col("fail_bits")
    return led.withColumns(
        {
            "base_failed": fails.bitwiseAND(F.lit(BASE_MASK)) != 0,
            "kept": fails.bitwiseAND(F.lit(POLICIES[version])) == 0,
        }
    )


def kept_documents(docs: DataFrame, version: str = CORPUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps."""
    judged = apply_policy(ledger(docs, id_col, text_col, carry=True), version)
    # Written first: a filter would be pushed below the measurements, which the optimizer then puts into it whole.
    return written(docs.sparkSession, judged.select(ROW, "kept"), "judged").filter("kept").select(f"{ROW}.*")


def ablations(led: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """For each rule of the policy: how many documents it fails, and how many only it rejects."""
    mask = POLICIES[version]
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask))
    used = [r for r in RULES if mask >> r.bit & 1]
    aggs = [F.count("*").alias("n_docs"), F.count_if(hit != 0).alias("n_rejected")]
    for r in used:
        aggs += [
            F.count_if(hit.bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"f{r.bit}"),
            F.count_if(hit == F.lit(1 << r.bit)).alias(f"o{r.bit}"),
        ]
    rows = F.array(
        *[
            F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"o{r.bit}").alias("n_only"))
            for r in used
        ]
    )
    return led.agg(*aggs).select("n_docs", "n_rejected", F.inline(rows))
