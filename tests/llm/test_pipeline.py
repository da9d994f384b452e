import base64

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import quality_rules

from .test_rules_dedup_join import LOWER, brute_classes, measures
from .util import awkward, empty, rows

DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


def kept_by_rules(text):
    m = measures(text)
    t = text or ""
    w, c = m["n_words"], m["word_chars"]
    lines = len([x for x in t.split("\n") if x.strip(" \t\n\x0b\f\r")])
    upper, digits = sum("A" <= x <= "Z" for x in t), sum("0" <= x <= "9" for x in t)
    return not (
        100 * m["n_repeat_words"] > 50 * w or 10 * m["n_symbols"] > w or 2 * m["n_dup_lines"] > lines
        or c < 2 * w or c > 14 * w or 2 * upper > c or 10 * digits > 4 * c or 5 * t.count("!") > w
    )


def test_run_matches_brute_force(spark, sf):
    docs = rows(spark.read.parquet(f"{sf}/documents.parquet"))
    want = [r for r in docs if kept_by_rules(r["text"])]
    last = {}
    for r in want:
        t = r["text"].translate(LOWER)
        last[t] = max(last.get(t, r), r, key=lambda x: x["doc_id"])
    want = list(last.values())
    classes = brute_classes([(r["doc_id"], r["text"]) for r in want], 5, 80)
    want = {r["doc_id"]: r for r in want if classes[r["doc_id"]][1] == r["doc_id"]}
    before = corpus_pipeline.near(spark, corpus_pipeline.exact(spark, corpus_pipeline.rules(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf), sf), sf)
    assert before.columns == DOCS
    assert {r["doc_id"]: r for r in rows(before)} == want
    got = rows(corpus_pipeline.run(spark, sf))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(corpus_pipeline.RANKS), "rb"))}
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got and {r["doc_id"] for r in got} <= set(want)
    for r in got:
        assert r["token_ids"] == tik.encode_ordinary(want[r["doc_id"]]["text"])
        assert r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) and r["lang"] == want[r["doc_id"]]["lang"]


def test_stages_awkward(spark, sf):
    body = " ".join(f"w{i}" for i in range(80))
    df, texts = awkward(spark, [(50, body), (50, body), (51, body + " end"), (52, None)])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == df.columns
        assert out.count() <= 2 * len(texts)
        assert rows(stage(spark, empty(spark), sf)) == []
    once = corpus_pipeline.exact(spark, df, sf)
    assert once.filter(F.col("doc_id") == 50).count() == 1 and once.filter(F.col("doc_id") == 5).count() == 0
    assert once.count() == len({(t or "").translate(LOWER) for _, t in texts})
    near = {r["doc_id"] for r in rows(corpus_pipeline.near(spark, df, sf))}
    assert 50 in near and 51 not in near and {1, 2, 3, 52} <= near
    assert quality_rules.kept_documents(df).columns == df.columns
