import hashlib
import os
import random
import re

import numpy as np
import pytest

from sluice.llm import bitmap, exact_dedup, ngram_join, quality_rules
from sluice.llm.common import shared_dir
from sluice.llm.queries import op5_ngram_jaccard_join, op8_quality_rules, op10_exact_dedup

from .util import COLS, awkward, by_id, empty, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    win = {}
    for i in range(len(w) - 2):
        win.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {p + d for v in win.values() if len(v) > 1 for p in v for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
    }


def check_rules(got, texts):
    for r in got:
        m = measures(texts[r["doc_id"]])
        assert {k: r[k] for k in m} == m
        assert r["base_failed"] == (m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_rules_on_table(spark, sf):
    docs = by_id(spark.read.parquet(f"{sf}/documents.parquet"))
    got = rows(op8_quality_rules(spark, sf))
    assert len(got) == len(docs)
    check_rules(got, {k: v["text"] for k, v in docs.items()})
    clean = {r["doc_id"] for r in rows(spark.read.parquet(f"{sf}/labels.parquet")) if r["quality"] == 1 and r["toxic"] == 0}
    assert sum(r["kept"] or r["base_failed"] for r in got if r["doc_id"] in clean) >= 0.98 * sum(r["doc_id"] in clean for r in got)


def test_rules_awkward(spark):
    df, texts = awkward(spark)
    got = rows(quality_rules.apply_policy(quality_rules.ledger(df)))
    assert len(got) == len(texts)
    check_rules(got, dict(texts))
    assert rows(quality_rules.ledger(empty(spark))) == []


def test_ablations(spark, sf):
    led = quality_rules.ledger(spark.read.parquet(f"{sf}/documents.parquet"))
    bits = [r["fail_bits"] for r in rows(led)]
    for version, mask in quality_rules.POLICIES.items():
        assert [r["kept"] for r in rows(quality_rules.apply_policy(led, version).select("kept"))] == [b & mask == 0 for b in bits]
        for r in rows(quality_rules.ablations(led, version)):
            bit = next(1 << x.bit for x in quality_rules.RULES if x.name == r["rule"])
            assert r["n_failed"] == sum(b & bit > 0 for b in bits)
            assert r["n_only"] == sum(b & mask == bit for b in bits)
            assert r["n_rejected"] == sum(b & mask > 0 for b in bits)


def check_dedup(got, texts, keep=max):
    low = lambda i: -(1 << 63) if i is None else i
    groups = {}
    for i, t in texts:
        groups.setdefault((t or "").translate(LOWER), []).append(low(i))
    text_of = {low(i): (t or "").translate(LOWER) for i, t in texts}
    assert len(got) == len(texts)
    for r in got:
        t = text_of[low(r["doc_id"])]
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert r["group_size"] == len(groups[t]) and low(r["keep_id"]) == keep(groups[t])
        assert not r["kept"] or r["keep_id"] == r["doc_id"]
    assert sum(r["kept"] for r in got) == len(groups)


def test_dedup_on_table(spark, sf):
    docs = rows(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    check_dedup(rows(op10_exact_dedup(spark, sf)), [(r["doc_id"], r["text"]) for r in docs])


@pytest.mark.parametrize("keep", ["max", "min"])
def test_dedup_awkward(spark, keep):
    df, texts = awkward(spark, [(i, "hot copy") for i in range(100, 160)])
    df = df.repartition(7)
    check_dedup(rows(exact_dedup.exact_dedup(spark, df, keep=keep)), texts, {"max": max, "min": min}[keep])
    assert rows(exact_dedup.exact_dedup(spark, empty(spark))) == []


def entries_of(df):
    return exact_dedup.digests(df, "doc_id", "text").selectExpr("digest", "check", "bytes", "coalesce(id, -1) keep", "row keep_row")


@pytest.mark.parametrize("smallest", [False, True])
def test_merge_in_rounds(spark, monkeypatch, smallest):
    df, texts = awkward(spark, [(1000 + i, f"text {i % 37}") for i in range(400)])
    want = {}
    for i, t in texts:
        want.setdefault(hashlib.sha256((t or "").translate(LOWER).encode()).digest(), []).append(-1 if i is None else i)
    want = {d: (len(v), (min if smallest else max)(v)) for d, v in want.items()}
    monkeypatch.setattr(exact_dedup, "BLOCK", 8)
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", 20)
    for bits, width in ((1, 1), (4, 1), (4, 3), (6, 2)):
        merged = exact_dedup.merge_runs(spark, entries_of(df.repartition(11)), smallest, bits, width)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") - 1 == -(-bits // width)  # one more for this test's own
        assert merged.rdd.getNumPartitions() == 1 << bits
        got = merged.selectExpr("*", "spark_partition_id() p").collect()
        assert {bytes(r["digest"]): (r["n"], r["keep"]) for r in got} == want and len(got) == len(want)
        assert all(r["p"] == int.from_bytes(r["digest"][:4], "big") % (1 << bits) for r in got)  # a run a task


def test_rounds():
    for parts in (1, 2, 3, 32, 33, 1000, 5000, 10**6):
        bits, width = exact_dedup.rounds_for(parts)
        assert 1 << bits >= min(parts, 1 << exact_dedup.MOST_BITS) and -(-bits // width) <= exact_dedup.ROUNDS
    assert exact_dedup.rounds_for(32) == (5, 1)


def sorted_entries(rnd, n, kinds):
    x = np.zeros(n, exact_dedup.ENTRY)
    x["digest"] = [hashlib.sha256(b"%d" % rnd.randrange(kinds)).digest()[:31] + b"\0" * rnd.randrange(1, 2) for _ in range(n)]
    x["n"], x["keep"], x["keep_row"] = 1, rnd.choices(range(50), k=n), rnd.choices(range(50), k=n)
    return x[np.argsort(x["digest"], kind="stable")]


def test_merge_streams():
    rnd = random.Random(8)
    for _ in range(20):
        runs = [sorted_entries(rnd, rnd.randrange(1, 300), 200) for _ in range(rnd.randrange(1, 6))]
        blocks = sorted((r[i : i + 16] for r in runs for i in range(0, len(r), 16)), key=lambda b: b["digest"][0].ljust(32, b"\0"))
        most, out = 0, []
        for x in exact_dedup.merge_blocks(iter(blocks), smallest=False):
            most = max(most, len(x))
            out.append(x)
        got = np.concatenate(out)
        assert (got["digest"][1:] > got["digest"][:-1]).all() and most <= 16 * (len(runs) + 1)
        every = np.concatenate(runs)
        for g in got:
            mine = every[every["digest"] == g["digest"]]
            best = max(zip(mine["keep"], mine["keep_row"]))
            assert (g["n"], g["keep"], g["keep_row"]) == (len(mine), *best)


def test_one_digest_of_two_texts():
    x = np.zeros(2, exact_dedup.ENTRY)
    x["bytes"] = 1, 2
    with pytest.raises(ValueError, match="one SHA-256"):
        exact_dedup.one_of_each(x, False)


def brute_classes(texts, k, percent):
    low = lambda i: -(1 << 63) if i is None else i
    sets = []
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((low(i), {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    top = {i: i for i, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                top[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def check_classes(got, texts, k, percent):
    want = brute_classes(texts, k, percent)
    assert len(got) == len(texts)
    low = lambda i: -(1 << 63) if i is None else i
    assert {low(r["doc_id"]): (r["n_shingles"], low(r["component_id"])) for r in got} == want


def test_join_on_table(spark, sf):
    docs = rows(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    check_classes(rows(op5_ngram_jaccard_join(spark, sf)), [(r["doc_id"], r["text"]) for r in docs], 4, 85)


def near_copies(seed, base_words, copies, edits, first):
    rnd = random.Random(seed)
    base = [f"b{rnd.randrange(5000)}" for _ in range(base_words)]
    out = []
    for c in range(copies):
        w = base[:]
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(5000)}"
        out.append((first + c, " ".join(w)))
    return out


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 60), (1, 50)])
def test_join_near_copies(spark, k, percent):
    more = near_copies(1, 150, 60, 8, 100) + near_copies(2, 12, 40, 2, 300) + near_copies(3, 700, 20, 25, 400)
    df, texts = awkward(spark, more)
    check_classes(rows(ngram_join.ngram_classes(spark, df.repartition(3), k=k, percent=percent)), texts, k, percent)


def test_join_boundary_any(spark, monkeypatch):
    more = near_copies(4, 40, 40, 4, 100) + near_copies(5, 90, 30, 5, 300)
    texts = more
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], COLS)
    for limit in (0, 40, 256):
        monkeypatch.setattr(ngram_join, "boundary", lambda *a, x=limit: x)
        check_classes(rows(ngram_join.ngram_classes(spark, df, k=3, percent=70)), texts, 3, 70)
    assert rows(ngram_join.ngram_classes(spark, empty(spark))) == []


def test_join_without_bitmaps(spark, monkeypatch):
    """Keys and documents beyond a bitmap or a broadcast are joined by shuffle."""
    monkeypatch.setattr(bitmap, "MOST_BITS", 2)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    texts = near_copies(7, 60, 20, 4, 100) + [(900, ""), (901, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    check_classes(rows(ngram_join.ngram_classes(spark, df, k=3, percent=70)), texts, 3, 70)


def test_join_beside_a_long_word(spark):
    copies = near_copies(6, 60, 4, 1, 100)
    texts = [*copies, (200, copies[0][1]), (201, "x" * 2000 + " " + "y" * 3000), (202, "x" * 2000 + " " + "y" * 3000)]
    rdd = spark.sparkContext.parallelize(texts[:4], 1).union(spark.sparkContext.parallelize(texts[4:6], 1)).union(spark.sparkContext.parallelize(texts[6:], 1))
    df = spark.createDataFrame(rdd, "doc_id long, text string")
    check_classes(rows(ngram_join.ngram_classes(spark, df, k=5, percent=60)), texts, 5, 60)


def test_near_stage_beside_a_long_word(spark):
    body = " ".join(f"w{i}" for i in range(80))
    sc = spark.sparkContext
    rdd = sc.parallelize([(1, body), (2, "z" * 2000)], 1).union(sc.parallelize([(3, body + " end")], 1))
    left = ngram_join.drop_near_copies(spark, spark.createDataFrame(rdd, "doc_id long, text string"))
    assert {r["doc_id"] for r in rows(left)} == {1, 2}


def test_join_even_vocabulary(spark):
    text = " ".join(f"w{i}" for i in range(10_000))
    texts = [(1, text), (2, text)]
    check_classes(rows(ngram_join.ngram_classes(spark, spark.createDataFrame(texts, "doc_id long, text string").coalesce(1))), texts, 5, 80)


def test_join_texts_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    texts = [(1, a), (7, a + " end"), (7, b), (None, c), (None, a + " more"), (9, c + " end"), (None, ""), (8, "z"), (8, "z")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["n_shingles"]) for r in rows(ngram_join.ngram_classes(spark, df))}
    assert got == {(1, None, 76), (7, None, 77), (7, 7, 76), (None, None, 76), (None, None, 77), (9, None, 77), (None, None, 0), (8, 8, 1)}
    left = sorted(((r["doc_id"], r["text"]) for r in rows(ngram_join.drop_near_copies(spark, df))), key=str)
    assert left == sorted([(7, b), (None, c), (None, a + " more"), (None, ""), (8, "z")], key=str)


def test_join_writes_few_files(spark):
    """What is small is written as one file however many tasks it comes from, and few edges need no tables for rounds."""
    texts = near_copies(8, 60, 40, 4, 100) + near_copies(9, 90, 30, 5, 300)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    top = shared_dir(spark).removeprefix("file:")

    def tables():
        return {f"{top}/{d}/{x}" for d in os.listdir(top) if d.startswith("sluice-") for x in os.listdir(f"{top}/{d}")}

    before = tables()
    check_classes(rows(ngram_join.ngram_classes(spark, df, k=3, percent=70)), texts, 3, 70)
    made = {}
    for x in tables() - before:
        made.setdefault(os.path.basename(x).rsplit("-", 1)[0], []).append(sum(f.startswith("part-") for f in os.listdir(x)))
    assert "hooks" not in made
    assert all(max(made[x]) == 1 for x in ("keys", "pivots", "pairs", "wanted", "sets", "edges")), made


@pytest.mark.parametrize("most", [500_000, 20, 0])
def test_components(spark, monkeypatch, most):
    """By the driver, by rounds of joins, and by rounds whose rest the driver joins."""
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", most)
    rnd = random.Random(11)
    ids = [rnd.randrange(-(1 << 63), 1 << 63) for _ in range(120)]
    edges = [(ids[i], ids[i + 1]) for i in range(39)] + [(ids[40], x) for x in ids[41:70]] + [(rnd.choice(ids[70:]), rnd.choice(ids[70:])) for _ in range(30)]
    edges += [(b, a) for a, b in edges[::3]] + [(ids[0], ids[0])]
    rnd.shuffle(edges)
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = ngram_join.components(spark, spark.createDataFrame(edges, "a long, b long"))
    assert sorted((r["v"], r["label"]) for r in rows(got)) == sorted(least.items())
    assert rows(ngram_join.components(spark, spark.createDataFrame([(1, 1)], "a long, b long"))) == []
