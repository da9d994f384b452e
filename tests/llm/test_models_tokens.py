import base64
import hashlib
import random
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from sluice.llm import byte_bpe, language_id, mixing, quality_classifier, queries, sharding, token_counts, url_filter

from .util import COLS, awkward, by_id, empty, rows

RANKS = public_tokenizers.path(queries.RANKS)
PIECES = public_tokenizers.path(queries.PIECES)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=150):
    rnd = random.Random(3)
    some = ["".join(rnd.choice("ab cde \n▁é你<s>0😀'") for _ in range(rnd.randrange(200))) for _ in range(n)]
    return [*some, "<|endoftext|> <s></s>", "a" * 3000, " " * 500, "=-" * 300, "\x00", "▁▁a ▁", "한국어", "é " * 50]


def check_round_trip(got, texts, tik):
    for r in got:
        t = texts[r["doc_id"]] or ""
        ids = tik.encode_ordinary(t)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_bpe(spark, sf, tik):
    docs = {r["doc_id"]: r["text"] for r in rows(spark.read.parquet(f"{sf}/documents.parquet"))}
    got = rows(queries.op9_byte_bpe(spark, sf))
    assert len(got) == len(docs)
    check_round_trip(got, docs, tik)
    df, texts = awkward(spark, list(enumerate(odd_texts(), 1000)))
    got = rows(byte_bpe.round_trip(df, RANKS, public_tokenizers.PATTERN))
    assert len(got) == len(texts)
    check_round_trip(got, dict(texts), tik)
    assert rows(byte_bpe.round_trip(empty(spark), RANKS, public_tokenizers.PATTERN)) == []
    coded = byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    assert all(r["round_trip"] for r in rows(coded))
    back = {r["doc_id"]: r["text"] for r in rows(byte_bpe.decode(coded, RANKS, public_tokenizers.PATTERN))}
    assert back == {i: t or "" for i, t in texts}


def test_bpe_small_tables(tik, monkeypatch):
    for name in ("KEPT_STEPS", "KEPT_FITS", "KEPT_WORDS"):
        monkeypatch.setattr(byte_bpe, name, 20)
    c = byte_bpe.Coder(open(RANKS, "rb").read(), public_tokenizers.PATTERN, named=False)
    for t in odd_texts(40) * 2:
        assert c.ids(t).tolist() == tik.encode_ordinary(t)


def test_streaming_decoder():
    rnd = random.Random(9)
    ranks = {bytes((i,)): i for i in range(256)} | {b"\xe4\xbd": 256, b"\xa0a": 257}
    d = byte_bpe.Decoder(ranks)
    for _ in range(500):
        ids = [rnd.choice([0x61, 0xC3, 0xA9, 0xE4, 0xBD, 0xA0, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xFF, 256, 257]) for _ in range(rnd.randrange(12))]
        want = b"".join(d.bytes_of[i] for i in ids).decode("utf-8", "replace")
        assert d.decode(ids) == want
        held, text = b"", ""
        for i in ids:
            held, more = d.stream([i], held)
            text += more
        assert text + "�" * bool(held) == want


def test_token_counts(spark, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = {r["doc_id"]: r["text"] for r in rows(spark.read.parquet(f"{sf}/documents.parquet"))}
    df, texts = awkward(spark, list(enumerate(odd_texts(), 1000)))
    for got, src in ((rows(queries.op3_token_counts(spark, sf)), docs), (rows(token_counts.count_tokens(df, PIECES)), dict(texts))):
        for r in got:
            t = src[r["doc_id"]] or ""
            assert (r["n_tokens"], r["n_bytes"]) == (len(sp.encode(t)), len(t.encode()))
            assert r["over_limit"] == (r["n_tokens"] > 4096)
    assert rows(token_counts.count_tokens(empty(spark), PIECES)) == []


def test_token_counts_of_long_words(spark):
    rnd = random.Random(6)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    p = token_counts.Pieces(open(PIECES, "rb").read())
    some = "".join(rnd.choice(list(p.id)).replace("▁", "") for _ in range(3000))
    cjk = "的一是在不了有和人这中大为上个国我以要他"
    kinds = [
        lambda n: base64.b64encode(rnd.randbytes(n)).decode()[:n], lambda n: "".join(rnd.choices(cjk, k=n)), lambda n: "a" * n, lambda n: "ab" * n,
        lambda n: "".join(rnd.choices(["a", "aa", "er", "=", "==", "0", "é", "😀"], k=n)), lambda n: some[(i := rnd.randrange(len(some) - n)) : i + n],
    ]
    for kind in kinds:
        for _ in range(25):
            t = kind(rnd.randrange(1, 900))
            want = len(sp.encode(t))
            assert p.count_long(token_counts.SPACE + t) == want
            assert p.count(p.pre_tokens(t)).sum() == want
    for kind in kinds[:4]:
        t = kind(200_000)
        begun = time.time()
        assert p.count(p.pre_tokens(t)).sum() == len(sp.encode(t))
        assert time.time() - begun < 20
    df = spark.createDataFrame([(i, kind(3000) + " tail") for i, kind in enumerate(kinds[:5])], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in rows(df)}
    assert {r["doc_id"]: r["n_tokens"] for r in rows(token_counts.count_tokens(df, PIECES))} == {i: len(sp.encode(t)) for i, t in texts.items()}


def check_shards(got, texts, spread):
    sizes = [0] * 8
    for s in range(8):
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        sizes[s] = sum(r["size"] for r in mine)
    assert sum(len(t.encode()) + 1 if t else 1 for t in texts.values()) <= sum(sizes)
    for r in got:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
    assert max(sizes) - min(sizes) <= 2 * spread


def test_sharding(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in rows(spark.read.parquet(f"{sf}/documents.parquet"))}
    got = rows(queries.op4_sharding(spark, sf))
    assert len(got) == len(docs)
    check_shards(got, docs, max(len(t.encode()) for t in docs.values()) + 1)
    more = [(1000 + i, "hot copy " * 20) for i in range(500)] + [(2000 + i, f"text {i}") for i in range(500)]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in more + [(None, None), (1, "")]], COLS)
    got = rows(sharding.shard(spark, df))
    assert len(got) == 1002
    check_shards(got, dict(more) | {None: None, 1: ""}, 200)
    assert rows(sharding.shard(spark, empty(spark))) == []
    one = rows(sharding.shard(spark, awkward(spark)[0]))
    assert len(one) == 16


def brute_shards(texts, shards=8):
    """Records in the order of (hash, id), cut where the middle of a record passes an eighth of all bytes."""
    size = lambda t: len((t or "").encode()) + 1
    order = sorted(texts, key=lambda x: (zlib.crc32((x[1] or "").encode()), -(1 << 63) if x[0] is None else x[0]))
    total, at, out, slots = sum(size(t) for _, t in order), 0, [], [0] * shards
    for i, t in order:
        s = min(shards - 1, (2 * at + size(t)) * shards // (2 * total))
        out.append((i, s, slots[s]))
        slots[s] += 1
        at += size(t)
    return out


@pytest.mark.parametrize("ranges", [1, 7, 32])
def test_sharding_against_brute_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(sharding, "RANGES", ranges)
    texts = [(i, "hot copy " * 20) for i in range(300)] + [(1000 + i, f"text {i} " * (i % 40)) for i in range(500)] + [(None, None), (5000, ""), (5001, "long " * 5000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = sorted(((r["doc_id"], r["shard"], r["slot"]) for r in rows(sharding.shard(spark, df))), key=str)
    assert got == sorted(brute_shards(texts), key=str)


def accuracy(pairs):
    pairs = list(pairs)
    return sum(a == b for a, b in pairs) / len(pairs)


def test_language(spark):
    d = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in rows(spark.read.parquet(f"{d}/documents.parquet"))}
    got = rows(queries.op7_language_id(spark, d))
    assert len(got) == len(lang)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    assert accuracy((r["lang_pred"], lang[r["doc_id"]]) for r in got if r["held_out"]) >= 0.98
    df, texts = awkward(spark)
    for r in rows(language_id.predict(df)):
        t = dict(texts)[r["doc_id"]]
        assert (r["lang_pred"] == "und") == (not t or not any(c.isalpha() for c in t))
    assert rows(language_id.predict(empty(spark))) == []


def test_language_of_long_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    aside = [i for i in range(10**6, 10**6 + 200) if zlib.crc32(str(i).encode()) % 4 == 2]
    want, long = {}, []
    for lang in sorted({r["lang"] for r in rows(docs.select("lang").distinct()) if r["lang"]}):
        text = "\n".join(r["text"] for r in rows(docs.filter(docs["lang"] == lang).orderBy("doc_id")) if r["text"])
        for size in (100_000, 500_000, 3_000_000):
            i = aside.pop()
            want[i] = lang
            long.append((i, (text * (size // len(text) + 1))[:size], None))
    more = spark.createDataFrame(long, "doc_id long, text string, lang string").repartition(4)
    got = {r["doc_id"]: r["lang_pred"] for r in rows(language_id.predict(docs.unionByName(more))) if r["doc_id"] in want}
    assert len(want) >= 12 and got == want


def test_language_with_repeated_ids(spark):
    ids = [i for i in range(80) if zlib.crc32(str(i).encode()) % 4 != 2][:40]
    order = [r["id"] for r in spark.createDataFrame([(i,) for i in ids], "id long").selectExpr("id", "xxhash64(id) h").orderBy("h").collect()]
    few = [(i, f"text {i} here", "zz" if k % 2 else "aa") for k, i in enumerate(order)]
    for often in (order[0], order[10]):
        for text in ("much repeated", "repeated {} times"):
            df = spark.createDataFrame(few + [(often, text.format(k), "aa") for k in range(300)], "doc_id long, text string, lang string")
            assert language_id.fit(df, "doc_id", "text", "lang", rows=20)[0] == ["aa", "zz"]


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in rows(spark.read.parquet(f"{d}/labels.parquet"))}
    got = rows(queries.op6_quality_classifier(spark, d))
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert accuracy((r["predicted"], label[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in label) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    df, texts = awkward(spark)
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, None), (None, 1), (8, 0), (8, 1)], "doc_id long, quality int")
    assert len(rows(quality_classifier.score_quality(df, labels))) == len(texts)
    assert {r["score"] for r in rows(quality_classifier.score_quality(df, labels.limit(0)))} == {0.5}
    assert rows(quality_classifier.score_quality(empty(spark), labels)) == []


def brute_sums(words, shapes, index):
    n, win = len(index), quality_classifier.WINDOW
    out, seen = np.zeros((n, quality_classifier.DIM)), np.zeros(n)
    for w, s in zip(words, shapes):
        for i, (a, b) in enumerate(zip(w, s)):
            near = sum((index[w[j]] + index[s[j]] for j in range(max(0, i - win), min(len(w), i + win + 1))), np.zeros(quality_classifier.DIM))
            out[a] += near - index[a]
            out[b] += near - index[b]
            seen[[a, b]] += 1
    return out, seen


def brute_pool(w, s, vectors):
    """One text's features, counted name by name."""
    names, n = [*w, *s], max(1, len(w))
    counts = {k: names.count(k) for k in set(names)}
    mean = sum((c / n * vectors[k].astype(float) for k, c in counts.items()), np.zeros(quality_classifier.DIM))
    square = sum((c / n * vectors[k].astype(float) ** 2 for k, c in counts.items()), np.zeros(quality_classifier.DIM))
    fold = np.zeros(64)
    for k in s:
        fold[(k - quality_classifier.WORDS) % 64] += 1 / n
    top = sorted([c / n for k, c in counts.items() if k < quality_classifier.WORDS] + [0, 0, 0])[-3:]
    again = sum(x == y for x, y in zip(w, w[1:]))
    return np.concatenate([mean, np.sqrt(np.maximum(0, square - mean**2)), fold, [again / n, np.log1p(n) / 10, len(set(w)) / n, *top]])


def test_quality_against_brute_force():
    """Names, word vectors, pooling and the network's score, worked out text by text and word by word."""
    texts = ["Plain words, some MORE of them: 12 and 345.", "", "a a a b", "one", " lead tail ", "Été naïve 你好 !!"]
    index = quality_classifier.index_vectors()
    word, shape, owner, n = next(quality_classifier.names(pa.array(texts)))
    per = [(word[owner == i].tolist(), shape[owner == i].tolist()) for i in range(n)]
    assert [len(w) for w, _ in per] == [len(t.split()) for t in texts]
    sums, seen = quality_classifier.around(word, shape, owner, index)
    want, often = brute_sums(*zip(*per), index)
    assert np.allclose(sums, want) and (seen == often).all()
    vectors = quality_classifier.word_vectors(sums, seen)
    got = quality_classifier.pool(word, shape, owner, n, vectors)
    assert np.allclose(got, [brute_pool(w, s, vectors) for w, s in per], atol=1e-4)
    net = quality_classifier.Network().fit(np.random.default_rng(2).normal(size=(40, got.shape[1])), np.arange(40) % 2.0)
    x = np.clip((got - net.mid) / net.dev, -8, 8)
    logit = [sum(np.tanh(r @ net.p[0][:, k] + net.p[1][k]) * net.p[2][k, 0] for k in range(quality_classifier.HIDDEN)) + net.p[3][0] for r in x]
    assert np.allclose(net.predict(got), [1 / (1 + np.exp(-z / net.temperature)) for z in logit])


def test_quality_of_many_tiny_texts():
    """Counts are made for ROWS texts at a time, whatever a batch holds."""
    made = list(quality_classifier.names(pa.array(["tiny text"] * 10_000)))
    assert max(n for *_, n in made) <= quality_classifier.ROWS and sum(n for *_, n in made) == 10_000
    tracemalloc.start()
    vectors = quality_classifier.index_vectors()
    for chunk in quality_classifier.names(pa.array(["tiny text"] * 10_000)):
        quality_classifier.pool(*chunk, vectors)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_quality_sample_is_bounded(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(ids[0], f"more {k}") for k in range(300)] + [(ids[1], "same")] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    got = rows(quality_classifier.sample(docs, labels, "doc_id", "text", "quality", 50))
    assert 0 < len(got) <= 100 and len({(r["y"], r["text"]) for r in got}) == len(got)


def test_quality_beside_a_long_word():
    texts = ["Plain words, some MORE of them: 12 and 345.", "other text " * 9]
    vectors = np.random.default_rng(1).normal(size=(quality_classifier.WORDS + quality_classifier.SHAPES, quality_classifier.DIM)).astype(np.float32)
    net = quality_classifier.Network().fit(np.random.default_rng(2).normal(size=(40, 2 * quality_classifier.DIM + 70)), np.arange(40) % 2.0)
    alone = list(quality_classifier.names(pa.array(texts)))
    for long in ("x" * 2000, "aB1-" * 600):
        beside = list(quality_classifier.names(pa.array([*texts, long])))
        assert len(alone) == len(beside) == 1
        mine = beside[0][2] < len(texts)
        assert (beside[0][0][mine] == alone[0][0]).all() and (beside[0][1][mine] == alone[0][1]).all()
        score = [net.predict(quality_classifier.pool(*x[0], vectors))[: len(texts)] for x in (alone, beside)]
        assert np.allclose(*score, rtol=0, atol=1e-5)


def brute_rule(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.partition(c)[0]
    path = rest[len(host) :].partition("?")[0].partition("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in url_filter.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best


def test_urls(spark, sf):
    pages = rows(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url"))
    extra = [None, "", "no scheme", "http://NET/x", "http://x.net", "https://a.example.net/en/1?x=http://b.net/", "ftp://org/fr/#z", "http://É.net/a?b#c", "http://xnet/", "a://b://c.net/d"]
    pages += [{"page_id": 10_000 + i, "url": u} for i, u in enumerate(extra)] + [{"page_id": None, "url": "http://q.org/fr/"}]
    df = spark.createDataFrame([(r["page_id"], r["url"], "clash") for r in pages], "page_id long, url string, host string")
    got = rows(url_filter.judge_urls(df))
    assert len(got) == len(pages)
    src = {r["page_id"]: r["url"] for r in pages}
    for r in got:
        host, path, best = brute_rule(src[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        assert r["verdict"] == best[1] if best else r["verdict"] in ("allow", "block")
    assert rows(url_filter.judge_urls(df.limit(0))) == []


def test_urls_learn_from_labels(spark):
    """Trees from a table of labelled urls, held out accuracy; a row's suffix statistics leave out its own label."""
    rnd = random.Random(4)
    url = lambda bad, i: f"http://{'x' if bad else 'news'}{rnd.randrange(99) if bad else ''}.site{rnd.randrange(6) + 9 * bad}.com/{'a/' * (4 * bad)}{i}" + "?p=1&q=2" * bad
    some = [(url(i % 3 == 0, i), i % 3 == 0) for i in range(900)]
    labelled = spark.createDataFrame([*some[:600], (None, True), ("http://x.y/", None)], "url string, block boolean")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(some[600:])], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in rows(url_filter.judge_urls(pages, rules=(), labelled=labelled))}
    assert accuracy((got[i], "block" if bad else "allow") for i, (_, bad) in enumerate(some[600:])) >= 0.98
    stats = np.zeros((4, 2))
    stats[2], stats[3] = (1, 1), (3, 4)
    x = url_filter.suffix_features(np.array([[2, 3], [3, 3]]), stats, np.array([1, 0]))
    assert np.allclose(x, [[0.5, np.log1p(0), 3 / 5, np.log1p(3)], [4 / 5, np.log1p(3), 4 / 5, np.log1p(3)]])


def brute_tree(node, x, b):
    feat, cut, value = b
    while feat[node] >= 0:
        node = 2 * node + (x[feat[node]] > cut[node])
    return value[node]


def test_trees_against_brute_force():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5)).astype(float)
    model = url_filter.Boosted().fit(x, y)
    p = model.predict(x)
    assert ((p > 0.5) == y).mean() > 0.97
    for row, q in zip(x[:50], p):
        bins = [np.searchsorted(c, v, "right") for c, v in zip(model.cuts, row)]
        score = model.base + url_filter.RATE * sum(brute_tree(1, bins, t) for t in model.trees)
        assert np.isclose(q, 1 / (1 + np.exp(-score)))
    # the first split is the best of all, tried one by one
    b, g, h = model._bin(x), y - y.mean(), np.full(len(y), y.mean() * (1 - y.mean()))
    feat, cut, _ = model._grow(b, g, h)
    gain = lambda at: g[at].sum() ** 2 / (h[at].sum() + 1)
    best = max(gain(b[:, f] <= c) + gain(b[:, f] > c) for f in range(5) for c in range(url_filter.BINS - 1))
    assert np.isclose(gain(b[:, feat[1]] <= cut[1]) + gain(b[:, feat[1]] > cut[1]), best)


def brute_fill(children, budget):
    """children: [(weight, cap)] -> shares, by rounds of handing out."""
    got = [0.0] * len(children)
    open_ = [i for i, (w, c) in enumerate(children) if w > 0]
    while open_ and budget > 1e-9:
        total = sum(children[i][0] for i in open_)
        give = {i: budget * children[i][0] / total for i in open_}
        full = [i for i in open_ if got[i] + give[i] >= children[i][1]]
        if not full:
            for i in open_:
                got[i] += give[i]
            break
        level = min((children[i][1] - got[i]) / children[i][0] for i in open_)
        for i in open_:
            got[i] += level * children[i][0]
            budget -= level * children[i][0]
        open_ = [i for i in open_ if children[i][1] - got[i] > 1e-9]
    return got


def test_mixing(spark):
    df, texts = awkward(spark, [(1000 + i, "w " * (i % 7)) for i in range(60)])
    docs = df.selectExpr("doc_id", "text", "array('en','fr',null)[cast(pmod(coalesce(doc_id,0),3) as int)] lang", "concat('src', cast(pmod(coalesce(doc_id,0),17) as string)) source")
    for mix in (mixing.Mix(), mixing.Mix(share=1.5, max_epochs=3), mixing.Mix(domain={"web": 1, "*": 0}, share=0.3)):
        got = rows(mixing.mix_sources(spark, docs, mix))
        assert len(got) == len(texts)
        for r in got:
            assert r["tokens"] == len((dict(texts)[r["doc_id"]] or "").split())
        w = lambda level, k: level.get(k, level.get("*", 0))
        tree = {}
        for r in got:
            leaf = tree.setdefault(r["domain"], {}).setdefault(r["lang"], {}).setdefault(r["source"], [0, 0, []])
            leaf[0] += r["tokens"]
            leaf[1] += r["tokens"] * r["copies"]
            leaf[2].append(r)
        cap = lambda d: sum(x[0] * mix.max_epochs * (w(mix.source, s) > 0) for s, x in d.items())
        doms = list(tree)
        caps = [sum(cap(l) * (w(mix.lang, n) > 0) for n, l in tree[d].items()) for d in doms]
        total = int(sum(x["tokens"] for x in got) * mix.share)
        for d, b in zip(doms, brute_fill([(w(mix.domain, d), c) for d, c in zip(doms, caps)], total)):
            langs = list(tree[d])
            for n, b2 in zip(langs, brute_fill([(w(mix.lang, n), cap(tree[d][n])) for n in langs], b)):
                srcs = list(tree[d][n])
                for s, b3 in zip(srcs, brute_fill([(w(mix.source, s), tree[d][n][s][0] * mix.max_epochs) for s in srcs], b2)):
                    a, given, members = tree[d][n][s]
                    assert given <= b3 + 1e-6
                    if a and b3 > 0:
                        # the next document of the epoch's order would not have fitted
                        out = [m["tokens"] for m in members if m["copies"] == min(x["copies"] for x in members)]
                        assert given + max(out) > b3 - 1 or given >= a * mix.max_epochs
                        assert {m["copies"] for m in members} <= {int(b3 // a), int(b3 // a) + 1}
    again = rows(mixing.mix_sources(spark, docs, mixing.Mix()))
    key = lambda r: (r["doc_id"] or -1, r["copies"])
    assert sorted(map(key, again)) == sorted(map(key, rows(mixing.mix_sources(spark, docs.repartition(5), mixing.Mix()))))
    assert rows(mixing.mix_sources(spark, empty(spark))) == []


def test_mixing_of_empty_and_repeated_rows(spark):
    """No copies beyond MAX_EPOCHS, none of texts without words where no token is left, repeated ids within the budget."""
    texts = [(i, "") for i in range(20)] + [(100 + i, "some words here") for i in range(10)]
    docs = spark.createDataFrame([(i, t, "en", "src0") for i, t in texts], "doc_id long, text string, lang string, source string")
    got = rows(mixing.mix_sources(spark, docs, mixing.Mix(share=5.0)))
    assert {r["copies"] for r in got} == {2}
    got = rows(mixing.mix_sources(spark, docs, mixing.Mix(share=1.0)))
    assert {r["copies"] for r in got} == {1}
    many = [(7, f"text {k % 5}", "en", "src0") for k in range(40)] + [(7, "text 1", "fr", "src1"), (None, "x y", "en", "src2"), (None, "x y", "en", "src2"), (8, "a b c", "en", "src0")]
    docs = spark.createDataFrame(many, docs.schema)
    for share in (0.3, 1.4):
        mix = mixing.Mix(share=share)
        chosen = {}
        for r in rows(mixing.mix_sources(spark, docs, mix)):
            k = r["doc_id"], r["lang"], r["source"], r["tokens"]
            chosen[k] = chosen.get(k, 0) + r["copies"]
        given = {}
        for r in rows(mixing.mixed_documents(spark, docs, mix)):
            k = r["doc_id"], r["lang"], r["source"], len(r["text"].split())
            given[k] = given.get(k, 0) + 1
        assert given == {k: n for k, n in chosen.items() if n}
        assert sum(k[3] * n for k, n in given.items()) <= share * sum(len(m[1].split()) for m in many)


def test_mixing_exact_prefix(spark):
    """Of the epoch that is given in part, the longest prefix of its order that fits."""
    texts = [(i, "w " * (1 + i % 5)) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}") for i, t in texts], "doc_id long, text string, lang string, source string")
    mix = mixing.Mix(share=0.6)
    got = rows(mixing.mix_sources(spark, docs, mix))
    # three leaves under one domain and language share by equal weights; none is used up
    budget = int(sum(r["tokens"] for r in got) * mix.share) / 3
    for source in ("src0", "src1", "src2"):
        leaf = [r["doc_id"] for r in got if r["source"] == source]
        order = spark.createDataFrame([(i,) for i in leaf], "id long").selectExpr("id", f"xxhash64({mix.seed}, 0, id) h").collect()
        left, want = int(budget), set()
        for r in sorted(order, key=lambda r: r["h"] % (1 << 64)):
            left -= 1 + r["id"] % 5
            if left < 0:
                break
            want.add(r["id"])
        assert {r["doc_id"] for r in got if r["source"] == source and r["copies"]} == want


def test_mixing_of_many_sources(spark, monkeypatch):
    """Budgets by bins are those of one sort, with another mapping of domains."""
    texts = [(i, "w " * (1 + i * i % 37), "en", f"s{i % 150}") for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    mix = mixing.Mix(domain={"one": 0.2, "two": 0.8}, source={"*": 1.0, "s3": 9.0, "s4": 0.1}, share=1.2)
    domain = lambda s: F.when(s.endswith("7"), "one").otherwise("two")
    leaves = {}
    for i, t, _, s in texts:
        leaves[s] = leaves.get(s, 0) + len(t.split())
    want = {}
    doms = {d: {s: (mix.source.get(s, 1.0), 2.0 * a) for s, a in leaves.items() if s.endswith("7") == (d == "one")} for d in ("one", "two")}
    top = brute_fill([(mix.domain[d], sum(c for _, c in x.values())) for d, x in doms.items()], int(sum(leaves.values()) * 1.2))
    for (d, x), b in zip(doms.items(), top):
        want |= dict(zip(x, brute_fill(list(x.values()), b)))
    for broadcast in (0, 500_000):
        monkeypatch.setattr(mixing, "BROADCAST_IDS", broadcast)
        table = spark.createDataFrame([("one" if s.endswith("7") else "two", "en", s, a) for s, a in leaves.items()], "domain string, lang string, source string, a long")
        got = {r["source"]: r["got"] for r in rows(mixing.budgets(table, mix))}
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)
    given = {}
    for r in rows(mixing.mix_sources(spark, docs, mix, domain=domain)):  # BROADCAST_IDS is 500,000 here, 0 below
        given[r["source"]] = given.get(r["source"], 0) + r["tokens"] * r["copies"]
    assert all(given[s] <= want[s] + 1e-6 for s in want)
    key = lambda r: (r["doc_id"], r["copies"])
    few = sorted(map(key, rows(mixing.mix_sources(spark, docs, mix, domain=domain))))
    monkeypatch.setattr(mixing, "BROADCAST_IDS", 0)
    monkeypatch.setattr(mixing, "HOT", 1 / 100)
    assert sorted(map(key, rows(mixing.mix_sources(spark, docs, mix, domain=domain)))) == few
