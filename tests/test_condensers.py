"""Condensers against their rules spelled out line by line, over whole tables and over odd texts."""

import json
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sluice import plans
from sluice.functions import text as T
from sluice.operators import jsonprune, lines, routing, search, truncate, webpage
from sluice.plans import hooks

BLANK = re.compile(r"^[ \t\n\x0b\f\r]*$")


def marker(n):
    return f"... ({n} lines omitted) ..."


def tokens(ls):
    return sum(-(-(len(x) + 1) // 4) for x in ls)


def fits_any(line, patterns):
    t = line.strip(" \t\n\x0b\f\r")
    return any(re.search(p, t, re.A) for p in patterns)


def brute_cut(ls, m, kind):
    n = len(ls)
    if n <= m:
        return ls
    if m <= 1:
        return [marker(n)]
    if kind in truncate.AROUND:
        patterns, before, after = (T.ERRORS, 3, 4) if kind == "bash" else ((truncate.FAILURE.replace("(?i:", "(?i:"),), 2, 3)
        at = [i for i, x in enumerate(ls) if fits_any(x, patterns)]
        if at:
            start, end = max(0, at[0] - before), min(n, at[-1] + after)
            if end - start < m * 0.7:
                room = max(0, m - (end - start) - 2)
                head = min(int(room * 0.4), start)
                tail = min(room - head, n - end)
                gap = lambda k: [marker(k)] if k > 0 else []
                return ls[:head] + gap(start - head) + ls[start:end] + gap(n - tail - end) + ls[n - tail :]
        head = int(m * truncate.HEAD[kind])
        tail = m - head - 1
    else:
        wanted = max(1, int((m - 1) * truncate.HEAD[kind]))
        head, tail = wanted, m - 1 - wanted
        if kind == "read":
            for d in range(6):
                up, down = wanted - d, wanted + d
                if 1 <= up <= m - 1 and re.search(truncate.BOUNDARY, ls[up]):
                    head = up
                    break
                if 1 <= down <= m - 1 and down < n and re.search(truncate.BOUNDARY, ls[down]):
                    head = down
                    break
            tail = min(tail, max(0, m - head - 1))
    return ls[:head] + [marker(n - head - tail)] + ls[n - tail :] if n - head - tail > 0 else ls


def brute_search(n, cut, most):
    """The stepped search for the budget."""
    if tokens(cut(n)) <= most:
        return n
    step = max(1, math.isqrt(n))
    first = next((b for b in range(n, 0, -step) if tokens(cut(b)) <= most), 1)
    return next((b for b in range(min(n, first + step - 1), first, -1) if tokens(cut(b)) <= most), first)


def brute_fit(ls, max_lines, max_tokens, kind):
    if max_lines is not None:
        ls = brute_cut(ls, max_lines, kind)
    if max_tokens is not None and ls:
        ls = brute_cut(ls, max(1, brute_search(len(ls), lambda b: brute_cut(ls, b, kind), max_tokens)), kind)
    return ls


def odd_lines(rnd, n):
    some = ["x" * 30, "", "}", "def f():", "error: bad", "FAIL a", "  at f (a.js:1:2)", "plain text", "y", "class A:", "é" * 9, "npm ERR! x", "expected 1"]
    return [rnd.choice(some) if rnd.random() < 0.5 else f"line {k} " * rnd.randrange(4) for k in range(n)]


@pytest.mark.parametrize("kind", ["bash", "test", "read", "grep", "web", "ls", "summary"])
def test_fit_against_brute_force(spark, kind):
    rnd = random.Random(kind)
    made = [odd_lines(rnd, rnd.choice([0, 1, 2, 3, 7, 20, 60, 130])) for _ in range(25)]
    made += [["z"] * 50, ["z"] * 20 + ["error: one"] + ["z"] * 29]
    df = spark.createDataFrame([(i, ls) for i, ls in enumerate(made)], "i int, l array<string>")

    def cut(ls, m):
        if kind != "summary":
            return brute_cut(ls, m, kind)
        return ls if len(ls) <= m else [marker(len(ls))] if m <= 1 else ls[: m - 1] + [marker(len(ls) - m + 1)]

    limits = [(1, None), (2, None), (9, None), (40, None), (None, 3), (None, 40), (None, 150), (30, 60)]
    cols = [truncate.fit(F.col("l"), a, b, kind)["lines"].alias(f"c{k}") for k, (a, b) in enumerate(limits)]
    for r in df.select("i", *cols).collect():
        for k, (a, b) in enumerate(limits):
            want = made[r.i] if a is None else cut(made[r.i], a)
            if b is not None and want:
                base = want
                want = cut(base, max(1, brute_search(len(base), lambda m, base=base: cut(base, m), b)))
            assert r[f"c{k}"] == want, (kind, a, b, made[r.i])


def brute_chunks(chunks, m):
    join = lambda parts, gap: [x for i, p in enumerate(parts) for x in [*p, *([""] if i < len(parts) - 1 and gap(p) else [])]]
    whole = join([a + b for a, b in chunks], lambda p: True)
    core = join([a for a, _ in chunks], lambda p: True)
    rest = join([b for _, b in chunks], bool)
    if len(whole) <= m:
        return whole
    if m <= 1:
        return [marker(len(whole))]
    if len(core) >= m:
        head = max(1, int((m - 1) * 0.75))
        tail = max(0, m - 1 - head)
        return core[:head] + [marker(len(core) - head - tail)] + core[len(core) - tail :]
    left = m - len(core)
    if len(rest) <= left:
        return core + rest
    return core + (rest[: left - 1] if left > 1 else []) + [marker(len(rest) - max(0, left - 1))]


def trimmed(ls):
    while ls and ls[-1] == "":
        ls = ls[:-1]
    return ls


def test_chunks_against_brute_force(spark):
    rnd = random.Random(2)
    made = [[([f"head {i}", *["+x" * rnd.randrange(4)] * rnd.randrange(6)], ["-y"] * rnd.choice([0, 0, 3, 9])) for i in range(rnd.choice([1, 2, 5, 9]))] for _ in range(40)]
    df = spark.createDataFrame([(i, [{"priority": a, "rest": b} for a, b in c]) for i, c in enumerate(made)], "i int, c array<struct<priority: array<string>, rest: array<string>>>")
    limits = [(1, None), (2, None), (8, None), (20, None), (None, 4), (None, 30), (6, 60), (None, None)]
    cols = [truncate.fit_chunks(F.col("c"), a, b)["lines"].alias(f"c{k}") for k, (a, b) in enumerate(limits)]
    for r in df.select("i", *cols).collect():
        c = made[r.i]
        whole = brute_chunks(c, 10**6)
        for k, (a, b) in enumerate(limits):
            want = whole if a is None else brute_chunks(c, a)
            if b is not None:  # begins with all chunks again
                want = brute_chunks(c, max(1, brute_search(len(whole), lambda m, c=c: brute_chunks(c, m), b)))
            assert r[f"c{k}"] == trimmed(want), (a, b, c)


def brute_bash(text, max_lines):
    """(lines before, lines after) of a log."""
    before = re.sub(r"\r\n?", "\n", text).split("\n")
    bare = re.sub(r"\r(?!\n)", "", re.sub(T.ANSI, "", text))
    ls = re.sub(r"\r\n?", "\n", bare).split("\n")
    ls = ["" if BLANK.match(x) else x for i, x in enumerate(ls) if not BLANK.match(x) or i == 0 or not BLANK.match(ls[i - 1])]
    out, run = [], 0
    for x in [*ls, None]:
        if x is not None and x.strip(" \t\n\x0b\f\r") and fits_any(x, T.NOISE):
            run += 1
            continue
        out += [f"  ... ({run} progress/noise lines filtered)"] * (run >= 3) + ([x] if x is not None else [])
        run = 0

    def norm(x):
        x = re.sub(r"(?i)(?=[0-9a-f]*\d)[0-9a-f]{7,}", "H", x, flags=re.A)
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub(r"\d+", "N", x, flags=re.A)).strip()

    done, i = [], 0
    while i < len(out):
        j = i + 1
        while j < len(out) and lines.similar(norm(out[i]), norm(out[j])):
            j += 1
        done += [out[i], f"  ... ({j - i - 2} similar lines omitted)", out[j - 1]] if j - i >= 3 else out[i:j]
        i = j
    return before, brute_cut(done, max_lines, "bash")


def check_bash(df, key, limit=40):
    rows = df.select(key, "t", plans.bash(F.col("t"), limit).alias("r")).collect()
    for r in rows:
        before, after = brute_bash(r["t"], limit - 1)
        assert r["r"]["output"].rpartition("\n")[0] == "\n".join(after), r["t"][:300]
        assert (r["r"]["original_size"], r["r"]["compressed_size"]) == (len(before), len(after))
        percent = max(0, math.floor((1 - len("\n".join(after)) / len("\n".join(before))) * 100 + 0.5)) if "\n".join(before) else 0
        assert r["r"]["output"].endswith(f"\n--- condensed: {len(before)} lines → {len(after)} lines ({percent}% saved) ---")
    return len(rows)


def test_bash_on_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null").select("doc_id", F.col("text").alias("t"))
    assert check_bash(docs, "doc_id") == docs.count()


def test_bash_on_odd_logs(spark):
    rnd = random.Random(11)
    some = ["npm info step 1", "Downloading x 1.5 MB / 20 MB", "\x1b[31merror: bad\x1b[0m", "", "   ", "step 12 of 90", "[####------] 40%", "█████ 10", "Get a\rGet b", "systemd[1]: Started x", "PID USER", "warning: old", "abc 0xdeadbeef12", "plain", "Process: 1 ExecStart"]
    texts = ["\n".join(rnd.choice(some) if rnd.random() < 0.6 else some[k % 3] for k in range(rnd.randrange(90))) for _ in range(120)] + ["", "\n", "\r\n\r\n", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert check_bash(df, "i", 12) == len(texts)


def test_long_log_is_linear(spark):
    """Twice the lines cost about twice the time, not four times."""
    took = []
    for n in (20_000, 40_000, 80_000):
        df = spark.createDataFrame([("\n".join(f"npm info {k}" if k % 5 < 3 else f"word{k * 7919 % 1000} text {'ab' * (k % 9)}" for k in range(n)),)], "t string")
        df.select(plans.bash(F.col("t"), 40, 900).alias("r")).collect()
        begun = time.time()
        df.select(plans.bash(F.col("t"), 40, 900).alias("r")).collect()
        took.append(time.time() - begun)
    assert took[2] < 3.2 * took[1] + 1, took


def test_read_on_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null")
    for r in docs.select("text", plans.read(F.col("text"), 12, numbers=True).alias("r")).collect():
        ls = re.sub(r"\r\n?", "\n", r["text"]).split("\n")
        first = [x for x in ls if not BLANK.match(x)][:10]
        head = re.compile(r"^\s*\d+\s*[:|]\s?")
        if len(first) >= 3 and sum(bool(head.search(x)) for x in first) > 0.6 * len(first):
            ls = [head.sub("", x) for x in ls]
        ls = ["" if BLANK.match(x) else x for i, x in enumerate(ls) if not BLANK.match(x) or i == 0 or not BLANK.match(ls[i - 1])]
        want = brute_cut(ls, 11, "read")
        assert r["r"]["output"].split("\n")[:-1] == [f"{i + 1}: {x}" for i, x in enumerate(want)]


def test_limits_as_options():
    assert [plans.limit(x) for x in (None, 0, -3, 2.9, 0.5, float("nan"), float("inf"), True, "7", 12)] == [None, None, None, 2, 1, None, None, None, None, 12]


def test_numbers_and_keys():
    for text, want in (
        ("1.0", "1"), ("-0.0", "0"), ("1e21", "1e+21"), ("12345678901234567890", "12345678901234567000"), ("1e-7", "1e-7"),
        ("0.000001", "0.000001"), ("1.5e300", "1.5e+300"), ("100", "100"), ("-2.50", "-2.5"), ("9007199254740993", "9007199254740992"),
    ):
        assert jsonprune.stringify(json.loads(text)) == want
    assert jsonprune.prune('{"b": 1, "2": "é\\n", "10": [true], "01": 0}')["output"] == '{"2":"é\\n","10":[true],"b":1,"01":0}'
    assert [jsonprune.prune(x)["valid"] for x in ("NaN", "[1", "null", '"x"', None)] == [False, False, True, True, False]


def test_payload_limits(spark):
    df = spark.createDataFrame([('{"a":[1,2,3]}',), ("oops",), ("3.50",), (None,)], "c string")
    got = [r.r for r in df.select(plans.api(F.col("c"), 1, 20).alias("r")).collect()]
    assert [(r.output, r.error) for r in got] == [('{"a":[1,2,3]}', None), ("oops", "Invalid JSON input"), ("3.5", None), (None, "Invalid JSON input")]
    assert (got[2].original_size, got[2].compressed_size, got[2].ratio) == (4, 3, 0.75)


def test_search_condenser(spark):
    body = json.dumps([{"title": "", "url": "https://www.a.org/x", "snippet": "s", "sources": ["bing", "facts"]}, {"title": "B", "url": "no url", "snippet": ""}, {"title": "C"}])
    df = spark.createDataFrame([(1, body), (2, "text"), (3, '{"title": "x"}'), (4, None)], "id int, c string")
    got = {r.id: r.r.output.split("\n") for r in df.select("id", plans.search(F.col("c"), "q", 2).alias("r")).collect()}
    assert got[1] == ['Search: "q" — 2 results from 2 engines', "", "1. **(untitled)** (a.org)", "   s", "   Sources: bing, facts", "2. **B** (no url)", "--- condensed: 1 lines → 6 lines (0% saved) ---"]
    assert all(got[i][0] == 'Search: "q" — 0 results from 0 engines' for i in (2, 3, 4))


def test_replies(spark):
    texts = ['{"autopromptString": "asked", "query": "own", "results": [{"title": "A", "url": "u", "text": "t", "description": "d"}, {"url": ""}, {"title": "no"}]}', "not json", "[1]", '{"x": 1}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.e, r.l) for r in df.select("i", search.parse_reply(F.col("t"), "exa").alias("e"), search.parse_reply(F.col("t")).alias("l")).collect()}
    assert (got[0][0].query, [tuple(x) for x in got[0][0].results]) == ("asked", [("A", "u", "t")])
    assert (got[0][1].query, [tuple(x) for x in got[0][1].results]) == ("own", [("A", "u", "d")])
    assert [g for i in (1, 2, 4) for g in got[i]] == [None] * 6 and got[3][0].results == []


def test_merged_lists(spark):
    mine = [("A", "https://a.org/", "short", ["llm"], 0.0), ("A2", "https://www.a.org", "last", ["llm"], 0.0), ("B", "https://b.org", "long enough", ["llm"], 0.0)]
    theirs = [("x", "https://a.org?utm_source=z", "longer", ["bing"], 1.0), ("C", "https://c.org", "c", ["facts"], 0.5), ("b", "https://b.org/", "b", ["bing"], 0.2)]
    df = spark.createDataFrame([(mine, theirs)], f"m {search.RESULTS}, t {search.RESULTS}")
    got = df.select(search.merged_lists(F.col("m"), F.col("t")).alias("r")).first().r
    assert [tuple(x)[:4] for x in got] == [("A2", "https://www.a.org", "longer", ["llm", "bing"]), ("B", "https://b.org", "long enough", ["llm", "bing"]), ("C", "https://c.org", "c", ["facts"])]


def test_payload_parsers(spark):
    facts = json.dumps({"ok": True, "results": [{"title": "A", "url": "u", "snippet": "s"}, {"title": None, "url": "v"}]})
    df = spark.createDataFrame([("q", "facts", facts), ("r", "facts", '{"ok": false, "results": [{"title": "x"}]}'), ("s", "facts", "broken"), ("t", "facts", None)], "query string, engine string, body string")
    assert sorted(tuple(r) for r in search.parse_facts(df).collect()) == [("q", "facts", 1, "A", "u", "s"), ("q", "facts", 2, None, "v", None)]
    entries = json.dumps({"results": [{"title": "A", "url": "u", "description": ""}, {"title": "", "url": "v"}, {"title": "B", "url": "w", "description": "d"}]})
    df = spark.createDataFrame([("q", "duckduckgo", entries)], df.schema)
    assert sorted(tuple(r) for r in search.parse_entries(df).collect()) == [("q", "duckduckgo", 1, "A", "u", "A"), ("q", "duckduckgo", 2, "B", "w", "d")]
    feed = json.dumps({"feed": {"entry": [{"title": "A", "url": "u", "abs": "s"}, {"url": "v"}]}})
    df = spark.createDataFrame([("q", "baidu", feed)], df.schema)
    assert [tuple(r) for r in search.parse_feed(df).collect()] == [("q", "baidu", 1, "A", "u", "s")]


def test_regions_and_runners(spark):
    votes = [(a, b, c, d) for a in (True, False) for b in (True, False) for c in (True, False) for d in (True, False)]

    def brute(locale, zone, resolves, reaches):
        china = locale + zone + 2 * (not resolves)
        other = (not locale) + (not zone) + resolves
        if other >= china:
            china, other = china + 2 * (not reaches), other + 2 * reaches
        return "china" if china > other else "global"

    df = spark.createDataFrame(votes, "a boolean, b boolean, c boolean, d boolean")
    assert all(r.r == brute(r.a, r.b, r.c, r.d) for r in df.select("*", search.region(*map(F.col, "abcd")).alias("r")).collect())
    df = spark.createDataFrame([(c,) for c in ("python -m pytest x", "npx vitest", "go test ./...", "cargo test", "npx jest", "make")], "c string")
    assert [r.r for r in df.select(routing.runner_hint(F.col("c")).alias("r")).collect()] == ["pytest", "vitest", "go", "go", "jest", None]  # the first part that fits: "cargo test" has "go test"


def test_page_strategies(monkeypatch):
    page = f"<body><nav>menu</nav><article><h1>T</h1><p>{'word ' * 40}</p><pre>code</pre></article></body>"
    assert webpage.read_one(page)["source"] == "page" and webpage.read_one(page)["text"].startswith("# T")
    assert webpage.read_one("<body><nav>only menu</nav></body>") == {"text": "only menu", "source": "raw", "score_line": None}
    assert [webpage.read_one(page, mode=m)["source"] for m in ("dense", "snapshot", "code")] == ["dense", "snapshot", "code"]
    assert webpage.read_one(None)["text"] == "" and webpage.read_one(page, score=True)["score_line"].startswith("--- score: textRatio=")
    monkeypatch.setattr(webpage, "LARGE", 100)
    assert webpage.read_one(page)["source"] == "large"


def test_second_profile(spark):
    long = "x\n\n\n\n" * 200
    reply = json.dumps({"query": "q", "results": [{"title": "A", "url": "https://a.org", "description": "d"}]})
    rows = [("s", 1, "exec", {}, long), ("s", 2, "bash", {}, long), ("s", 3, "web_search", {}, reply), ("s", 4, "web_search", {"query": "bad"}, reply), ("s", 5, "web_search", {"query": "new"}, reply), ("s", 6, "read", {}, None), ("s", 7, "read", {}, "")]
    events = spark.createDataFrame(rows, "session string, seq int, tool string, args map<string,string>, output string")
    found = [("q", [("B", "https://b.org", "b", ["bing"], 1.0)], ["bing"], [], 3), ("bad", None, None, ["bing"], 9)]
    results = spark.createDataFrame(found, f"query string, results {search.RESULTS}, engines array<string>, failed array<string>, millis int")
    got = {r.seq: r for r in hooks.outputs(events, results, profile="second").collect()}
    assert got[1].route == "bash" and got[1].changed and got[2].route is None and got[2].output == long
    assert got[3].output.endswith("- llm results: 1\n- Engines: bing\n- Merge time: 3ms") and "## 2. B" in got[3].output
    assert got[4].output.endswith("- llm results: 1\n- Engines: fallback (search failed)")
    assert got[5].output == reply and not got[5].changed and got[6].output is None and got[7].output == ""
