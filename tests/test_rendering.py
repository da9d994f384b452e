"""Rendering and parsing of grep hits, listings, diffs and pages, on small texts."""

from pyspark.sql import functions as F

from sluice import plans
from sluice.operators import diff, grep, htmltree, listing, truncate


def _lines(spark, *texts):
    return spark.createDataFrame([(d, k, x) for d, t in enumerate(texts) for k, x in enumerate(t.split("\n"))], "doc_id int, line_no int, line string")


def _out(df):
    return {r.doc_id: r.lines for r in df.collect()}


def test_grep(spark):
    text = "\n".join([f"src/a.py:{n}:x{n}" for n in (1, 2, 3, 4, 5, 50)] + ["src/b.py:7:2:y", "src/c.py:1:", "no hit"])
    ls = _lines(spark, text, "nothing")
    hits = ls.select("doc_id", "line_no", grep.parse_hit(F.col("line")).alias("h")).filter("h is not null").select("doc_id", "line_no", "h.*")
    got = _out(grep.render(hits, max_files=2, docs=ls.select("doc_id").distinct()))
    assert got[1] == ["0 matches in 0 files"]
    assert got[0] == [
        "8 matches in 3 files", "", "a.py (6 matches):", "  :1-5 (5 matches)", "    :1 x1", "    :2 x2", "    ... (2 more nearby matches)", "    :5 x5", "  :50 x50",
        "", "b.py (1 match):", "  :7:2 y", "", "... and 1 more file (1 match)",
    ]
    assert _out(grep.render(hits, files_only=True))[0][2:] == ["a.py (6 matches)", "", "b.py (1 match)", "", "c.py (1 match)"]


def test_agent_grep(spark):
    ls = _lines(spark, "Found 3 matches in 2 file(s)\n\n/a/x.py\n  1: one\n  Line 12: two\nC:\\y.ts:\n  3:\n  0: none", "  4: no file")
    got = [(r.file, r.line, r.text) for r in grep.agent_hits(ls).orderBy("line_no").collect()]
    assert got == [("/a/x.py", 1, "one"), ("/a/x.py", 12, "two"), ("C:\\y.ts", 3, "")]


TREE = """proj
├── src/
│   ├── b.py
│   └── A.py
├── .git
│   └── x
└── README

2 directories, 3 files"""


def test_trees(spark):
    ls = _lines(spark, TREE)
    got = _out(listing.render(listing.tree_entries(ls), roots=listing.root_names(ls)))
    assert got[0] == ["proj/ (3 files, 1 dirs)", "├── src/", "│   ├── A.py", "│   └── b.py", "└── README", "", "Types: .py(2), [no-ext](1)"]


def test_listings(spark):
    long = "total 8\ndrwxr-xr-x 2 u g 4096 Jan  1 10:00 lib\n-rw-r--r-- 1 u 12 Jan  1 2024 a.ts\nlrwxr-xr-x 1 u g 1 Jan 1 10:00 b -> c\n\nlib:\n-rw-r--r-- 1 u g 5 Jan  1 10:00 z.TS"
    paths = "./app/one.md\n./app/sub/two.md\napp/three"
    ls = _lines(spark, long, paths)
    found = listing.entries(ls)
    got = _out(listing.render(found, roots=listing.root_names(ls)))
    assert got[0] == ["lib/ (3 files, 1 dirs)", "├── lib/", "│   └── z.TS", "├── a.ts", "└── b", "", "Types: .ts(2), [no-ext](1)"]
    assert got[1] == ["app/ (3 files, 1 dirs)", "├── sub/", "│   └── two.md", "├── one.md", "└── three", "", "Types: .md(2), [no-ext](1)"]
    assert _out(listing.render(found, depth=0))[1][1] == "(empty)"
    assert _out(listing.render(found, depth=1))[1][1:4] == ["├── sub/", "├── one.md", "└── three"]
    assert _out(listing.render(found, by_type=True))[1] == ["app/ (3 files, 1 dirs)", "", "Markdown (2 files):", "  one.md, sub/two.md", "", "No Extension (1 file):", "  three"]


DIFF = """diff --git a/x.py b/x.py
index 1..2 100644
--- a/x.py
+++ b/x.py
@@ -1,3 +1,3 @@
 same
-old
+new
@@ -9,1 +9,1 @@
 only context
diff --git a/old.txt b/new.txt
similarity index 98%
rename from old.txt
rename to new.txt
diff --git a/i.png b/i.png
new file mode 100644
Binary files /dev/null and b/i.png differ"""


def test_diffs(spark):
    ls = _lines(spark, DIFF)
    assert _out(diff.render(ls, level="summary"))[0] == ["3 files changed, +1 -1", "M x.py (+1 -1)", "R old.txt → new.txt (similarity 98%)", "A i.png (binary)"]
    assert _out(diff.render(ls))[0] == [
        "M x.py (+1 -1)", "@@ -1,3 +1,3 @@", "-old", "+new", "@@ -9,1 +9,1 @@", "  ... context omitted ...", "", "R old.txt → new.txt (similarity 98%)",
        "No textual hunks", "", "A i.png (binary)", "Binary file changed",
    ]
    full = _out(diff.render(ls, level="full"))[0]
    assert [x for x in full if x] == DIFF.split("\n") and full.count("") == 2
    said = spark.createDataFrame([("x\n 2 files changed, 3 insertions(+)\n",), ("none",), (None,)], "t string").select(diff.told_stats(F.col("t")).alias("s"))
    assert [r.s and tuple(r.s) for r in said.collect()] == [(2, 3, 0), None, None]


PAGE = """<body><header><a href="/">Home</a></header><main><h1>Big  Title</h1><p>Some text <a href="/in">in</a> a paragraph.</p>
<div class="sr-only"><p>unseen</p></div><a href="/out">Out</a><a href="/in2">in</a><a href="#x">skip</a><p>some text in A paragraph.</p>
<input type="password" name="pw" value="secret"><select id="s"><option>a<option>b</select><button>Go</button></main><div class="ad">buy</div></body>"""


def test_pages(spark):
    assert htmltree.read_snapshot(PAGE).split("\n") == [
        "# Big Title", "Some text in a paragraph.", "[Out](/out)", '[input:password name="pw"]', '[select name="s" options=[a, b]]', '[button "Go"]',
    ]
    assert htmltree.read_snapshot(None) == "" and htmltree.read_densest("")["composite"] is None
    best = htmltree.read_densest(f"<body><div class='ad'>{'no ' * 90}</div><section><h2>T</h2><p>{'word ' * 40}</p></section><div>short</div></body>")
    assert best["text"].startswith("Tword") or best["text"].startswith("T word")
    assert best["headings"] == 1 and best["link_density"] == 0
    assert htmltree.fixed3(1.0005) == "1.000" and htmltree.fixed3(0.0625) == "0.063"
    df = spark.createDataFrame([(1, PAGE), (2, None)], "id int, html string")
    rows = df.select("id", htmltree.snapshot(F.col("html")).alias("s"), htmltree.densest(F.col("html")).alias("d"), htmltree.code_of(F.col("html")).alias("c")).orderBy("id").collect()
    assert rows[1].s == "" and rows[1].d.composite is None and rows[1].c == []
    assert htmltree.read_code("<pre>\nx\n</pre><code>y</code><pre><code>z</code></pre>") == ["x", "z", "y"]


def test_result_pages(spark):
    bing = """<div id="b_results"><li class="b_algo"><h2><a href="https://www.bing.com/ck/a?x=1&u=a1aHR0cHM6Ly9leGFtcGxlLm9yZy9h">A</a></h2><p>about a</p></li>
    <li class="b_algo"><h2>no link</h2></li><li class="b_algo"><h2><a href="https://b.org">B</a></h2></li></div>"""
    sogou = '<div class="vrwrap"><h3 class="vr-title"><a href="/link?url=q">S</a></h3><div class="space-txt"> told </div></div><div class="rb"><h3 class="pt"><a data-url="https://d.org" href="/x">D</a></h3></div>'
    df = spark.createDataFrame([("q", "Bing", bing), ("q", "sogou", sogou), ("q", "other", bing), ("q", "bing", None)], "query string, engine string, body string")
    got = sorted((r.engine, r.position, r.title, r.url, r.snippet) for r in htmltree.results(df).collect())
    assert got == [
        ("Bing", 1, "A", "https://example.org/a", "about a"), ("Bing", 2, "B", "https://b.org", "B"),
        ("sogou", 1, "S", "https://www.sogou.com/link?url=q", "told"), ("sogou", 2, "D", "https://d.org", "D"),
    ]


def _cut(spark, ls, column):
    return spark.createDataFrame([(ls,)], "l array<string>").select(column(F.col("l")).alias("o")).first().o


def test_truncation(spark):
    ls = [f"x{k}" for k in range(30)]
    flagged = ls[:12] + ["error: bad"] + ls[13:]
    got = _cut(spark, flagged, lambda c: truncate.fit(c, 14, None, "bash")["lines"])
    assert got == ["x0", "x1", "... (7 lines omitted) ...", *flagged[9:16], "... (11 lines omitted) ...", "x27", "x28", "x29"]
    plain = _cut(spark, ls, lambda c: truncate.fit(c, 5, None, "bash")["lines"])
    assert plain == ["x0", "x1", "... (26 lines omitted) ...", "x28", "x29"]
    code = ls[:7] + ["}"] + ls[8:]
    assert _cut(spark, code, lambda c: truncate.fit(c, 11, None, "read")["lines"]) == [*code[:7], "... (20 lines omitted) ...", *code[27:]]
    assert _cut(spark, ls, lambda c: truncate.fit(c, 1, None, "read")["lines"]) == ["... (30 lines omitted) ..."]


def _tokens(lines):
    return sum((len(x) + 4) // 4 for x in lines)


def test_token_budgets(spark):
    """Against the search spelled out, over lines of many lengths."""
    for n, most, kind in ((40, 100, "grep"), (41, 60, "web"), (7, 9, "bash"), (5, 2, "ls"), (3, 500, "test"), (150, 300, "bash")):
        ls = [chr(97 + k % 26) * (k * 7 % 23) for k in range(n)]
        got = _cut(spark, ls, lambda c: truncate.by_tokens(c, most, kind))

        def cut(m):
            h = int(m * truncate.HEAD[kind]) if kind in ("bash", "test") else max(1, int((m - 1) * truncate.HEAD[kind]))
            t = m - h - 1
            return ls if n <= m else [f"... ({n} lines omitted) ..."] if m == 1 else [*ls[:h], f"... ({n - h - t} lines omitted) ...", *ls[n - t:]]

        fits = [m for m in range(1, n + 1) if _tokens(cut(m)) <= most]
        step = max(1, int(n**0.5))
        coarse = next((m for m in range(n, 0, -step) if m in fits), min(fits, default=1))
        want = cut(max([m for m in fits if m < coarse + step], default=1))
        assert got.lines == want and got.exceeded == (_tokens(want) > most), (n, most, kind)


def test_condensers(spark):
    docs = spark.createDataFrame([(1, "a/x.py:3:hit\na/x.py:9:hit"), (2, "Found 1 match\n/p/q\n  Line 4: t"), (3, ""), (4, None)], "id int, t string")
    got = {r.id: r.output.split("\n")[:-1] for r in plans.grep(docs, "id", "t").collect()}
    assert got == {1: ["2 matches in 1 file", "", "a/x.py (2 matches):", "  :3 hit", "  :9 hit"], 2: ["1 match in 1 file", "", "/p/q (1 match):", "  :4 t"], 3: ["0 matches in 0 files"], 4: ["0 matches in 0 files"]}
    docs = spark.createDataFrame([(1, TREE), (2, "a/b.py\na/c.py"), (3, None)], "id int, t string")
    got = {r.id: r.output.split("\n")[0] for r in plans.ls(docs, "id", "t").collect()}
    assert got == {1: "proj/ (3 files, 1 dirs)", 2: "a/ (2 files, 0 dirs)", 3: "project/ (0 files, 0 dirs)"}
    docs = spark.createDataFrame([(1, DIFF), (2, None)], "id int, t string")
    got = {r.id: (r.output.split("\n")[0], r.compressed_size) for r in plans.diff(docs, "id", "t", max_lines=6).collect()}
    assert got[1] == ("M x.py (+1 -1)", 5) and got[2][0] == "0 files changed, +0 -0"
    src = spark.createDataFrame([("a.py", "def f():\n  a\n  b\n  c\nx")], "n string, t string").select(plans.read(F.col("t"), name=F.col("n"), mode="skeleton").alias("r")).first().r
    assert src.output.split("\n")[:3] == ["def f():", "    ... (3 lines collapsed)", "x"]


def test_all_limits_at_once(spark):
    text = "\n".join([f"line {k}" for k in range(200)] + ["error: bad", "", "", "end"])
    df = spark.createDataFrame([("a.py", text), ("b.json", None)], "n string, t string")
    both = {"max_lines": 30, "max_tokens": 90}
    made = [plans.bash(F.col("t"), **both), plans.read(F.col("t"), name=F.col("n"), numbers=True, mode="skeleton", **both), plans.report(F.col("t"), **both), plans.web(F.col("t"), mode="snapshot", **both)]
    row = df.select(*[c.alias(f"c{k}") for k, c in enumerate(made)]).first()
    assert "error: bad" in row.c0.output and row.c0.compressed_size <= 29
    bare = [x.partition(": ")[2] if x[:1].isdigit() else x for x in row.c1.output.split("\n")]  # numbers count against no limit
    assert all(_tokens(ls) <= 90 for ls in (bare, *(r.output.split("\n") for r in (row.c0, row.c2, row.c3))))
