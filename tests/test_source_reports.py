"""Folding of source files and whole test reports, on small texts."""

import pytest
from pyspark.sql import functions as F

from sluice.functions import language as L
from sluice.functions import text as T
from sluice.operators import source
from sluice.operators import testfailures as reports

PY = '''import a
import b

import c
from d import e
# one
#  two
# three
def f(x):
    """Doc
    more
    end"""
    y = 1

    return y
z = f(1)
class C:
    pass'''
TS = """/* a
 b
 */
export function go(a: string) {
  const x = "}";  // }
  if (x) { y(); }
  return x;
}
function next()
{
  a();
  b();
}
function tiny() { return 1; }
/* open
x"""
RB = "def a\n  x\n  y\n  z\nend\ndef b\n  x\nend"


@pytest.mark.parametrize(
    ("text", "lang", "bodies", "want"),
    [
        (PY, "python", True, ["import a", "# ... (2 more imports)", "from d import e", "# one", "# ... (2 more comment lines)", "def f(x):", "    ... (5 lines collapsed)", "z = f(1)", "class C:", "    pass"]),
        (TS, "typescript", True, ["/* a", "... (2 more comment lines)", "export function go(a: string) {", "  ... (3 lines collapsed)", "}", "function next()", "{", "  ... (2 lines collapsed)", "}", "function tiny() { return 1; }", "/* open", "x"]),
        (RB, "ruby", True, ["def a", "  ... (3 lines collapsed)", "end", "def b", "  x", "end"]),
        (PY, "unknown", True, PY.split("\n")),
        ("", "python", True, [""]),
    ],
)
def test_fold(text, lang, bodies, want):
    assert source.fold(text.split("\n"), lang, bodies=bodies) == want


def test_long_import_runs_count_anew():
    got = source.fold([f"import m{k}" for k in range(150)], "python")
    assert got == ["import m0", "# ... (98 more imports)", "import m99", "import m100", "# ... (48 more imports)", "import m149"]


def test_columns(spark):
    rows = [(1, "a.py", PY), (2, "b.ts", TS), (3, "c", None)]
    df = spark.createDataFrame(rows, "id int, name string, content string").withColumn("lang", L.detect_language(F.col("name")))
    got = {r.id: r.l for r in df.select("id", source.fold_source(T.lines(F.col("content")), F.col("lang"), bodies=True).alias("l")).collect()}
    assert got == {1: source.fold(PY.split("\n"), "python", bodies=True), 2: source.fold(TS.split("\n"), "typescript", bodies=True), 3: None}
    sigs = [tuple(r) for r in source.signatures(df, "id", "name", "content").orderBy("id", "line_no").collect()]
    assert sigs[:2] == [(1, 8, "function", "def f(x):"), (1, 16, "class", "class C:")]
    ls = df.select("id", F.posexplode(T.lines(F.col("content"))).alias("line_no", "line"))
    depth = {(r.id, r.line_no): r.depth for r in source.brace_depth(ls, "id").collect()}
    assert [depth[2, k] for k in (3, 4, 7, 9, 12, 13)] == [1, 1, 0, 1, 0, 0]
    flags = ls.join(df.select("id", "lang"), "id").filter(L.is_import(F.col("line"), F.col("lang")) | L.is_line_comment(F.col("line"), F.col("lang")))
    assert flags.count() == 7


PYTEST = """==== test session starts ====
=== FAILURES ===
____ test_a ____
    def test_a():
>       assert 1 == 2
E       assert 1 == 2
t/test_x.py:5: AssertionError
=== short test summary info ===
FAILED t/test_x.py::test_a - assert 1 == 2
=== 1 failed, 3 passed in 0.12s ==="""
JEST = """FAIL src/a.test.ts
  ● sums two
    expect(received).toBe(expected)
    Expected: 3
    Received: 4
      at Object.<anonymous> (src/a.test.ts:4:10)
Tests:       1 failed, 2 passed, 3 total
Time:        1.2 s"""
GO = """=== RUN   TestA
    a_test.go:9: got 1
--- FAIL: TestA (0.00s)
=== RUN   TestB
--- PASS: TestB (0.00s)
FAIL
FAIL	example.org/a	0.012s"""
CARGO = """test t::a ... FAILED
test t::b ... FAILED
---- t::a stdout ----
thread 't::a' panicked at src/lib.rs:3:5
failures:
test result: FAILED. 1 passed; 2 failed; 0 ignored; 0 measured; 0 filtered out; finished in 0.01s"""


def _report(text):
    return reports.read_report(text, KIND[text])


KIND = {PYTEST: "pytest", JEST: "jest", GO: "go", CARGO: "cargo"}


def test_reports():
    r = _report(PYTEST)
    assert (r["status"], r["total"], r["passed"], r["failed"], r["duration"]) == ("fail", 4, 3, 1, "0.12s")
    assert r["failures"] == [{"test_name": "t/test_x.py::test_a", "location": "t/test_x.py:5", "error": "assert 1 == 2", "context": ["E       assert 1 == 2"]}]
    r = _report(JEST)
    assert (r["status"], r["total"], r["passed"], r["failed"], r["duration"]) == ("fail", 3, 2, 1, "1.2s")
    (f,) = r["failures"]
    assert (f["test_name"], f["location"], f["error"]) == ("src/a.test.ts > sums two", "src/a.test.ts:4:10", "expect(received).toBe(expected)")
    r = _report(GO)
    assert (r["status"], r["total"], r["passed"], r["failed"], r["duration"]) == ("fail", 2, 1, 1, "0.012s")
    assert r["failures"][0] == {"test_name": "TestA", "location": "a_test.go:9", "error": "got 1", "context": []}
    r = _report(CARGO)
    assert (r["status"], r["total"], r["passed"], r["failed"], r["duration"]) == ("fail", 3, 1, 2, "0.01s")
    assert [(f["test_name"], f["error"]) for f in r["failures"]] == [("t::a", "src/lib.rs:3:5"), ("t::b", None)]
    assert reports.read_report("", "unknown")["status"] == "unknown"


def test_rendered_reports(spark):
    texts = [PYTEST, JEST, GO, CARGO, "all 3 passed in 2s", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string").withColumn("r", reports.parse_report(F.col("t")))
    got = [r.l for r in df.orderBy("id").select(reports.render(F.col("r"), F.col("t")).alias("l")).collect()]
    assert got[0] == ["✗ 1/4 tests failed (3 passed, 0.12s)", "", "FAIL t/test_x.py::test_a", "  at t/test_x.py:5", "  assert 1 == 2", "  E       assert 1 == 2"]
    assert got[2][:3] == ["✗ 1/2 tests failed (1 passed, 0.012s)", "", "FAIL TestA"]
    assert got[4:] == [["✓ 3 tests passed (2s)"], ["? No test output received"], ["? No test output received"]]
    assert [r.runner for r in df.orderBy("id").select("r.runner").collect()] == ["pytest", "jest", "go", "cargo"] + ["unknown"] * 3
