"""Sources, syntax trees, savings."""

from pyspark.sql import functions as F

from sluice import sources, sql
from sluice.functions import text as T
from sluice.operators import grep, lines, savings, syntax

PY = """import os


@decorated
def first(a,
          b=1):  # why
    x = a
    y = b
    return x + y


class Box(Base):
    size = 1

    async def fill(self):
        def inner():
            return 1
        a = inner()
        return a

    def one(self): return 1
"""


def test_definitions():
    assert [d[:5] for d in syntax.definitions(PY)] == [
        (4, 0, "function", "first", "def first(a, b=1):  # why"), (11, 0, "class", "Box", "class Box(Base):"), (14, 1, "method", "fill", "async def fill(self):"),
        (15, 2, "function", "inner", "def inner():"), (20, 1, "method", "one", "def one(self):"),
    ]
    assert syntax.definitions("def f(:") is None and syntax.definitions(None) == [] and syntax.definitions("a\0b") is None


def test_skeleton(spark):
    want = PY.replace("    x = a\n    y = b\n    return x + y\n", "    ... (3 lines collapsed)\n")
    want = want.replace("        def inner():\n            return 1\n        a = inner()\n        return a\n", "        ... (4 lines collapsed)\n")
    assert syntax.skeleton(PY) == want
    df = spark.createDataFrame([(1, PY), (2, "not python at all ("), (3, None)], "id int, t string")
    assert {r.id: r.s for r in df.select("id", syntax.skeletons(F.col("t")).alias("s")).collect()} == {1: want, 2: None, 3: ""}
    assert syntax.signatures(df, "id", "t").count() == 5


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("")
    got = {r.name.rpartition("/")[2]: r.content for r in sources.whole_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == "one\ntwo\n"
    df = spark.createDataFrame([("o", "e", 0), ("", None, 2), (None, " ", 1)], "o string, e string, s int")
    assert [r.c for r in df.select(sources.captured(F.col("o"), F.col("e"), F.col("s")).alias("c")).collect()] == ["o\ne", "Command exited with code 2", "Command exited with code 1"]
    df = spark.createDataFrame([("abcdef",), ("abc",), (None,)], "t string")
    assert [r.c for r in df.select(sources.capped(F.col("t"), 3, "...").alias("c")).collect()] == ["abc...", "abc", None]


def test_few_partitions_are_dealt(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = sources.table(spark, str(tmp_path / "t"))
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and df.count() == 100


def test_savings(spark):
    df = spark.createDataFrame([("a", "x  ", "x"), ("a", "", ""), ("b", None, None)], "k string, b string, a string")
    got = {r.k: (r.n_docs, r.chars_before, r.chars_after, r.saved_percent) for r in savings.rollup(df, F.col("b"), F.col("a"), "k").collect()}
    assert got["a"] == (2, 3, 1, 67) and got[None] == (3, 3, 1, 67) and got["b"][:3] == (1, None, None)


def test_sql_functions(spark):
    """The functions of SQL are those of Columns."""
    assert set(sql.register(spark)) == {"estimate_tokens", "content_hash", "text_lines", "grep_hits"}
    texts = ["a/b.py:3:7:x\r\nc-4-y\nno hit\nz:0:none\nq.ts:12:", "", "é😀\nk:1-t", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    df.createOrReplaceTempView("texts")
    ls = lines.explode_lines(df, "id", "t")
    assert sorted(spark.sql("SELECT id, l.* FROM texts, LATERAL text_lines(t) l").collect()) == sorted(ls.select("id", "line_no", "line").collect())
    want = ls.select("id", "line_no", grep.parse_hit(F.col("line")).alias("h")).filter("h is not null").select("id", "line_no", "h.*")
    got = spark.sql("SELECT id, h.* FROM texts, LATERAL grep_hits(t) h")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count() == 4
    both = spark.sql("SELECT id, estimate_tokens(t) n, content_hash(t) h FROM texts").collect()
    own = df.select("id", T.estimate_tokens(F.col("t")).alias("n"), T.content_hash(F.col("t")).alias("h")).collect()
    assert sorted(map(tuple, both)) == sorted(map(tuple, own))
