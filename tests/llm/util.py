"""Small fixtures: awkward documents, and rows as plain data."""

import random

COLS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in rows(df)}


def awkward(spark, more=()):
    """Null and empty texts, spaces only, a long text, repeated rows, ties, a null id, extra columns of clashing names."""
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    long = " ".join(rnd.choice(vocab) for _ in range(30_000))
    body = " ".join(rnd.choice(vocab) for _ in range(120))
    texts = [
        (1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, long), (5, body), (5, body), (6, body.upper()), (7, body + " tail"),
        (8, "one"), (9, "one two"), (10, "ONE two"), (None, body + " other tail"), (11, "Été 你好 \U0001f600 naïve"),
        (12, "a\n\na\nb\n b\n"), (13, "x y z " * 60), (14, long + " end"), *more,
    ]
    df = spark.createDataFrame([(i, t, None if i == 9 else "en", "s", 0) for i, t in texts], COLS)
    for c in ("n", "key", "id", "t", "run", "digest", "rep", "label", "kind", "size", "h", "_t", "_w", "score"):
        df = df.selectExpr("*", f"'clash' as `{c}`")
    return df, texts


def empty(spark):
    return spark.createDataFrame([], COLS)
