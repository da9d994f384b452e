"""N-gram Jaccard self-join: a size-aware heavy-light join, and its components.

Two sets link when 100 * |A & B| >= percent * |A | B|.  All sets are put into
one order of shingles, rare ones first: by how frequent their words are, and
last those that many documents share, by rising count.  (Both come from one
pass over all blocks of documents: what has a share f of the whole has a share
f of some block.)  The order decides the cost only; any order gives the same
links.

* Light (small) sets enumerate fixed-size subsets: two linked sets share at
  least two of their first n - ceil(t n) + 2 shingles, so each pair of these is
  a key.
* Heavy (large) sets are scanned through inverted lists: linked sets share at
  least one of their first n - ceil(t n) + 1 shingles, so each of these is a key.

The boundary is the size at which the two ways' estimated costs, summed over
the histogram of sizes, are least; light sets of a size that a heavy set can
link with take part in the inverted lists as well, so no link is lost.

Equal sets are one class from the start.  Within a key no list of all pairs is
made: a few pivots a key are compared with its members first, linked ones are
merged, and what is then compared are pairs of different components only, and
only those that the sizes, the key's places in both sets (the members from
there on bound the overlap, if it is the first key in common) and a parity
sketch (its distance never exceeds that of the sets) leave open.  Every comparison is of whole sets.

Defined results.  Null or empty text, or text without words: n_shingles 0,
linked with nothing, component its own id.  Null ids are kept, as the smallest
id.  What is linked are classes of equal sets, known by a digest: different texts
of one id are documents of their own.  Repeated rows are one class.  Empty
tables give empty results.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import passing
from .common import BROADCAST_IDS, LOW, model, without, written
from .shingles import U, chunk_sets, chunks, mix, short_shingle, shingle_sets

#: A shingle counts as common from this share of the documents; at most (mean set size) / SHARE shingles can.
SHARE = 1 / 2048
#: A word counts as frequent from this share of all words; at most 1 / WORD_SHARE words can.
WORD_SHARE = 1 / 8192
#: Shingles of a block in which common ones are counted.
BLOCK = 1_000_000
#: Pivots a key, by round.
PIVOTS = (4, 12)
#: 64-bit words of the parity sketch.
SKETCH = 8
_SEEDS = tuple(U(x) for x in np.random.default_rng(7).integers(1, 1 << 63, 8))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def digest(s: np.ndarray, seed: int) -> int:
    """A 64-bit hash of a set of hashes."""
    x = mix(s * _SEEDS[seed] + _SEEDS[seed + 1]).sum(dtype=U) + U(len(s))
    return int(_signed(mix(np.array([x], U)))[0])


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return batch["text"].fill_null("")


SKETCHES = [f"k{i}" for i in range(SKETCH)]
PROFILE = "kind int, id long, n long, sid long, sid2 long, " + ", ".join(f"{c} long" for c in SKETCHES) + ", mark long, wide binary"


def _sketch(s: np.ndarray, places: int) -> np.ndarray:
    """Whether an odd number of the set's hashes falls on each place: a bit each."""
    at = ((s >> U(20)) & U(places - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=places) & 1).astype(np.uint8))


def _wide(s: np.ndarray) -> bytes:
    """A sketch of about as many places as the set has members."""
    return _sketch(s, 1 << max(6, len(s).bit_length())).tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """At most the number of hashes that are in one set only; a sketch of more places is folded first."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _profile(batches, k: int, share: float):
    """Rows of five kinds.

    0: a document's id, set size n, two digests of the set, parity sketches, the text's mark.
    1: a shingle (sid) common in a block, and its count n.  3: a word (sid)
    frequent in a block, and its count n.  2: a block's documents (id),
    shingles (n), and how many others of the block equal an uncommon one (sid).
    4: a block's words (n).
    """
    model()  # this worker may hold another operator's caches
    width = 5 + SKETCH
    block, words, held, docs = [], [], 0, 0

    def rows(kind, *cols, wide=None):
        cols = [pa.array(c, pa.int64()) for c in cols]
        m = len(cols[0])
        cols += [pa.nulls(m, pa.int64())] * (width - len(cols)) + [pa.array(wide, pa.binary()) if wide else pa.nulls(m, pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), *cols], ["kind", "id", "n", "sid", "sid2", *SKETCHES, "mark", "wide"])

    def common():
        nonlocal block, words, held, docs
        if block:
            x, c = np.unique(np.concatenate(block), return_counts=True)
            big = c >= max(3, math.ceil(share * docs))
            yield rows(2, [docs], [held], [int((c[~big] * (c[~big] - 1)).sum())])
            yield rows(1, np.zeros(big.sum(), np.int64), c[big].astype(np.int64), _signed(x[big]))
        if words:
            w = np.concatenate(words)
            x, c = np.unique(w, return_counts=True)
            big = c >= max(2, len(w) * WORD_SHARE / 2)
            yield rows(3, np.zeros(big.sum(), np.int64), c[big].astype(np.int64), _signed(x[big]))
            yield rows(4, [0], [len(w)])
        block, words, held, docs = [], [], 0, 0

    for b in batches:
        n, one, two, sketches, wide = [], [], [], [], []
        for h, begin, s in chunks(_texts(b), k):
            words.append(h)
            for x in chunk_sets(h, begin, s, k):
                n.append(len(x)), one.append(digest(x, 0)), two.append(digest(x, 2)), sketches.append(_sketch(x, 64 * SKETCH).view(np.int64)), wide.append(_wide(x))
                block.append(x)
                held, docs = held + len(x), docs + 1
            if held >= BLOCK:
                yield from common()
        ids = b["id"].to_numpy(zero_copy_only=False)
        yield rows(0, ids, n, one, two, *(np.array(sketches, np.int64).reshape(len(n), SKETCH).T.copy()), b["mark"].to_numpy(zero_copy_only=False), wide=wide)
    yield from common()


def need(n, percent: int):
    """The least overlap that any set linked with one of size n has with it."""
    return -(-percent * n // 100)


def boundary(sizes: dict[int, int], spread: float, percent: int, most: int = 256) -> int:
    """The largest light size: least cost of keys made and list places scanned.

    sizes: how many sets have each size.  spread: places of other sets that a
    scanned key meets on the mean.  A light set makes C(p + 1, 2) keys and meets
    spread**2 / p places a key, a heavy one makes p keys and meets spread.
    """
    def light(n):
        p = n - need(n, percent) + 1
        return (p + 1) * p / 2 * (1 + spread * spread / p)

    def heavy(n):
        return (n - need(n, percent) + 1) * (1 + spread)

    both = {n: (light(n), heavy(n)) for n in sizes if n <= most / percent * 100}
    cost = lambda x: sum(c * ((both[n][0] if n <= x else 0) + (both[n][1] if 100 * n > percent * x else 0)) for n, c in sizes.items() if n in both)
    return min(range(0, most + 1, 4), key=cost)


def keys_of(s: np.ndarray, w: np.ndarray, percent: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a set (sorted hashes s, their counts among the common w), and the most
    members it can share with a set whose first key in common this is."""
    n = len(s)
    p = n - need(n, percent) + 1
    p2 = min(n, p + 1)
    if w.any():
        order = np.lexsort((s, w))
        head = s[order[:p2]]
    else:
        head = s[:p2]
    keys, rest = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    if n <= limit:  # light: pairs; a set of one shingle links with equal sets only
        a, b = np.triu_indices(p2, 1)
        lo, hi = np.minimum(head[a], head[b]), np.maximum(head[a], head[b])
        keys.append(mix(lo * _SEEDS[4] + hi * _SEEDS[5] + U(2)))
        rest.append(n + 1 - b)
    if 100 * n > percent * limit:  # heavy, or of a size that a heavy one can link with
        keys.append(mix(head[:p] * _SEEDS[6] + U(1)))
        rest.append(n - np.arange(p))
    return np.concatenate(keys), np.concatenate(rest)


def _postings(batches, k: int, percent: int, limit: int, tables):
    (known, count), (frequent, weight) = tables.value

    def look(x, names, values):
        if not len(names):
            return np.zeros(len(x), values.dtype)
        at = np.searchsorted(names, x)
        at[at == len(names)] = 0
        return np.where(names[at] == x, values[at], 0)

    def posted():
        return pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(keys))), pa.array(np.concatenate(owner)), pa.array(np.concatenate(left).astype(np.int32))], ["key", "sid", "rest"])

    for b in batches:
        keys, owner, left, seen, rows = [], [], [], set(), 0
        for h, begin, s in chunks(_texts(b), k):
            total = np.concatenate([[0], np.cumsum(look(h, frequent, weight))])
            score = np.minimum(total[k : k + len(s)] - total[: len(s)], 255).astype(U)
            ranked = (score << U(56)) | (s >> U(8))  # a shingle's name and its place in the order
            held = look(s, known, count)
            for i, j in zip(begin[:-1], begin[1:]):
                if j == i:
                    continue
                if j - i >= k:
                    x, first = np.unique(ranked[i : j - k + 1], return_index=True)
                    w, one = held[i : j - k + 1][first], digest(np.unique(s[i : j - k + 1]), 0)
                else:
                    x = short_shingle(h[i:j])
                    w, one = np.zeros(1, np.int64), digest(x, 0)
                if one in seen:
                    continue
                seen.add(one)
                x, rest = keys_of(x, w, percent, limit)
                keys.append(x), owner.append(np.full(len(x), one, np.int64)), left.append(rest)
                rows += len(x)
                if rows >= 200_000:
                    yield posted()
                    keys, owner, left, rows = [], [], [], 0
        if keys:
            yield posted()


def _whole_sets(batches, k: int):
    for b in batches:
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            sets = [_signed(s) for s in shingle_sets(_texts(part), k)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(s.view(U), 0) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["rep", "n", "items"]
            )


def _near(batches, percent: int):
    """The pairs that the wide sketches leave open."""
    for b in batches:
        na, nb = b["a_n"].to_numpy(), b["b_n"].to_numpy()
        apart = np.fromiter((_apart(x.as_py(), y.as_py()) for x, y in zip(b["a_wide"], b["b_wide"])), np.int64, b.num_rows)
        ok = (100 + percent) * apart <= (100 - percent) * (na + nb)
        yield b.select(["a", "b"]).filter(pa.array(ok))


def _open(a: str, b: str, percent: int) -> Column:
    """False only where sizes or sketches prove that a and b don't link."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    apart = sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in SKETCHES), F.lit(0))
    # |A ^ B| = |A| + |B| - 2 |A & B|, and (100 + t) |A & B| >= t (|A| + |B|) where they link
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * apart <= (100 - percent) * (na + nb))


def _least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices of the edges a to b, for each the smallest vertex it is connected with)."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(names))
    while (up[x] != up[y]).any():
        low = np.minimum(up[x], up[y])
        np.minimum.at(up, up[x], low)
        np.minimum.at(up, up[y], low)
        while (up[up] != up).any():
            up = up[up]
    return names, names[up]


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(v, label): for each vertex of edges (a, b) the smallest vertex it is connected with.

    Each round hooks every vertex to its smallest neighbour, halves the paths
    twice, and contracts the edges.  Up to BROADCAST_IDS edges, all or what
    the rounds have left, are joined by the driver.
    """
    labels = None
    left = edges.select("a", "b")
    while True:
        e = written(spark, left.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", small=True)
        n = e.count()
        if not n and labels is not None:
            return labels
        last = n <= BROADCAST_IDS
        if last:
            found = e.toArrow()
            v, least = _least_reachable(found["a"].to_numpy(), found["b"].to_numpy())
            p = spark.createDataFrame(pa.table({"a": pa.array(v, pa.int64()), "up": pa.array(least, pa.int64())}))
        else:
            e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            p = written(spark, e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")), "hooks")
            for _ in range(2):
                p = written(spark, p.alias("x").join(p.alias("y"), F.col("x.up") == F.col("y.a")).select("x.a", F.col("y.up").alias("up")), "hooks")
        labels = (
            p.select(F.col("a").alias("v"), F.col("up").alias("label"))
            if labels is None
            else written(spark, labels.join(p, labels["label"] == p["a"], "left").select("v", F.coalesce("up", "label").alias("label")), "labels")
        )
        if last:
            return labels
        left = (
            e.join(p.withColumnRenamed("up", "pa"), "a")
            .join(p.select(F.col("a").alias("b"), F.col("up").alias("pb")), "b")
            .filter("pa < pb")
            .select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        )


def _verified(spark: SparkSession, pairs: DataFrame, info: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose whole sets link.  Only sets in a pair that the sketches leave open are made."""
    side = lambda t, name: t.select(*[F.col(c).alias(f"{name}_{c}") for c in t.columns])
    sketch = info.select("rep", "n", "wide", *SKETCHES)
    some = pairs.join(side(sketch, "a"), F.col("a") == F.col("a_rep")).join(side(sketch, "b"), F.col("b") == F.col("b_rep"))
    some = some.filter(_open("a_", "b_", percent)).select("a", "b", "a_n", "b_n", "a_wide", "b_wide")
    some = written(spark, some.mapInArrow(partial(_near, percent=percent), "a long, b long"), "pairs", small=True)
    if some.isEmpty():
        return some
    ends = some.select(F.col("a").alias("rep")).unionByName(some.select(F.col("b").alias("rep"))).distinct()
    ends = written(spark, ends.join(info.select("rep", "id"), "rep"), "wanted", small=True)
    ids, wanted = ends.select("id").distinct(), ends.count()
    if wanted <= BROADCAST_IDS:
        whole = docs.join(F.broadcast(ids), "id", "left_semi")
    else:
        whole = passing(spark, docs, ids, "id")
    sets = written(spark, whole.mapInArrow(partial(_whole_sets, k=k), "rep long, n long, items array<long>"), "sets", small=True)
    if sets.count() != wanted:  # several rows of one id
        sets = written(spark, sets.join(ends.select("rep"), "rep", "left_semi").dropDuplicates(["rep"]), "sets", small=True)
    full = some.join(side(sets, "a"), F.col("a") == F.col("a_rep")).join(side(sets, "b"), F.col("b") == F.col("b_rep"))
    full = full.withColumn("i", F.size(F.array_intersect("a_items", "b_items")))
    return full.filter(100 * F.col("i") >= percent * (F.col("a_n") + F.col("b_n") - F.col("i"))).select("a", "b")


def _link(spark: SparkSession, members: DataFrame, info: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(v, label) for every class in members (key, rep, n, rest)."""
    labels = written(spark, members.select(F.col("rep").alias("v"), F.col("rep").alias("label")).distinct(), "labels")

    def labelled(first: bool) -> DataFrame:
        if first:
            return members.withColumn("label", F.col("rep"))
        return written(spark, members.join(labels, F.col("rep") == F.col("v")).select("key", "rep", "n", "rest", "label"), "members")

    def merged(pairs: DataFrame) -> DataFrame:
        edges = _verified(spark, pairs, info, docs, k, percent)
        edges = edges.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        up = components(spark, edges).toDF("w", "up")
        return written(spark, labels.join(up, F.col("label") == F.col("w"), "left").select("v", F.coalesce("up", "label").alias("label")), "labels")

    near = (100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")) & ((100 + percent) * F.least("rest", "prest") >= percent * (F.col("n") + F.col("pn")))
    ordered = [F.least("rep", "prep").alias("a"), F.greatest("rep", "prep").alias("b")]
    done = 0
    for upto in PIVOTS:
        m = labelled(done == 0)
        chosen = [F.min(F.struct(F.xxhash64("rep", F.lit(j)).alias("h"), "rep", "n", "rest", "label")).alias(f"p{j}") for j in range(done, upto)]
        pivots = m.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), *chosen).filter("lo != hi")
        one = [F.struct(*[F.col(f"p{j}.{c}").alias(f"p{c}") for c in ("rep", "n", "rest", "label")]) for j in range(done, upto)]
        pivots = written(spark, pivots.select("key", F.inline(F.array_distinct(F.array(*one)))), "pivots", small=True)
        labels = merged(m.join(pivots, "key").filter((F.col("label") != F.col("plabel")) & near).select(*ordered).distinct())
        done = upto
    # What is left: pairs of different components, one of them not the key's largest.
    m = labelled(False)
    sizes = m.groupBy("key", "label").agg(F.count("*").alias("c"))
    top = written(spark, sizes.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.count("*").alias("c")).filter("c > 1").select("key", "top"), "tops")
    held = written(spark, m.join(top, "key").join(info.select(F.col("rep").alias("r"), *SKETCHES), F.col("rep") == F.col("r")).drop("r"), "open")
    x, out = held.alias("x"), held.filter("label != top").alias("u")
    rest = x.join(out, F.col("x.key") == F.col("u.key")).filter(
        (F.col("x.label") != F.col("u.label")) & ((F.col("x.label") == F.col("x.top")) | (F.col("x.rep") < F.col("u.rep")))
        & ((100 + percent) * F.least("x.rest", "u.rest") >= percent * (F.col("x.n") + F.col("u.n"))) & _open("x.", "u.", percent)
    )
    return merged(rest.select(F.least("x.rep", "u.rep").alias("a"), F.greatest("x.rep", "u.rep").alias("b")).distinct())


def _mark(text_col: str) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _classes(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """Per row: id (LOW for null), mark, n, label of the component (null without words), top (its smallest id)."""
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)).alias("id"), F.col(text_col).alias("text"))
    both = written(spark, d.withColumn("mark", _mark("text")).mapInArrow(partial(_profile, k=k, share=SHARE), PROFILE), "profile")
    rows = both.filter("kind = 0").drop("kind")
    sizes = {r["n"]: r["c"] for r in rows.groupBy("n").agg(F.count("*").alias("c")).collect()}  # one row a set size
    n_docs, places = sum(sizes.values()), sum(n * c for n, c in sizes.items())

    def heavy(kind: int, least: int, most: float):
        found = both.filter(F.col("kind") == kind).groupBy("sid").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).collect()
        if len(found) > most:  # what is sent to every executor is bounded by these counts
            raise ValueError("more heavy hitters than there can be")
        found = sorted((r["sid"] % (1 << 64), r["n"]) for r in found)
        return np.array([x for x, _ in found], U), np.array([c for _, c in found], np.int64)

    floor = max(3, math.floor(SHARE * n_docs))
    common = heavy(1, floor, places / floor + 1)
    n_words = both.filter("kind = 4").agg(F.sum("n")).first()[0] or 0
    least = max(2, math.floor(WORD_SHARE * n_words))
    names, counts = heavy(3, least, n_words / least)
    weight = (2 * np.log2(np.maximum(1, counts / max(1.0, WORD_SHARE * n_words)))).astype(np.int64) + 1
    met = both.filter("kind = 2").agg(F.sum(F.col("sid") * F.lit(n_docs) / F.col("id")).alias("m"), F.sum("n").alias("n")).first()
    limit = boundary(sizes, (met["m"] or 0) / max(1, met["n"] or 0), percent)
    sent = spark.sparkContext.broadcast((common, (names, weight)))

    classes = rows.filter("n > 0").groupBy("sid", "sid2", "n").agg(F.min("id").alias("id"), *[F.min(c).alias(c) for c in SKETCHES])
    classes = written(spark, classes, "classes")
    posted = written(spark, d.mapInArrow(partial(_postings, k=k, percent=percent, limit=limit, tables=sent), "key long, sid long, rest int"), "postings")
    shared = posted.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo != hi").select("key")
    places_of = passing(spark, posted, written(spark, shared, "keys", small=True), "key")
    places_of = written(spark, places_of.distinct(), "places")
    wide = rows.select("id", "sid", "sid2", "wide")
    info = places_of.select("sid").distinct().join(classes, "sid").join(wide, ["id", "sid", "sid2"])
    info = info.dropDuplicates(["sid"]).withColumn("rep", F.col("sid"))
    info = written(spark, info, "info")
    members = written(spark, places_of.join(info.select("sid", "rep", "n").distinct(), "sid").select("key", "rep", "n", "rest"), "members")
    labels = _link(spark, members, info, d, k, percent)

    ends = classes.join(labels, F.col("sid") == F.col("v"), "left").select("sid", "sid2", "n", "id", F.coalesce("label", "sid").alias("label"))
    ends = written(spark, ends, "ends")
    tops = ends.groupBy("label").agg(F.min("id").alias("top"), F.count("*").alias("c")).filter("c > 1").select("label", "top")
    tops = written(spark, tops, "firsts")
    side = F.broadcast(tops) if tops.count() <= BROADCAST_IDS else tops
    ends = ends.join(side, "label", "left").select("sid", "sid2", "n", "label", F.coalesce("top", "id").alias("top"))
    out = rows.select("id", "mark", "n", "sid", "sid2").join(ends, ["sid", "sid2", "n"], "left")
    return out.select("id", "mark", "n", "label", F.coalesce("top", "id").alias("top"))


def ngram_classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id that links lead to, itself included)."""
    out = _classes(spark, docs, id_col, text_col, k, percent)
    back = lambda c: F.nullif(F.col(c), F.lit(LOW))
    return out.select(back("id").alias(id_col), F.col("n").alias("n_shingles"), back("top").alias("component_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs with one document, that of the smallest id, of each component."""
    found = written(spark, _classes(spark, docs, id_col, text_col, k, percent), "near")
    again = written(spark, found.groupBy("id").count().filter("count > 1").select("id"), "again")
    gone = found.filter("id != top").select("id").distinct()
    if again.isEmpty():
        return without(docs, id_col, gone)
    # Rows that share their id: what stays is told by the text as well, one row a component; texts without words all stay.
    first = without(without(docs, id_col, again), id_col, gone)
    stay = found.filter("n > 0 and id = top").groupBy("label", "id").agg(F.min("mark").alias("mark")).select("id", "mark", F.lit(True))
    stay = stay.union(found.filter("n = 0").select("id", "mark", F.lit(False)).distinct()).toDF("sluice_id", "sluice_mark", "sluice_words")
    some = docs.select("*", F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)).alias("sluice_id"), _mark(text_col).alias("sluice_mark"))
    many = again.toDF("sluice_id")
    some = some.join(F.broadcast(many) if many.count() <= BROADCAST_IDS else many, "sluice_id", "left_semi").join(stay, ["sluice_id", "sluice_mark"])
    once = some.filter("sluice_words").dropDuplicates(["sluice_id", "sluice_mark"])
    return first.unionByName(once.unionByName(some.filter("not sluice_words")).select(docs.columns))
