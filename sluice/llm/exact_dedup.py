"""Exact dedup: a tree merge of sorted digest runs.

Each partition of the input makes sorted runs of its digests: one entry for a
digest with the count, the identifier that stays, and the text's length and a
second hash as proof.  The partitions then exchange runs in binomial rounds: in
round r, partition p keeps the entries whose digest agrees with bit r of p and
sends the others to partition p XOR 2**r.  What a partition holds after a round
is one run again, merged from all runs that reached it; when every bit has had
its round, each partition owns one share of the digests, each once.  With more
than 2**ROUNDS partitions a round settles several bits at once, with as many
more partners, so that no entry moves more than ROUNDS times.

Runs travel as blocks of BLOCK sorted entries.  A merge takes blocks in the
order of their first digests and holds, of each run, the part of one block that
may still meet later digests: it streams, and no entry is ever sorted again
after the first runs.  At every level entries of one digest must have one
length and one second hash, and the identifier that stays is kept.  A digest
held by a third of all rows is one entry a partition from the first level on.

Defined results.  Null text counts as empty.  A null id is smaller than any
other.  Of rows with the same id and text, exactly one stays.  An empty table
gives an empty result.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOW, lower_ascii, model, without, written

#: Digests that a first run is sorted from, and entries of a block.
RUN_ROWS, BLOCK = 1 << 18, 1 << 14
#: Bits of partitions that exchange runs at most; more input partitions make several first runs in one.
MOST_BITS, ROUNDS = 14, 5
ENTRY = np.dtype([("digest", "S32"), ("check", "i8"), ("bytes", "i8"), ("n", "i8"), ("keep", "i8"), ("keep_row", "i8")])
BLOCKS = "to int, first binary, entries binary"
GROUPS = "digest binary, n long, keep long, keep_row long"


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow row a document: id, row, sha-256 of the normalised text, its length and a second hash."""
    t = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    return (
        docs.select(F.col(id_col).cast("long").alias("id"), t.alias("t"))
        .select(
            "id",
            F.monotonically_increasing_id().alias("row"),
            F.unhex(F.sha2("t", 256)).alias("digest"),
            F.xxhash64("t").alias("check"),
            F.octet_length("t").cast("long").alias("bytes"),
        )
    )


def one_of_each(x: np.ndarray, smallest: bool) -> np.ndarray:
    """Sorted entries -> one entry for each digest; those of a digest must be of one text."""
    if len(x) < 2:
        return x
    new = np.ones(len(x), bool)
    new[1:] = x["digest"][1:] != x["digest"][:-1]
    start = np.flatnonzero(new)
    if len(start) == len(x):
        return x
    group = np.cumsum(new) - 1
    for c in ("check", "bytes"):
        if (x[c] != x[c][start][group]).any():
            raise ValueError("two texts have one SHA-256 digest")
    best, none = (np.minimum, np.iinfo(np.int64).max) if smallest else (np.maximum, np.iinfo(np.int64).min)
    out = x[start]
    out["n"] = np.add.reduceat(x["n"], start)
    out["keep"] = best.reduceat(x["keep"], start)
    out["keep_row"] = best.reduceat(np.where(x["keep"] == out["keep"][group], x["keep_row"], none), start)
    return out


def _two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two sorted arrays merged."""
    if not len(a) or not len(b):
        return a if len(a) else b
    out = np.empty(len(a) + len(b), ENTRY)
    place = np.arange(len(b)) + np.searchsorted(np.ascontiguousarray(a["digest"]), np.ascontiguousarray(b["digest"]), "right")
    rest = np.ones(len(out), bool)
    rest[place] = False
    out[place], out[rest] = b, a
    return out


def merged(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted arrays merged, two by two."""
    while len(parts) > 1:
        parts = [reduce(_two, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0] if parts else np.empty(0, ENTRY)


def merge_blocks(blocks, smallest: bool):
    """Blocks in the order of their first digests -> sorted arrays with each digest once."""
    held: list[np.ndarray] = []
    for block in blocks:
        at = [int(np.searchsorted(np.ascontiguousarray(h["digest"]), block["digest"][0])) for h in held]
        ready = merged([h[:k] for h, k in zip(held, at) if k])
        if len(ready):
            yield one_of_each(ready, smallest)
        held = [h[k:] for h, k in zip(held, at) if k < len(h)] + [block]
    if held:
        yield one_of_each(merged(held), smallest)


def owner(x: np.ndarray) -> np.ndarray:
    """The number in a digest's first bytes, whose bits say where the entry goes."""
    return np.ascontiguousarray(x["digest"]).view(">u4")[::8].astype(np.int64)


def _sent(arrays, here: int, bit: int, width: int):
    """Rows of BLOCKS for sorted arrays of partition ``here``: ``width`` bits of the digest's number from ``bit`` on choose the partner."""
    waiting: dict[int, list] = {}
    mask = (1 << width) - 1 << bit

    def row(to):
        x = np.concatenate(waiting.pop(to))
        return pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([x["digest"][0].ljust(32, b"\0")]), pa.array([x.tobytes()])], ["to", "first", "entries"])

    for x in arrays:
        to = owner(x) & mask | here & ~mask
        for t in np.unique(to).tolist():
            mine = x[to == t]
            for i in range(0, len(mine), BLOCK):
                waiting.setdefault(t, []).append(mine[i : i + BLOCK])
                if sum(map(len, waiting[t])) >= BLOCK:
                    yield row(t)
    for t in list(waiting):
        yield row(t)


def _first_runs(batches, bits: int, width: int, smallest: bool):
    """The partition's digests as sorted runs, sent for round 0."""
    model()  # this worker may hold another operator's caches
    here, parts, rows = TaskContext.get().partitionId() % (1 << bits), [], 0

    def run():
        x = np.concatenate(parts)
        return _sent([one_of_each(x[np.argsort(x["digest"], kind="stable")], smallest)], here, 0, width)

    for b in batches:
        if b.num_rows:
            x = np.empty(b.num_rows, ENTRY)
            x["digest"] = np.frombuffer(b"".join(b["digest"].to_pylist()), "S32")
            x["n"] = 1
            for c in ("check", "bytes", "keep", "keep_row"):
                x[c] = b[c].to_numpy()
            parts.append(x)
            rows += len(x)
        if rows >= RUN_ROWS:
            yield from run()
            parts, rows = [], 0
    if parts:
        yield from run()


def _arrived(batches, at: set):
    """The blocks that reached one partition; its number goes into ``at``."""
    for b in batches:
        at.update(b["to"].to_pylist())
        if len(at) > 1:
            raise ValueError("runs of several partitions in one task")
        for x in b["entries"]:
            yield np.frombuffer(x.as_py(), ENTRY)


def _round(batches, bit: int, width: int, smallest: bool):
    """What reached this partition, merged and sent on by the next bits."""
    model()
    at: set = set()
    arrays = merge_blocks(_arrived(batches, at), smallest)
    first = next(arrays, None)
    if first is not None:
        yield from _sent(chain([first], arrays), *at, bit, width)


def _groups(batches, smallest: bool):
    model()
    for x in merge_blocks(_arrived(batches, set()), smallest):
        flat = np.ascontiguousarray(x["digest"]).view("u1").tobytes()
        digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(x), [None, pa.py_buffer(flat)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([digest, *[pa.array(np.ascontiguousarray(x[c])) for c in ("n", "keep", "keep_row")]], ["digest", "n", "keep", "keep_row"])


def rounds_for(parts: int) -> tuple[int, int]:
    """(bits, width): 2**bits partitions for so many of the input, and the bits that a round settles."""
    bits = max(1, min(MOST_BITS, (parts - 1).bit_length()))
    return bits, -(-bits // ROUNDS)


def merge_runs(spark: SparkSession, entries: DataFrame, smallest: bool = False, bits: int = 0, width: int = 0) -> DataFrame:
    """GROUPS: one row for each digest of entries (digest, check, bytes, keep, keep_row).  bits, width: by the partitions, if not given."""
    if not bits:
        bits, width = rounds_for(entries.rdd.getNumPartitions())
    step = lambda f, r: partial(f, width=min(width, bits - r), smallest=smallest)
    out = entries.select("digest", "check", "bytes", "keep", "keep_row").mapInArrow(partial(step(_first_runs, 0), bits=bits), BLOCKS)
    for r in range(width, bits + width, width):
        # the partition's number is the run's: each task gets what was sent to its own run, heads of blocks in order
        out = out.repartitionById(1 << bits, "to").sortWithinPartitions("first")
        out = out.mapInArrow(partial(step(_round, r), bit=r), BLOCKS) if r < bits else out.mapInArrow(partial(_groups, smallest=smallest), GROUPS)
    return out


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256.  ``keep``: max or min id stays.

    Groups that hold at least a 1024th of the rows are at most 1024: they are
    joined by broadcast, so no task gets all copies of a hot text; the others
    are joined by their digest.
    """
    low = LOW
    rows = written(spark, digests(docs, id_col, text_col), "digests")
    entries = rows.select(
        "digest", "check", "bytes", F.coalesce("id", F.lit(low)).alias("keep"), F.col("row").alias("keep_row")
    )
    groups = written(spark, merge_runs(spark, entries, keep == "min"), "groups")
    total = rows.count()
    hot = F.col("n") * 1024 >= F.lit(total)
    big = F.broadcast(groups.filter(hot).select("digest", F.struct("n", "keep", "keep_row").alias("g")))
    first = rows.join(big, "digest", "left")
    rest = first.filter("g is null").drop("g").join(
        groups.filter(~hot).select("digest", F.struct("n", "keep", "keep_row").alias("g")), "digest"
    )
    every = first.filter("g is not null").unionByName(rest)
    return every.select(
        F.col("id").alias(id_col),
        F.nullif(F.col("g.keep"), F.lit(low)).alias("keep_id"),
        F.col("g.n").alias("group_size"),
        (F.col("row") == F.col("g.keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of docs that stay."""
    found = written(spark, exact_dedup(spark, docs, id_col, text_col, keep), "copies")
    again = written(spark, found.groupBy(id_col).count().filter("count > 1").select(id_col), "again")
    gone = found.filter("not kept").select(id_col)
    if again.isEmpty():
        return without(docs, id_col, gone)
    # Rows that share their id: what stays is told by the text as well, and of equal rows one is left.
    many = again.withColumn("many", F.lit(True)).withColumnRenamed(id_col, "again")
    digest = F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256)
    first = without(without(docs, id_col, again), id_col, gone)
    some = docs.join(many, docs[id_col].eqNullSafe(many["again"])).select(*[docs[c] for c in docs.columns], digest.alias("sluice_digest"))
    stay = found.filter("kept").select(F.col(id_col).alias("stay"), F.col("text_sha256").alias("sha"))
    some = some.join(stay, some[id_col].eqNullSafe(stay["stay"]) & (some["sluice_digest"] == stay["sha"]), "left_semi")
    return first.unionByName(some.dropDuplicates([id_col, "sluice_digest"]).drop("sluice_digest"))
