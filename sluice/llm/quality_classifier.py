"""Quality classifier: random-indexing word vectors, pooled, and a small calibrated network.

Words are named twice: by their lower-cased bytes and by their shape (runs of
upper and lower case, digits and other bytes), each hashed to a bounded
vocabulary.  Every name has a sparse random index vector; its word vector is
the sum of the index vectors of the names around it in the sample, scaled by
how often it occurs.  A document is the mean and the spread of the vectors of
all its words, with its share of frequent shapes; a two-layer network learns
the label from that, and a temperature fitted on rows kept aside calibrates its
probabilities.

The sample holds at most TRAIN_ROWS labelled ids of the learning fold and 2 *
TRAIN_ROWS different texts of them; its word vectors are summed by PARTS tasks
and the driver gets these sums and, of each text, its features.
Defined results: a text without words scores as the zero vector; without two
kinds of labels the score is the label's mean (0.5 without any).  A document
with labels of both kinds is learned as each.  Null ids are passed through,
repeated rows scored alike, empty tables give empty results.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learned_fold, written
from .language_id import sample_under
from .shingles import _LOWER, U, buffers, span_hashes, word_spans

TRAIN_ROWS = 4000
WORDS, SHAPES = 4096, 1024
DIM, NONZERO = 48, 4
HIDDEN, EPOCHS, RATE = 24, 60, 0.01
WINDOW = 2
THRESHOLD = 0.7
#: Texts whose counts are made at once, tasks that sum up word vectors.
ROWS, PARTS = 256, 8
#: Byte classes of shapes: lower case and bytes of other alphabets 1, upper case 2, digits 3, others themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 1


def names(texts: pa.Array):
    """Chunk by chunk: (word names, shape names, text of each word, texts)."""
    for part in range(0, len(texts), ROWS):
        for i, j, data, off in buffers(texts.slice(part, ROWS)):
            starts, ends, owner, solid = word_spans(data, off)
            word = span_hashes(_LOWER[data[solid]], ends - starts) % U(WORDS)
            kind = _CLASS[data]
            new = solid.copy()
            new[1:] &= kind[1:] != kind[:-1]
            new[starts] = True
            runs = np.diff(np.append(np.cumsum(new)[starts] - 1, new.sum())) if len(starts) else np.zeros(0, np.int64)
            shape = span_hashes(kind[new], runs) % U(SHAPES)
            yield word.astype(np.int64), WORDS + shape.astype(np.int64), owner, j - i


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(17)
    out = np.zeros((WORDS + SHAPES, DIM), np.float32)
    for k in range(NONZERO):
        out[np.arange(len(out)), rng.integers(0, DIM, len(out))] += 1 - 2 * rng.integers(0, 2, len(out))
    return out


def around(word: np.ndarray, shape: np.ndarray, owner: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the index vectors around each name, how often each occurs) in texts that follow each other."""
    n, size = len(index), len(word)
    out, seen = np.zeros((n, DIM)), (np.bincount(word, minlength=n) + np.bincount(shape, minlength=n)).astype(float)
    if not size:
        return out, seen
    at = np.arange(size)
    first = np.searchsorted(owner, owner, "left")
    low, high = np.maximum(at - WINDOW, first), np.minimum(at + WINDOW + 1, np.searchsorted(owner, owner, "right"))
    for d in range(DIM):
        near = index[word, d] + index[shape, d]
        total = np.concatenate([[0], np.cumsum(near)])
        beside = total[high] - total[low]
        out[:, d] = np.bincount(word, beside - index[word, d], n) + np.bincount(shape, beside - index[shape, d], n)
    return out, seen


def word_vectors(sums: np.ndarray, seen: np.ndarray) -> np.ndarray:
    return (sums / np.maximum(1, seen)[:, None] + index_vectors()).astype(np.float32)


def counts_of(word: np.ndarray, shape: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts of the names of each text, words equal to the one before)."""
    n = WORDS + SHAPES
    counts = np.bincount(np.concatenate([owner, owner]) * n + np.concatenate([word, shape]), minlength=texts * n)
    again = np.zeros(texts)
    if len(word) > 1:
        again = np.bincount(owner[1:], (word[1:] == word[:-1]) & (owner[1:] == owner[:-1]), texts)
    return counts.reshape(texts, n).astype(np.float32), again


def pooled(counts: np.ndarray, again: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    size = np.maximum(1, counts[:, :WORDS].sum(axis=1, keepdims=True))
    share = counts / size
    mean = share @ vectors
    spread = np.sqrt(np.maximum(0, share @ vectors**2 - mean**2))
    top = np.sort(share[:, :WORDS], axis=1)[:, -3:] if len(counts) else share[:, :3]
    some = np.column_stack([again / size[:, 0], np.log1p(size) / 10, (counts[:, :WORDS] > 0).sum(axis=1, keepdims=True) / size, top])
    return np.hstack([mean, spread, share[:, WORDS : WORDS + SHAPES] @ _FOLD, some]).astype(np.float32)


def pool(word, shape, owner, texts: int, vectors: np.ndarray) -> np.ndarray:
    return pooled(*counts_of(word, shape, owner, texts), vectors)


#: Shapes folded to 64 places.
_FOLD = np.zeros((SHAPES, 64), np.float32)
_FOLD[np.arange(SHAPES), np.arange(SHAPES) % 64] = 1


class Network:
    """Two layers, trained by Adam on log-loss with weights that balance the labels; a temperature scales its logits."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Network":
        rng = np.random.default_rng(23)
        self.mid, self.dev = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = np.clip((x - self.mid) / self.dev, -8, 8)
        aside = rng.random(len(x)) < 0.2
        if min(y[aside].std(), y[~aside].std()) == 0 if aside.any() and not aside.all() else True:
            aside[:] = False
        tx, ty = x[~aside], y[~aside]
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, (HIDDEN, 1)), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(tx))
            for i in range(0, len(order), 64):
                at = order[i : i + 64]
                h = np.tanh(tx[at] @ p[0] + p[1])
                out = 1 / (1 + np.exp(-(h @ p[2] + p[3])[:, 0]))
                g = ((out - ty[at]) / len(at))[:, None]
                back = (g @ p[2].T) * (1 - h * h)
                grads = [tx[at].T @ back + 1e-3 * p[0], back.sum(0), h.T @ g + 1e-3 * p[2], g.sum(0)]
                t += 1
                for k, d in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        cx, cy = (x[aside], y[aside]) if aside.any() else (x, y)
        z = self._logits(cx)
        cy = np.where(cy > 0, (cy.sum() + 1) / (cy.sum() + 2), 1 / (len(cy) - cy.sum() + 2))  # as many more of each kind would not all agree

        def loss(temp):
            q = np.clip(1 / (1 + np.exp(-z / temp)), 1e-9, 1 - 1e-9)
            return -(cy * np.log(q) + (1 - cy) * np.log(1 - q)).mean()

        self.temperature = min(np.geomspace(0.25, 64, 61), key=loss)
        return self

    def _logits(self, x):
        return (np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3])[:, 0]

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mid) / self.dev, -8, 8)
        return 1 / (1 + np.exp(-self._logits(x) / self.temperature))


def _summed(batches):
    """One row: the sums around all names of this task's texts, and how often each occurs."""
    index, sums, seen = index_vectors(), np.zeros((WORDS + SHAPES, DIM)), np.zeros(WORDS + SHAPES)
    for b in batches:
        for word, shape, owner, _ in names(b["text"]):
            more, often = around(word, shape, owner, index)
            sums += more
            seen += often
    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([sums.ravel(), seen]).tobytes()], pa.binary())], ["sums"])


def _pooled(batches, sent):
    """A row a text: label and features."""
    for b in batches:
        x = [pool(*chunk, sent.value) for chunk in names(b["text"])]
        yield pa.RecordBatch.from_arrays([b["y"], pa.array([row.tobytes() for part in x for row in part], pa.binary())], ["y", "x"])


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(y, text): the different texts of at most ``rows`` labelled ids, at most 2 * rows of them, in PARTS partitions."""
    spark = docs.sparkSession
    marks = labels.filter(F.col(label_col).isin(0, 1) & learned_fold(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    marks = sample_under(marks, rows, "id").distinct()  # a few thousand rows by construction
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    got = written(spark, text.join(F.broadcast(marks), "id").select("y", "text", F.xxhash64("text", "y").alias("h")), "sample")
    # repeated ids may bring more texts than ids: a hash says which are left out
    few = sample_under(got.select("h"), 2 * rows, "h", once=True).distinct()
    return got.dropDuplicates(["h"]).join(F.broadcast(few), "h", "left_semi").repartition(PARTS, "h").sortWithinPartitions("h").select("y", "text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = TRAIN_ROWS):
    """(network or mean label, word vectors)."""
    few = written(docs.sparkSession, sample(docs, labels, id_col, text_col, label_col, rows), "few")
    # a few MB for each of PARTS tasks and some hundred bytes a text come to the driver
    parts = [np.frombuffer(r, np.float64) for r in sorted(bytes(r["sums"]) for r in few.select("text").repartition(PARTS).mapInArrow(_summed, "sums binary").collect())]
    whole = sum(parts, np.zeros((WORDS + SHAPES) * (DIM + 1)))
    vectors = word_vectors(whole[: -(WORDS + SHAPES)].reshape(-1, DIM), whole[-(WORDS + SHAPES) :])
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    got = sorted((r["y"], bytes(r["x"])) for r in few.mapInArrow(partial(_pooled, sent=sent), "y int, x binary").collect())
    y = np.array([g[0] for g in got], float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5, vectors
    return Network().fit(np.stack([np.frombuffer(g[1], np.float32) for g in got]), y), vectors


def _score(batches, sent):
    net, vectors = sent.value
    for b in batches:
        if isinstance(net, float):
            p = np.full(b.num_rows, net)
        else:
            p = np.concatenate([net.predict(pool(*chunk, vectors)) for chunk in names(b["text"])] or [np.zeros(0)])
        yield pa.RecordBatch.from_arrays([b["id"], b["held_out"], pa.array(p, pa.float64())], ["id", "held_out", "score"])


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (~learned_fold(F.col(id_col))).alias("held_out"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.select("id", "held_out", "text").mapInArrow(partial(_score, sent=sent), f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
