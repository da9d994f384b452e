"""Language ID by string kernels.

A text's features are the square roots of the counts of its blended spectrum of
byte n-grams (n of 1 to 4, hashed to BUCKETS places); the kernel of two texts is
their cosine, the Bhattacharyya coefficient of their n-grams' shares, which
settles as a text grows.  Landmarks drawn from the training sample give the
Nystroem map, one-versus-rest kernel ridge regression is solved in it, and a
batch of texts is scored by two matrix products.

The sample holds at most TRAIN_ROWS documents of the learning fold, those with
the smallest hashes of their ids.  Defined results: a null text or one without
a letter is ``und`` with score 1, as is every text if nothing could be learned
(score 0).  Ties go to the language that sorts first.  Null ids are passed
through, repeated rows scored alike, empty tables give empty results.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learned_fold
from .shingles import U, buffers, mix

TRAIN_ROWS = 3000
LANDMARKS = 128
BUCKETS = 4096
#: Texts whose counts are made at once.
ROWS = 512
GRAMS = (1, 2, 3, 4)
RIDGE = 1e-3
_SEED = np.random.default_rng(11).integers(1, 1 << 63, 8, dtype=U) * U(2) + U(1)
_LETTER = regex.compile(r"\p{L}")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def spectra(texts: pa.Array):
    """Chunk by chunk: rows of counts over BUCKETS."""
    for at in range(0, len(texts), ROWS):
        for i, j, data, off in buffers(texts.slice(at, ROWS)):
            b = _LOWER[data].astype(U)
            owner = np.repeat(np.arange(j - i), np.diff(off))
            count = np.zeros((j - i) * BUCKETS, np.int64)
            h = np.zeros(len(b), U)
            for n in range(1, max(GRAMS) + 1):
                h = h[: len(b) - n + 1] + (b[n - 1 :] + U(1)) * _SEED[n]
                if n in GRAMS:
                    m = len(h)
                    inside = owner[:m] == owner[n - 1 :]
                    place = ((h ^ _SEED[0]) * _SEED[7] >> U(52)).astype(np.int64)
                    count += np.bincount((owner[:m] * BUCKETS + place)[inside], minlength=len(count))
            yield count.reshape(j - i, BUCKETS)


def _unit(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True))).astype(np.float32)


def _packed(batches):
    for b in batches:
        rows = [np.concatenate([at := np.flatnonzero(x), x[at]]).astype(np.uint32).tobytes() for m in spectra(b["text"]) for x in m]
        yield pa.RecordBatch.from_arrays([b["lang"], pa.array(rows, pa.binary())], ["lang", "grams"])


def _unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), BUCKETS), np.float32)
    for x, row in zip(out, rows):
        at, count = np.frombuffer(row, np.uint32).reshape(2, -1)
        x[at] = _unit(count[None, :].astype(np.int64))[0]
    return out


def sample_under(docs: DataFrame, rows: int, id_col: str, once: bool = False) -> DataFrame:
    """The rows whose id's hash is among the ``rows`` smallest; only hashes are sorted.  once: a repeated id counts once."""
    h = F.xxhash64(F.col(id_col))
    hashes = docs.select(h.alias("h"))
    last = (hashes.distinct() if once else hashes).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return docs.filter(h <= F.lit(last)) if last is not None else docs.limit(0)


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = TRAIN_ROWS):
    """(languages, landmarks, weights) from the learning fold."""
    known = docs.filter(learned_fold(F.col(id_col))).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    known = sample_under(known.filter("text is not null and lang is not null"), rows, "id", once=True)
    # repeated ids may bring more rows than ids: a hash, not the language, says which are left out
    got = known.select("lang", "text").mapInArrow(_packed, "lang string, grams binary").distinct().orderBy(F.xxhash64("lang", "grams"), "lang", "grams").limit(4 * rows).collect()
    if not got:
        return [], None, None
    x = _unpacked([bytes(r["grams"]) for r in got])
    langs = sorted({r["lang"] for r in got})
    y = np.array([[1.0 if r["lang"] == v else -1.0 for v in langs] for r in got])
    pick = np.random.default_rng(3).permutation(len(x))[:LANDMARKS]
    marks = x[np.sort(pick)]
    val, vec = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = val > 1e-6
    root = vec[:, keep] / np.sqrt(val[keep])
    z = (x @ marks.T) @ root
    weights = np.linalg.solve(z.T @ z + RIDGE * len(x) * np.eye(z.shape[1]), z.T @ y)
    return langs, marks.T.copy(), (root @ weights).astype(np.float32)


def _score(batches, sent):
    langs, marks, weights = sent.value
    for b in batches:
        for i in range(0, b.num_rows, 1024):
            part = b.slice(i, 1024)
            texts = part["text"]
            letter = np.array([t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)
            if not langs:
                pred, score = ["und"] * part.num_rows, (~letter).astype(float)
            else:
                s = np.vstack([_unit(x) @ marks @ weights for x in spectra(texts.fill_null(""))])
                best = s.argmax(axis=1)
                e = np.exp(4 * (s - s.max(axis=1, keepdims=True)))
                pred = [langs[k] if ok else "und" for k, ok in zip(best, letter)]
                score = np.where(letter, 1 / e.sum(axis=1), 1.0)
            yield pa.RecordBatch.from_arrays([part["id"], part["held_out"], pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["id", "held_out", "lang_pred", "score"])


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (~learned_fold(F.col(id_col))).alias("held_out"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.select("id", "held_out", "text").mapInArrow(partial(_score, sent=sent), f"id {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
