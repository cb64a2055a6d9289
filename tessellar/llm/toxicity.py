"""Toxicity: logistic regression fitted by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text: the different words, word bigrams and pairs of words one apart (skip-grams) of its lower-cased
words (letter and digit runs), hashed into ``2**BITS`` coordinates; a text without words has none. FTRL-proximal
(McMahan et al., 2013) keeps per-coordinate learning rates and sets weak weights to exactly zero (L1), so that what is
left is a short list of (coordinate, weight) that is broadcast to score the table.

The fit reads at most ``FIT_ROWS`` labelled texts, those with the smallest hash of doc_id, and of them in that order as many as have
``FIT_COORDINATES`` coordinates together (documented bounds on a sample of the labelled rows, never of the rows that are scored), each
of them whole: workers hash it to at most ``2**BITS`` coordinates.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, table, text_or_empty, tune, written

BITS = 20
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 6.0, 1.0, 4
FIT_ROWS, FIT_COORDINATES = 10_000, 32_000_000
_WORD = re.compile(r"[^\W_]+")
_MEMO_CHARS = 60_000_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Hasher:
    """Texts to sorted arrays of different coordinates."""

    def __init__(self, bits: int = BITS):
        self.shift, self.memo, self.held = np.uint64(64 - bits), {}, 0

    def __call__(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        if not words:
            return np.zeros(0, np.uint32)
        if self.held > _MEMO_CHARS:
            self.memo, self.held = {}, 0
        memo = self.memo
        for w in set(words):
            if w not in memo:
                self.held += len(w) + 100
                memo[w] = zlib.crc32(w.encode()) << 32 | zlib.crc32(w.encode()[::-1], 0x5BD1E995)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        grams = [h * _M1, (h[:-1] * _M1 + h[1:]) * _M2, (h[:-2] * _M2 + h[2:]) * _M3]
        return np.unique((np.concatenate([(g ^ (g >> np.uint64(29))) * _M1 for g in grams]) >> self.shift).astype(np.uint32))


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2, epochs=EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, their weights, bias) by FTRL-proximal over the rows in the given order, ``epochs`` times."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = np.array([1 << bits])
    rows = [np.concatenate([r, bias]).astype(np.int64) for r in rows]
    penalty = np.full((1 << bits) + 1, l1)
    penalty[-1] = 0

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= penalty[at], 0.0, -(zi - np.sign(zi) * penalty[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = rows[i]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[i]
            n_at = n[at]
            z[at] += g - (np.sqrt(n_at + g * g) - np.sqrt(n_at)) / alpha * w
            n[at] = n_at + g * g
    w = weights(np.arange(len(z)))
    at = np.flatnonzero(w[:-1])
    return at.astype(np.uint32), w[at], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, hold_out: int | None = 5, fit_rows: int = FIT_ROWS):
    """The model (coordinates, weights, bias) from ``labels`` (doc_id, toxic) on ``docs`` (doc_id, text).

    Rows whose crc32 of doc_id as text leaves no remainder modulo ``hold_out`` are never learned from. Null ids, null
    labels and labels other than 0 and 1 are left out; a doc_id with several labels takes the largest one; a repeated
    doc_id counts once. Without any label the model has no weight and scores 0.5.
    """
    spark = docs.sparkSession
    tune(spark)
    known = labels.filter("doc_id is not null and toxic in (0, 1)")
    if hold_out:
        known = known.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(hold_out)) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    hasher_bits = BITS

    def run(batches):
        hasher = Hasher(hasher_bits)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([hasher(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())], ["doc_id", "toxic", "at"])

    # at most fit_rows ids: a broadcast of proven size
    sample = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    hashed = sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text")).mapInArrow(run, "doc_id bigint, toxic int, at binary")
    hashed = written(hashed, "features")
    sizes = hashed.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.octet_length("at").alias("n")).orderBy("h", "doc_id").toPandas()  # at most fit_rows
    fits = sizes[sizes["n"].cumsum() <= 4 * FIT_COORDINATES]
    got = hashed.filter(F.xxhash64("doc_id") <= int(fits["h"].max())).toPandas() if len(fits) else hashed.limit(0).toPandas()
    drop(hashed)
    got = got.sort_values("doc_id")
    return fit([np.frombuffer(x, np.uint32) for x in got["at"]], got["toxic"].to_numpy(np.float64))


def score(docs: DataFrame, model, to: str = "score") -> DataFrame:
    """``docs`` with the column ``to``: the probability of label 1, for whole texts, however long; a null or empty text has the bias alone.
    All rows and other columns stay, repeated ones too; an empty table gives an empty one.

    The model travels inside the function: at most ``2**BITS`` weights, in practice some thousands."""
    tune(docs.sparkSession)
    at, weight, bias = model
    bits = BITS

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher, dense = Hasher(bits), np.zeros(1 << bits)  # once a task
        dense[at] = weight
        for texts in batches:
            yield pd.Series([1 / (1 + np.exp(-np.clip(bias + dense[hasher(t)].sum(), -30, 30))) for t in texts], dtype="float64")

    return docs.withColumn(to, probability(text_or_empty()))


def op3_ftrl_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text of ``documents``; rows that are held out are never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
