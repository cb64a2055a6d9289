"""Quality rules: base rules over exact document statistics, and gradient-boosted trees for what passes them.

``statistics`` reads whole texts once and gives a row of counts a document; ``train`` fits the trees on the counts of labelled documents (at
most ``FIT_ROWS`` of them, those with the smallest hash of doc_id: a documented bound on the sample, never on what is judged); ``judged`` adds
the verdict. The score can only fall as a document has more symbols, repeated lines, repeated or stuttered words, capitals or exclamation marks
(see ``SIGNS``). The trees travel as flat numpy arrays inside the function, some tens of KB.

Words are ``[^\\x20\\x09-\\x0D]+``, as they stand (case counts). A null text counts as one without words; it, empty texts and texts of fewer
than ten words fail the base rules. Repeated rows are judged alike. Null ids are judged but never learned from; labels other than 0 and 1 are
ignored, a doc_id with several labels takes the smallest, and a repeated doc_id counts once in the fit. Without labels, or with one kind only, the
base rules alone decide, unless all labels are 0: then nothing is kept. An empty table gives an empty one; columns other than doc_id, text and quality
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .hashing import Words
from .shared import table, text_or_empty, tune, written

FIT_ROWS = 20_000
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter", "n_capitals", "n_exclaim", "n_digits", "n_different")
#: Feature -> direction in which the score may move as it grows (0: either).
SIGNS = {"words": 0, "word length": 0, "symbols": -1, "repeated lines": -1, "repeated words": -1, "stutter": -1, "capitals": -1, "exclamations": -1, "digits": 0, "different words": 0, "lines": 0}
_BLANK = b" \t\n\v\f\r"


def _among(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_SYMBOL, _EXCLAIM, _DIGIT, _CAPITAL = _among(b"#*$%&|<>"), _among(b"!?"), _among(b"0123456789"), _among(bytes(range(65, 91)))
_IN_WORD = ~_among(_BLANK)
_IN_WORD[0x80:0xC0] = False  # the first byte of each code point counts


def _repeated(grams: np.ndarray, n: int) -> int:
    """Of ``n`` words, those inside a window (one hash of ``grams`` each) that is there twice or more."""
    _, at, times = np.unique(grams, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[at] > 1)
    if not len(twice):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return int((edge.cumsum() > 0).sum())


def counted(column: pa.Array) -> np.ndarray:
    """The ``COUNTS`` of each text of an Arrow string column, a row of integers each."""
    words = Words(column, fold=False)
    grams, data = words.grams(WINDOW), words.data
    capital = _CAPITAL[data]
    if len(data) > 1:  # accented capitals of Latin-1: C3 80 to C3 9E, but the multiplication sign
        capital[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    kinds = (_IN_WORD[data], _SYMBOL[data], capital, _EXCLAIM[data], _DIGIT[data])
    out = np.zeros((len(column), len(COUNTS)), np.int64)
    for i in range(len(column)):
        b, e = words.offsets[i], words.offsets[i + 1]
        first, last = words.first[i], words.first[i + 1]
        n = last - first
        if not n:
            continue
        chars, symbols, capitals, exclaim, digits = (np.count_nonzero(k[b:e]) for k in kinds)
        lines = [x for x in data[b:e].tobytes().split(b"\n") if x.strip(_BLANK)]
        own = words.hash[first:last]
        repeated = _repeated(grams[first : last - WINDOW + 1], n) if n >= WINDOW else 0
        stutter = np.count_nonzero(own[1:] == own[:-1])
        out[i] = n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), stutter, capitals, exclaim, digits, len(np.unique(own))
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """Columns as in ``SIGNS``, from rows of ``COUNTS``."""
    n, chars, symbols, dup, repeated, lines, stutter, capitals, exclaim, digits, different = counts.T.astype(np.float64)
    n, chars, lines = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    return np.stack([np.log(n), chars / n, symbols / chars, dup / lines, repeated / n, stutter / n, capitals / chars, exclaim / n, digits / chars, different / n, lines / n], axis=1)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the ``COUNTS`` of every document of ``docs`` (doc_id, text)."""
    tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            counts = counted(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in counts.T)], ["doc_id", *COUNTS])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, ", ".join(["doc_id bigint", *(f"{c} bigint" for c in COUNTS)]))


def train(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> boosting.Forest:
    """The trees fitted on ``stats`` (of :func:`statistics`) and ``labels`` (doc_id, quality)."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # at most fit_rows ids: a broadcast of proven size, and as many rows for the driver
    rows = stats.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("s"), F.first("quality").alias("quality"))
    got = rows.select("doc_id", "s.*", "quality").toPandas().sort_values("doc_id")
    return boosting.fit(features(got[list(COUNTS)].to_numpy(np.int64)), got["quality"].to_numpy(np.float64), list(SIGNS.values()))


def judged(stats: DataFrame, model: boosting.Forest) -> DataFrame:
    """``stats`` with base_failed, score (null where the base rules failed) and kept (score of 0.5 or more)."""

    def run(batches):
        for b in batches:
            at = {c: b.column(i).to_numpy() for i, c in enumerate(b.schema.names) if c in COUNTS}
            failed = (at["n_words"] < LEAST_WORDS) | (100 * at["n_repeat_words"] > MOST_REPEATED * at["n_words"])
            score = model.score(features(np.stack([at[c] for c in COUNTS], axis=1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(failed), pa.array(score, mask=failed), pa.array(~failed & (score >= 0.5))], [*b.schema.names, "base_failed", "score", "kept"])

    kept = [f.name for f in stats.schema]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema), "base_failed boolean", "score double", "kept boolean"])
    return stats.select(kept).mapInArrow(run, schema)


def op11_boosted_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, the counts of the base rules, base_failed and kept of every document; further counts and the score follow.

    Texts are read once: their counts are written to the shared folder, and the fit and the verdicts read those."""
    stats = written(statistics(table(spark, sf_dir, "documents")), "counts")
    model = train(stats, table(spark, sf_dir, "labels"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    out = judged(stats, model)
    return out.select(*first, *[c for c in out.columns if c not in first])
