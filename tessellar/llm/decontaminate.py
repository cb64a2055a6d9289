"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. An item's *seeds* are its rare word 3-grams: those that at most ``RARE`` different items hold, and in any case the ``LEAST`` rarest of
   each item. Rarity is counted over items, not over documents: what an edited copy keeps is in all exact copies too, so that copies would
   make just the grams that find it common. Equal items count as one.
2. Seeds go into a Bloom filter of bounded size. One pass over the whole texts keeps, around every run of 3-grams that pass it, a
   *passage* (the run and a margin as long as the longest item) with its 3-grams. These are joined to the seeds on the gram's hash, which pairs a gram
   with ``RARE`` items or few more, and shared seeds are counted for each passage and item before any words move.
3. Passages and items that share ``SHARED`` seeds (one, where an item has fewer than ``FEW``), and have so many words in common that the
   threshold can be reached, are aligned word by word (Smith-Waterman: match 2, mismatch -1, gap -1). The score is the
   best local alignment's over that of the whole item against itself; from ``THRESHOLD`` on the pair is reported,
   with the words of the document that the alignment covers.

Words are runs of letters, digits and non-ASCII characters, in lower case. An item shorter than three words is one gram, of all its words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hashing import MARKS, Words
from .shared import bit_array, drop, n_parts, table, tune, written

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
#: A changed word takes three grams with it. An item of n words, all of whose grams are rare, still shares two with a copy that has (n - 4) / 3 words changed, each in the
#: worst place; the threshold is reached with n / 3 changed at most.
RARE, LEAST, SHARED, FEW = 3, 8, 2, 6
#: Seeds that are broadcast at most (about 12 MB); beyond, both sides are dealt by gram and salt.
FEW_SEEDS, SALTS = 500_000, 16


def item_grams(items: DataFrame, gram: int = GRAM) -> DataFrame:
    """item_id, words (array of word hashes), n_words, grams (array of different gram hashes); items without words go."""

    def run(batches):
        for b in batches:
            w = Words(b.column(1), MARKS, latin=True)
            g, ids, words, grams = w.grams(gram), [], [], []
            for i, (a, e) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                if e > a:
                    ids.append(b.column(0)[i].as_py())
                    words.append(w.hash[a:e].view(np.int64))
                    grams.append(np.unique(g[a : e - gram + 1] if e - a >= gram else _short(w.hash[a:e])).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array([len(x) for x in words], pa.int64()), pa.array(grams, pa.list_(pa.int64()))], ["item_id", "words", "n_words", "grams"])

    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return rows.mapInArrow(run, "item_id bigint, words array<bigint>, n_words bigint, grams array<bigint>")


def _short(h: np.ndarray) -> np.ndarray:
    """The gram of an item of one or two words: unlike that of three."""
    return np.array([h[0] * np.uint64(3) + (h[1] if len(h) > 1 else np.uint64(1))], np.uint64)


def seeds_of(known: DataFrame, rare: int = RARE, least: int = LEAST) -> DataFrame:
    """t, g, need: the seeds of each different item (``t``: the hash of its words), and how many of them a passage must share."""
    every = known.select("t", "words", "grams").dropDuplicates(["t"]).select("t", F.explode("grams").alias("g"))
    holders = every.groupBy("g").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("t").orderBy("n", "g"))
    some = every.join(holders, "g").withColumn("r", rank).filter((F.col("n") <= rare) | (F.col("r") <= least))
    return some.select("t", "g", F.when(F.count("*").over(W.partitionBy("t")) >= FEW, SHARED).otherwise(1).alias("need"))


def bloom_bits(grams: DataFrame, count: int) -> tuple[bytes, int]:
    """A Bloom filter (bytes, bits) of the distinct values of the bigint column ``g``: two bits a value, 2**14 to 2**27 bits in all."""
    size = 1 << min(27, max(14, (32 * max(1, count)).bit_length()))
    return bit_array(grams.select(F.explode(F.array(F.col("g").bitwiseAND(F.lit(size - 1)), F.shiftright("g", 32).bitwiseAND(F.lit(size - 1))))), size), size


def passages(docs: DataFrame, bits, size: int, margin: int, lengths: tuple, gram: int = GRAM) -> DataFrame:
    """doc_id, begin (word), words, grams of every passage of ``docs`` around grams that pass the filter."""

    def run(batches):
        ok, mask = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").astype(bool), size - 1
        for b in batches:
            w = Words(b.column(1), MARKS, latin=True)
            n = len(w.hash)
            last = np.repeat(w.first[1:], np.diff(w.first))  # end of each word's row
            found_at, found = [], []
            for k in lengths:  # gram, and 1 or 2 where there are items so short
                g = (w.grams(gram) if k == gram else w.hash * np.uint64(3) + (np.ones(n, np.uint64) if k == 1 else np.append(w.hash[1:], np.zeros(min(1, n), np.uint64)))).view(np.int64)
                hit = np.flatnonzero(ok[g & mask] & ok[(g >> 32) & mask] & (np.arange(n) + k <= last)) if n else np.zeros(0, np.int64)
                found_at.append(hit)
                found.append(g[hit])
            at, g = np.concatenate(found_at), np.concatenate(found)
            by = np.argsort(at, kind="stable")
            at, g = at[by], g[by]
            if not len(at):
                continue
            row = np.searchsorted(w.first, at, "right") - 1
            cut = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] - at[:-1] > 2 * margin)])
            starts = np.flatnonzero(cut)
            ids, begin, words, grams = [], [], [], []
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
                r = row[i]
                a, e = max(int(w.first[r]), int(at[i]) - margin), min(int(w.first[r + 1]), int(at[j - 1]) + gram + margin)
                ids.append(b.column(0)[int(r)].as_py())
                begin.append(a - int(w.first[r]))
                words.append(w.hash[a:e].view(np.int64))
                grams.append(np.unique(g[i:j]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begin, pa.int64()), pa.array([x.tobytes() for x in words], pa.binary()), pa.array(grams, pa.list_(pa.int64()))], ["doc_id", "begin", "words", "grams"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, begin bigint, words binary, grams array<bigint>")


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(best score, end) of a local alignment of all of ``item`` with ``text``; row by row, vectorised along the text."""
    n = len(text)
    step = np.arange(1, n + 1, dtype=np.int64) * -GAP
    above = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for x in item:
        diagonal = above[:-1] + np.where(text == x, MATCH, MISMATCH)
        row = np.maximum(np.maximum(diagonal, above[1:] + GAP), 0)
        row = np.maximum.accumulate(row + step) - step  # gaps in the item
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k + 1
        above[1:] = row
    return best, end


def may_reach(item: np.ndarray, text: np.ndarray, threshold: float) -> bool:
    """False only where no alignment reaches the threshold: one that does has that share of the item's length in matches, and its
    gaps, which the matches must outweigh, bound the words of ``text`` that it spans."""
    span = min(len(text), math.ceil(len(item) * (1 + MATCH * (1 - threshold) / -GAP)))
    known = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.isin(text, item))])
    return int((known[span:] - known[: len(known) - span]).max()) >= threshold * len(item)


def score_pairs(pairs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, item_id, score, begin, end of those ``pairs`` (doc_id, begin, words, item_id, item) that reach the threshold."""

    def run(batches):
        for b in batches:
            out = []
            for doc, begin, words, item_id, item in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text, x = np.frombuffer(words, np.int64), np.array(item, np.int64)
                best, end = align(x, text) if may_reach(x, text, threshold) else (0, 0)
                if best >= threshold * MATCH * len(x):
                    back, length = align(x[::-1], text[:end][::-1])
                    out.append((doc, item_id, best / (MATCH * len(x)), begin + end - length, begin + end))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "score", "begin", "end"])

    return pairs.select("doc_id", "begin", "words", "item_id", "item").mapInArrow(run, "doc_id bigint, item_id bigint, score double, begin bigint, end bigint")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, begin, end (words of the document): the best alignment of each document and test item that
    reaches the threshold.

    Null or empty texts on either side match nothing; documents that repeat an id are one document here; null ids are kept. Equal
    items (other ids) are each reported. Empty tables give no row."""
    spark = docs.sparkSession
    tune(spark)
    known = written(item_grams(items).withColumn("t", F.xxhash64("words")), "items")
    seeds = written(seeds_of(known), "seeds")
    rows, distinct = seeds.agg(F.count("*"), F.countDistinct("g")).first()
    if not rows:
        drop(known, seeds)
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, score double, begin bigint, end bigint")
    longest, shortest = known.agg(F.max("n_words"), F.min("n_words")).first()
    filled, size = bloom_bits(seeds, distinct)
    bits = spark.sparkContext.broadcast(filled)
    lengths = tuple(k for k in (1, 2) if k >= shortest) + (GRAM,)
    found = written(passages(docs, bits, size, longest, lengths), "passages")
    at = found.withColumn("p", F.xxhash64("doc_id", "begin", "words"))
    pairs = shared_seeds(at, seeds, rows)
    spread = max(1, 4 * n_parts(spark))
    pairs = pairs.join(at.select("p", "doc_id", "begin", "words").dropDuplicates(["p"]), "p")
    pairs = pairs.join(known.select("t", F.col("words").alias("item")).dropDuplicates(["t"]), "t").repartition(spread)
    best = score_pairs(pairs.withColumnRenamed("t", "item_id"), threshold).groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("begin")).alias("back"), "end")).alias("b"))
    best = best.select("doc_id", F.col("item_id").alias("t"), F.col("b.score").alias("score"), (-F.col("b.back")).alias("begin"), F.col("b.end").alias("end"))
    return best.join(known.select("t", "item_id").distinct(), "t").select("doc_id", "item_id", "score", "begin", "end")


def shared_seeds(at: DataFrame, seeds: DataFrame, rows: int) -> DataFrame:
    """p, t: the passages (p, grams) and items that share as many of the ``rows`` seeds as these need. A gram that very many passages hold stays spread: few seeds are broadcast, many are
    dealt by gram and salt."""
    grams = at.select("p", F.explode("grams").alias("g"))
    if rows <= FEW_SEEDS:
        met = grams.join(F.broadcast(seeds), "g")
    else:
        salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = grams.withColumn("salt", F.pmod("p", F.lit(SALTS)).cast("int")).join(salted, ["g", "salt"])
    # a passage's grams are different ones; the same passage of a repeated row counts again, which changes nothing
    return met.groupBy("p", "t").agg(F.countDistinct("g").alias("n"), F.max("need").alias("need")).filter("n >= need").select("p", "t")


def op2_smith_waterman_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score, begin, end: every passage of a benchmark item found in the whole texts of ``documents``."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
