"""Token ids in patched frame-of-reference files.

A *segment* is a self-contained byte string, little-endian, that holds whole documents::

    magic "PFR1" | version u16 | block u16 | n_docs u32 | n_blocks u32 | n_ids u64 | start u64
    doc_id i64[n_docs] (a null id: the smallest i64) | n_tokens u32[n_docs]
    minimum u32[n_blocks] | width u8[n_blocks] | n_exceptions u16[n_blocks]
    word u64[n_blocks]      -- block index: where each block's packed words start
    patch u32[n_blocks]     -- block index: where each block's exceptions start
    packed u64[...] | exception position u8[...] | exception value u32[...]

Ids are cut into blocks of 256. A block stores its minimum and packs ``id - minimum`` at the smallest width that holds
the ``PERCENTILE`` of the block; what does not fit is packed as 0 and its full difference goes to the exception list.
64 values of width w take w words of 64 bits, so packing and unpacking are a few dozen vectorised shifts over all
blocks of a width. With the block index any id can be read without decoding what is before it.

Files: segments are rows of a Parquet table (part, seq, start, n_ids, segment BINARY) written by Spark's own committer,
which works on any store the cluster can reach and survives retried tasks; ``segment`` is the file's content.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memo import WordIds
from .shared import n_parts, table, text_or_empty, tune, written

MAGIC, VERSION, BLOCK, LANE = b"PFR1", 1, 256, 64
PERCENTILE = 95
#: Ids after which a segment is closed (at the end of a document).
SEGMENT_IDS = 1 << 20
#: Words whose ids a worker remembers, and bytes of the parts of words.
MEMO_WORDS = 2_000_000
MEMO_BYTES = 64 << 20
NULL_ID = -(1 << 63)
HEAD = "<4sHHIIQQ"


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits needed for each value of an unsigned array below 2**32."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _pack(values: np.ndarray, w: int) -> np.ndarray:
    """(n, 64) values below 2**w as (n, w) words of 64 bits, the first value in the lowest bits."""
    v = np.ascontiguousarray(values.T).astype(np.uint64)
    out = np.zeros((w, v.shape[1]), np.uint64)
    for i in range(LANE):
        at, shift = divmod(i * w, 64)
        out[at] |= v[i] << np.uint64(shift)
        if shift + w > 64:
            out[at + 1] |= v[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def _unpack(words: np.ndarray, w: int) -> np.ndarray:
    m = np.ascontiguousarray(words.T)
    out = np.empty((LANE, m.shape[1]), np.uint32)
    mask = np.uint64((1 << w) - 1)
    for i in range(LANE):
        at, shift = divmod(i * w, 64)
        x = m[at] >> np.uint64(shift)
        if shift + w > 64:
            x |= m[at + 1] << np.uint64(64 - shift)
        out[i] = (x & mask).astype(np.uint32)
    return np.ascontiguousarray(out.T)


def encode_segment(doc_ids, lengths, ids: np.ndarray, start: int = 0, percentile: int = PERCENTILE) -> bytes:
    """The segment of these documents: their ids, numbers of tokens and all token ids in order."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n, nb = len(ids), -(-len(ids) // BLOCK)
    grid = np.empty(nb * BLOCK, np.uint32)
    grid[:n] = ids
    if n < len(grid):
        grid[n:] = ids[-1]
    grid = grid.reshape(nb, BLOCK)
    low = grid.min(axis=1) if nb else np.zeros(0, np.uint32)
    diff = grid - low[:, None]
    kth = min(BLOCK - 1, BLOCK * percentile // 100)
    width = _bits(np.partition(diff, kth, axis=1)[:, kth]) if nb else np.zeros(0, np.uint8)
    over = diff > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))[:, None].astype(np.uint32) if nb else np.zeros((0, BLOCK), bool)
    row, pos = np.nonzero(over)
    value = diff[row, pos]
    diff[row, pos] = 0
    n_exc = np.bincount(row, minlength=nb).astype(np.uint16)
    sizes = width.astype(np.int64) * (BLOCK // 64)
    word = np.concatenate([[0], np.cumsum(sizes)])
    packed = np.zeros(word[-1], np.uint64)
    for w in np.unique(width):
        if w:
            of = np.flatnonzero(width == w)
            got = _pack(diff[of].reshape(-1, LANE), int(w)).reshape(len(of), -1)
            packed[word[of][:, None] + np.arange(got.shape[1])] = got
    patch = np.concatenate([[0], np.cumsum(n_exc.astype(np.int64))])[:-1].astype(np.uint32) if nb else np.zeros(0, np.uint32)
    docs = np.array([NULL_ID if d is None else d for d in doc_ids], np.int64)
    head = struct.pack(HEAD, MAGIC, VERSION, BLOCK, len(docs), nb, n, start)
    return b"".join([head, docs.tobytes(), np.asarray(lengths, np.uint32).tobytes(), low.tobytes(), width.tobytes(), n_exc.tobytes(), word[:-1].astype(np.uint64).tobytes(), patch.tobytes(), packed.tobytes(), pos.astype(np.uint8).tobytes(), value.astype(np.uint32).tobytes()])


class Segment:
    """A segment that can be read whole or from any position."""

    def __init__(self, data: bytes):
        magic, version, block, n_docs, self.n_blocks, self.n_ids, self.start = struct.unpack_from(HEAD, data)
        if magic != MAGIC or version != VERSION or block != BLOCK:
            raise ValueError("not a segment of this format")
        self.at = struct.calcsize(HEAD)

        def take(kind, count):
            out = np.frombuffer(data, kind, count, self.at)
            self.at += out.nbytes
            return out

        nb = self.n_blocks
        self.doc_ids, self.lengths = take("<i8", n_docs), take("<u4", n_docs)
        self.low, self.width, self.n_exc = take("<u4", nb), take("u1", nb), take("<u2", nb)
        self.word, self.patch = take("<u8", nb), take("<u4", nb)
        self.packed = take("<u8", int(self.width.astype(np.int64).sum()) * (BLOCK // 64))
        total = int(self.n_exc.astype(np.int64).sum())
        self.pos, self.value = take("u1", total), take("<u4", total)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first to last - 1."""
        width, out = self.width[first:last], np.zeros((last - first, BLOCK), np.uint32)
        for w in np.unique(width):
            if w:
                of = np.flatnonzero(width == w)
                words = self.packed[self.word[first:last][of].astype(np.int64)[:, None] + np.arange(int(w) * (BLOCK // 64))]
                out[of] = _unpack(words.reshape(-1, int(w)), int(w)).reshape(len(of), BLOCK)
        n_exc = self.n_exc[first:last].astype(np.int64)
        if n_exc.sum():
            p0 = int(self.patch[first])
            p1 = p0 + int(n_exc.sum())
            out[np.repeat(np.arange(last - first), n_exc), self.pos[p0:p1]] = self.value[p0:p1]
        return (out + self.low[first:last, None]).reshape(-1)

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids begin to end - 1, decoding only the blocks that hold them."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if begin >= end:
            return np.zeros(0, np.uint32)
        first, last = begin // BLOCK, -(-end // BLOCK)
        return self.blocks(first, last)[begin - first * BLOCK : end - first * BLOCK]


#: The printable stand-ins of the 256 bytes in byte-level BPE: printable Latin-1 bytes stand for themselves, the others
#: follow from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_STAND_IN = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}
_PARTS = re.compile(r"([!-&(-/:-@\[-`{-~]*)([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")
_SPECIAL = "<|"
#: The one letter below U+0250 that becomes two characters in lower case: a letter and a mark.
_DOTTED = "\u0130"


class WordEncoder:
    """Ids of whole texts by the tokenizers library, word by word.

    ``word_bpe_49k.json`` drops white space, never merges across it and splits letters from ASCII marks other than the
    apostrophe, so a text's ids are those of its ASCII-blank separated words in turn, and a word's those of its leading
    marks, letters and trailing marks. Each different part is encoded by the library once and remembered; a run of
    letters below U+0250, which the normaliser turns into as many lower-case letters, goes straight to the library's BPE model; a
    word with U+0130, which becomes a letter and a mark, isn't taken apart. Only words of ASCII bytes are lower-cased here: with a
    combining mark the library composes before it lower-cases. A text that holds ``<|`` (special tokens are matched before anything else) and, for
    other tokenizers, every text is encoded whole.
    """

    def __init__(self, path: str, by_word: bool = True):
        from tokenizers import Tokenizer

        self.t, self.by_word = Tokenizer.from_file(path), by_word
        self.tokenize = self.t.model.tokenize
        self.parts, self.held = {}, 0
        self.ids = WordIds(self._word, MEMO_WORDS, lower=True)

    def _part(self, s: str):
        known = self.parts.get(s)
        if known is None:
            if s.isascii() and s.isalpha():
                known = [t.id for t in self.tokenize(s.lower())]
            elif s.isalpha() and max(s) < "\u0250" and _DOTTED not in s:
                known = [t.id for t in self.tokenize("".join([_STAND_IN[b] for b in s.lower().encode()]))]
            else:
                known = self.t.encode(s, add_special_tokens=False).ids
            self.held += len(s) + 100
            if self.held > MEMO_BYTES:
                self.parts, self.held = {}, 0
            self.parts[s] = known
        return known

    def _word(self, word: bytes):
        s = word.decode()
        m = None if s.isalpha() or _DOTTED in s else _PARTS.fullmatch(s)
        return [i for part in m.groups() if part for i in self._part(part)] if m else self._part(s)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a string column in a row, number of ids of each text)."""
        texts = texts.fill_null("")
        whole = pc.match_substring(texts, _SPECIAL) if self.by_word else pa.array(np.ones(len(texts), bool))
        of = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if not len(of):
            return self.ids(texts)
        ids, n = self.ids(pc.if_else(whole, "", texts))
        got = [e.ids for e in self.t.encode_batch(texts.take(pa.array(of)).to_pylist(), add_special_tokens=False)]
        more = np.array([len(g) for g in got], np.int64)
        where = np.concatenate([[0], np.cumsum(n)])[of]
        n[of] = more
        return np.insert(ids, np.repeat(where, more), np.fromiter((i for g in got for i in g), np.uint32, int(more.sum()))), n


@lru_cache(1)
def encoder(path: str, by_word: bool) -> WordEncoder:
    """The encoder of a worker: what it remembers serves all tasks."""
    return WordEncoder(path, by_word)


def write_segments(docs: DataFrame, tokenizer: str, end_id: int, name: str = "segments", by_word: bool = True) -> DataFrame:
    """Encode all ``docs`` (doc_id, text) in ascending doc_id order and write the segment table; returns it, reread.

    A null text is encoded as the empty one (just the end id); null doc_ids come first; rows that repeat a doc_id stay
    separate rows, ordered by text. An empty table gives an empty table of segments.
    """
    spark = docs.sparkSession
    tune(spark)

    def run(batches):
        from pyspark import TaskContext

        enc, part, seq, start = encoder(tokenizer, by_word), TaskContext.get().partitionId(), 0, 0
        docs_, lens, held, n_held = [], [], [], 0

        def close():
            nonlocal seq, start, docs_, lens, held, n_held
            ids = np.concatenate(held)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([encode_segment(docs_, np.concatenate(lens), ids, start)], pa.binary())], ["part", "seq", "start", "n_ids", "segment"])
            seq, start, docs_, lens, held, n_held = seq + 1, start + len(ids), [], [], [], 0
            return out

        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1)
            bytes_ = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            i = 0
            while i < len(texts):  # a few hundred KB of text at a time, however long the texts of a batch are
                j = max(i + 1, int(np.searchsorted(bytes_, (bytes_[i - 1] if i else 0) + (1 << 19), "right")))
                ids, n = enc.encode(texts.slice(i, j - i))
                ends = np.cumsum(n + 1)
                all_ids = np.full(int(ends[-1]), end_id, np.uint32)
                keep = np.ones(len(all_ids), bool)
                keep[ends - 1] = False
                all_ids[keep] = ids
                docs_ += names[i:j]
                lens.append(n + 1)
                held.append(all_ids)
                n_held += len(all_ids)
                i = j
                if n_held >= SEGMENT_IDS:
                    yield close()
        if docs_:
            yield close()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.repartitionByRange(n_parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return written(rows.mapInArrow(run, "part int, seq int, start bigint, n_ids bigint, segment binary"), name)


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the segment table.

    Starts: a segment knows how many ids its part wrote before it, and the totals of the parts (one row a task) are
    summed and joined in."""
    from pyspark.sql import Window as W

    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = totals.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def run(batches):
        for b in batches:
            for base, data in zip(b.column("base").to_pylist(), b.column("segment"), strict=True):
                s = Segment(data.as_buffer())
                ids, ends = s.ids(), np.cumsum(s.lengths.astype(np.int64))
                raw = memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), s.lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, mask=s.doc_ids == NULL_ID), pa.array(base + s.start + ends - s.lengths, pa.int64()), pa.array(s.lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a segment is about 1 to 2 MB: few in a batch
    return segments.join(F.broadcast(bases), "part").select("base", "segment").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


END_ID = 1


def op1_pfor_token_ids(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of ``documents``, in ascending order of doc_id (null ids first), read back from the segments that hold all ids.

    A null or empty text has the end id alone; repeated rows are documents of their own, side by side; no document gives no row; other columns are ignored."""
    import public_tokenizers

    segments = write_segments(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return read_documents(segments)
