"""SentencePiece encoding and decoding over a relational lattice.

Encoding: texts are cut into *words* wherever no piece of the model holds the two characters beside the cut, so that no merge reaches across. The
different words of all texts go through the lattice: all their substrings up to the longest piece are exploded with their places and equi-joined to the
piece table (of the size of the model file); the edges found are grouped by word, and a Viterbi fold with Spark's ``aggregate`` walks
from end to end of the word. No word has another path, however rare or long it is.

The fold: for every end it holds the best path that reaches it: its score, its last piece, where that starts. An edge extends the path at its start if the
two pieces may follow each other, and of the edges that do the one with the best total stays. Pieces of this model come from byte-pair
merges, so the total alone would pick other paths than the model's own encoder; what makes the fold exact is the rule about neighbours: a
piece b may follow a unless merging their characters in order of score would join a part at the end of a with a part at the start of b before either part
is taken up in its own piece. Which joining pieces there are is told by the edges of the word themselves; an Arrow function notes the edges that each may
follow, for all words of a batch at once (:func:`followed`).

Back to the texts: a task numbers the different words of a *chunk* of its documents and keeps the chunk as a row of word numbers (compressed). Words travel to the
lattice with the number of their chunk and their own, and their ids back to the chunk, where they are put in place. What is shuffled is the chunks' different words,
their ids, and the chunks.

White space is kept as the mark U+2581, one is put before the text. Of several marks in a row, whose pieces share one score and merge last, the
last belongs to the word after them if they merge; the others are cut from the left (checked for each model file).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memo import Numbers, _ranges
from .shared import n_parts, table, text_or_empty, tune

MARK = "▁"
#: Bytes of text of a chunk, about at most (a longer document is a chunk of its own).
CHUNK_BYTES = 14 << 20
#: Characters of a word that is its own name; longer ones are named by their digest while they are in the lattice.
LONG = 64
#: Places of a window, from which substrings are taken.
WINDOW = 48
#: A word's place is its task, its chunk in the task and its number in the chunk: bits of the last two.
CHUNK_BITS, PLACE_BITS = 16, 26


def read_model(data: bytes) -> tuple[list[tuple[str, float, int]], dict]:
    """Pieces (text, score, type) and the normaliser's switches of a model file (a protocol buffer)."""

    def fields(b):
        at = 0
        while at < len(b):
            key, at = varint(b, at)
            kind = key & 7
            if kind == 0:
                value, at = varint(b, at)
            elif kind == 2:
                n, at = varint(b, at)
                value, at = b[at : at + n], at + n
            else:
                n = {1: 8, 5: 4}[kind]
                value, at = b[at : at + n], at + n
            yield key >> 3, value

    def varint(b, at):
        out = shift = 0
        while True:
            x = b[at]
            out |= (x & 127) << shift
            at, shift = at + 1, shift + 7
            if x < 128:
                return out, at

    pieces, switches = [], {"dummy": True, "squeeze": True, "map": b""}
    for number, value in fields(data):
        if number == 1:
            f = dict(fields(value))
            pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, 1)))
        elif number == 3:
            f = dict(fields(value))
            switches |= {"map": f.get(2, b""), "dummy": bool(f.get(3, 1)), "squeeze": bool(f.get(4, 1))}
    return pieces, switches


class Model:
    """A byte-pair model with byte fallback and an identity normaliser that keeps white space."""

    def __init__(self, data: bytes):
        pieces, switches = read_model(data)
        if switches["map"] or switches["squeeze"] or not switches["dummy"]:
            raise ValueError("only models that keep the text as it is are supported")
        self.pieces = pieces
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        self.score = {p: s for p, s, kind in pieces if kind == 1}
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        if len(self.byte) != 256:
            raise ValueError("only models with byte fallback are supported")
        self.longest = max(map(len, self.id))
        runs = {len(p) for p in self.id if not p.strip(MARK)}
        self.run = max(runs)
        if self.longest > 30 or any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("only models are supported whose pieces have their marks in front, and up to 30 characters")
        if any(self.merge(MARK * n)[0] != self.blanks(n) for n in range(1, 3 * self.run)) or min(self.score.values()) < max(self.score[MARK * n] for n in runs if n > 1):
            raise ValueError("only models are supported in which runs of blanks are cut from the left and merge last")
        pairs = {x for p in self.id for x in zip(p, p[1:])}
        letters = sorted({c for x in pairs for c in x})
        if any(c not in self.id or ord(c) > 0xFFFF for c in letters):
            raise ValueError("only models are supported whose pieces are made of single-character pieces")
        #: The class of each character that stands in longer pieces (as a space for the mark), and which classes may stand side by side in one.
        self.kind = np.zeros(1 << 16, np.int16)
        number = {c: i + 1 for i, c in enumerate(letters)}
        for c, i in number.items():
            self.kind[ord(" " if c == MARK else c)] = i
        self.together = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for x, y in pairs:
            self.together[number[x], number[y]] = True
        self.chars = np.array([len(p) for p, _, _ in pieces])

    def merge(self, s: str) -> tuple[list[str], str]:
        """The encoding by its definition, and the left part of the last merge: merge the best-scored neighbours, leftmost first, until none is a piece."""
        x, left = list(s), ""
        while True:
            best = max(((self.score[x[i] + x[i + 1]], -i) for i in range(len(x) - 1) if x[i] + x[i + 1] in self.score), default=None)
            if best is None:
                return x, left
            i = -best[1]
            left = x[i]
            x[i : i + 2] = [x[i] + x[i + 1]]

    def table(self) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        """(piece, rank), the id of each rank, and what takes up the parts at a piece's ends.

        Pieces have a space for the mark, and their rank by score, the best first; only those are in it that merging their own characters gives, and of those
        with several marks none. The last two: for each rank and length the rank of the piece that the part of that length at the piece's end (at its start) is merged
        into; -1 if merging makes no such part, the largest number for the whole piece."""
        able, known = [], {}
        for p in self.id:
            if not p.startswith(MARK * 2):
                got, left = self.merge(p)
                if got == [p]:
                    able.append(p)
                    if len(p) > 1:
                        known[p] = left, p[len(left) :]
        able.sort(key=lambda p: -self.score[p])
        if any(self.score[a] == self.score[b] for a, b in zip(able, able[1:])):
            raise ValueError("only models are supported whose pieces differ in score")
        rank = {p: i for i, p in enumerate(able)}
        taken = np.full((2, len(able), self.longest + 1), -1, np.int32)
        for p, i in rank.items():
            for side in (0, 1):
                taken[side, i, len(p)] = np.iinfo(np.int32).max
                part = p
                while part in known:
                    into, part = rank[part], known[part][1 - side]
                    taken[side, i, len(part)] = into
        return pd.DataFrame({"piece": [p.replace(MARK, " ") for p in able], "rank": range(len(able))}), np.array([self.id[p] for p in able], np.int32), taken[0], taken[1]

    def blanks(self, n: int) -> list[str]:
        """The pieces of a run of n blanks: the longest ones from the left, and what merging gives for the rest."""
        return [MARK * self.run] * (n // self.run) + self.merge(MARK * (n % self.run))[0]

    def ids(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        return [i] if i is not None else [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(UTF-8 bytes of all texts with spaces for marks and one in front of each, begin and end of each word, number of words of each text)."""
        texts = [" " + t.replace(MARK, " ") if t else "" for t in texts]
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = np.cumsum([0, *map(len, texts)])
        kind = np.where(code < 1 << 16, self.kind[np.minimum(code, 0xFFFF)], 0)
        new = np.ones(len(code) + 1, bool)
        new[1:-1] = ~self.together[kind[:-1], kind[1:]] if len(code) else True
        new[starts] = True
        first = np.flatnonzero(new)
        at = np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 1 << 16), dtype=np.int64)])[first]
        return np.frombuffer(joined.encode(), np.uint8), at[:-1], at[1:], np.diff(np.searchsorted(first, starts))


@lru_cache(2)
def load(data: bytes) -> Model:
    """The model of a file's bytes, once a worker."""
    return Model(data)


class Decoder:
    """Ids to text: pieces in a row, bytes as bytes, marks as spaces, without the one put in front. Control pieces are
    empty, an unknown piece is the library's sign for it; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, model: Model):
        raw = []
        for p, _, kind in model.pieces:
            raw.append(bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else p.replace(MARK, " ").encode())
        self.n = np.array([len(r) for r in raw])
        self.at = np.cumsum(self.n) - self.n
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def __call__(self, ids: np.ndarray) -> str:
        n = self.n[ids]
        ends = np.cumsum(n)
        s = self.flat[np.repeat(self.at[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes().decode("utf-8", "replace")
        return s[1:] if s.startswith(" ") else s


# ---------------------------------------------------------------- the lattice


#: An edge is one number: its end, its start and its piece's rank, 20 bits for each of the latter.
BITS = 20


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """w, edges: the edges of each different word in order of end and start. ``words`` has columns w, long, place (see :func:`_chunks`), ``pieces`` is that of :meth:`Model.table`."""
    # the condition holds for every word; what it asks for keeps all columns, so that this and the join read the same shuffle
    different = words.groupBy("w", "long").agg(F.max("place").alias("place")).filter("place >= 0").select("w", F.coalesce("long", "w").alias("text"))
    # windows that overlap by a piece: no row holds more of a long word
    begin = F.explode(F.sequence(F.lit(0), F.char_length("text") - 1, F.lit(WINDOW))).alias("begin")
    windows = different.select("w", "text", begin).select("w", "begin", F.expr(f"substring(text, begin + 1, {WINDOW + longest - 1})").alias("text"))
    places = windows.select("w", "begin", "text", F.explode(F.sequence(F.lit(0), F.least(F.char_length("text"), F.lit(WINDOW)) - 1)).alias("s"))
    subs = places.select("w", "begin", "text", "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("s") + longest, F.char_length("text")))).alias("e"))
    subs = subs.select("w", (F.col("begin") + F.col("s")).alias("s"), (F.col("begin") + F.col("e")).alias("e"), F.substring("text", F.col("s") + 1, F.col("e") - F.col("s")).alias("piece"))
    # the piece table is the model's: of the size of the file that the caller gave
    edges = subs.join(F.broadcast(pieces), "piece").select("w", F.shiftleft(F.shiftleft(F.col("e").cast("bigint"), BITS) + F.col("s"), BITS).bitwiseOR(F.col("rank").cast("bigint")).alias("edge"))
    return edges.groupBy("w").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


#: Edges whose neighbours are worked out at once, at most.
AT_ONCE = 16384


def _masks(edge_at: np.ndarray, reach: np.ndarray, taken: np.ndarray, own: np.ndarray, rank: np.ndarray, cross, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """For every edge, as bits (two words of 64), which of the pieces that cross the place ``edge_at`` where it meets its neighbour would take up a part of it first. ``reach``:
    how far each crossing piece goes into the edge's side; ``taken``: what takes up the parts of a piece of rank ``own``; ``rank``: that of all edges; ``strict``: whether
    the crossing piece has to be better, or merges first at the same rank too."""
    first, count, piece, slot = cross
    n = count[edge_at]
    of, at = np.repeat(np.arange(len(own)), n), _ranges(first[edge_at], n)
    into, far = rank[piece[at]], np.minimum(reach[at], taken.shape[1] - 1)
    limit = taken[own[of], far]
    hit = ((into < limit) if strict else (into <= limit)) & (reach[at] < taken.shape[1])
    of, bit = of[hit], slot[at][hit].astype(np.uint64)
    out = np.zeros((2, len(own)), np.uint64)
    for half in (0, 1):
        some = (bit >> np.uint64(6)) == half
        if some.any():
            o = of[some]
            starts = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
            out[half, o[starts]] = np.bitwise_or.reduceat(np.uint64(1) << (bit[some] & np.uint64(63)), starts)
    return out[0], out[1]


def followed(edges: np.ndarray, offsets: np.ndarray, tails: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """For each edge of many words (those of word i from ``offsets[i]`` on) which edges it may follow, as bits by their length; bit 0 for one at the start.

    Piece b may follow a unless a piece that crosses the place between them joins an end of a with a start of b before either is taken up otherwise; at
    the same rank the one further left merges first."""
    mask = (1 << BITS) - 1
    e, s, rank = edges >> 2 * BITS, edges >> BITS & mask, edges & mask
    size = np.diff(offsets)
    word = np.repeat(np.arange(len(size)), size)
    last = np.zeros(len(size), np.int64)
    last[size > 0] = e[offsets[1:][size > 0] - 1]
    base = np.cumsum(last + 1) - last - 1
    begin, end = base[word] + s, base[word] + e
    places = int(base[-1] + last[-1] + 1) if len(size) else 0
    # pieces that cross each place
    n = (e - s - 1).astype(np.int64)
    piece, place = np.repeat(np.arange(len(e)), n), _ranges(begin + 1, n)
    by = np.argsort(place, kind="stable")
    piece, place = piece[by], place[by]
    count = np.bincount(place, minlength=places)
    first = np.cumsum(count) - count
    slot = np.arange(len(place)) - first[place]
    cross, to_left, to_right = (first, count, piece, slot), place - begin[piece], end[piece] - place
    # pairs: edges are in order of their ends
    ending = np.bincount(end, minlength=places)
    from_ = np.cumsum(ending) - ending
    out, length = (s == 0).astype(np.int32), (e - s).astype(np.int32)
    for i in range(0, len(e), AT_ONCE):
        j = min(i + AT_ONCE, len(e))
        inner = s[i:j] > 0
        if not inner.any():
            continue
        k = int(from_[begin[i:j][inner]].min())  # where the edges that these may follow begin
        a = _masks(end[k:j], to_left, tails, rank[k:j], rank, cross, True)
        b = _masks(begin[i:j], to_right, heads, rank[i:j], rank, cross, False)
        n = np.where(inner, ending[begin[i:j]], 0)
        right, left = np.repeat(np.arange(j - i), n), _ranges(from_[begin[i:j]], n) - k
        fits = ((a[0][left] & b[0][right]) | (a[1][left] & b[1][right])) == 0
        right, left = right[fits], left[fits]
        if len(right):
            starts = np.flatnonzero(np.concatenate([[True], right[1:] != right[:-1]]))
            out[i + right[starts]] = np.bitwise_or.reduceat(np.int32(1) << length[k + left], starts)
    return out


def viterbi() -> Column:
    """The ranks along the best path through ``edges`` of a word; ``after`` says which edges each may follow.

    The state holds for each end, from 0 on, the best path to it as one number: its cost (the sum of its pieces' ranks), the rank of its last piece and, in the lowest
    5 bits, that piece's length (31: no path). An edge that may follow the best path at its start makes a path to its end, and the cheapest to an end stays.
    Ends far behind are put aside in blocks (``done``, up to ``base``), so that a step copies little in long words too."""
    low = (1 << BITS) - 1
    s, e = f"cast(shiftright(y.edges, {BITS}) & {low} as int)", f"cast(shiftright(y.edges, {2 * BITS}) as int)"
    at_start, rank = f"get(r.now, {s} - r.base)", f"(y.edges & {low})"
    path = f"(shiftleft(shiftright({at_start}, {BITS + 5}) + {rank}, {BITS + 5}) | shiftleft({rank}, 5) | ({e} - {s}))"
    size = "(r.base + size(r.now))"
    longer = f"CASE WHEN {size} = {e} THEN concat(r.now, array({path})) WHEN {size} > {e} THEN concat(slice(r.now, 1, {e} - r.base), array(least(get(r.now, {e} - r.base), {path}))) ELSE concat(r.now, array_repeat(31L, {e} - {size}), array({path})) END"
    aside = "if(size(r.now) < 512, r, named_struct('base', r.base + 256, 'done', concat(r.done, array(slice(r.now, 1, 256))), 'now', slice(r.now, 257, size(r.now) - 256)))"
    step = f"if((shiftright(y.after, cast({at_start} & 31 as int)) & 1) = 1, named_struct('base', r.base, 'done', r.done, 'now', {longer}), {aside})"
    start = "named_struct('base', 0, 'done', cast(array() as array<array<bigint>>), 'now', array(0L))"
    back = f"""aggregate(reverse(flatten(concat(r.done, array(r.now)))), named_struct('at', r.base + size(r.now) - 1, 'left', 0, 'ranks', cast(array() as array<int>)),
        (b, x) -> if(b.left > 1, named_struct('at', b.at - 1, 'left', b.left - 1, 'ranks', b.ranks), if(b.at = 0, b, named_struct('at', b.at - 1, 'left', cast(x & 31 as int), 'ranks', concat(array(cast(shiftright(x, 5) & {low} as int)), b.ranks)))), b -> b.ranks)"""
    return F.expr(f"aggregate(arrays_zip(edges, after), {start}, (r, y) -> {step}, r -> {back})")


def encode_words(words: DataFrame, model: bytes) -> DataFrame:
    """w, ranks (of the pieces) for the different words (with spaces for marks, at least two characters, at most one space) of a table w, long, place, by the lattice."""
    m = load(model)
    table, _, tails, heads = m.table()
    pieces = words.sparkSession.createDataFrame(table, "piece string, rank int")
    # the model's own tables, of the size of its file
    sides = words.sparkSession.sparkContext.broadcast((tails, heads))

    @F.arrow_udf("array<int>")
    def after(edges: pa.Array) -> pa.Array:
        offsets = edges.offsets.to_numpy()
        flat = edges.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(followed(flat, offsets.astype(np.int64), *sides.value)))

    return lattice(words, pieces, m.longest).select("w", "edges", after("edges").alias("after")).select("w", viterbi().alias("ranks"))


# ---------------------------------------------------------------- chunks


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    raw = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    return zstandard.compress(struct.pack(f"<{len(raw) + 1}Q", len(raw), *map(len, raw)) + b"".join(raw), 3)


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, which compress better."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    """The inverse of :func:`_planes`."""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _unpack(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    (n,) = struct.unpack_from("<Q", raw)
    at, out = 8 * (n + 1), []
    for size in struct.unpack_from(f"<{n}Q", raw, 8):
        out.append(raw[at : at + size])
        at += size
    return out


class Chunk:
    """Documents as numbers of words. Words are numbered by how often they stand in the chunk."""

    def __init__(self, model: Model):
        self.model, self.numbers, self.size = model, Numbers(), 0
        self.at, self.counts, self.crc, self.kept = [], [], [], []

    def add(self, texts: list[str], kept: pa.RecordBatch):
        data, begin, end, n = self.model.cut(texts)
        self.at.append(self.numbers(data, begin, end).astype(np.uint32))
        self.counts.append(n)
        self.crc.append(np.array([zlib.crc32(t.encode()) for t in texts], np.uint32))
        self.kept.append(kept)
        self.size += len(data)

    def closed(self):
        """(words for the lattice, their numbers, the chunk as bytes)."""
        m, at, words = self.model, np.concatenate(self.at), [w.decode() for w in self.numbers.words]
        order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        at = place[at]
        if len(words) > 1 << PLACE_BITS:
            raise ValueError("a document with too many different words")
        own, own_n, own_ids, sent, to, marks = [], [], [], [], [], []
        for k, w in enumerate(words[i] for i in order.tolist()):
            rest = w.lstrip(" ")
            blanks = len(w) - len(rest)
            if len(w) == 1 or not rest:  # single characters and runs of blanks need no lattice
                got = [i for p in (m.blanks(blanks) if blanks else [w]) for i in m.ids(p)]
                own.append(k), own_n.append(len(got)), own_ids.extend(got)
            else:
                sent.append(w[blanks - 1 :] if blanks > 1 else w), to.append(k), marks.append(blanks)
        table = pa.Table.from_batches(self.kept).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        blob = _pack(
            np.minimum(at, 255).astype(np.uint8), _planes(at[at >= 255]), np.concatenate(self.counts).astype(np.uint32), np.concatenate(self.crc),
            np.array(own, np.uint32), np.array(own_n, np.uint32), np.array(own_ids, np.int32), _planes(np.diff(np.array(to, np.uint32), prepend=np.uint32(0))), _planes(np.array(marks, np.uint32)), _planes(np.array([len(w) for w in sent], np.uint32)),
            sink.getvalue().to_pybytes(),
        )
        return sent, to, blob


def _chunks(docs: DataFrame, model: bytes, words: bool) -> DataFrame:
    """With ``words`` w, long, place: the different words of each chunk for the lattice (one of more than LONG characters is named by its digest in w, and
    stands in long); else chunk, bytes: the chunks. ``docs`` has the text in its last column."""

    def run(batches):
        from pyspark import TaskContext

        m, number = load(model), TaskContext.get().partitionId() << CHUNK_BITS
        now = Chunk(m)

        def flush():
            nonlocal now, number
            sent, to, blob = now.closed()
            here, number, now = number, number + 1, Chunk(m)
            if words:
                long = [w if len(w) > LONG else None for w in sent]
                keys = ["#" + hashlib.sha256(w.encode()).hexdigest() if len(w) > LONG else w for w in sent]
                return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(long, pa.string()), pa.array((here << PLACE_BITS) + np.array(to, np.int64))], ["w", "long", "place"])
            return pa.RecordBatch.from_arrays([pa.array([here], pa.int64()), pa.array([blob], pa.binary())], ["chunk", "bytes"])

        for b in batches:
            texts, i = b.column(b.num_columns - 1).to_pylist(), 0
            kept = pa.RecordBatch.from_arrays(b.columns[:-1], schema=pa.schema(list(b.schema)[:-1]))
            while i < len(texts):  # about a MB at a time
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= 1 << 20):
                    size += len(texts[j])
                    j += 1
                if now.size and now.size + size > CHUNK_BYTES:
                    yield flush()
                now.add(texts[i:j], kept.slice(i, j - i))
                i = j
        if now.at:
            yield flush()

    return docs.mapInArrow(run, "w string, long string, place bigint" if words else "chunk bigint, bytes binary")


def _together(found: DataFrame, ids_of: np.ndarray) -> DataFrame:
    """chunk, bytes: the ids of what a task found (place, ranks) for each chunk, in one row."""

    def run(batches):
        def rows(t):
            by = np.argsort(t.column(0).to_numpy(), kind="stable")
            t = t.take(pa.array(by)).combine_chunks()
            place, ids = t.column(0).to_numpy(), t.column(1).combine_chunks() if isinstance(t.column(1), pa.ChunkedArray) else t.column(1)
            chunk, k = place >> PLACE_BITS, place & (1 << PLACE_BITS) - 1
            n, flat = np.diff(ids.offsets.to_numpy()), ids_of[ids.flatten().to_numpy(zero_copy_only=False)]
            ends = np.concatenate([[0], np.cumsum(n)])
            cuts = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
            out = [(int(chunk[a]), _pack(_planes(np.diff(k[a:b], prepend=0)), _planes(n[a:b]), _planes(flat[ends[a] : ends[b]]))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["chunk", "bytes"])

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size > 1_000_000:
                yield rows(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield rows(pa.Table.from_batches(held))

    return found.select("place", "ranks").mapInArrow(run, "chunk bigint, bytes binary")


class Changed(ValueError):
    """The documents were others when they were read again."""


def _in_place(blob: bytes, found: list[bytes], model: Model):
    """(columns kept, ids in a row, ids of each document, crc32 of each text) of a chunk, with the ``found`` ids of its words."""
    low, high, counts, crc, own, own_n, own_ids, to, marks, chars, kept = _unpack(blob)
    high, to, marks, chars = map(_numbers, (high, to, marks, chars))
    to = np.cumsum(to, dtype=np.int64)
    low, counts, crc, own, own_n = (np.frombuffer(x, k) for x, k in zip((low, counts, crc, own, own_n), ("u1", *["<u4"] * 4), strict=True))
    parts = [_unpack(x) for x in found]
    k = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(_numbers(p[0]), dtype=np.int64) for p in parts)])
    n = np.concatenate([np.zeros(0, np.int64), *(_numbers(p[1]).astype(np.int64) for p in parts)])
    ids = np.concatenate([np.zeros(0, np.int32), *(_numbers(p[2]).view(np.int32) for p in parts)])
    by = np.argsort(k, kind="stable")
    start = (np.cumsum(n) - n)[by]
    k, n = k[by], n[by]
    ids = ids[_ranges(start, n)]
    ends = np.cumsum(n)
    length = np.diff(np.concatenate([[0], np.cumsum(model.chars[ids])])[np.concatenate([[0], ends])])
    if len(k) != len(to) or (k != to).any() or (length != chars).any():
        raise Changed("the documents were others when they were read again: write them to a table first")
    start = ends - n
    several, flat, more = np.flatnonzero(marks > 1), [ids], []
    end = len(ids)
    for i in several.tolist():  # several marks in front: the last one is the word's own, if it merges with it
        word = ids[start[i] : start[i] + n[i]]
        alone = word[0] == model.id[MARK]
        got = np.array([model.id[p] for p in model.blanks(int(marks[i]) - (0 if alone else 1))] + word[int(alone) :].tolist(), np.int32)
        more.append((i, end, len(got)))
        flat.append(got)
        end += len(got)
    for i, at, size in more:
        start[i], n[i] = at, size
    flat.append(np.frombuffer(own_ids, np.int32))
    ids = np.concatenate(flat)
    every_start, every_n = np.zeros(len(to) + len(own), np.int64), np.zeros(len(to) + len(own), np.int64)
    every_start[to], every_n[to] = start, n
    every_start[own], every_n[own] = end + np.cumsum(own_n.astype(np.int64)) - own_n, own_n
    at = low.astype(np.int64)
    at[at == 255] = high
    n = every_n[at]
    total = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts.astype(np.int64))])]
    return pa.ipc.open_stream(kept).read_all(), every_start[at], n, np.concatenate([[0], np.cumsum(counts.astype(np.int64))]), total, crc, ids


def encode(docs: DataFrame, model: bytes, keep: list[str] | None = None, check: str | None = None, finish=None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``ids`` (array<int>) of the whole ``text``, and the text's crc32 as column ``check`` if that is named. ``finish``: (a function
    of Arrow batches of these rows, the schema of what it gives), applied in the same workers.

    A null or empty text has no ids; all rows stay, repeated ones too, in no certain order; an empty table gives an empty one. Texts may be of any
    length, and so may words without any place to cut them. ``docs`` is read twice and has to give the same rows in the same tasks, as
    tables in files do; where it doesn't, the query fails with :class:`Changed`."""
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

    spark = docs.sparkSession
    tune(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", check)]
    rows = docs.select(*keep, text_or_empty().alias("__text"))
    words = _chunks(rows, model, True).repartition(n_parts(spark), "w")
    encoded = encode_words(words, model)
    # a row for each chunk and task that found ids of its words
    # both sides are dealt by the word: merged as they are, whatever their sizes are thought to be; the condition always holds and
    # asks for the column that only the lattice needs, so that both read the same shuffle
    placed = words.select("w", F.when(F.coalesce(F.length("long"), F.lit(0)) >= 0, F.col("place")).alias("place"))
    found = _together(placed.join(encoded.hint("merge"), "w"), load(model).table()[1]).groupBy("chunk").agg(F.collect_list("bytes").alias("found"))
    # a join, no union: a chunk's number is that of the task, which a union would shift
    both = _chunks(rows, model, False).join(found.hint("merge"), "chunk", "left")
    schema = StructType([docs.schema[c] for c in keep]).add("ids", ArrayType(IntegerType()))
    schema = schema.add(check, LongType()) if check else schema
    names = schema.names

    def run(batches):
        m = load(model)
        for b in batches:
            for data, parts in zip(b.column(0), b.column(1), strict=True):
                kept, start, n, words, total, crc, ids = _in_place(data.as_py(), parts.as_py() or [], m)
                i = 0
                while i < len(crc):  # about a million ids at a time
                    j = max(i + 1, int(np.searchsorted(total, total[i] + (1 << 20), "right")) - 1)
                    flat = ids[_ranges(start[words[i] : words[j]], n[words[i] : words[j]])]
                    of = pa.ListArray.from_arrays(pa.array(total[i : j + 1] - total[i], pa.int32()), pa.array(flat))
                    own = kept.slice(i, j - i).combine_chunks()
                    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own.columns]
                    out = pa.RecordBatch.from_arrays([*columns, of, *([pa.array(crc[i:j].astype(np.int64))] if check else [])], names)
                    yield finish[0](out) if finish else out
                    i = j

    return both.select("bytes", "found").mapInArrow(run, finish[1] if finish else schema)


def decode(rows: DataFrame, model: bytes, to: str = "decoded") -> DataFrame:
    """``rows`` with the text of its ``ids`` (null: empty) in column ``to``."""
    tune(rows.sparkSession)

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        d = Decoder(load(model))
        return ids.map(lambda x: d(np.asarray(x if x is not None else [], np.int64)))

    return rows.withColumn(to, run("ids"))


@lru_cache(2)
def decoder(data: bytes) -> Decoder:
    return Decoder(load(data))


def digests(model: bytes):
    """For :func:`encode` with ``doc_id`` and ``text_crc32``: doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers) and round_trip (decoding gives
    the very text: not so for texts that hold the mark U+2581 itself, which comes back as a space)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        d = decoder(model)
        ids, ends = b.column(1).values.to_numpy(zero_copy_only=False), b.column(1).offsets.to_numpy()
        got = [ids[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
        same = [zlib.crc32(d(x).encode()) == c for x, c in zip(got, b.column(2).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.diff(ends).astype(np.int64)), pa.array([zlib.crc32(x.tobytes()) for x in got], pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return run, "doc_id bigint, n_pieces bigint, ids_crc32 bigint, round_trip boolean"


def decoded(model: bytes):
    """For :func:`encode` with ``doc_id``: doc_id, n_pieces, ids and the text that the ids decode to."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        d = decoder(model)
        ids, ends = b.column(1).values.to_numpy(zero_copy_only=False), b.column(1).offsets.to_numpy()
        texts = pa.array([d(ids[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.diff(ends).astype(np.int64)), b.column(1), texts], ["doc_id", "n_pieces", "ids", "decoded"])

    return run, "doc_id bigint, n_pieces bigint, ids array<int>, decoded string"


def default_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op5_piece_lattice(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, round_trip of every whole text of ``documents``."""
    model = default_model()
    return encode(table(spark, sf_dir, "documents"), model, ["doc_id"], "text_crc32", digests(model))
