"""N-gram Jaccard join: the size-aware heavy-light join, exact, with its connected components.

A document's set holds its different 5-word shingles, as 64-bit hashes. Documents with equal sets form a *class*; the
join runs on classes. All sets are ordered by one global order, rarest shingle first. If two sets have Jaccard at least t,
their first k common shingles lie in the first ``n - ceil(t n) + k`` of each. Hence two ways to meet, chosen by set size:

* small sets (size up to a boundary) enumerate all 2-subsets of that prefix for k = 2 and meet on equal subsets;
* large sets write the prefix for k = 1 to inverted lists and scan the lists with more than one class.

Sets a little above the boundary do both, since a link may cross it. The boundary is where enumerating subsets costs as much as scanning
lists, by the corpus's own shingle frequencies (:func:`boundary`).

The order needs the frequent shingles only: any order gives the exact result, a good one keeps lists short. Shingles
that occur at least twice in a window of the scan are counted; those at or above the least count that at most
``MAX_HEAVY`` of them reach are the *heavy* ones, a broadcast of bounded size.

A link needs more than one common key: how many follows from the two sizes (:func:`shared_least`). Lists of up to ``SHORT``
classes are written out as pairs (of sizes that allow a link) and the pairs' lists counted; longer lists, those of large groups of
copies, are never written out, and count for a pair as if both were in them.

Pairs that share enough, and all pairs within a longer list, are compared by *sketches* of one to two bits a shingle (:func:`sketch`): these never
differ in more places than the sets do, so a pair whose sketches differ in more places than a link allows has no link. Without this, chance meetings, whose number
grows with the square of the corpus, would join unlike texts to ever larger families.
The connected components of the pairs that are left are *families*. Families are cut into blocks of about
``BLOCK`` classes, and each pair of blocks of a family goes to one task, which gets their whole sets, counts all
intersections by a matrix product and returns a spanning forest of the links it found: every link inside a family is
tested, and no links lie between families.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import mix, shingle_sets
from .shared import bit_array, drop, free, n_parts, table, tune, written

WORDS, PERCENT = 5, 80
#: Shingles whose frequency is broadcast, at most.
MAX_HEAVY = 400_000
#: Shingles of one counting window.
WINDOW = 1_500_000
BLOCK = 256
#: Classes in a list that is still written out as pairs.
SHORT = 16
#: Classes of a longer list whose sketches one task compares with each other, or with as many others.
LIST = 2048
_U = np.uint64


def need(n, percent: int = PERCENT):
    """The least overlap of a set of size n with any set it links to: ceil(percent n / 100)."""
    return -(-n * percent // 100)


def class_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63)


def boundary(frequencies: list[tuple[int, int]], total: int, percent: int = PERCENT) -> int:
    """The largest set size for which enumerating 2-subsets costs no more than scanning lists.

    frequencies: (count, number of heavy shingles with it); total: shingle occurrences. A prefix holds the rarest part of a set; its
    expected list length is the mean frequency of the rarest ``100 - percent`` percent of all occurrences."""
    rest = total - sum(c * k for c, k in frequencies)
    room = max(1, total * (100 - percent) // 100)
    cost, seen = min(rest, room), min(rest, room)
    for c, k in sorted(frequencies):
        if seen >= room:
            break
        got = min(c * k, room - seen)
        cost, seen = cost + got * c, seen + got
    list_length, n = cost / max(1, seen), 5
    while n < 500:
        p = n + 1 - need(n + 1, percent) + 2
        if p * (p - 1) / 2 > (p - 1) * (1 + list_length):
            return n
        n += 1
    return n


def sketch(s: np.ndarray) -> bytes:
    """A bit for each of 2**k values (64 or more, and as many as s has shingles at least): whether an odd number of shingles end in it.

    A shingle that two sets don't share changes one bit, so the sketches of two sets differ in at most as many bits as the sets have such shingles.
    The halves of a sketch, added without carry, are that of half as many bits."""
    bits = 1 << max(6, (len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All sketches of a binary column as 64-bit words, where each begins among them, and how many it has."""
    o = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    flat = np.frombuffer(column.buffers()[2], np.uint8)[o[0] : o[-1]].view(np.uint64)
    return flat, (o[:-1] - o[0]) // 8, np.diff(o) // 8


def apart(one: tuple, i: np.ndarray, other: tuple, j: np.ndarray) -> np.ndarray:
    """In how many bits sketch i of ``one`` and sketch j of ``other`` (:func:`words`) differ, the wider of them folded."""
    out, a, b = np.zeros(len(i), np.int64), one[2][i], other[2][j]
    for x, y in np.unique(np.stack([a, b]), axis=1).T.tolist():
        of = np.flatnonzero((a == x) & (b == y))
        u, v = one[0][one[1][i[of]][:, None] + np.arange(x)], other[0][other[1][j[of]][:, None] + np.arange(y)]
        while u.shape[1] != v.shape[1]:
            h = max(u.shape[1], v.shape[1]) // 2
            u, v = (w[:, :h] ^ w[:, h:] if w.shape[1] > h else w for w in (u, v))
        out[of] = np.bitwise_count(u ^ v).sum(axis=1)
    return out


def may_link(bits: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of sizes na and nb whose sketches differ in so many bits may be linked."""
    n = na.astype(np.int64) + nb
    return bits <= n - 2 * -(-percent * n // (100 + percent))


class Order:
    """The global order: light shingles by hash, then heavy ones by (frequency, hash)."""

    def __init__(self, heavy: np.ndarray, count: np.ndarray):
        self.heavy, self.count = heavy, count
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(heavy >> _U(44)).astype(np.int64)] = True

    def prefix(self, s: np.ndarray, k: int) -> np.ndarray:
        """The first k shingles of the sorted set s."""
        hit = np.flatnonzero(self.maybe[(s >> _U(44)).astype(np.int64)])
        if not len(hit) or not len(self.heavy):
            return s[:k]
        at = np.minimum(np.searchsorted(self.heavy, s[hit]), len(self.heavy) - 1)
        same = self.heavy[at] == s[hit]
        hit, at = hit[same], at[same]
        light = np.ones(len(s), bool)
        light[hit] = False
        out = s[light][:k]
        if len(out) < k:
            by = np.lexsort((s[hit], self.count[at]))
            out = np.concatenate([out, s[hit[by]][: k - len(out)]])
        return out


def keys_of(s: np.ndarray, order: Order, small: int, percent: int = PERCENT) -> np.ndarray:
    """The keys on which this set meets others."""
    n, out = len(s), []
    p = n - need(n, percent)
    if n > small:
        out.append(mix(order.prefix(s, p + 1) * _U(2) + _U(1)))
    if n * percent <= small * 100 and n > 1:  # may link to a small set
        first = order.prefix(s, min(n, p + 2))
        i, j = np.triu_indices(len(first), 1)
        out.append(mix(first[i] * _U(0x9E3779B97F4A7C15) + mix(first[j])))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def spanning(sets: list[np.ndarray], percent: int = PERCENT, left: int | None = None) -> list[tuple[int, int]]:
    """Links (pairs of positions) that join what links join: a spanning forest of all links among the sets (with ``left``, of those
    between the first ``left`` sets and the others)."""
    m, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    if m < 2:
        return []
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    by = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[by], owner[by]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    owner, column = owner[shared[column]], column[shared[column]]
    common = np.zeros((m, m), np.float32)
    if len(column):
        _, column = np.unique(column, return_inverse=True)
        step = max(256, (1 << 22) // m)
        cuts = np.searchsorted(column, np.arange(0, int(column[-1]) + step, step))
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(column)], strict=True)):
            if b > a:
                grid = np.zeros((m, int(column[b - 1]) - k * step + 1), np.float32)
                grid[owner[a:b], column[a:b] - k * step] = 1
                common += grid @ grid.T
    links = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    if left is not None:
        links[:left, :left] = links[left:, left:] = False
    np.fill_diagonal(links, False)
    out, todo = [], np.ones(m, bool)
    for root in range(m):
        if todo[root]:
            todo[root] = False
            stack = [root]
            while stack:
                x = stack.pop()
                near = np.flatnonzero(links[x] & todo)
                todo[near] = False
                out += [(x, int(y)) for y in near]
                stack += near.tolist()
    return out


def _scan(docs: DataFrame, window: int):
    """Pass 1: kind 0: doc_id, set size and class of every row, and (once a window at least) the class's sketch; kind 1: shingles seen more than once in a window, with their counts."""

    def run(batches):
        held, size, names = [], 0, ["kind", "id", "n", "cid", "sketch"]

        def counted():
            t = np.concatenate(held)
            held.clear()
            t.sort()
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            c = np.diff(np.append(first, len(t)))
            t, c = t[first[c > 1]], c[c > 1]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(t), np.int8)), pa.array(t.view(np.int64)), pa.array(c.astype(np.int64)), pa.nulls(len(t), pa.int64()), pa.nulls(len(t), pa.binary())], names)

        seen: set = set()
        for b in batches:
            sets = shingle_sets(b.column(1))
            ids = [class_id(s) for s in sets]
            sketches = [sketch(s) if c not in seen and len(s) else None for s, c in zip(sets, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int8)), b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()), pa.array(sketches, pa.binary())], names)
            for s, c in zip(sets, ids, strict=True):
                if c not in seen and len(s):
                    seen.add(c)
                    held.append(s)
                    size += len(s)
                    if size >= window:
                        yield counted()
                        size, seen = 0, set()
        if held:
            yield counted()

    return docs.mapInArrow(run, "kind tinyint, id bigint, n bigint, cid bigint, sketch binary")


def _meet(docs: DataFrame, order, small: int, percent: int):
    """Pass 2: (key, cid, n), each class once a batch window."""

    def run(batches):
        o, seen = Order(*order.value), set()
        for b in batches:
            key, cid, n = [], [], []
            for s in shingle_sets(b.column(0)):
                if len(s) and (c := class_id(s)) not in seen:
                    seen.add(c)
                    k = keys_of(s, o, small, percent)
                    key.append(k)
                    cid.append(np.full(len(k), c, np.int64))
                    n.append(np.full(len(k), len(s), np.int32))
            if len(seen) > 1_000_000:
                seen.clear()
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(cid)), pa.array(np.concatenate(n))], ["key", "cid", "n"])

    return docs.mapInArrow(run, "key bigint, cid bigint, n int")


def shared_least(na, nb, percent: int = PERCENT):
    """How many of their list keys (k = 1 prefixes) two linked sets of sizes na and nb share at least.

    They share t = ceil(percent (na + nb) / (100 + percent)) shingles or more; the l-th of these stands within the
    first na - t + l of one set and nb - t + l of the other, hence within both prefixes for every l up to the result."""
    t = -(-percent * (na + nb) // (100 + percent))
    return np.minimum(t + 1 - need(na, percent), t + 1 - need(nb, percent))


def _lists(met: DataFrame, percent: int, short: int = SHORT, part: int = LIST):
    """What meets in the lists; ``met`` comes sorted by key, n, cid. kind 0: pairs (a, b, sizes) in lists of up to ``short`` classes, with m lists;
    kind 1: that class b, of size na, is in the longer list a, in its part m of ``part`` classes."""
    names = ["kind", "a", "b", "na", "nb", "m"]

    def out(kind, a, b, na, nb, m):
        k = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int8)), pa.array(a), pa.array(b), pa.array(na.astype(np.int32)), pa.array(nb.astype(np.int32)), pa.array(m.astype(np.int64))], names)

    def whole(k, c, n, done):
        """Complete lists; ``done``: the first one goes on one of which so many classes are out already, its first class here too."""
        new = np.concatenate([[True], k[1:] != k[:-1]])
        run = np.cumsum(new) - 1
        is_long = np.bincount(run) > short
        is_long[0] |= done > 0
        is_long = is_long[run]
        a, b, na, nb = [], [], [], []
        for d in range(1, min(short, len(k))):
            ok = np.flatnonzero((k[d:] == k[:-d]) & ~is_long[d:] & (n[:-d].astype(np.int64) * 100 >= n[d:].astype(np.int64) * percent))
            if not len(ok):
                continue
            x, y = c[ok], c[ok + d]
            swap = x > y
            a.append(np.where(swap, y, x)), b.append(np.where(swap, x, y)), na.append(np.where(swap, n[ok + d], n[ok])), nb.append(np.where(swap, n[ok], n[ok + d]))
        if a:
            a, b, na, nb = (np.concatenate(v) for v in (a, b, na, nb))
            by = np.lexsort((b, a))
            a, b, na, nb = a[by], b[by], na[by], nb[by]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            yield out(0, a[first], b[first], na[first], nb[first], np.diff(np.append(first, len(a))))
        place = np.arange(len(k)) - np.flatnonzero(new)[run] + np.where(run == 0, max(0, done - 1), 0)
        of = np.flatnonzero(is_long)[min(done, 1) :]
        if len(of):
            yield out(1, k[of], c[of], n[of], n[of], place[of] // part)

    def run(batches):
        k, c, n, done = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            k, c, n = (np.concatenate([x, y.to_numpy(zero_copy_only=False)]) for x, y in zip((k, c, n), batch.columns, strict=True))
            same = np.concatenate([[False], (k[1:] == k[:-1]) & (c[1:] == c[:-1])])  # a class that several tasks found
            k, c, n = k[~same], c[~same], n[~same]
            cut = int(np.searchsorted(k, k[-1]))
            if cut:
                yield from whole(k[:cut], c[:cut], n[:cut], done)
                k, c, n, done = k[cut:], c[cut:], n[cut:], 0
            if len(k) > 100_000:  # one list that doesn't end: it is a long one, and its last class is enough to go on
                yield from whole(k, c, n, done)
                k, c, n, done = k[-1:], c[-1:], n[-1:], max(0, done - 1) + len(k)
        if len(k):
            yield from whole(k, c, n, done)

    return met.mapInArrow(run, "kind tinyint, a bigint, b bigint, na int, nb int, m bigint")


def _pairs(lists: DataFrame, sketches: DataFrame, percent: int, small: int) -> DataFrame:
    """Pairs (a, b) of the short lists that share enough of their keys, and whose sketches let them link.

    A pair's long lists aren't counted, so as many as both are in are allowed for. Pairs that a small set is in meet on subsets, and one subset is enough."""
    pairs = lists.filter("kind = 0").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("m").alias("m"))
    held = lists.filter("kind = 1").groupBy("b").count()
    t = F.ceil((F.col("na") + F.col("nb")) * percent / (100.0 + percent) - 1e-9)
    least = lambda n: t + 1 - F.ceil(F.col(n) * percent / 100.0 - 1e-9)
    pairs = pairs.join(held.select(F.col("b").alias("a"), F.col("count").alias("ha")), "a", "left").join(held.withColumnRenamed("count", "hb"), "b", "left")
    enough = F.col("m") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) >= F.least(least("na"), least("nb"))
    pairs = pairs.filter(enough | (F.least("na", "nb") <= small)).select("a", "b", "na", "nb")
    pairs = pairs.join(sketches.select(F.col("cid").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("cid").alias("b"), F.col("sketch").alias("sb")), "b")

    def run(batches):
        for t in batches:
            if t.num_rows:
                na, nb = (t.column(i).to_numpy() for i in (2, 3))
                every = np.arange(t.num_rows)
                good = may_link(apart(words(t.column(4)), every, words(t.column(5)), every), na, nb, percent)
                yield t.select(["a", "b"]).filter(pa.array(good))

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _long(lists: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that join what the pairs within each of the longer lists join whose sketches let them link. Each pair of a list's parts goes to one task."""
    entries = lists.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("cid"), F.col("na").alias("n"), F.col("m").cast("int").alias("part"))
    parts = entries.filter("part > 0").groupBy("key").agg(F.max("part").alias("last"))
    every = F.sequence(F.lit(0), F.coalesce("last", F.lit(0)))
    tasks = entries.join(parts, "key", "left").select("key", "cid", "n", "part", F.explode(every).alias("other")).select("key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "n", "cid", "part")
    tasks = tasks.join(sketches, "cid").select("key", "x", "y", "n", "cid", "part", "sketch")
    tasks = tasks.repartition(n_parts(lists.sparkSession), "key", "x", "y").sortWithinPartitions("key", "x", "y", "n", "cid")

    def joined(t):
        x, y, n, cid, part = (t.column(i).to_numpy() for i in range(1, 6))
        group, kept, (one, other) = _groups(t), words(t.column(6)), ([], [])
        for d in range(1, t.num_rows):
            i = np.flatnonzero((group[d:] == group[:-d]) & (n[:-d].astype(np.int64) * 100 >= n[d:].astype(np.int64) * percent))
            if not len(i):
                break
            i = i[(x[i] == y[i]) | (part[i] != part[i + d])]
            i = i[may_link(apart(kept, i, kept, i + d), n[i], n[i + d], percent)]
            one.append(i), other.append(i + d)
        one, other, label = np.concatenate([*one, np.zeros(0, np.int64)]), np.concatenate([*other, np.zeros(0, np.int64)]), np.arange(t.num_rows)
        while True:  # each class to the first one that it is joined with
            low = label.copy()
            np.minimum.at(low, other, label[one])
            np.minimum.at(low, one, label[other])
            low = low[low]
            if (low == label).all():
                break
            label = low
        of = np.flatnonzero(label != np.arange(t.num_rows))
        a, b = cid[label[of]], cid[of]
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    def run(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if rest is None else [rest, b]).combine_chunks().to_batches()[0]
            cut = int(np.searchsorted(g := _groups(t), g[-1]))
            if cut:
                yield joined(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            yield joined(rest)

    return tasks.mapInArrow(run, "a bigint, b bigint")


def _groups(t) -> np.ndarray:
    """The number of each row's group of rows with equal first three columns."""
    key = [t.column(i).to_numpy() for i in range(3)]
    return np.cumsum(np.concatenate([[False], np.any([k[1:] != k[:-1] for k in key], axis=0)]))


def _sets(docs: DataFrame, bits):
    """Pass 3: cid and whole set of the rows whose ``bit`` is among ``bits`` (a Bloom filter of one hash)."""

    def run(batches):
        want, seen = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little"), set()
        for b in batches:
            of = np.flatnonzero(want[b.column(0).to_numpy(zero_copy_only=False)])
            if len(of):
                cid, out = [], []
                for s in shingle_sets(b.column(1).take(pa.array(of))):
                    if len(s) and (c := class_id(s)) not in seen:
                        seen.add(c)
                        cid.append(c)
                        out.append(s.tobytes())
                if cid:
                    yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(out, pa.binary())], ["cid", "s"])

    return docs.mapInArrow(run, "cid bigint, s binary")


def _verify(tasks: DataFrame, percent: int):
    """Links (a, b) of each pair of blocks; ``tasks`` (fam, x, y, block, cid, s) comes sorted by fam, x, y."""

    def solve(rows):
        rows.sort(key=lambda r: r[0])
        left = sum(r[0] == rows[0][0] for r in rows)
        return [(rows[i][1], rows[j][1]) for i, j in spanning([np.frombuffer(r[2], np.uint64) for r in rows], percent, left if left < len(rows) else None)]

    def run(batches):
        now, rows = None, []
        kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            out = []
            for fam, x, y, block, cid, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (fam, x, y) != now:
                    out += solve(rows) if rows else []
                    now, rows = (fam, x, y), []
                rows.append((block, cid, s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], schema=kind)
        if rows and (out := solve(rows)):
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], schema=kind)

    return tasks.mapInArrow(run, "a bigint, b bigint")


def bloom(spark, keys: DataFrame, count: int):
    """A broadcast bit array (2**16 to 2**27 bits, by ``count``) with the bit of each ``bit``-hash of ``keys`` (one column) set, and its size."""
    size = 1 << min(27, max(16, (16 * max(1, count)).bit_length()))
    return spark.sparkContext.broadcast(bit_array(keys.select(F.pmod(F.xxhash64(keys.columns[0]), F.lit(size))), size)), size


def least_count(histogram: list[tuple[int, int]], most: int) -> int:
    """The least count that at most ``most`` shingles reach; ``histogram``: (count, number of shingles), counts from 2**16 on by powers of two, each
    standing for all counts from it to below the next power."""
    kept = 0
    for c, k in sorted(histogram, reverse=True):
        if kept + k > most:
            return c + 1 if c < 65536 else 2 * c
        kept += k
    return 2


def jaccard_components(docs: DataFrame, percent: int = PERCENT, max_heavy: int = MAX_HEAVY, window: int = WINDOW, block: int = BLOCK, small: int | None = None, part: int = LIST) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text); see the module.

    Rows without words (null, empty or blank texts) have size 0 and are alone. Rows with fewer than five words have their
    whole sequence as one shingle. Rows with equal sets are linked, whatever their number. Repeated rows stay; null doc_ids
    count as larger than all others (a component of them alone has a null id). An empty table gives an empty one."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = written(_scan(docs, window), "scan")
    rows = scanned.filter("kind = 0").select(F.col("id").alias("doc_id"), "n", "cid")
    counts = written(scanned.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("c")), "counts")
    # how many shingles have each count (counts from 2**16 on in powers of two): a few thousand rows at most
    histogram = sorted(counts.groupBy(F.when(F.col("c") < 65536, F.col("c")).otherwise(F.pow(F.lit(2), F.floor(F.log2("c"))).cast("bigint")).alias("c")).count().collect())
    total = rows.agg(F.sum("n")).first()[0] or 0
    least = least_count(histogram, max_heavy)
    heavy = counts.filter(F.col("c") >= least).toPandas().sort_values("id")
    ids = heavy["id"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(ids)
    order = spark.sparkContext.broadcast((ids[by], heavy["c"].to_numpy(np.int64)[by]))
    small = boundary([(c, k) for c, k in histogram if c >= least], total, percent) if small is None else small
    met = _meet(docs.select("text"), order, small, percent)
    met = met.repartition(n_parts(spark), "key").sortWithinPartitions("key", "n", "cid")
    # many small rows instead of few large texts
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50_000)
    lists = written(_lists(met, percent, part=part), "lists")
    free(spark)
    sketches = written(scanned.filter("sketch is not null").groupBy("cid").agg(F.first("sketch").alias("sketch")), "sketches")
    edges = written(_pairs(lists, sketches, percent, small).union(_long(lists, sketches, percent)), "candidates")
    tune(spark)
    free(spark)
    family = components(edges, "families")
    drop(counts, lists, sketches, edges)
    free(spark)
    classes = rows.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"))
    large = family.groupBy("label").count().select("label", F.ceil(F.col("count") / block).cast("int").alias("nb"))
    member = written(
        family.join(large, "label").join(classes.withColumnRenamed("cid", "node"), "node")
        .select(F.col("node").alias("cid"), F.col("label").alias("fam"), "nb", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int").alias("block"), "rep"), "members", few=True,
    )
    bits, size = bloom(spark, member.select("rep"), member.count())
    sets = _sets(docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(size)).alias("bit"), "text"), bits)
    sets = sets.groupBy("cid").agg(F.first("s").alias("s")).join(member, "cid")
    # a class of block b takes part in the pairs (x, y), x <= y, with x = b or y = b
    every = F.sequence(F.lit(0), F.col("nb") - 1)
    tasks = sets.select("fam", "block", "cid", "s", F.explode(every).alias("other")).select("fam", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "cid", "s")
    tasks = tasks.repartition(n_parts(spark), "fam", "x", "y").sortWithinPartitions("fam", "x", "y")
    links = written(_verify(tasks, percent), "links")
    free(spark)
    group = components(links, "groups")
    top = F.lit((1 << 63) - 1)
    linked = classes.select("cid", F.coalesce("rep", top).alias("rep")).join(group.withColumnRenamed("node", "cid"), "cid")
    smallest = linked.groupBy("label").agg(F.min("rep").alias("component"))
    of_class = written(classes.join(group.withColumnRenamed("node", "cid"), "cid", "left").join(smallest, "label", "left").select("cid", F.coalesce("component", F.coalesce("rep", top)).alias("component")), "classes", few=True)
    drop(links, member, family, group)
    out = rows.join(of_class, "cid", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(F.col("component") != top, F.col("component")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op7_heavy_light_jaccard(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every whole text of ``documents``: components of links at 80 percent of 5-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"))
