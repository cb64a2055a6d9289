"""Operators of the llm subpackage against brute force, on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessellar.llm import chat, components, decontaminate, extract, hashing, jaccard, neighbours, pfor, pieces, sharding, toxicity, warc

tokenizers = pytest.importorskip("public_tokenizers")
WORDS = ["the", "Cat", "sat,", "on", "a", "mat.", "Über", "naïve", "x1", "don't", "…", "日本"]


def texts(n, seed=1):
    r = random.Random(seed)
    out = [None, "", "   ", "a", "The cat", "\x00\x1f odd blank x"]
    while len(out) < n - 2:
        out.append(" ".join(r.choice(WORDS) for _ in range(r.randint(1, 40))))
    return out + ["long " * 30_000, "x" * 20_000]


def docs(spark, rows=None, n=60):
    """doc_id, text and columns whose names operators use inside."""
    rows = list(enumerate(texts(n))) if rows is None else rows
    data = [(i, t, "s", 1.5, 7, [1], "x") for i, t in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, source string, score double, n bigint, ids array<int>, shard string")


EDGE = [(None, "null id"), (3, None), (3, None), (5, "again"), (5, "again"), (6, "")]


# ---------------------------------------------------------------- 1


def test_pfor_segments():
    r = np.random.default_rng(1)
    for ids in (np.zeros(0), np.zeros(1), r.integers(0, 50000, 255), r.integers(0, 50000, 256), np.where(r.random(5000) < 0.03, 2**32 - 1, r.integers(5, 90, 5000)), np.full(700, 2**32 - 1)):
        ids = ids.astype(np.uint32)
        data = pfor.encode_segment([4, None], [len(ids), 0], ids, 9)
        s = pfor.Segment(data)
        assert (s.ids() == ids).all() and s.start == 9 and s.doc_ids.tolist() == [4, pfor.NULL_ID]
        for a, b in ((0, 1), (250, 260), (len(ids) - 1, len(ids)), (3, 3)):
            assert (s.ids(max(0, a), b) == ids[max(0, a) : b]).all()


def test_token_files(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    rows = [*enumerate(texts(80)), (200, "J̌ İ É ΑΣ <|endoftext|> <|EndOfText|> it's IT'S a.b,c"), *EDGE]
    got = pfor.read_documents(pfor.write_segments(docs(spark, rows), tokenizers.path("word_bpe_49k.json"), 1)).collect()
    want, at = [], 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert pfor.read_documents(pfor.write_segments(docs(spark, []), tokenizers.path("word_bpe_49k.json"), 1)).count() == 0


def test_word_encoder_as_library():
    """Random texts of U+0020 to U+024F, combining marks, blanks and special tokens: alone, in batches, and with a memory that overflows."""
    path = tokenizers.path("word_bpe_49k.json")
    r = random.Random(3)
    plain = [chr(c) for c in (*range(0x20, 0x250), *range(0x300, 0x370))] + list(" \t\n'.,aA1İT\u0308") * 15 + ["日", "한", "Σ", "\u00a0", "\u3000", "\u212a", "\x00", "\x1c"]
    whole, little = pfor.WordEncoder(path), pfor.WordEncoder(path)
    little.ids = type(little.ids)(little._word, 64, lower=True)
    want = lambda t: whole.t.encode(t or "", add_special_tokens=False).ids
    for turn in range(120):
        alphabet = plain + ["<|", "<|endoftext|>", "<|EndOfText|>"] * (turn % 2 * 20)
        batch = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(50)]
        batch += [None, "", "İw", "İ| x", "x" * 20, "a" * 15, "a" * 16, "a\x00", "a", "A\u0308 T\u0308x"]
        for e in (whole, little):
            ids, n = e.encode(pa.array(batch, pa.string()))
            cuts = np.concatenate([[0], np.cumsum(n)])
            assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [want(t) for t in batch]
            for t in batch[:5]:
                assert e.encode(pa.array([t], pa.string()))[0].tolist() == want(t)


# ---------------------------------------------------------------- 2


def sw(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment():
    r = np.random.default_rng(5)
    for _ in range(60):
        a, b = r.integers(0, 5, r.integers(1, 12)), r.integers(0, 5, r.integers(1, 30))
        assert decontaminate.align(a, b)[0] == sw(a.tolist(), b.tolist())


def test_decontamination(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    item = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (20, 40, 2)]
    noise = lambda n: [r.choice(vocabulary) for _ in range(n)]
    edited = item[1].split()
    for k in range(3, 40, 9):
        edited[k] = "changed"
    rows = [(1, " ".join(noise(100) + item[0].upper().split() + noise(5000))), (2, " ".join(noise(9) + edited)), (3, " ".join(noise(300))), (4, None), (5, ""), (None, item[0]), (7, ", ".join(item[0].split())), (7, ", ".join(item[0].split())), (8, "so, " + item[2] + "!")]
    rows += [(100 + k, " ".join(noise(3) + item[0].split())) for k in range(50)]  # a hot leak keeps its seeds
    items = spark.createDataFrame([(0, item[0]), (1, item[1]), (2, None), (3, ""), (4, item[2]), (9, item[0])], "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x for x in decontaminate.contaminated(docs(spark, rows), items).collect()}
    want = {(d, i) for d in (1, None, 7, *range(100, 150)) for i in (0, 9)} | {(2, 1), (8, 4)}
    assert set(got) == want and got[1, 0].begin == 100 and got[1, 0].end == 120 and got[2, 1].score > 0.7
    assert decontaminate.contaminated(docs(spark, []), items).count() == 0
    assert decontaminate.contaminated(docs(spark, rows), items.limit(0)).count() == 0


@pytest.mark.parametrize("exact", [0, 1, 5, 50])
def test_edited_copy_beside_exact_ones(spark, exact):
    """Fewer than half of the item's 3-grams survive the edits, and exact copies hold all of them."""
    r = random.Random(9)
    item = [f"w{r.randint(0, 999)}" for _ in range(40)]
    edited = [f"changed{k}" if k % 5 == 4 else w for k, w in enumerate(item)]
    noise = lambda: [f"w{r.randint(0, 999)}" for _ in range(30)]
    rows = [(1, " ".join(noise() + edited + noise())), (2, " ".join(noise()))] + [(100 + k, " ".join(noise() + item)) for k in range(exact)]
    items = spark.createDataFrame([(0, " ".join(item))], "item_id bigint, text string")
    got = {x.doc_id: x.score for x in decontaminate.contaminated(docs(spark, rows), items).collect()}
    assert set(got) == {1, *range(100, 100 + exact)} and 0.65 < got[1] < 0.75


def test_seeds_are_rare_and_pairs_few(spark, monkeypatch):
    """A phrase that all items hold is no seed of any; items made of such phrases alone keep their rarest ones; a hot phrase pairs nothing. Both joins find the same."""
    r = random.Random(12)
    common = "these words stand in every single item of all".split()
    items_ = [" ".join([f"i{k}x{j}" for j in range(12)] + common + [f"e{k}x{j}" for j in range(12)]) for k in range(30)] + [" ".join(common)] * 2 + ["a b c d e f", "a b c d e g", "a b c d e h", "a b c d e i"]
    items = spark.createDataFrame(list(enumerate(items_)), "item_id bigint, text string")
    rows = [(k, " ".join([f"x{r.randint(0, 99)}" for _ in range(20)] + common[:7] + [f"y{r.randint(0, 99)}" for _ in range(20)])) for k in range(60)]
    rows += [(100 + k, f"so {t} it is") for k, t in enumerate(items_)]
    known = decontaminate.item_grams(items).withColumn("t", F.xxhash64("words"))
    seeds = decontaminate.seeds_of(known)
    assert seeds.select("t").distinct().count() == 35 and seeds.groupBy("t").count().agg(F.max("count")).first()[0] <= 30
    met = []
    keep = decontaminate.shared_seeds
    monkeypatch.setattr(decontaminate, "shared_seeds", lambda *a: met.append(keep(*a)) or met[-1])
    want = None
    for few in (decontaminate.FEW_SEEDS, 1):
        monkeypatch.setattr(decontaminate, "FEW_SEEDS", few)
        got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs(spark, rows), items).collect()}
        assert met[-1].count() < 36 * 8 + 60
        assert {(100 + k, k) for k in range(len(items_))} <= got and want in (None, got)
        want = got
    assert {d for d, i in got if d < 100} <= set(range(60)) and {i for d, i in got if d < 100} <= {30, 31}


@pytest.mark.parametrize(("changed", "least"), [(0.1, 1.0), (0.2, 1.0), (0.25, 0.9)])
def test_recall_by_edit_rate(spark, changed, least):
    """Copies of 60-word items with a share of the words replaced at random places, inside other text: nearly all whose alignment reaches the threshold are found."""
    r = random.Random(int(changed * 100))
    items_ = [[f"w{r.randint(0, 3000)}" for _ in range(60)] for _ in range(20)]
    rows, reach = [], set()
    for k in range(200):
        item = items_[k % 20]
        copy = list(item)
        for at in r.sample(range(60), round(60 * changed)):
            copy[at] = f"w{r.randint(0, 3000)}"
        text = [f"w{r.randint(0, 3000)}" for _ in range(40)] + copy + [f"w{r.randint(0, 3000)}" for _ in range(40)]
        number = lambda x: np.array([int(w[1:]) for w in x], np.int64)
        if decontaminate.align(number(item), number(text))[0] >= decontaminate.THRESHOLD * 120:
            reach.add((k, k % 20))
        rows.append((k, " ".join(text)))
    items = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items_)], "item_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs(spark, rows), items).collect()}
    assert got <= reach and len(got) >= least * len(reach) > 0
    print(changed, len(got), len(reach))


def test_unreachable_pairs_only():
    r = np.random.default_rng(8)
    seen = set()
    for _ in range(600):
        a, b = r.integers(0, 12, r.integers(1, 12)), r.integers(0, 12, r.integers(1, 60))
        for t in (0.3, 0.5, 0.8):
            able, does = decontaminate.may_reach(a, b, t), decontaminate.align(a, b)[0] >= t * 2 * len(a)
            assert able or not does
            seen.add((able, does))
    assert len(seen) == 3


# ---------------------------------------------------------------- 3


def test_ftrl(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(30)) + (" vile brute" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (7, None), (5000, 1), (8, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs(spark, rows), labels)
    assert 0 < len(model[0]) < 5000
    got = toxicity.score(docs(spark, rows + [(900, None), (901, ""), (None, "vile brute")]), model).select("doc_id", "score").collect()
    assert all((x.score >= 0.5) == (x.doc_id is None or (x.doc_id % 4 == 0 and x.doc_id < 900)) for x in got)
    assert toxicity.score(docs(spark, []), model).count() == 0
    untrained = toxicity.train(docs(spark, rows), labels.limit(0))
    assert toxicity.score(docs(spark, rows[:1]), untrained).first().score == 0.5


def test_ftrl_learns_from_whole_texts(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(6000)) + (" vile brute" if i % 4 == 0 else "")) for i in range(80)]
    assert min(len(t) for _, t in rows) > 20_100
    model = toxicity.train(docs(spark, rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id bigint, toxic int"))
    got = {x.text: x.score for x in toxicity.score(docs(spark, [(0, "the vile brute"), (1, "the cat sat")]), model).collect()}
    assert got["the vile brute"] > got["the cat sat"]


def plain_ftrl(rows, labels, bits, alpha, beta, l1, l2, epochs):
    """FTRL-proximal one coordinate at a time, as it is defined."""
    z, n, order = {}, {}, np.random.default_rng(7)
    last = 1 << bits

    def weight(i):
        penalty = 0 if i == last else l1
        return 0.0 if abs(z.get(i, 0)) <= penalty else -(z[i] - math.copysign(penalty, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at = [*rows[k], last]
            w = [weight(i) for i in at]
            g = 1 / (1 + math.exp(-sum(w))) - labels[k]
            for i, wi in zip(at, w):
                sigma = (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / alpha
                z[i], n[i] = z.get(i, 0) + g - sigma * wi, n.get(i, 0) + g * g
    return {i: w for i in z if (w := weight(i))}


def test_ftrl_against_plain():
    r = np.random.default_rng(3)
    rows = [np.unique(r.integers(0, 64, 12)).astype(np.uint32) for _ in range(150)]
    labels = np.array([float(5 in x or 9 in x) for x in rows])
    at, w, bias = toxicity.fit(rows, labels, 6, 0.5, 1.0, 0.8, 0.3, 3)
    want = plain_ftrl([x.tolist() for x in rows], labels, 6, 0.5, 1.0, 0.8, 0.3, 3)
    assert {**dict(zip(at.tolist(), w)), 64: bias} == pytest.approx(want) and 3 < len(at) < 64


def test_ftrl_never_learns_held_out_rows(spark, tmp_path):
    """Held-out rows alone carry the sign of label 1: a model that learned from them would know it."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(20)) + (" vile brute" if held(i) else "")) for i in range(500)]
    docs(spark, [*rows, (None, "vile brute"), (None, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(held(i))) for i, _ in rows], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op3_ftrl_toxicity(spark, str(tmp_path))
    assert [f"{c} {t}" for c, t in got.dtypes] == ["doc_id bigint", "held_out boolean", "score double", "predicted int"]
    got = got.collect()
    assert len(got) == 502 and all(x.held_out == (x.doc_id is not None and held(x.doc_id)) and x.predicted == int(x.score >= 0.5) and 0 <= x.score <= 1 for x in got)
    with_sign = [x.score for x in got if x.held_out]
    assert max(with_sign) < 0.5


# ---------------------------------------------------------------- 4


def test_hash_tree(spark):
    rows = [*((i, f"t{i % 50}") for i in range(2000)), *EDGE]
    tree = sharding.Tree.of(16)
    got = sharding.place(docs(spark, rows), tree, tree.grown()).collect()
    assert len(got) == len(rows) and all(x.grown_shard in (x.shard, 16) for x in got)
    assert 50 < sum(x.grown_shard == 16 for x in got) < 200
    for s in range(16):
        slots = sorted(x.slot for x in got if x.shard == s)
        assert slots == list(range(len(slots))) and 60 < len(slots) < 200
    assert len({x.shard for x in got if x.doc_id == 5}) == 1
    assert all(x.text_crc32 == zlib.crc32((dict(rows)[x.doc_id] or "").encode()) for x in got if x.doc_id and x.doc_id > 6)
    assert sharding.place(docs(spark, []), tree).count() == 0
    # rows move only to subtrees whose weights grew: region 0 with its new shard
    wide = tree.add_to_rack("rack1")
    k = F.col("id")
    moved = spark.range(4000).select(sharding.shard_of(k, tree).alias("a"), sharding.shard_of(k, wide).alias("b")).filter("a <> b").collect()
    assert moved and all(x.b < 8 or x.b == 16 for x in moved)


# ---------------------------------------------------------------- 5


def test_pieces_as_library(spark, tmp_path, monkeypatch):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    model = pieces.default_model()
    more = ["Hello  world", " a", "a\nb\t c", "é€🙂𐍈", "<s> x </s>", "ﬁ Ⅳ ½ Å", "▁x ▁", "tail ", " " * 40 + "x" + " " * 31, "½a a½. ½. __init__ 12.5%", "กำ 中文 한국어", "²." * 9, "a" * 700, "  the   the", "   ---  --", "<0x41>"]
    r = random.Random(2)
    more += ["".join(r.choice("aeinst  lor▁") for _ in range(r.randint(1, 60))) for _ in range(150)]
    rows = [*enumerate(texts(40) + more, 10), *EDGE]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    stored = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for size in (pieces.CHUNK_BYTES, 3000):  # a chunk a task, and hundreds
        monkeypatch.setattr(pieces, "CHUNK_BYTES", size)
        out = pieces.decode(pieces.encode(stored, model), model)
        assert out.columns == ["doc_id", "text", "source", "score", "n", "shard", "ids", "decoded"]
        got = out.collect()
        assert sorted((x.doc_id is not None, x.doc_id, x.text is not None, x.text) for x in got if x.doc_id is not None and x.text is not None) == sorted((True, i, True, t) for i, t in rows if i is not None and t is not None)
        assert len(got) == len(rows)
        for x in got:
            assert x.ids == sp.encode(x.text or "") and x.decoded == (x.text or "").replace("▁", " ")
    full = pieces.op5_piece_lattice(spark, str(tmp_path)).collect()
    assert len(full) == len(rows)
    by_id = {i: t or "" for i, t in rows if i is not None and i >= 10}
    for x in full:
        if x.doc_id in by_id:
            want = sp.encode(by_id[x.doc_id])
            assert (x.n_pieces, x.ids_crc32, x.round_trip) == (len(want), zlib.crc32(np.array(want, "<i4").tobytes()), "▁" not in by_id[x.doc_id])
    assert pieces.encode(docs(spark, []), model).count() == 0


@pytest.mark.parametrize("at_once", [16384, 300])
def test_neighbour_rule_as_merging(monkeypatch, at_once):
    """Exactly one path of edges that may follow each other reaches each end, and that to the last one is what merging gives."""
    monkeypatch.setattr(pieces, "AT_ONCE", at_once)
    m = pieces.load(pieces.default_model())
    table, ids, tails, heads = m.table()
    rank, r = dict(zip(table["piece"], table["rank"])), random.Random(1)
    words = [" " + "".join(r.choice("thanginesorld") for _ in range(r.randint(1, 14))) for _ in range(400)] + ["a" * n for n in range(2, 40)] + ["xxaabb" * 7]
    edges = [sorted((e << 40) | (s << 20) | rank[w[s:e]] for s in range(len(w)) for e in range(s + 1, min(len(w), s + m.longest) + 1) if w[s:e] in rank) for w in words]
    offsets = np.cumsum([0, *map(len, edges)])
    after = pieces.followed(np.array([x for es in edges for x in es], np.int64), offsets, tails, heads).tolist()
    for k, w in enumerate(words):
        best = {0: (0, [])}
        for x, may in zip(edges[k], after[offsets[k] : offsets[k + 1]]):
            e, s = x >> 40, x >> 20 & (1 << 20) - 1
            if s in best and may >> best[s][0] & 1:
                assert e not in best
                best[e] = e - s, [*best[s][1], int(ids[x & (1 << 20) - 1])]
        assert best[len(w)][1] == [m.id[p] for p in m.merge(w.replace(" ", "▁"))[0]]


def test_pieces_refuse_rows_that_changed(spark):
    """A chunk whose words are others when it is read again isn't put together."""
    m = pieces.load(pieces.default_model())
    one, two = pieces.Chunk(m), pieces.Chunk(m)
    kept = pa.RecordBatch.from_arrays([pa.array([1])], ["doc_id"])
    one.add(["some words here"], kept), two.add(["other words there"], kept)
    sent, to, _ = one.closed()
    ids = [np.array([m.id["▁"]] * 1, np.int32) for _ in sent]
    found = pieces._pack(pieces._planes(np.diff(np.array(to), prepend=0)), pieces._planes(np.array([len(x) for x in ids])), pieces._planes(np.concatenate(ids)))
    with pytest.raises(pieces.Changed):
        pieces._in_place(two.closed()[2], [found], m)


# ---------------------------------------------------------------- 6


def test_fixity(spark):
    rows = [(i, f"http://h/{i % 7}", f"<p>{i}" * (i % 50)) for i in range(300)] + [(None, None, None), (3, "u", "x"), (3, "u", "x"), (4, "a\r\nb", "é" * 10_000)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id bigint, url string, html string, archive int, hash string")
    a = warc.archive(pages, 40).cache()
    recs = a.collect()
    assert len(recs) == len(rows)
    for x in recs:
        head, _, rest = bytes(x.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and int(head.rpartition(b"Content-Length: ")[2]) == len(rest) - 4 and x.length == len(x.record)
    for k in {x.archive for x in recs}:
        own = sorted((x for x in recs if x.archive == k), key=lambda x: x.record_no)
        assert [x.offset for x in own] == [sum(y.length for y in own[:i]) for i in range(len(own))]
    b = warc.damaged(a, 20)
    la, lb = warc.leaves(a), warc.leaves(b)
    n = warc.depth(40)
    assert max(Counter(x.archive for x in recs).values()) <= 40
    got = {(x.archive, x.node) for x in warc.audit(warc.tree(la, n), warc.tree(lb, n), n).collect()}
    other = {(x.archive, x.record_no): bytes(x.record) for x in b.collect()}
    assert got == {(x.archive, x.record_no) for x in recs if other[x.archive, x.record_no] != bytes(x.record)} and got
    assert warc.audit(warc.tree(la, n), warc.tree(la, n), n).count() == 0
    gone = (min(x.archive for x in recs), 0)  # a record, and a whole archive, that one replica lost
    other = la.filter(f"not (archive = {gone[0]} and node = 0) and archive <> {max(x.archive for x in recs)}")
    lost = {(x.archive, x.node) for x in warc.audit(warc.tree(la, n), warc.tree(other, n), n).collect()}
    assert lost == {gone} | {(x.archive, x.record_no) for x in recs if x.archive == max(y.archive for y in recs)}
    repeated = spark.createDataFrame([(1, "u", "same")] * 100, "page_id bigint, url string, html string")
    assert sorted(Counter(x.archive for x in warc.archive(repeated, 40).collect()).values()) == [20, 40, 40]
    assert warc.archive(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- 7


def brute(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            up[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    low = lambda g: min((d for d in g if d is not None), default=None)
    return sorted(((d, len(s), low(groups[find(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize("small,max_heavy", [(None, 400_000), (0, 400_000), (60, 0), (25, 10)])
def test_jaccard(spark, small, max_heavy):
    r = random.Random(6)
    base = [[f"v{r.randint(0, 300)}" for _ in range(n)] for n in (3, 5, 6, 9, 12, 24, 30, 60, 61, 150, 400)]
    rows = [*enumerate(texts(20)), *((i + 500, t) for i, t in enumerate(["A b c d e", "a B c d E", "a b c d e f"])), *EDGE]
    passage = [f"p{i}" for i in range(60)]
    for k in range(160):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            w[r.randrange(len(w))] = f"e{k}"
        if k % 5 == 0:
            w = [f"q{k}_{i}" for i in range(r.randint(40, 90))] + passage
        rows.append((1000 - k, " ".join(w)))
    got = jaccard.jaccard_components(docs(spark, rows), small=small, max_heavy=max_heavy, window=2000, block=12)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0


def test_shared_least():
    for a, b in itertools.product(range(1, 80), repeat=2):
        if 100 * min(a, b) >= 80 * max(a, b):
            worst = min(o for o in range(min(a, b) + 1) if 100 * o >= 80 * (a + b - o))
            assert jaccard.shared_least(a, b) <= worst - (a - jaccard.need(a) + 1 <= 0) and jaccard.shared_least(a, b) >= 1


def test_least_count():
    """Replays a bucket of counts that overflows the bound: none of its shingles may be broadcast."""
    assert jaccard.least_count([(2, 10), (131072, 500_000)], 400_000) == 262144
    assert jaccard.least_count([(2, 500_000), (3, 100_000), (65536, 10)], 400_000) == 3
    assert jaccard.least_count([(3, 7)], 400_000) == 2


def test_word_hashes():
    t = [*texts(40), "É é", "Aa aA"]
    w, known = hashing.Words(pa.array(t)), {}
    for i, x in enumerate(t):
        words = (x or "").encode().replace(b"\xff", b"").split()
        words = [bytes(c + 32 if 65 <= c <= 90 else c for c in q) for q in words]
        got = w.hash[w.first[i] : w.first[i + 1]]
        assert len(got) == len(words) and all(known.setdefault(q, h) == h for q, h in zip(words, got))
    assert len(set(known.values())) == len(known)


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    got = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    assert got == {x: find(x) for x in up}


# ---------------------------------------------------------------- 8


def test_neighbours(spark):
    r = np.random.default_rng(9)
    e = r.standard_normal((900, 12))
    rows = [(i, x.tolist()) for i, x in enumerate(e)] + [(1000 + i, e[100].tolist()) for i in range(30)] + [(1000, e[100].tolist())]
    rows += [(2000, None), (2100, [0.0] * 12), (2200, [1.0, None] + [0.0] * 10), (2300, [float("nan")] * 12), (2400, [float("inf")] * 12), (2500, [1.0]), (None, e[0].tolist())]
    t = spark.createDataFrame([(*x, 1.0, 2) for x in rows], "vec_id bigint, embedding array<float>, score double, rank int")
    got = neighbours.nearest(t, F.col("vec_id") % 100 == 0, 10, chunk=150, trees=3, rounds=4).collect()
    full = {i: np.array(v, np.float32).astype(float) for i, v in rows[:931]}
    ids = np.array(sorted(full))
    m = np.stack([full[i] for i in ids])
    hit, queries = 0, {x.query_id for x in got}
    assert queries == {i for i in full if i % 100 == 0}
    for q in queries:
        own = sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)
        d = np.sqrt(((m - full[q]) ** 2).sum(axis=1))
        assert [x.rank for x in own] == list(range(1, 11)) and all(x.score == d[np.searchsorted(ids, x.vec_id)] for x in own)
        assert [(x.score, x.vec_id) for x in own] == sorted((x.score, x.vec_id) for x in own) and q not in [x.vec_id for x in own]
        d[ids == q] = np.inf
        hit += len({x.vec_id for x in own} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hit >= 0.95 * 10 * len(queries)
    assert neighbours.nearest(t.limit(0), F.lit(True)).count() == 0
    few = neighbours.nearest(t.filter("vec_id in (1, 2, 2000)"), F.lit(True)).collect()
    assert {(x.query_id, x.vec_id) for x in few} == {(1, 2), (2, 1)}


# ---------------------------------------------------------------- 9


def test_template_language():
    run = lambda s, **v: "".join(t for t, _ in chat.compile_template(s)(**v))
    assert run("a{{ 1 + 2 * 3 }}b{% if x %}y{% elif z is defined %}z{% else %}n{% endif %}", z=0) == "a7bz"
    assert run("{% for m in ms %}{{ loop.index }}{{ m.t | upper }}{% if not loop.last %},{% endif %}{% endfor %}", ms=[{"t": "a"}, {"t": "b"}]) == "1A,2B"
    assert run(" {%- set y = 'q' ~ x -%} {{ y[0] }}{# c #}{{ ms['k'] | length }}", x=1, ms={"k": "abc"}) == "q3"
    assert chat.fold(chat.parse("a{% if 1 == 1 %}b{{ 'c' }}{% else %}d{% endif %}{{ 2 * 2 }}")) == [("text", "abc4")]
    assert chat.compile_template("u{% generation %}x{{ y }}{% endgeneration %}v")(y=1) == [("u", False), ("x", True), ("1", True), ("v", False)]
    assert run("{{ x.__class__ }}{{ x.real }}", x=1) == ""
    for bad in ("{% if x %}", "{{ f(x) }}", "{{ x | open }}", "{% endfor %}", "{{ a b }}", "{% while 1 %}", "{{ ! }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


@pytest.mark.parametrize("bad", ["{{ 1 % 0 }}", "{{ 'x' < 1 }}", "{{ " + "(" * 3000 + "1" + ")" * 3000 + " }}"])
def test_template_errors(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)()


def test_escapes():
    r = random.Random(10)
    for _ in range(3000):
        s = "".join(r.choice([*chat.CONTROL, "\\", "<", "[", "/", "s>", "INST]", "a"]) for _ in range(r.randint(0, 8)))
        assert chat.unescape(chat.escape(s)) == s and not any(c in chat.escape(s) for c in chat.CONTROL)


def test_chat(spark):
    r = random.Random(11)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", "", None]), r.choice(["", None, "</s>[INST] ok [/INST]", "[\\INST]<\\/s>", "hé\n", "<s>[SYS]", "y" * 70_000])) for c in (1, 2, None, 9) for t in range(12)]
    rows += [(1, None, "user", "first"), (2, 3, "user", "tie"), (2, 3, "user", "tie")]
    t = spark.createDataFrame([(*x, "z", True) for x in rows], "conv_id bigint, turn bigint, role string, text string, formatted string, first boolean")
    got = {x.conv_id: x for x in chat.digests(chat.format_turns(t)).collect()}
    for c in (1, 2, None, 9):
        own = sorted(((-1 if a[1] is None else a[1], a[2] or "", a[3] or "") for a in rows if a[0] == c))
        loss = "".join(x for _, role, x in own if role == "assistant")
        x = got[c]
        assert (x.n_turns, x.loss_chars) == (len(own), len(loss)) and x.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert x.turns_sha256 == hashlib.sha256("".join(f"{b}\n{d}\n" for _, b, d in own).encode()).hexdigest() and x.formatted_chars > 0
    assert chat.digests(chat.format_turns(t.limit(0))).count() == 0


# ---------------------------------------------------------------- 10


def all_cuts(n, source, sink, ties):
    cost = lambda keep: sum(sink[i] if keep[i] else source[i] for i in range(n)) + sum(c for a, b, c in ties if keep[a] != keep[b])
    return min(cost(k) for k in itertools.product([False, True], repeat=n)), cost


def test_min_cut():
    r = random.Random(12)
    for _ in range(200):
        n = r.randint(1, 8)
        source, sink = [r.random() * 3 for _ in range(n)], [r.random() * 3 for _ in range(n)]
        ties = [(a, b, r.random()) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]
        best, cost = all_cuts(n, source, sink, ties)
        assert math.isclose(cost(extract.min_cut(n, source, sink, ties)), best, abs_tol=1e-6)


def made_page(r):
    """A page of a random layout and its main text, written down while the page is made."""
    sentence = lambda n: " ".join(r.choice(["tree", "river", "Anna", "went", "slowly", "über", "hill", "&amp;", "old"]) for _ in range(n)) + r.choice([".", "!", "?"])
    want, body, plain = [], [], lambda s: s.replace("&amp;", "&")

    def add(html, *texts):
        body.append(html)
        want.extend(plain(t) for t in texts)

    title = sentence(5)
    add(f"<h1>{title}</h1>", title)
    for _ in range(r.randint(2, 7)):
        t = sentence(r.choice([1, 2, 12, 30, 60]))
        kind = r.choice(["p", "p", "p", "ul", "table", "quote", "figure", "linked", "split"])
        if kind == "ul":
            u = sentence(3)
            add(f"<ul><li>{t}</li><li>{u}</li></ul>", t, u)
        elif kind == "table":
            add(f"<table><tr><td>{t}</td><td>7</td></tr></table>", t, "7")
        elif kind == "figure":
            add(f"<figure><img src=x><figcaption>{t}</figcaption></figure>", t)
        elif kind == "quote":
            add(f"<blockquote><p>{t}</p></blockquote>", t)
        elif kind == "split":
            add(f"<p>{t}<br>\n <b>x</b>  <i>y</i></p>", f"{t} x y")
        else:
            add(f"<p><a href=/q>{t}</a></p>" if kind == "linked" else f"<p>{t}</p>", t)
        if r.random() < 0.3:
            body.append(r.choice(["<div class='ad'>Buy it now.</div>", "<script>var p='<p>no</p>'</script>", "<aside><p>Aside words stand here.</p></aside>", "<style>p{}</style>", "<div class='share-buttons'><a href=/f>Share</a></div>"]))
    wrapper = r.choice(["<article>{}</article>", "<main>{}</main>", "<article class='post'><div><div>{}</div></div></article>", "<div class='content'>{}</div>", "<main><article>{}</article></main>"])
    menu = r.choice(["<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>", "<div class='menu'><a href=/>Home</a> <a href=/n>News</a></div>", "<header><h2>Site</h2></header>"])
    end = "".join(r.sample(["<footer>© site. All rights reserved</footer>", "<section id='comments'><p>I liked to read all of this very much, thank you.</p></section>", "<form><label>Mail</label> <input><button>Go</button></form>", "<div class='sidebar'><p>Read the other ones too.</p></div>", "<div role='alert'>We use cookies.</div>"], 3))
    return f"<html><head><title>T</title></head><body class='has-sidebar'>{menu}{wrapper.format(''.join(body))}{end}</body></html>", "\n\n".join(want)


def test_extraction_of_made_pages(spark):
    r = random.Random(13)
    made = [made_page(r) for _ in range(120)]
    t = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(made)], "page_id bigint, url string, html string")
    weights = extract.fit(t)
    got = {x.page_id: x.text for x in extract.extract(t, weights).collect()}
    assert [got[i] for i in range(len(made))] == [x for _, x in made]
    changed = 0
    for h, _ in made:
        keep, alone = extract.labels(extract.Page(h), weights)
        changed += any(k != (a > 0) for k, a in zip(keep, alone))
    assert changed > 60  # the cut, not the classifier alone, decides


def test_extraction_fit_is_the_optimum(spark):
    """Newton's sums by task give the weights that a plain optimiser finds."""
    r = random.Random(14)
    made = [made_page(r)[0] for _ in range(60)]
    t = spark.createDataFrame([(i, "u", h) for i, h in enumerate(made)] + [(None, None, None)], "page_id bigint, url string, html string")
    x, y = (np.concatenate(z) for z in zip(*map(extract.sure_blocks, made)))
    w = extract.fit(t)
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + extract.RIDGE / 2 * ((w - extract.PRIOR) ** 2).sum()
    assert all(loss(w) < loss(w + d) for d in 0.01 * np.random.default_rng(1).standard_normal((200, len(w))))
    assert (extract.fit(t.limit(0)) == extract.PRIOR).all()


LINE = "It is a long sentence with enough words in it to be the text of an article for sure."


@pytest.mark.parametrize("part", ["<div>x", "<b>x", "<div><nav>x", '<a "', "<p>a <a>b</a>", "<li>x", "<span class=ad>x", "<p>a<span class=ad>x</span>b", "<b hidden>x</b>y", "<article>x</article><nav>y</nav>", "<form><div class=ad>", "<!--", "&amp", "<td>"])
def test_extraction_of_deep_pages(part):
    took = []
    for n in (4000, 16_000):
        began = time.process_time()
        extract.main_text(part * n)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><p>Words of it.</p><figure><figcaption>Caption</figcaption></figure><p class='tags'>tags: a</p><section id='related'><p>And this.</p></section></article>", ["Words of it.", "Caption", "tags: a", "And this."]),
        ("<form><div><h1>Head</h1><p>A page in one form, as some servers make them all.</p></div><input></form>", ["Head", "A page in one form, as some servers make them all."]),
        ("<div class='layout no-sidebar'><article><p>Kept.</p></article></div>", ["Kept."]),
        (f"<h2><a aria-hidden=true>#</a> Heading of the section</h2><p>{LINE}</p><p>{LINE}</p>", ["Heading of the section", LINE, LINE]),
        ("<p>See the <em class=menu-item>soup</em> of the day in our kitchen, which is made of many things.</p>", ["See the soup of the day in our kitchen, which is made of many things."]),
        (f"<article><p>{LINE}</p><h2>Head <a class=anchor aria-hidden='true' href='#x'>¶</a></h2><p>Two <span class=ad>Buy now</span> three words<sup class='footnote'><a href='#1'>1</a></sup> and <i class='icon share-icon' aria-hidden=true>x</i>more.</p></article>", [LINE, "Head", "Two three words1 and more."]),
        (f"<article><p>{LINE}</p><section class='ad-hoc'><p>{LINE} 2</p></section><section class=menu><p>{LINE} 3</p></section><p class='login-note'>Readers who log in can see all of the figures of this text.</p><ul class=menu><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul><div class=ad>{LINE}</div></article>", [LINE, f"{LINE} 2", f"{LINE} 3", "Readers who log in can see all of the figures of this text."]),
        (f"<article><p>{LINE}</p><p>A<span class=ad>x</span>B <b><span class=ad>y<b>z</b></span></b>C</p><p><span class=ad>only</span></p><p>{LINE}</p></article>", [LINE, "AB C", LINE]),
        (f"<article><p>{LINE}</p><div>One <span class=banner>two <div>three</div></span> four</div><p>{LINE}</p></article>", [LINE, "One", "four", LINE]),
        ("<div><p>One has some words that stand here.</p><p>Two has some words.</p></div><ol class='comment-list'><li><article><p>A reader wrote all of this here.</p></article></li></ol>", ["One has some words that stand here.", "Two has some words."]),
    ],
)
def test_extraction_keeps_the_article(page, want):
    assert extract.main_text(page).split("\n\n") == want


def test_extraction(spark):
    p = "<p>{} is a paragraph that is long enough to be content for all readers, surely.</p>"
    page = f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><!-- x --><div class='ad'>Buy this now, it is a long advert with many words in it.</div><article><h1>Head &amp; line</h1>{p.format('One')}<p>Two<br>lines\n\n here &lt;b&gt; &copy;<p>Short.</p></article><div class='comments'>{p.format('Comment')}</div><form><p>Join us today please.</p></form><aside>{p.format('Side')}</aside><footer>&copy; me</footer></body></html>"
    want = "\n\n".join(["Head & line", "One is a paragraph that is long enough to be content for all readers, surely.", "Two lines here <b> ©", "Short."])
    cut = page[: page.index("<p>Short") + 3]
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<script>only</script>"), (None, "u", page), (1, "u", page), (7, "u", cut), (8, "u", "<p>" + "long words again. " * 20_000), (9, "u", "<" * 50 + "<div class=x id='" + "<p" * 20)]
    t = spark.createDataFrame([(*x, "t", 5) for x in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = [(x.page_id, x.text, x.n_chars) for x in extract.extract(t).collect()]
    assert got[0] == got[5] == (1, want, len(want)) and got[4][1] == want
    assert [x[1] for x in got[1:4]] == ["", "", ""] and got[6][1] == want.removesuffix("\n\nShort.") and got[7][2] == len("long words again. " * 20_000) - 1
    assert extract.extract(t.limit(0)).count() == 0
