"""Every query and pipeline stage on tables with nulls, empties, repeats, ties, clashing columns, and without rows."""

import hashlib
import importlib.util
import random
import zlib

import pytest

pytest.importorskip("public_tokenizers")

from tessellar.llm import queries  # noqa: E402

Q = {name.split("_")[0]: f for name, f in queries.queries().items()}
CLASH = ", score double, n bigint, ids array<int>, shard string, key string, __key string, __row string, __score double, cid bigint, w string, chunk string, embedding_ string"
EXTRA = (1.5, 7, [1], "x", "k", "kk", "rr", 2.5, 3, "w", "c", "e")
ITEM = " ".join(f"item{i}" for i in range(25))
PAGE = "<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>Words of the article, some of them.</p></article><footer>end</footer></body></html>"


def rows():
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["Über", "naïve,", "日本語", "don't"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    out = [(i, text(r.randint(5, 40)) + (" vile brute" if i % 4 == 0 else "")) for i in range(60)]
    copy = text(60)
    out += [(100 + k, copy) for k in range(6)] + [(110 + k, f"{copy} tail{k}") for k in range(4)]
    out += [(None, None), (None, None), (None, f"some {ITEM} more"), (None, "plain words of a row without id"), (120, None), (121, ""), (122, "   "), (123, "one"), (7, out[7][1]), (7, "another text under one id")]
    return [*out, (130, f"start {ITEM} end"), (131, "long " * 30_000), (132, "x" * 3000)]


def write(spark, at, some=True):
    keep = lambda x: x if some else []
    make = lambda data, schema, name: spark.createDataFrame(keep(data), schema).write.parquet(f"{at}/{name}.parquet")
    make([(i, t, "en", "s", *EXTRA) for i, t in rows()], f"doc_id bigint, text string, lang string, source string{CLASH}", "documents")
    make([(i, 1, int(i % 4 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None), (5, 0, 0)], "doc_id bigint, quality int, toxic int", "labels")
    make([(0, ITEM), (1, ITEM), (2, None), (None, ""), (4, "never seen words at all")], "item_id bigint, text string", "benchmark")
    make([(1, "u", PAGE, 3, "z"), (1, "u", PAGE, 3, "z"), (None, None, None, 3, "z"), (4, "v", "", 3, "z"), (5, "v", "<p>" + "a b " * 9000, 3, "z")], "page_id bigint, url string, html string, n_chars int, hash string", "pages")
    make([(1, 0, "user", "hi</s>"), (1, 1, "assistant", "ho"), (1, 1, "assistant", "ho"), (2, None, None, None), (None, 3, "assistant", "x" * 40_000), (3, 0, "system", "")], "conv_id bigint, turn bigint, role string, text string", "conversations")
    r = random.Random(9)
    vectors = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(250)] + [(300, [0.0] * 8), (400, None), (500, [float("nan")] * 8), (None, [1.0] * 8), (600, [1.0] * 3)]
    make([(i, v, 1, 0.5, None if i == 3 else i % 2 if i else 7, "c") for i, v in [*vectors, vectors[100], (700, vectors[100][1])]], "vec_id bigint, embedding array<float>, rank int, score double, label int, code string", "embeddings")
    return str(at)


@pytest.fixture(scope="module")
def full(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("full"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), False)


COLUMNS = {
    "op1": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op2": "doc_id bigint, item_id bigint, score double, begin bigint, end bigint",
    "op3": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op5": "doc_id bigint, n_pieces bigint, ids_crc32 bigint, round_trip boolean",
    "op6": "page_id bigint, archive bigint, record_no int, begin bigint, length bigint, hash string, damaged boolean",
    "op7": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op8": "query_id bigint, rank int, vec_id bigint, score double",
    "op9": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op10": "page_id bigint, url string, text string, n_chars bigint",
    "op11": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op12": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op13": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
}


@pytest.mark.parametrize("op", COLUMNS)
def test_empty_tables(spark, empty, op):
    got = Q[op](spark, empty)
    assert dict(x.split() for x in COLUMNS[op].split(", ")).items() <= dict(got.dtypes).items()
    assert [x.conv_id for x in got.select("conv_id").collect()] == [-7] if op == "op9" else got.count() == 0


def test_token_ids(spark, full):
    got = Q["op1"](spark, full).orderBy("start").collect()
    assert len(got) == len(rows()) and [x.doc_id for x in got] == sorted((i for i, _ in rows()), key=lambda i: (i is not None, i or 0))
    assert [x.start for x in got] == [sum(y.n_tokens for y in got[:k]) for k in range(len(got))]
    assert all(x.n_tokens == 1 and x.ids_crc32 == zlib.crc32((1).to_bytes(4, "little")) for x in got if x.doc_id in (120, 121, 122))


def test_decontamination(spark, full):
    assert {(x.doc_id, x.item_id) for x in Q["op2"](spark, full).collect()} == {(i, k) for i in (None, 130) for k in (0, 1)}


def test_toxicity(spark, full):
    got = Q["op3"](spark, full).collect()
    assert len(got) == len(rows()) and all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and x.predicted == int(x.score >= 0.5) for x in got)


def test_shards(spark, full):
    got = Q["op4"](spark, full).collect()
    assert len(got) == len(rows()) and {x.law for x in got} == {"key"} and all(0 <= x.shard < 16 and x.grown_shard in (x.shard, 16) for x in got)
    assert sorted((x.size, x.text_crc32) for x in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows())
    for s in range(16):
        assert sorted(x.slot for x in got if x.shard == s) == list(range(sum(x.shard == s for x in got)))
    assert all(len({x.shard for x in got if x.doc_id == i}) == 1 for i in (7, 120))


def test_fixity(spark, full):
    got = Q["op6"](spark, full).collect()
    assert len(got) == 5 and sum(x.page_id == 1 for x in got) == 2 and len({x.record_no for x in got if x.archive == got[0].archive}) == sum(x.archive == got[0].archive for x in got)


def test_components(spark, full):
    from test_ops import brute

    assert sorted(map(tuple, Q["op7"](spark, full).collect()), key=repr) == brute(rows())


def test_neighbours(spark, full):
    got = Q["op8"](spark, full).collect()
    assert {x.query_id for x in got} == {0, 100, 200, 700} and all(sorted(x.rank for x in got if x.query_id == q) == list(range(1, 11)) for q in (0, 100, 200, 700))
    assert [(x.vec_id, x.score) for x in got if x.query_id == 100 and x.rank == 1] == [(700, 0.0)]


def test_chat(spark, full):
    got = {x.conv_id: x for x in Q["op9"](spark, full).collect()}
    assert set(got) == {1, 2, 3, None, -7} and got[1].n_turns == 3 and got[1].loss_chars == 4
    text = "</s>[INST] ok [/INST]"
    assert (got[-7].n_turns, got[-7].loss_chars, got[-7].loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert got[-7].turns_sha256 == hashlib.sha256("".join(f"{r}\n{text}\n" for r in ("user", "assistant")).encode()).hexdigest()


def test_extraction(spark, full):
    got = [(x.page_id, x.text, x.n_chars) for x in Q["op10"](spark, full).collect()]
    want = "Title\n\nWords of the article, some of them."
    assert sorted(got, key=repr) == sorted([(1, want, len(want))] * 2 + [(None, "", 0), (4, "", 0), (5, ("a b " * 9000).strip(), 35_999)], key=repr)


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
@pytest.mark.parametrize("which", ["full", "empty"])
def test_stages(spark, full, empty, which):
    import corpus_pipeline as p

    at = {"full": full, "empty": empty}[which]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = p.written(stage(spark, docs, at), f"test-{name}")
        assert docs.columns == names and docs.count() <= before
        before = docs.count()
    last = p.STAGES[-1][1](spark, docs, at).collect()
    assert len(last) == before
    if which == "full":
        left = [(x.doc_id, x.text) for x in docs.collect()]
        assert {x["__key"] for x in docs.collect()} == {"kk"} and {x.score for x in docs.collect()} == {1.5}
        assert not any(ITEM in (t or "") for _, t in left) and (None, "plain words of a row without id") in left and (120, None) in left
        assert sum(i is not None and 100 <= i < 120 for i, _ in left) == 1 and left.count((None, None)) == 1
        assert sorted((x.doc_id is not None, x.doc_id, x.decoded) for x in last if x.doc_id is not None) == sorted((True, i, t or "") for i, t in left if i is not None)


def test_quality(spark, full):
    got = Q["op11"](spark, full).collect()
    assert sorted(repr(x.doc_id) for x in got) == sorted(repr(i) for i, _ in rows())
    assert {x.n_words for x in got if x.doc_id in (120, 121, 122)} == {0} and next(x for x in got if x.doc_id == 131).base_failed
    assert all(x.kept is not None and (x.score is None) == x.base_failed for x in got)


def test_vectors_of_other_lengths(spark, full):
    """The fixture's vectors have 8 components: neither 64 nor a multiple of 16."""
    assert Q["op12"](spark, full).count() == 0 and Q["op13"](spark, full).count() == 0
