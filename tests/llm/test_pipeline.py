"""The pipeline on the smallest tables, against the stages' rules by brute force."""

import importlib.util

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_pipeline(spark):
    import corpus_pipeline as p
    from test_ops import brute

    from tessellar.llm import decontaminate, toxicity

    assert [s[0] for s in p.STAGES] == ["toxicity", "near_copies", "decontamination", "pieces"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = p.STAGES[0][1](spark, docs, SF).cache()
    assert kept.columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    assert {x.doc_id for x in kept.collect()} == {d for d, s in scores.items() if s < 0.5}
    one = p.STAGES[1][1](spark, kept, SF).cache()
    rows = [(x.doc_id, x.text) for x in kept.collect()]
    assert sorted(x.doc_id for x in one.collect()) == sorted(d for d, _, c in brute(rows) if d == c)
    clean = p.STAGES[2][1](spark, one, SF).cache()
    hits = {x.doc_id for x in decontaminate.contaminated(one, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {x.doc_id for x in clean.collect()} == {x.doc_id for x in one.collect()} - hits and clean.columns == docs.columns
    last = {x.doc_id: x for x in p.STAGES[3][1](spark, clean, SF).collect()}
    assert {k: x.decoded for k, x in last.items()} == {x.doc_id: x.text for x in clean.collect()}
    assert sorted(x.doc_id for x in p.run(spark, SF).collect()) == sorted(last)


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as p

    item, other = (" ".join(f"{w}{i}" for i in range(30)) for w in "uv")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = lambda rows: spark.createDataFrame([(i, "s", t) for i, t in rows], "doc_id bigint, source string, text string")
    rows = [(None, f"so {item}"), (None, "clean one"), (None, None), (4, f"and {item}"), (4, "clean two"), (5, "clean two")]
    got = p.uncontaminated(spark, docs(rows), str(tmp_path))
    assert got.columns == ["doc_id", "source", "text"]
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=repr) == sorted((r for r in rows if item not in (r[1] or "")), key=repr)
    near = [f"{other} end{k}" for k in range(4)]
    rows = [(None, near[0]), (3, near[1]), (None, "alone"), (None, None), (None, ""), (7, item), (7, f"{item} end"), (7, "apart"), (None, "two same"), (None, "two same"), (8, near[2])]
    got = sorted(((x.doc_id, x.text) for x in p.one_of_near_copies(spark, docs(rows), str(tmp_path)).collect()), key=repr)
    sevens = [r for r in got if r[0] == 7]
    assert len(sevens) == 2 and (7, "apart") in sevens
    assert [r for r in got if r[0] != 7] == sorted([(3, near[1]), (None, "alone"), (None, None), (None, ""), (None, "two same")], key=repr)
