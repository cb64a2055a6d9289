"""Quality rules against plain Python, the forest's constraints, and held-out accuracy."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessellar.llm import boosting, quality

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def plain(text):
    """The base counts of a text, one rule a line."""
    words, lines, seen, dup = WORD.findall(text), text.split("\n"), set(), 0
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    for line in lines:
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def odd_texts():
    r = random.Random(1)
    bits = ["a", "A", "é", "É", "日本", "#", "$x", "|", " ", "\n", "\t", "\x0b", "\r\n", " ", " ", "\x00", "1", "!", "w w w w w w", "one two three four five", "\n\n", "😀"]
    return ["", " \n ", "one", "a " * 4, "a " * 6, "x\nx\nx", "x\nx \nx", "x\r\nx\r\n", "long " * 20_000, "y" * 100_000] + ["".join(r.choice(bits) + r.choice(["", " ", "\n"]) for _ in range(r.randint(1, 60))) for _ in range(600)]


def test_counts_as_plain_python():
    texts = odd_texts()
    got = quality.counted(pa.array(texts))[:, :5]
    assert [tuple(x) for x in got.tolist()] == [plain(t) for t in texts]
    cut = pa.array([*texts[:3], *texts]).slice(3)  # a column that begins inside its buffers
    assert (quality.counted(cut)[:, :5] == got).all()


def test_query_as_plain_python(spark):
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = quality.op11_boosted_quality(spark, SF).collect()
    assert sorted(x.doc_id for x in got) == sorted(docs)
    for x in got:
        assert tuple(x[c] for c in BASE) == plain(docs[x.doc_id] or "")
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words)
        assert x.kept == (not x.base_failed and x.score >= 0.5)
    known = [x for x in got if x.doc_id in labels and not x.base_failed]
    assert np.mean([x.kept == bool(labels[x.doc_id]) for x in known]) > 0.97


def test_held_out_accuracy(spark):
    stats = quality.statistics(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.train(stats, labels.filter("doc_id % 3 > 0"))
    got = quality.judged(stats, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").filter("not base_failed")
    right, n = got.selectExpr("avg(double(kept = (quality = 1)))", "count(*)").first()
    assert n > 1000 and right > 0.98


def test_fewer_rows_than_labelled(spark):
    """The bound picks a sample for the fit alone; everything is judged."""
    stats = quality.statistics(spark.read.parquet(f"{SF}/documents.parquet"))
    model = quality.train(stats, spark.read.parquet(f"{SF}/labels.parquet"), fit_rows=150)
    assert 0 < len(model.feature) and quality.judged(stats, model).count() == 1000


def test_forest_is_monotonic_and_exact():
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 5))
    y = (np.sin(3 * x[:, 0]) + 0.8 * np.sin(2 * x[:, 1]) - x[:, 2] + r.normal(0, 0.5, 3000) > 0).astype(float)
    for signs in ([-1, 1, 0, 0, 0], [1, 1, -1, -1, 1], [0] * 5):
        f = boosting.fit(x, y, signs)
        for k, sign in enumerate(signs):
            line = np.repeat(x[:200], 41, axis=0)
            line[:, k] = np.tile(np.linspace(-4, 4, 41), 200)
            step = np.diff(f.margin(line).reshape(200, 41), axis=1)
            assert not sign or (sign * step >= -1e-12).all()

        def walk(row, f=f):
            total = f.bias
            for t in range(len(f.feature)):
                at = 0
                while f.feature[t, at] >= 0:
                    at = f.left[t, at] + (row[f.feature[t, at]] > f.split[t, at])
                total += f.value[t, at]
            return total

        assert np.allclose(f.margin(x[:50]), [walk(row) for row in x[:50]])
    free = boosting.fit(x, y, [0] * 5)
    assert ((free.score(x) >= 0.5) == y).mean() > 0.85
    step = np.diff(free.margin(np.column_stack([np.linspace(-3, 3, 61), np.zeros((61, 4))])))
    assert (step > 0).any() and (step < 0).any()  # only the constraint makes it monotonic


@pytest.mark.parametrize(("labels", "kept"), [([], True), ([1, 1], True), ([0, 0], False)])
def test_one_kind_of_label(spark, labels, kept):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(12 + i))) for i in range(5)] + [(9, None)], "doc_id bigint, text string")
    known = spark.createDataFrame([(i, q) for i, q in enumerate(labels)], "doc_id bigint, quality int")
    stats = quality.statistics(docs)
    got = quality.judged(stats, quality.train(stats, known)).collect()
    assert {x.kept for x in got if x.doc_id < 9} == {kept} and [(x.base_failed, x.kept, x.n_words) for x in got if x.doc_id == 9] == [(True, False, 0)]
