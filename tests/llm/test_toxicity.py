"""Toxicity: the string kernel against plain Python, held-out accuracy, edge cases."""

import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from textlens.llm import toxicity as tox

SF = "/root/testdata/sf0.1"


def plain_units(text):
    """Units of a text, one character at a time: tuples of symbols, None marks a later piece."""
    words = []
    for w in text.lower().split():
        letters = [c for c in w if c.isalpha()]
        if letters:
            words.append([ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % tox.OTHERS for c in letters])
    joined = []
    for w, before in zip(words, [None, *words]):
        if before is not None and len(w) == len(before) == 1:
            joined[-1].extend(w)
        else:
            joined.append(list(w))
    out = []
    for w in joined:
        k = 0
        while True:
            out.append((tox.MARK if k == 0 else 0, *w[k:k + tox.PIECE]))
            k += tox.STRIDE
            if k - tox.STRIDE + tox.PIECE >= len(w):
                break
    return out


def plain_features(unit):
    out = {}
    for order, span in tox.SPANS.items():
        for at in itertools.combinations(range(len(unit)), order):
            if at[-1] - at[0] < span:
                gram = tuple(unit[i] for i in at)
                out[gram] = out.get(gram, 0) + tox.DECAY ** (at[-1] - at[0] + 1 - order)
    return out


def plain_norm(unit):
    return max(1, sum(tox.DECAY ** (2 * (at[-1] - at[0] + 1 - order)) for order, span in tox.SPANS.items()
                      for at in itertools.combinations(range(len(unit)), order) if at[-1] - at[0] < span)) ** 0.5


TEXTS = ["You i.d.i.o.t, i d i o t!", "", "  ", "123 ...", "banana bananas a b", "straße ÉTÉ naïve", "x" * 60 + " " + "abc" * 11, "a"]


def test_units_equal_plain_python():
    units = tox.Units(TEXTS)
    got = [tuple(units.flat[units.start[u]:units.start[u] + units.size[u]].tolist()) for u in units.unit]
    want = [(i, u) for i, t in enumerate(TEXTS) for u in plain_units(t)]
    assert list(zip(units.doc.tolist(), got)) == want
    assert len(units) == len({u for _, u in want})


def test_kernel_and_values_equal_plain_python():
    units = tox.Units(TEXTS)
    plain = [tuple(units.flat[a:a + n].tolist()) for a, n in zip(units.start, units.size)]
    features, norms = [plain_features(u) for u in plain], [plain_norm(u) for u in plain]
    want = np.array([[sum(x * b.get(g, 0) for g, x in a.items()) / p / q for b, q in zip(features, norms)]
                     for a, p in zip(features, norms)])
    assert np.allclose(units.kernel(units), want, atol=1e-5)
    table = np.zeros(tox.CODES, np.float32)  # the machine that is one landmark
    some = units.take([2])
    for _, code, weight in some.features():
        np.add.at(table, code, weight)
    assert np.allclose(units.values(table) / some.norms()[0], want[:, 2], atol=1e-5)
    values = np.arange(len(units), dtype=float)
    best = tox.highest(units, values, len(TEXTS))
    for i in range(len(TEXTS)):
        own = sorted(values[units.unit[units.doc == i]], reverse=True)
        assert best[i].tolist() == (own + [0.0, 0.0])[:2]


def test_support_vectors_part_and_sigmoid_orders():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = np.where(x[:, 0] > 0.2, 1.0, -1.0)
    w = tox.support_vectors(x, y, np.full(300, 1 / 300))
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97
    slope, offset = tox.sigmoid_fit(x[:, 0], (y + 1) / 2)
    assert slope > 1 and offset < 0


def test_held_out_documents_and_inserted_letters(spark):
    rows = tox.op13_toxicity(spark, SF).collect()
    assert len(rows) == 10_000 and len({r.doc_id for r in rows}) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r.predicted, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    assert np.mean([p for p, t in held if t]) >= 0.9 and np.mean([p for p, t in held if not t]) <= 0.03
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = tox.fit(docs, labels)
    twice = [f"The {w} and that {w} here." for w in ("idiot", "i.d.i.o.t", "i d i o t", "id-iot", "idiiot", "worthlessss")]
    assert (model(twice) >= 0.3).all()
    assert (model(["", "...", "of the and that", "1 2 3"]) < 0.1).all()
    long = "the and that " * 60_000
    assert model([long + "idiot stupid", long])[0] >= 0.3 > model([long])[0]


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, "some words here", "x"), (2, None, ""), (None, "", ""), (1, "some words here", "y"), (3, "bad bad one", "")],
                               "doc_id long, text string, score string")
    score = lambda docs, labels: tox.toxicity_scores(docs, labels).collect()
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in score(df, none)} == {0.5} and {r.predicted for r in score(df, none)} == {1}
    one = spark.createDataFrame([(1, 0), (1, None), (2, 0), (9, 1), (None, 1)], "doc_id long, label int")
    assert {r.score for r in score(df, one)} == {1 / 4}  # the documents labelled 1 are not there
    assert score(df.limit(0), one) == []
    both = spark.createDataFrame([(1, 0), (3, 0), (3, 1)], "doc_id long, label int")
    rows = score(df, both)
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[1]) == 1
    wordless = spark.createDataFrame([(2, 1), (1, 0)], "doc_id long, label int")
    assert {r.score for r in score(df, wordless)} == {2 / 4}
