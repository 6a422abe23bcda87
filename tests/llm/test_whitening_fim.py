"""Whitening against dense eigenvectors; fill-in-middle against regular expressions."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlens.llm import fill_middle as fim
from textlens.llm import whitening as wh

SF = "/root/testdata/sf0.01"


def dense(vectors):
    """(n, S, deviations, eigenvalues, components, whitened) by a dense eigensolver."""
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    a = x - s / n
    e, v = np.linalg.eigh(a.T @ a / n)
    e, v = e[::-1], v[:, ::-1]
    dev = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s)) for row in x]
    return n, dev, e, v, a @ v[:, :8] / np.sqrt(np.maximum(e[:8], 1e-300))


def test_query_equals_dense_eigenvectors(spark):
    source = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, dev, e, v, w = dense([r.embedding for r in source])
    place = {r.vec_id: i for i, r in enumerate(source)}
    rows = wh.op11_embedding_whitening(spark, SF).collect()
    assert len(rows) == 8 * n and {r.component for r in rows} == set(range(1, 9))
    got = np.zeros((n, 8))
    for r in rows:
        assert r.n == n and r.deviation == dev[place[r.vec_id]] and r.identity_error < 1e-10
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-12
        got[place[r.vec_id], r.component - 1] = r.whitened
    for k in range(8):  # either sign
        assert min(np.abs(got[:, k] - w[:, k]).max(), np.abs(got[:, k] + w[:, k]).max()) < 1e-8
    assert np.abs(got.T @ got / n - np.eye(8)).max() < 1e-10


@pytest.mark.parametrize("shape", ["stretched", "few rows", "constant column", "copied column"])
def test_hard_matrices(spark, shape):
    rng = np.random.default_rng(3)
    rows, dims = (5, 12) if shape == "few rows" else (400, 6)
    c = rng.normal(size=(rows, dims))
    if shape == "stretched":
        c = c * 10.0 ** np.arange(0, -dims / 2, -0.5) @ np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    if shape == "constant column":
        c[:, 2] = 0.25
    if shape == "copied column":
        c[:, 4] = c[:, 1]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(c)], "vec_id long, embedding array<double>").repartition(3)
    got = wh.whiten(df).toPandas()
    n, _, e, v, w = dense(c)
    rank = min(8, int((e > 1e-15 * e[0]).sum())) if shape != "few rows" else 4
    assert sorted(set(got.component)) == list(range(1, rank + 1))
    assert got.identity_error.max() < 1e-8
    for k in range(rank):
        own = got[got.component == k + 1].sort_values("vec_id").whitened.to_numpy()
        assert min(np.abs(own - w[:, k]).max(), np.abs(own + w[:, k]).max()) < 1e-6


def test_left_out_vectors_and_empty_tables(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.1, 0.2], "a"), (1, [0.1, 0.2], "b"), (None, [0.5, -0.3], ""), (4, [1.0, 0.0], None), (5, None, ""), (6, [], ""),
            (7, [nan, 0.0], ""), (8, [inf, 0.0], ""), (9, [None, 1.0], ""), (10, [1.0, 2.0, 3.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string")
    got = wh.whiten(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (4, 1), (4, 2)]
    assert {r.n for r in got} == {4}
    assert wh.whiten(df.limit(0)).count() == 0
    assert wh.whiten(df.where("vec_id = 1")).count() == 0  # equal vectors vary in no direction
    assert wh.whiten(df.where("vec_id = 5")).count() == 0


def test_triangular_solve_and_first_factor():
    rng = np.random.default_rng(1)
    a, r = rng.normal(size=(50, 7)), np.triu(rng.normal(size=(7, 7))) + 5 * np.eye(7)
    assert np.allclose(wh.solve_rows(a, r) @ r, a)
    flat = np.ones((4, 4))  # of rank 1: only the shift makes it definite
    f = wh.factor(flat, 10, True)
    assert np.allclose(f.T @ f, flat, atol=1e-9) and np.allclose(f, np.triu(f))


# ---- fill-in-middle ------------------------------------------------------------------

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(doc_id, text):
    """The contract, by a token list."""
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    w = TOKEN.findall(text)
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(w), "plain", None, None, text
    if h4 % 100 < 80:
        return len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, " ", "\n\t ", "a", " a b ", "tail space \r\n", "a<P>b c", "<", "<S", "<<S", "x <M", "é ü n o \U0001f600 z",
         "nul\x00 in it", "\x1c\x85 not space", "w " * 40_000, "long" * 50_000, "\n" * 70_000, ("ab " * 30 + "x" * 70_000) * 2]


def test_fill_in_middle_equals_brute_force(spark):
    rows = [(i, t, "z") for i in range(12) for t in TEXTS] + [(None, "some words here", "z"), (3, "a", "z"), (3, "a", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string").repartition(3)
    out = fim.fill_in_middle(df)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda r: tuple(str(x) for x in r)
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(key, ([*r][:6] for r in got))) == sorted(key((i, *brute(i, t))) for i, t, _ in rows)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t, _ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_containers_select_what_they_hold():
    rng = np.random.default_rng(0)
    sparse = np.sort(rng.choice(1 << 16, 900, replace=False))
    dense_set = np.sort(rng.choice(1 << 16, 30_000, replace=False))
    runs = np.concatenate([np.arange(10, 20_000), np.arange(30_000, 65_536)])
    assert [fim.Container(x).kind for x in (sparse, dense_set, runs)] == ["array", "bitmap", "runs"]
    parts = np.concatenate([sparse, dense_set + (1 << 16), runs + (5 << 16), [9 << 16]])
    rank = rng.permutation(len(parts))
    assert (fim.Boundaries(parts).select(rank) == parts[rank]).all()
    for x in (sparse, dense_set, runs):
        assert (fim.Container(x).select(np.arange(len(x))) == x).all()
    assert len(fim.Boundaries(np.zeros(0, np.int64)).select(np.zeros(0, np.int64))) == 0
