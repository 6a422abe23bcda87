"""Jaccard join, embedding near-duplicates and the pipeline against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as CP
from textlens.llm import jaccard_join as J
from textlens.llm import vector_dedup as V
from textlens.operators.groups import connected
from textlens.session import materialize


def shingles(t):
    w = (t or "").encode().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """doc_id -> (class_id, n_links) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or (sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), 1 << 60), rows[i][0])
    return {r[0]: (least[find(i)], links[i]) for i, r in enumerate(rows)}


def corpus():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for size in (300, 60, 25, 8):
        base = [rnd.choice(vocab) for _ in range(size)]
        for k in range(14):
            t = list(base)
            for _ in range(k % 5):
                t[rnd.randrange(size)] = "new"
            rows.append((n, " ".join(t)))
            n += 1
    passage = " ".join(rnd.choice(vocab) for _ in range(60))
    for _ in range(12):
        rows.append((n, passage + " " + " ".join(rnd.choice(vocab) for _ in range(150))))
        n += 1
    rows += [(n, "a b c"), (n + 1, "a  b\tc"), (n + 2, "a b d"), (n + 3, ""), (n + 4, None), (n + 5, " \n"), (n + 6, "a b c d e")]
    rnd.shuffle(rows)
    return rows


def test_jaccard_classes_equal_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, class_id int")
    audit = {}
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.jaccard_classes(df, audit=audit).collect()}
    assert got == brute(rows) and audit["recall"] >= J.RECALL
    monkeypatch.setattr(J, "CHUNK", 5)  # groups are cut: each task gets two chunks
    assert {r.doc_id: (r.class_id, r.n_links) for r in J.jaccard_classes(df).collect()} == got


def test_jaccard_edge_cases(spark):
    df = spark.createDataFrame([(3, "x y z"), (3, "x y z"), (None, "x y z"), (1, "other")], "doc_id long, text string")
    rows = J.jaccard_classes(df).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1, r.n_links, r.kept) for r in rows) == [
        (-1, -1, 0, True), (1, 1, 0, True), (3, 3, 1, True), (3, 3, 1, True)]
    assert J.jaccard_classes(df.limit(0)).count() == 0
    assert J.prefix_depth(0.8, 0.999) == 5 and J.prefix_depth(0.5, 0.999) < 5


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50))).astype(np.uint64) for _ in range(30)]
    got = J.shared_counts(sets, np.arange(20), np.arange(10, 30))
    assert (got == [[len(set(sets[i]) & set(sets[j])) for j in range(10, 30)] for i in range(20)]).all()


def test_connected(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (95, 90), (7, 7), (100, 95)]
    got = {r.id: r.root for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 95: 90, 100: 90}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x[100:140] = x[100] + rng.normal(size=(40, 16)) * 0.08
    x[200:220] = x[200] + rng.normal(size=(20, 16)) * 0.25
    x[290:295] = x[290]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, [1.0, 2.0]), (305, [2.0, 4.0]),
             (306, []), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, kept string")
    audit = {}
    got = {r.vec_id: r for r in V.link_vectors(df, audit=audit).collect()}
    assert len(got) == 307 and audit["recall"] >= V.RECALL
    u = x / np.linalg.norm(x, axis=1)[:, None]
    true = (u @ u.T >= 0.95).sum(1) - 1
    assert all(got[i].n_links <= true[i] for i in range(300))
    assert sum(got[i].n_links for i in range(300)) >= 0.97 * true.sum()
    assert (got[304].n_links, got[305].component_id) == (1, 304)
    for i in (300, 301, 302, 303, 306):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert V.link_vectors(df.limit(0)).count() == 0
    # a recall that no search reaches: the exact comparison, in small chunks
    monkeypatch.setattr(V, "CHUNK", 32)
    monkeypatch.setattr(V, "GUESTS", 50)
    monkeypatch.setattr(V, "MAX_OVERLAP", V.OVERLAP)
    exact = {r.vec_id: r for r in V.link_vectors(df, recall=1.1, audit=audit).collect()}
    assert audit["exact"] and [exact[i].n_links for i in range(300)] == true.tolist()
    root = list(range(300))
    for _ in range(300):
        root = [min(root[j] for j in range(300) if j == i or u[i] @ u[j] >= 0.95) for i in range(300)]
    assert [exact[i].component_id for i in range(300)] == root


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01]), (3, [1.0, 0.01])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in V.link_vectors(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_links_of_the_table_equal_brute_force(spark):
    source = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    x = np.array([r.embedding for r in source], float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    got = {r.vec_id: r for r in V.op6_embedding_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert [got[r.vec_id].n_links for r in source] == (near.sum(1) - 1).tolist()
    root = np.array([r.vec_id for r in source])
    for _ in range(50):
        root = np.where(near, root[None], root[:, None]).min(1)
    assert [got[r.vec_id].component_id for r in source] == root.tolist()


SF = "/root/testdata/sf0.001"


def odd_documents(spark):
    """Documents with clashing columns; some again without an id or with a shared one, and
    null and empty texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    rows = [(None, t) for t in texts[:20]] + [(10_000 + i // 4, t) for i, t in enumerate(texts[20:60])]
    rows += [(20_000, None), (20_001, ""), (None, None), (None, ""), (10_000, None), (20_002, texts[0]), (20_002, texts[0])]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(own)
    clash = ["_key", "_key_", "score", "predicted", "kept", "_row", "copies", "label", "_gone", "n"]
    return both.select("*", *[F.monotonically_increasing_id().alias(c) for c in clash])


def test_quality_stage_judges_every_row_by_its_text(spark):
    docs = materialize(odd_documents(spark))
    out = CP.quality_classifier(spark, docs, SF)
    assert out.dtypes == docs.dtypes
    left = {r.score for r in out.collect()}  # the row's number, under a clashing name
    kept = {}
    for r in docs.collect():
        kept.setdefault(r.text or "", set()).add(r.score in left)
    assert all(len(v) == 1 for v in kept.values()) and {v for s in kept.values() for v in s} == {True, False}


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_gone", F.lit(1)).withColumn("kept", F.lit("x"))
    assert [n for n, _ in CP.STAGES] == ["quality classifier", "near duplicates", "secret scans", "mixing", "byte-level BPE"]
    one = CP.near_duplicates(spark, plain, SF)
    assert one.dtypes == plain.dtypes
    want = brute([(r.doc_id, r.text) for r in plain.collect()])
    assert {r.doc_id for r in one.collect()} == {c for c, _ in want.values()}
    docs = materialize(odd_documents(spark))
    out = CP.near_duplicates(spark, docs, SF)
    assert out.dtypes == docs.dtypes
    rows = [(i, r.text) for i, r in enumerate(docs.collect())]
    want = brute(rows)
    group = {(t or ""): want[i][0] for i, t in rows}
    left = [group[r.text or ""] for r in out.collect()]
    assert len(left) == len(set(left)) == len(set(group.values()))


def test_secret_mixing_and_bpe_stages_on_odd_rows(spark):
    docs = materialize(odd_documents(spark))
    n = docs.count()
    hidden = CP.secret_scans(spark, docs, SF)
    assert hidden.dtypes == docs.dtypes and hidden.count() == n
    mixed = CP.mixing(spark, docs, SF)
    assert mixed.dtypes == docs.dtypes
    rows = {(r.doc_id, r.text, r.score) for r in docs.collect()}
    got = [(r.doc_id, r.text, r.score) for r in mixed.collect()]
    assert set(got) <= rows and 0.5 * n < len(got) < 2 * n
    coded = CP.byte_bpe(spark, docs, SF)
    tokens = {r.doc_id: r.n_tokens for r in coded.collect()}
    assert coded.count() == n and tokens[20_000] == tokens[20_001] == 0


def test_stages_of_an_empty_table(spark):
    none = odd_documents(spark).limit(0)
    for name, stage in CP.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0 and (name == "byte-level BPE" or out.dtypes == none.dtypes)


def test_pipeline_run(spark):
    out = CP.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 50 < out.count() < 300
