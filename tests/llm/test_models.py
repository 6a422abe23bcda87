"""Quality classifier, language tagger and mixing: held-out accuracy, brute force, edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlens.llm import language, mixing, quality
from textlens.llm.common import fold

SF = "/root/testdata/sf0.01"


def rest(i, k):
    return zlib.crc32(str(i).encode()) % k


def test_contexts_equal_brute_force():
    at, sign = quality.index_vectors()
    docs = ["a b a. c", "", "x", "b b !! a"]
    slots, sizes = quality.Slots().of(docs)
    total = np.zeros((quality.SLOTS, quality.DIMS), np.int64)
    quality.add_contexts(total, slots, sizes, at, sign)
    want, start = np.zeros_like(total), 0
    for n in sizes:
        s = slots[start:start + n]
        start += n
        for i in range(n):
            for j in range(max(0, i - quality.REACH), min(n, i + quality.REACH + 1)):
                if i != j:
                    np.add.at(want[s[i]], at[s[j]], sign[s[j]].astype(np.int64))
    assert (total == want).all()


def test_quality_of_held_out_documents(spark):
    rows = quality.op1_quality_classifier(spark, SF).collect()
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(r.held_out == (rest(r.doc_id, 3) == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    assert np.mean([p == q for p, q in held]) >= 0.95


def test_quality_edge_cases(spark):
    df = spark.createDataFrame([(1, "good words here", "x"), (2, None, ""), (None, "", ""), (1, "good words here", "y")],
                               "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in quality.quality_scores(df, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, 0), (2, None)], "doc_id long, label int")
    assert {r.score for r in quality.quality_scores(df, one).collect()} == {3 / 4}
    assert quality.quality_scores(df.limit(0), one).count() == 0


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    t = language.Tagger(["a", "b", "c"])
    for net in (t.ahead, t.back):
        net.x, net.u = net.x.astype(float), net.u.astype(float)
    t.out, t.bias = t.out.astype(float), t.bias.astype(float)
    m = rng.integers(0, 256, (4, language.WINDOW)).astype(np.uint8)
    valid, y = np.array([language.WINDOW, 30, 5, language.WINDOW]), np.array([0, 1, 2, 1])
    _, grads = t.gradients(m, valid, y)
    for p, g in zip(t.parameters(), grads):
        i = (0, int(m[0, 3])) if p.shape[1] == 256 else (0, 0)
        old, e = p[i], 1e-6
        p[i] = old + e
        up, _ = t.gradients(m, valid, y)
        p[i] = old - e
        down, _ = t.gradients(m, valid, y)
        p[i] = old
        assert g[i] == pytest.approx((up - down) / (2 * e), abs=1e-7)


def test_windows_cover_every_byte():
    docs = [b"", b"x" * language.WINDOW, b"abc", bytes(range(200))]
    m, valid, doc = language.windows(docs)
    got = [b"".join(bytes(r[:n]) for r, n, d in zip(m, valid, doc) if d == i) for i in range(len(docs))]
    assert got == docs


def test_batches_do_not_change_a_text():
    t = language.Tagger(["a", "b"])
    docs = [b"first text " * 9, b"", b"z", "zweiter Täxt".encode() * 40]
    whole = t.documents(docs)
    assert np.allclose(whole, np.vstack([t.documents([d]) for d in docs]), atol=1e-6)
    assert np.allclose(whole[[0, 2, 3]].sum(1), 1, atol=1e-5)


def test_language_of_held_out_documents(spark):
    rows = language.op7_language_id(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == 1000 and all(r.held_out == (rest(r.doc_id, 5) == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) >= 0.97


def test_language_edge_cases(spark):
    df = spark.createDataFrame([(1, "ein kurzer satz", "de"), (2, None, "en"), (3, "123 !?", "en"), (None, "some words", None),
                                (4, "these are words", "en")], "doc_id long, text string, lang string")
    got = language.predict_language(df, fold(F.col("doc_id"), 5) >= 0).collect()
    assert {(r.doc_id, r.lang_pred) for r in got if r.doc_id in (2, 3)} == {(2, "und"), (3, "und")}
    assert {r.lang_pred for r in got if r.doc_id not in (2, 3)} <= {"de", "en"}
    nothing = language.predict_language(df, F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert language.predict_language(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mixing_meets_targets_and_equals_numpy(spark, sf):
    path = f"/root/testdata/{sf}"
    out = mixing.mix_rates(spark.read.parquet(f"{path}/documents.parquet"), mixing.domain_labels(spark, path), mixing.TARGETS).collect()
    names = sorted(mixing.TARGETS)
    n = np.array([r.n_words for r in out], float)
    p = np.array([[r[f"p_{d}"] for d in names] for r in out])
    rate = np.array([r.rate for r in out])
    goal, reached = ([out[0][f"{c}_{d}"] for d in names] for c in ("target", "reached"))
    assert np.allclose(p.sum(1), 1) and (rate >= 0).all() and np.allclose(goal, [mixing.TARGETS[d] for d in names])
    goal, r, y = np.array(goal), np.ones(len(n)), np.ones(len(n))
    share = (n[:, None] * p).sum(0) / n.sum()
    for t in range(3000):  # the accelerated projected gradient, plainly
        off = (n[:, None] * y[:, None] * p).sum(0) / n.sum() - goal
        new = np.maximum(0, y - mixing.STEP * (p @ (off / share) + mixing.RIDGE * (y - 1)))
        if np.allclose(new, rate, atol=1e-6):
            break
        r, y = new, new + t / (t + 3) * (new - r)
    assert np.allclose(rate, new, atol=1e-6)  # the rates are those after some step
    now = (n[:, None] * rate[:, None] * p).sum(0) / n.sum()
    assert np.allclose(now, reached, atol=1e-6)
    if sf == "sf0.1":
        assert np.abs(now - goal).max() <= 0.01
    assert all(abs(x.copies - x.rate) < 1 + 1e-9 for x in out)


def test_posteriors_equal_plain_python(spark):
    rows = [(i, t) for i, t in enumerate(["a b c", "a a d", "c d e x", "q r", "", None] * 60)]
    domain = lambda t: "one" if "a" in (t or "") else "two" if "d" in (t or "") else "three"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, domain(t)) for i, t in rows], "doc_id long, domain string")
    names = ["one", "three", "two"]
    out = mixing.mix_rates(df, labels, dict.fromkeys(names, 1 / 3)).collect()
    count, docs = {}, [sum(domain(t) == d for _, t in rows) for d in names]
    for _, t in rows:
        for w in set((t or "").split()):
            count.setdefault(w, [0, 0, 0])[names.index(domain(t))] += 1
    pairs = [sum(c[i] for c in count.values()) for i in range(3)]

    def weight(w, i):
        n, e = sum(count[w]), sum(count[w]) * pairs[i] / sum(pairs)
        c = mixing.SMOOTH * n / sum(docs)
        x = np.log((count[w][i] + c) / (e + c))
        return x if abs(count[w][i] - e) >= mixing.Z * np.sqrt(e + 1) and abs(x) >= mixing.RATIO else 0.0

    def kind(t):
        e = [sum(weight(w, i) for w in set((t or "").split())) for i in range(3)]
        return e, 3 if not any(weight(w, i) for w in (t or "").split() for i in range(3)) else int(np.argmax(e))

    table = [[(docs[i] + 1) / (sum(docs) + 3) for i in range(3)] for _ in range(4)]
    for _, t in rows:
        table[kind(t)[1]][names.index(domain(t))] += 1
    for r in out:
        e, c = kind(rows[r.doc_id][1])
        s = np.array(e) + np.log(np.array(table[c]) / sum(table[c]))
        want = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert np.allclose([r[f"p_{d}"] for d in names], want, atol=1e-9)
    assert any(abs(weight(w, i)) > 0 for w in count for i in range(3))


def test_mixing_rows_and_edge_cases(spark):
    rows = [(i, "plain words only", "a") for i in range(400)] + [(1000 + i, "vile insult words", "b") for i in range(400)]
    rows += [(None, None, "c"), (7, "plain words only", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    labels = spark.createDataFrame([(i, "ok") for i in range(400)] + [(1000 + i, "bad") for i in range(400)], "doc_id long, domain string")
    out = mixing.mix_rows(df, labels, {"ok": 0.9, "bad": 0.1})
    assert out.columns == df.columns
    kinds = out.groupBy("_row").count().collect()
    n = {r._row: r["count"] for r in kinds}
    assert n["a"] >= 600 and n.get("b", 0) <= 200
    got = mixing.mix_rates(df, labels, {"ok": 0.9, "bad": 0.1, "never": 0.5}).first()
    assert got.target_never == 0 and np.allclose([got.target_ok, got.target_bad], [1.35, 0.15])  # its target goes to the others
    assert np.allclose([got.reached_ok, got.reached_bad], [1.35, 0.15], atol=2e-3)
    rare = [(i, "x", 0) for i in range(2000)] + [(5000 + i, "odd thing", 0) for i in range(2)]
    few = spark.createDataFrame(rare, "doc_id long, text string, n int")
    own = spark.createDataFrame([(i, "common" if i < 5000 else "rare") for i, _, _ in rare], "doc_id long, domain string")
    got = mixing.mix_rates(few, own, {"common": 0.99, "rare": 0.01}).first()
    assert got.target_rare == 0.01 and got.reached_rare is not None  # a share of 0.1% is no reason to give up its target
    assert mixing.mix_rates(df.where("text IS NULL"), labels, {"ok": 0.9, "bad": 0.1}).first().reached_ok is None
    assert mixing.mix_rows(df.limit(0), labels, {"ok": 0.9, "bad": 0.1}).count() == 0
    assert mixing.mix_rows(df, labels.limit(0), {"ok": 0.5, "bad": 0.5}).count() == len(rows)
