"""Language-model scoring against plain Python."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlens.llm import suffix_lm as L
from textlens.llm.common import fold
from textlens.session import scratch_tables, table_scope

SF = "/root/testdata/sf0.001"


def split(t):
    return (t or "").encode().lower().split()


def brute(rows, learns, p_min, tail, penalty):
    """(base, score) of each text by dictionaries: depth 2, Witten-Bell, divergence test."""
    count = Counter()
    train = [split(t) for i, t in rows if learns(i)]
    for w in train:
        count.update(w)
    count[b""] = len(train)
    count = +count
    n, v = sum(count.values()), len(count)
    own = {w for w, c in count.items() if w and len(w) <= L.OWN_BYTES and c >= p_min * n}

    def cls(w):
        return w if w in own or w == b"" else zlib.crc32(w[-2:]) % tail

    size = len(own) + tail + 2
    tokens, kinds = Counter(), Counter()
    for w, c in count.items():
        tokens[cls(w)] += c
        kinds[cls(w)] += 1
    grams = [Counter(), Counter(), Counter()]
    for words in train:
        s = ["start", "start", *map(cls, words), b""]
        for i in range(2, len(s)):
            for d in (1, 2):
                grams[d][tuple(s[i - d:i]), s[i]] += 1
    seen0 = len(tokens)

    def p0(s):
        return (tokens[s] + max(1, seen0) / size) / (n + max(1, seen0))

    totals, nexts = [None, Counter(), Counter()], [None, {}, {}]
    for d in (1, 2):
        for (ctx, s), c in grams[d].items():
            totals[d][ctx] += c
            nexts[d].setdefault(ctx, {})[s] = c
    state = {}

    def p(ctx, s):
        ctx = ctx if ctx in state else ctx[1:]
        if not ctx or ctx not in state:
            return p0(s)
        seen = nexts[len(ctx)][ctx]
        return (seen.get(s, 0) + len(seen) * p(ctx[1:], s)) / (totals[len(ctx)][ctx] + len(seen))

    for d in (1, 2):
        for ctx, t in totals[d].items():
            starts = "start" in ctx and ctx != ("start",) * d
            common = t >= p_min * n and t >= 1 and (d == 1 or totals[1][ctx[1:]] >= p_min * n)
            if not common or (starts and d == 2 and ctx[1] == "start"):
                continue
            gain = sum(c * math.log(c / t / p(ctx[1:], s)) for s, c in nexts[d][ctx].items())
            if gain >= penalty * len(nexts[d][ctx]):
                state[ctx] = True
    out = []
    for _, text in rows:
        s, base, score = ["start", "start"], 0.0, 0.0
        for w in [*split(text), b""]:
            c, k = count[w], cls(w)
            base += math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
            inside = 1 if w in own or w == b"" else (c + 0.1) / (tokens[k] + 0.1 * (kinds[k] + 1))
            score += math.log10(p(tuple(s[-2:]), k) * inside)
            s.append(k)
        out.append((base, score))
    return out, n


def test_small_corpus_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    words = ["the", "a", "Of", "cat,", "dog", "runs", "ran.", "ünder", "x"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40), p=np.arange(9, 0, -1) / 45))) for i in range(60)]
    rows += [(60, None), (61, ""), (70, "unseen zzz THE the\x0bdog"), (80, "the " * 50), (80, "the " * 50)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, learn int")
    got = L.score_documents(df, fold(F.col("doc_id"), 10) != 0, p_min=0.05, tail=4, penalty=0.5, block_chars=500)
    got = {r.doc_id: r for r in got.collect()}
    want, n = brute(rows, lambda i: zlib.crc32(str(i).encode()) % 10 != 0, 0.05, 4, 0.5)
    for (i, text), (base, score) in zip(rows, want):
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0) and r.train_tokens == n
        assert r.n_tokens == len(split(text)) + 1
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=1e-9), (i, text)


def test_held_out_texts_score_better_than_base(spark):
    rows = L.op10_lm_scoring(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 200 and held
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "")], "doc_id long, text string")
    rows = L.score_documents(df, F.lit(False)).collect()
    assert [r.base_score for r in rows] == [0.0, 0.0] and {r.n_known for r in rows} == {0}
    assert L.score_documents(df.limit(0), F.lit(True)).count() == 0


def test_rare_contexts_seen_often_are_states(spark):
    """Words and contexts below 0.0005 of the corpus, but seen 300 times; one of three words."""
    rng = np.random.default_rng(8)
    filler = [f"w{i}{e}" for i in range(2500) for e in ("ta", "ha", "xe", "no")]
    rows = [(i, " ".join(rng.choice(filler, 2000))) for i in range(350)]
    rows += [(1000 + i, "qalpha qbeta") for i in range(300)]
    rows += [(2000 + i, ("qone qfive qsix qxe", "qtwo qfive qsix qno")[i % 2]) for i in range(600)]
    rows += [(-1, "qalpha qbeta"), (-2, "qone qfive qsix qxe")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in L.score_documents(df, F.col("doc_id") >= 0, depth=L.DEPTH).collect()}
    assert 300 / got[-1].train_tokens < 5e-4
    # a text starts with one of 1250; all that follows is nearly certain
    assert got[-1].score > math.log10(300 / 1250) - 0.4
    assert got[-2].score > math.log10(300 / 1250) - 0.4


def test_only_the_result_stays_written(spark):
    """Interim tables of a run go with it; the session's settings are as before."""
    rows = [(i, "a b a b c " * 5) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with scratch_tables(spark):
        out = L.score_documents(df, F.col("doc_id") >= 0, min_count=20, block_chars=200)
        assert len(table_scope()) == 1
        assert out.count() == 40
    assert spark.conf.get(key, None) == before
