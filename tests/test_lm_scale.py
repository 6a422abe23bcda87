"""In-sample scoring in two moves of hashed steps: rare and common tokens, hot contexts, odd
rows; and what the queries on the model may cost."""

import math
from collections import Counter

import pytest

from textlens.operators import lm as LM
from textlens.operators import scoring as S

SCHEMA = "row_id long, text string"


def brute(rows, add_bos, lam=0.7):
    texts = [(i, (t or "").split()) for i, t in rows]
    steps = [(p, t) for _, w in texts for p, t in zip([LM.BOS if add_bos else None, *w], w)]
    uni, pair = Counter(t for _, t in steps), Counter(s for s in steps if s[0] is not None)
    ctx = Counter()
    for (p, _), c in pair.items():
        ctx[p] += c
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, w in texts:
        scored = [(k + 1, t, lam * pair[p, t] / ctx[p] + (1 - lam) * (uni[t] + 1) / (n + v + 1))
                  for k, (p, t) in enumerate(zip([LM.BOS if add_bos else None, *w], w)) if p is not None]
        out += [(i, *x) for x in scored] or [(i, None, None, None)]
    return out


ROWS = [(1, "a b a b <s> a c"), (2, "a"), (3, ""), (4, None), (5, "a a a a b c d"), (5, "a a a a b c d"), (None, "x <s> y"), (6, "z b a"), (7, "b")]


@pytest.mark.parametrize("common,hot", [(100_000, 1 / 500), (1, 0.2), (2, 0.9), (3, 0.05)])
@pytest.mark.parametrize("add_bos", [True, False])
def test_scores_whatever_is_common_or_hot(spark, monkeypatch, common, hot, add_bos):
    monkeypatch.setattr(LM, "COMMON", common)
    monkeypatch.setattr(LM, "HOT", hot)
    df = spark.createDataFrame(ROWS, SCHEMA)
    key = lambda r: tuple(str(x) for x in r[:3])
    weights = spark.createDataFrame([("a", 2.0), ("d", 3.0)], "token string, weight double")
    got = sorted([(r.row_id, r.pos, r.token, r.prob, r.weight) for r in LM.fit_and_score(
        df, add_bos=add_bos, weights=weights).collect()], key=key)
    want = sorted(brute(ROWS, add_bos), key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want):
        assert (g[3] is None and w[3] is None) or math.isclose(g[3], w[3], rel_tol=1e-12)
        assert g[4] == ({"a": 2.0, "d": 3.0}.get(g[2], 0.001) if g[1] else None)


def test_no_score_moves_with_its_strings(spark):
    plan = S.row_metrics_long(LM.fit_and_score(spark.createDataFrame(ROWS, SCHEMA), tokens=False), ["row_id"])
    moved = [x for x in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert moved and not any("token" in x or "prev" in x for x in moved)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("\n") and "first(" not in text and "max(CASE" not in text  # no window for each threshold


@pytest.mark.parametrize("chunk", [1, 2, 5, 1 << 18])
def test_metrics_do_not_depend_on_batches(spark, monkeypatch, chunk):
    rows = [(i, p, 0.05 + ((i * 7 + p * 13) % 19) / 20) for i in range(9) for p in range(2, 2 + i * 3)]
    rows += [(100, None, None), (100, 3, 0.5), (101, None, None), (None, 1, 0.2), (None, 1, 0.9)]
    ts = spark.createDataFrame(rows, "row_id long, pos int, prob double").selectExpr("*", "1D AS weight")
    one = S._metric_pass
    monkeypatch.setattr(S, "_metric_pass", lambda keys, ths: one(keys, ths, chunk))
    ths = (1.01, 0.7, 0.3)
    got = {(r.row_id, r.threshold): r for r in S.row_metrics_long(ts, ["row_id"], ths).collect()}
    ids = {r[0] for r in rows}
    assert len(got) == len(ids) * 3
    for i in ids:
        own = sorted((p, q) for j, p, q in rows if j == i and p is not None)
        for t in ths:
            r, best = got[i, t], 0
            last = own[0][0] - 1 if own else 0
            for p, q in own:
                last = p if q < t else last
                best = max(best, p - last)
            kept = [q for _, q in own if q < t]
            assert (r.total_tokens, r.filtered_tokens) == (len(own), len(own) - len(kept))
            assert r.longest_run == (best / len(own) if own else 0.0)
            assert (r.perplexity is None) == (not kept)
            if kept:
                assert math.isclose(r.perplexity, math.exp(-sum(map(math.log, kept)) / len(kept)), rel_tol=1e-12)


def test_unigrams_alone_count_no_bigrams(spark):
    lm = LM.fit_bigram_lm(spark.createDataFrame(ROWS, SCHEMA), "text", lazy=True)
    assert {r.token: r.cnt for r in lm.unigrams.collect()}["a"] == Counter(w for _, t in ROWS for w in (t or "").split())["a"]
    assert "pairs" not in lm.__dict__
    assert {tuple(r) for r in lm.unigrams.collect()} == {tuple(r) for r in lm.bigrams.groupBy("token").agg({"cnt": "sum"}).collect()}


def test_texts_are_scored_from_hashed_counts_without_counting_strings(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    lm = LM.fit_bigram_lm(df, "text")
    id_col, text_col = df.columns[:2]
    got = LM.score_long(lm, df, id_col, text_col).groupBy(id_col).count().collect()
    want = Counter()
    for i, t in ROWS:
        want[i] += max(1, len((t or "").split()))
    assert {r[0]: r["count"] for r in got} == want
    assert "pairs" not in lm.__dict__  # the table of token strings is counted for those who read it
    tokens = Counter(w for _, t in ROWS for w in (t or "").split())
    assert {tuple(r) for r in lm.totals.collect()} == {(sum(tokens.values()), len(tokens))}
    assert sorted(r.cu for r in lm.types.where("cu IS NOT NULL").collect()) == sorted(tokens.values())
