"""Modified Kneser-Ney against plain Python, and its sums."""

import random
from collections import Counter, defaultdict

import pytest

from textlens.functions.text import BOS
from textlens.operators import ngram as N


def plain_model(texts, order):
    """p(w, h) by the recursion of the definition, over dictionaries."""
    raw, left = [Counter() for _ in range(order + 1)], [defaultdict(set) for _ in range(order + 1)]
    starts = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = [BOS, *t.split()]
        for i in range(1, len(s)):
            for m in range(1, order + 1):
                if i - m + 1 < 0:
                    continue
                g = tuple(s[i - m + 1:i + 1])
                raw[m][g] += 1
                if i - m >= 0:
                    left[m][g].add(s[i - m])
                else:
                    starts[m][g] += 1
    a = [None] + [raw[m] if m == order else Counter({g: len(left[m][g]) + starts[m][g] for g in raw[m]}) for m in range(1, order + 1)]
    rates = [None]
    for m in range(1, order + 1):
        t = [0] + [sum(v == k for v in a[m].values()) for k in (1, 2, 3, 4)]
        d = list(N.FALLBACK)
        if t[1] and t[2] and t[3]:
            y = t[1] / (t[1] + 2 * t[2])
            own = [k - (k + 1) * y * t[k + 1] / t[k] for k in (1, 2, 3)]
            if all(0 <= x <= k for k, x in zip((1, 2, 3), own)):
                d = own
        rates.append(d)
    by_context = [None] + [defaultdict(list) for _ in range(order)]
    for m in range(1, order + 1):
        for g, v in a[m].items():
            by_context[m][g[:-1]].append(v)
    types = len(a[1])

    def p(w, h):
        m = len(h) + 1
        lower = p(w, h[1:]) if h else 1 / (types + 1)
        counts = by_context[m].get(h)
        if not counts:
            return lower
        cut = lambda v: rates[m][min(v, 3) - 1]
        v = a[m].get((*h, w), 0)
        gamma = sum(min(cut(c), c) for c in counts) / sum(counts)
        return (max(v - cut(v), 0) / sum(counts) if v else 0) + gamma * lower

    return p, rates


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: f"w{int(30 * rnd.random() ** 2)}"
    texts = [" ".join(word() for _ in range(rnd.choice([0, 1, 2, 5, 15, 30]))) for _ in range(n)]
    return texts + texts[:5] + ["", " "]


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_scores_equal_the_definition(spark, order):
    train, other = corpus(1), corpus(2, 12) + ["new words w1 w2 new w3 w4 w5 w6", None]
    p, rates = plain_model(train, order)
    lm = N.fit_ngram_lm(spark.createDataFrame([(t,) for t in train], "text string"), "text", order)
    got = {r.order: (r.d1, r.d2, r.d3) for r in lm.discounts.collect()}
    assert all(got[m] == pytest.approx(rates[m]) for m in range(1, order + 1))
    for bos in (True, False):
        rows = N.ngram_token_scores(lm, spark.createDataFrame(list(enumerate(other)), "row_id long, text string"), add_bos=bos).collect()
        by = defaultdict(dict)
        for r in rows:
            if r.pos is None:
                assert r.prob is None
            else:
                by[r.row_id][r.pos] = (r.token, r.prob)
        assert {r.row_id for r in rows} == set(range(len(other)))
        for i, t in enumerate(other):
            words = (t or "").split()
            s = [BOS, *words] if bos else words
            want = {}
            for j, w in enumerate(words, 1):
                at = j if bos else j - 1
                if at >= 1:
                    want[j] = (w, p(w, tuple(s[max(0, at - order + 1):at])))
            assert by[i].keys() == want.keys()
            for j in want:
                assert by[i][j][0] == want[j][0] and by[i][j][1] == pytest.approx(want[j][1], rel=1e-9)


def test_probabilities_sum_to_one(spark):
    train = corpus(3)
    lm = N.fit_ngram_lm(spark.createDataFrame([(t,) for t in train], "text string"), "text", 3)
    vocabulary = sorted({w for t in train for w in t.split()}) + ["<never seen>"]
    contexts = ["", "w0", "w0 w1", f"{BOS} w2", BOS, "<never> w0", "<never> <never>", "w1 <never>"]
    grams = spark.createDataFrame([(c, w, 1) for c in contexts for w in vocabulary], "ctx string, token string, n_occ long")
    sums = defaultdict(float)
    rows = N.gram_probabilities(lm, grams).collect()
    assert len(rows) == len(contexts) * len(vocabulary)
    for r in rows:
        assert r.prob > 0
        sums[r.ctx] += r.prob
    assert all(sums[c] == pytest.approx(1, rel=1e-9) for c in contexts)


def test_prompts_weights_and_the_longer_context_helps(spark):
    train = ["a b c d e f"] * 3 + ["x b c q", "y b c q", "z b c q"]
    df = spark.createDataFrame([(t,) for t in train], "text string")
    rows = spark.createDataFrame([(1, "a b", "a b c d"), (2, "a b c d", "a b")], "row_id long, prompt string, text string")
    weights = spark.createDataFrame([("c", 2.0)], "token string, weight double")
    got = {}
    for order in (2, 4):
        lm = N.fit_ngram_lm(df, "text", order)
        scored = N.ngram_token_scores(lm, rows, prompt_col="prompt", weights=weights).collect()
        got[order] = {(r.row_id, r.pos): r for r in scored}
        assert set(got[order]) == {(1, 3), (1, 4), (2, None)}
        assert got[order][1, 3].weight == 2.0 and got[order][1, 4].weight == 0.001
    assert got[4][1, 4].prob > got[2][1, 4].prob


def test_discounts_take_one_pass_and_write_no_table_of_grams(spark):
    from textlens.session import table_scope

    df = spark.createDataFrame([(t,) for t in corpus(4)], "text string")
    before = len(table_scope())
    counts = N.adjusted_counts(df, "text", 5)
    got = {r.order: (r.d1, r.d2, r.d3) for r in N.discounts(counts).collect()}
    assert len(table_scope()) - before == 1  # the texts as hashes
    _, rates = plain_model(corpus(4), 5)
    assert all(got[m] == pytest.approx(rates[m]) for m in range(1, 6))
    assert counts.tables.keys() == got.keys()  # written now, and counted from
    assert {r.order: (r.d1, r.d2, r.d3) for r in N.discounts(counts).collect()} == got
