"""Golden scoring: recorded probability arrays must reproduce the recorded perplexities,
longest runs and filtered-token shares at all 12 thresholds."""

import math

import pytest
from pyspark.sql import functions as F

from textlens.functions.metrics import DEFAULT_THRESHOLDS
from textlens.operators import lm as LM
from textlens.operators import scoring as S

# --- fixed values: recorded per-token probabilities (two rows, prediction and source) ---
GOLDEN = {
    (1, "prediction"): [0.7971671223640442, 0.34823089838027954, 0.5217762589454651, 0.5119389295578003,
                        0.2902586758136749, 0.4713563621044159, 0.7499223351478577],
    (2, "prediction"): [],
    (1, "source"): [4.610147516359575e-05, 0.8706060647964478, 0.16088776290416718, 0.17516280710697174,
                    0.29449665546417236, 0.4431178867816925, 0.2834112346172333, 0.4533606171607971, 0.8056100606918335],
    (2, "source"): [0.004097589757293463, 0.8653528094291687, 8.43568159325514e-06, 0.0003548822132870555,
                    0.03553945571184158, 1.3593200492323376e-05, 0.5420088171958923, 0.06376860290765762,
                    0.09773667901754379, 0.5682585835456848, 0.9839205145835876, 0.041648756712675095],
}
# --- end of fixed values ---


def _scores_df(spark):
    rows = []
    for (rid, side), ps in GOLDEN.items():
        for i, p in enumerate(ps):
            rows.append((rid, side, i + 1, f"t{i}", float(p)))
    return spark.createDataFrame(rows, "row_id long, side string, pos int, token string, prob double")


def _arrays(spark):
    a = LM.assemble_scores(_scores_df(spark), ["row_id", "side"])
    empty = spark.createDataFrame([(2, "prediction")], "row_id long, side string").select(
        "row_id", "side", F.array().cast(LM.SCORE_STRUCT).alias("scores"))
    return a.unionByName(empty)


def _metrics(spark):
    rm = S.row_metrics(_arrays(spark))
    return {(r.row_id, r.side, r.threshold): r for r in rm.collect()}


# --- fixed values: recorded results ---
EXPECTED_PPL = {
    (1, "prediction"): {1.01: 2.0075912475585938, 0.999: 2.0075912475585938, 0.99: 2.0075912475585938,
                        0.98: 2.0075912475585938, 0.97: 2.0075912475585938, 0.96: 2.0075912475585938,
                        0.95: 2.0075912475585938, 0.9: 2.0075912475585938, 0.8: 2.0075912475585938,
                        0.7: 2.39363956451416, 0.6: 2.39363956451416, 0.5: 2.7584550380706787},
    (1, "source"): {1.01: 7.386419296264648, 0.999: 7.386419296264648, 0.99: 7.386419296264648,
                    0.98: 7.386419296264648, 0.97: 7.386419296264648, 0.96: 7.386419296264648,
                    0.95: 7.386419296264648, 0.9: 7.386419296264648, 0.8: 12.432286262512207,
                    0.7: 12.432286262512207, 0.6: 12.432286262512207, 0.5: 12.432286262512207},
    (2, "source"): {1.01: 60.65332794189453, 0.999: 60.65332794189453, 0.99: 60.65332794189453,
                    0.98: 87.96141052246094, 0.97: 87.96141052246094, 0.96: 87.96141052246094,
                    0.95: 87.96141052246094, 0.9: 87.96141052246094, 0.8: 135.65660095214844,
                    0.7: 135.65660095214844, 0.6: 135.65660095214844, 0.5: 399.5956726074219},
}

EXPECTED_RUN = {
    (1, "prediction"): {0.7: 1 / 7, 0.6: 1 / 7, 0.5: 2 / 7},
    (1, "source"): {0.8: 1 / 9, 0.7: 1 / 9, 0.6: 1 / 9, 0.5: 1 / 9},
    (2, "source"): {0.98: 1 / 12, 0.97: 1 / 12, 0.96: 1 / 12, 0.95: 1 / 12, 0.9: 1 / 12, 0.8: 1 / 12,
                    0.7: 1 / 12, 0.6: 1 / 12, 0.5: 2 / 12},
}
SOURCE_SHARE = [0.0, 0.0, 0.0, 0.0476190476, 0.0476190476, 0.0476190476, 0.0476190476, 0.0476190476,
                0.1904761905, 0.1904761905, 0.1904761905, 0.2857142857]
PREDICTION_SHARE = [0.0] * 9 + [0.2857142857, 0.2857142857, 0.5714285713]
# --- end of fixed values ---


def test_golden_perplexity_and_runs(spark):
    m = _metrics(spark)
    for key, per_t in EXPECTED_PPL.items():
        for t, v in per_t.items():
            got = m[(key[0], key[1], t)].perplexity
            assert got == pytest.approx(v, rel=1e-5), (key, t)
    for key in EXPECTED_PPL:
        for t in DEFAULT_THRESHOLDS:
            want = EXPECTED_RUN.get(key, {}).get(t, 0.0)
            assert m[(key[0], key[1], t)].longest_run == pytest.approx(want, abs=1e-9), (key, t)
    for t in DEFAULT_THRESHOLDS:
        r = m[(2, "prediction", t)]
        assert r.perplexity is None and r.longest_run == 0.0 and r.total_tokens == 0


def test_golden_shares(spark):
    rm = S.row_metrics(_arrays(spark))
    share = {r.threshold: r for r in S.paired_share(rm).collect()}
    for i, t in enumerate(DEFAULT_THRESHOLDS):
        assert share[t].source_filtered_token_percentage == pytest.approx(SOURCE_SHARE[i], abs=5e-10)
        assert share[t].filtered_token_percentage == pytest.approx(PREDICTION_SHARE[i], abs=5e-10)


def test_long_form_equals_array_form(spark):
    """The relational row metrics (window + aggregate) equal the array expressions."""
    empty = spark.createDataFrame([(2, "prediction", None, None, None)], _scores_df(spark).schema)
    ts = _scores_df(spark).union(empty).withColumn("weight", F.lit(1.0))
    lf = {(r.row_id, r.side, r.threshold): r for r in S.row_metrics_long(ts, ["row_id", "side"]).collect()}
    af = _metrics(spark)
    assert lf.keys() == af.keys()
    for k, a in af.items():
        b = lf[k]
        assert (a.total_tokens, a.filtered_tokens) == (b.total_tokens, b.filtered_tokens)
        assert a.longest_run == pytest.approx(b.longest_run)
        if a.perplexity is None:
            assert b.perplexity is None
        else:
            assert math.isclose(a.perplexity, b.perplexity, rel_tol=1e-12)


def test_threshold_filtering_two_tokens(spark):
    """Probabilities on both sides of a threshold, at 0.2: one of two
    tokens kept per row, totals [2, 2], filtered [1, 1], longest run 0.5."""
    rows = [(r, i + 1, "x", p) for r in (1, 2) for i, p in enumerate([0.2188, 0.1148])]
    df = spark.createDataFrame(rows, "row_id long, pos int, token string, prob double")
    rm = S.row_metrics(LM.assemble_scores(df, ["row_id"]), thresholds=[0.2]).orderBy("row_id").collect()
    assert [r.total_tokens for r in rm] == [2, 2]
    assert [r.filtered_tokens for r in rm] == [1, 1]
    assert [r.longest_run for r in rm] == pytest.approx([0.5, 0.5])


def test_nothing_filtered_at_101_and_share_monotone(spark):
    rm = S.row_metrics(_arrays(spark))
    c = {r.threshold: r.filtered_share for r in S.corpus_metrics(rm).collect()}
    assert c[1.01] == 0.0
    ts = sorted(c, reverse=True)
    assert all(c[a] <= c[b] + 1e-15 for a, b in zip(ts, ts[1:]))
