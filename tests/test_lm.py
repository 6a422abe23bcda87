"""Bigram LM fit/score, prompt exclusion, IDF weights, imputation."""

import math

import pytest
from pyspark.sql import functions as F

from textlens.operators import idf as I
from textlens.operators import lm as LM
from textlens.operators import scoring as S


def test_scoring_positions_and_probabilities(spark):
    fit = spark.createDataFrame([("a b a b",), ("a c",)], "text string")
    lm = LM.fit_bigram_lm(fit, "text", lam=0.5)
    df = spark.createDataFrame([(1, "a b", "a b c")], "row_id long, prompt string, text string")
    ts = LM.token_scores(lm, df, "row_id", "text", "prompt").collect()
    # prompt has 2 tokens: with a start token only t3 = "c" is scored, context "b".
    assert [(r.pos, r.token) for r in ts] == [(3, "c")]
    n, v = 6, 3  # predicted tokens a,b,a,b,a,c ; types a,b,c
    uni = (1 + 1) / (n + v + 1)
    want = 0.5 * (0 / 2) + 0.5 * uni  # context "b" seen twice, never followed by "c"
    assert ts[0].prob == pytest.approx(want)
    no_bos = LM.token_scores(lm, df.drop("prompt"), "row_id", "text", None, add_bos=False).collect()
    assert [r.pos for r in no_bos] == [2, 3]


def test_score_rows_keeps_every_row(spark):
    fit = spark.createDataFrame([("a b c",)], "text string")
    lm = LM.fit_bigram_lm(fit, "text")
    df = spark.createDataFrame([(1, "a b", "a b"), (2, "a", "a b c"), (3, "", "")], "row_id long, prompt string, text string")
    got = {r.row_id: r.scores for r in LM.score_rows(lm, df, "row_id", "text", "prompt").collect()}
    assert got[1] == [] and got[3] == [] and len(got[2]) == 2


def test_idf_and_vocab_weights(spark):
    docs = spark.createDataFrame([("ab cd",), ("ab",), ("x",)], "text string")
    t = {r.term: r.idf for r in I.idf(docs, "text").collect()}
    assert t["ab"] == pytest.approx(math.log(4 / 3) + 1)
    assert t["cd"] == pytest.approx(math.log(4 / 2) + 1)
    adm = {r.term for r in I.idf(docs, "text", admit=True).collect()}
    assert "x" not in adm and "ab" in adm
    vocab = spark.createDataFrame([("ab.cd",), ("zz",)], "token string")
    w = {r.token: r.weight for r in I.vocab_weights(vocab, I.idf(docs, "text"), "token").collect()}
    assert w["ab.cd"] == pytest.approx((t["ab"] + t["cd"]) / 2)  # "." is unknown: skipped
    assert w["zz"] == 0.001


def test_vocab_weights_with_a_custom_aggregate(spark):
    import pandas as pd

    @F.pandas_udf("double")
    def median(x: pd.Series) -> float:
        return float(x.median())

    idf = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 2.0)], "term string, idf double")
    vocab = spark.createDataFrame([("a.b.c",), ("zz",)], "token string")
    got = {r.token: r.weight for r in I.vocab_weights(vocab, idf, "token", agg=median).collect()}
    assert got == {"a.b.c": 2.0, "zz": 0.001}


def test_unknown_tokens_weigh_the_default(spark):
    fit = spark.createDataFrame([("a b c",)], "text string")
    weights = I.vocab_weights(I.corpus_vocabulary(fit, "text", lambda c: F.split(c, " ")), I.idf(fit, "text"), "token")
    lm = LM.fit_bigram_lm(fit, "text")
    df = spark.createDataFrame([(1, "a zz qq")], "row_id long, text string")
    got = {r.token: r.weight for r in LM.token_scores(lm, df, "row_id", "text", weights=weights).collect()}
    assert got["zz"] == got["qq"] == 0.001 and got["a"] == pytest.approx(1 + math.log(2 / 2))
    assert {r.weight for r in LM.token_scores(lm, df, "row_id", "text").collect()} == {1.0}


def test_long_metrics_equal_array_metrics(spark):
    fit = spark.createDataFrame([("a b a b c a b",), ("c c a",)], "text string")
    lm = LM.fit_bigram_lm(fit, "text")
    df = spark.createDataFrame([(1, "a b a b x"), (2, ""), (3, "c"), (4, None)], "row_id long, text string")
    long = {(r.row_id, r.threshold): r for r in S.row_metrics_long(LM.score_long(lm, df), ["row_id"], (0.9, 0.3)).collect()}
    arrays = {(r.row_id, r.threshold): r for r in S.row_metrics(LM.score_rows(lm, df), (0.9, 0.3)).collect()}
    assert set(long) == set(arrays) and len(long) == 8
    for k, r in long.items():
        a = arrays[k]
        assert (r.total_tokens, r.filtered_tokens) == (a.total_tokens, a.filtered_tokens)
        assert r.longest_run == pytest.approx(a.longest_run) and (r.perplexity is None) == (a.perplexity is None)
    both = LM.fit_and_score(df.fillna(""), "row_id", "text").filter("pos IS NOT NULL").count()
    assert both == 6


def test_hot_keys_are_salted(spark):
    from textlens.operators.skew import hot_salts, lookup_join
    from textlens.session import materialize

    big = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = materialize(big.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("v")))
    assert [(r.k, r["__salts"]) for r in hot_salts(table, ["k"], "n", 0.1).collect()] == [("hot", 9)]
    got = lookup_join(big, table, ["k"], "n", 0.1)
    assert got.columns == ["id", "k", "v"] and got.count() == 1000
    assert got.filter("k = 'hot'").select("v").distinct().collect()[0].v == 899
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 1000") == 1  # read once


def test_split_valid_and_prompt_mismatches(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "a b")], "row_id long, text string")
    ok, bad = LM.split_valid(df, "text", add_bos=False)
    assert sorted(r.row_id for r in ok.collect()) == [4]
    assert {r.row_id: r.reason for r in bad.collect()} == dict.fromkeys((1, 2, 3), "fewer than 2 tokens")
    ds = df.withColumnRenamed("text", "prompt")
    res = spark.createDataFrame([(1, "a"), (2, None), (3, None), (9, "z")], "row_id long, prompt string")
    assert {r.row_id for r in LM.prompt_mismatches(ds, res).collect()} == {2, 9}


def test_impute_failed_uses_earlier_mean(spark):
    rows = [(1, 0.5, 2.0, 0.1, False), (2, 0.5, 4.0, 0.3, False), (3, 0.5, None, None, True), (4, 0.5, None, 0.0, False),
            (5, 0.5, None, None, True)]
    df = spark.createDataFrame(rows, "row_id long, threshold double, perplexity double, longest_run double, failed boolean")
    got = {r.row_id: r for r in S.impute_failed(df, partitions=3).collect()}
    assert got[3].perplexity == pytest.approx(3.0) and got[3].longest_run == pytest.approx(0.2)
    assert got[5].perplexity == pytest.approx(3.0) and got[5].longest_run == pytest.approx(0.4 / 3)
    first = spark.createDataFrame([(1, 0.5, None, None, True)], df.schema)
    assert S.impute_failed(first).collect()[0].perplexity is None
