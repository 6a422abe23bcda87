"""Mergeable metrics: any split into batches gives the results of one batch."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from textlens.operators import lm as LM
from textlens.operators import scoring as S
from textlens.operators.running import RunningMetrics
from textlens.streaming.scoring import score_stream

SCHEMA = "row_id long, threshold double, total_tokens long, filtered_tokens long, perplexity double, longest_run double, failed boolean"


def rows_of(seed, n=120):
    rnd = random.Random(seed)
    out = []
    for i in rnd.sample(range(1000), n):
        bad = rnd.random() < 0.2
        for t in (1.01, 0.5):
            out.append((i, t, rnd.randrange(20), rnd.randrange(9), None if bad or rnd.random() < 0.2 else rnd.random() * 9, None if bad else rnd.random(), bad))
    return out


def values(df, keys, cols):
    return {tuple(r[k] for k in keys): tuple(r[c] for c in cols) for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert all((x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9)) for x, y in zip(a[k], b[k])), k


@pytest.mark.parametrize("seed,batches,block_rows", [(1, 1, 100), (2, 4, 100), (3, 7, 10), (4, 3, 5000)])
def test_any_split_gives_the_batch_result(spark, seed, batches, block_rows):
    rows, rnd = rows_of(seed), random.Random(seed)
    whole = spark.createDataFrame(rows, SCHEMA)
    parts = [[] for _ in range(batches)]
    for i in sorted({r[0] for r in rows}):
        parts[rnd.randrange(batches)] += [r for r in rows if r[0] == i]
    running = RunningMetrics(spark, tempfile.mkdtemp(prefix="textlens-run-", dir="/tmp"), block_rows=block_rows)
    for b, part in enumerate(parts):
        running.add(spark.createDataFrame(part, SCHEMA), b)
    running.add(spark.createDataFrame(parts[0], SCHEMA), 0)  # delivered again
    good = whole.where("NOT failed")
    close(values(running.corpus(), ["threshold"], ["mean_perplexity", "filtered_share", "n"]),
          values(S.corpus_metrics(good).join(good.groupBy("threshold").count(), "threshold"), ["threshold"], ["mean_perplexity", "filtered_share", "count"]))
    want = S.impute_failed(whole).where("failed")
    close(values(running.imputed(), ["row_id", "threshold"], ["perplexity", "longest_run"]),
          values(want, ["row_id", "threshold"], ["perplexity", "longest_run"]))


def test_batches_without_rows_or_failures(spark):
    running = RunningMetrics(spark, tempfile.mkdtemp(prefix="textlens-run-", dir="/tmp"))
    running.add(spark.createDataFrame([], SCHEMA), 0)
    assert running.corpus().count() == 0 and running.imputed().count() == 0
    running.add(spark.createDataFrame([(3, 0.5, 0, 0, None, None, True)], SCHEMA), 1)
    assert [tuple(r) for r in running.imputed().collect()] == [(3, 0.5, None, None)]
    running.add(spark.createDataFrame([(-2_000_001, 0.5, 4, 1, 2.0, 0.5, False)], SCHEMA), 2)  # arrives later, comes earlier
    assert [tuple(r) for r in running.imputed().collect()] == [(3, 0.5, 2.0, 0.5)]


def test_streamed_batches_equal_the_batch_metrics(spark):
    d = tempfile.mkdtemp(prefix="textlens-run-", dir="/tmp")
    texts = [(i, "a", "a " + " ".join(random.Random(i).choice("bcdef") for _ in range(3 + i % 7))) for i in range(24)]
    df = spark.createDataFrame(texts, "row_id long, prompt string, prediction string")
    for k in range(3):
        df.where(F.col("row_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{d}/in")
    lm = LM.fit_bigram_lm(df, "prediction")
    running = RunningMetrics(spark, f"{d}/running", ("threshold",), block_rows=5)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    score_stream(spark, stream, lm, f"{d}/out", f"{d}/check", thresholds=(1.01, 0.3), running=running).awaitTermination(300)
    rm = S.row_metrics_long(LM.score_long(lm, df, "row_id", "prediction", "prompt"), ["row_id"], (1.01, 0.3))
    close(values(running.corpus(), ["threshold"], ["mean_perplexity", "filtered_share"]),
          values(S.corpus_metrics(rm), ["threshold"], ["mean_perplexity", "filtered_share"]))
