"""End-to-end experiment run and the streaming scorer, with values."""

import json
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from test_golden import EXPECTED_PPL, EXPECTED_RUN, GOLDEN, PREDICTION_SHARE, SOURCE_SHARE
from textlens.functions.metrics import DEFAULT_THRESHOLDS
from textlens.operators import lm as LM
from textlens.plans.experiment import ExperimentSpec, run_experiment
from textlens.session import checkpoint_dir
from textlens.streaming.scoring import score_stream


def scratch(name):
    return tempfile.mkdtemp(prefix=f"textlens-{name}-", dir="/tmp")


def read_csv(spark, path):
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_dataset(d, rows, columns="id,prompt,language,source"):
    path = os.path.join(d, "data.csv")
    with open(path, "w") as f:
        f.write(columns + "\n")
        for r in rows:
            f.write(",".join('"' + str(v).replace('"', '""') + '"' for v in r) + "\n")
    return path


ROWS = [(1, "let total n =", "ocaml", "let total n =\n  n + 1"), (2, "proc start", "tcl", "proc start {} { puts ok }")]
ANSWERS = [(1, "let total n =", "ocaml", "### Response\n```ocaml\nlet total n =\n  n * 2\n```"),
           (2, "proc start", "tcl", "### Response\n```tcl\nproc start {} {\n  puts no")]
ANSWER_SCHEMA = "row_id long, prompt string, language string, response string"


def test_run_from_prompts_to_shares(spark):
    d = scratch("exp")
    spec = ExperimentSpec(dataset=write_dataset(d, ROWS), save_path=os.path.join(d, "out"), key="id", thresholds=(1.01, 0.3),
                          chat_template="<{language}> {{ messages }}")
    out = run_experiment(spark, spec, spark.createDataFrame(ANSWERS, ANSWER_SCHEMA))
    told = {int(r.row_id): r.instruction for r in read_csv(spark, out["instructions"]).collect()}
    assert told == {1: "<ocaml> let total n =", 2: "<tcl> proc start"}
    code = {int(r.row_id): r for r in read_csv(spark, out["generated_code"]).collect()}
    assert code[1].generated_code == "\n  n * 2" and code[1].prediction == "let total n =\n  n * 2"
    assert code[2].prediction == "proc start {} {\n  puts no"
    res = {int(r.row_id): r.asDict() for r in read_csv(spark, out["results"]).collect()}
    # the LM of the two predictions, by hand: 13 tokens of 13 types, each context seen once
    def p(seen, unigram):
        return 0.7 * seen + 0.3 * (unigram + 1) / (13 + 12 + 1)

    tokens = "<s> let total n = n * 2".split(), "<s> proc start {} { puts no".split()
    assert sum(len(t) - 1 for t in tokens) == 13 and len(set(tokens[0][1:]) | set(tokens[1][1:])) == 12
    # scored after the prompt "let total n =": n (after =), * (after n: seen "=" and "*"), 2
    own = [p(1, 2), p(0.5, 1), p(1, 1)]
    assert json.loads(res[1]["token_probabilities"]) == pytest.approx(own)
    assert float(res[1]["1.01_perplexity"]) == pytest.approx(math.exp(-sum(map(math.log, own)) / 3))
    assert float(res[1]["0.3_longest_filtered_sequence"]) == pytest.approx(1.0)
    source = json.loads(res[1]["source_token_probabilities"])  # n, +, 1
    assert source == pytest.approx([p(1, 2), p(0, 0), 1 / 26])
    shares = {r.threshold: r for r in spark.read.json(out["token_percentages"]).collect()}
    assert shares[1.01].filtered_token_percentage == 0.0 and len(shares) == 2
    assert shares[0.3].filtered_token_percentage == pytest.approx(1.0, abs=1e-8)


def test_repeated_prompts_keep_their_own_results(spark):
    """Two rows of one prompt with predictions of 5 and 3 further words, and their responses
    in the order of the dataset."""
    d = scratch("exp")
    rows = [("def f", "python", "def f a b c d e"), ("def f", "python", "def f a b c"), ("def g", "python", "def g x")]
    path = write_dataset(d, rows, "prompt,language,prediction")
    spec = ExperimentSpec(dataset=path, save_path=os.path.join(d, "out"), generation=False, thresholds=(1.01,))
    res = {int(r.row_id): r for r in read_csv(spark, run_experiment(spark, spec)["results"]).collect()}
    assert {i: len(json.loads(r.token_probabilities)) for i, r in res.items()} == {0: 5, 1: 3, 2: 1}
    assert len({r["1.01_perplexity"] for r in res.values()}) == 3
    answers = [(p, lang, f"### Response\n```{lang}\n{full}\n```") for p, lang, full in rows]
    given = spark.createDataFrame(answers, "prompt string, language string, response string").coalesce(1)
    spec = ExperimentSpec(dataset=path, save_path=os.path.join(d, "out2"), scoring=False)
    code = read_csv(spark, run_experiment(spark, spec, given)["generated_code"]).collect()
    assert {int(r.row_id): r.prediction for r in code} == {i: full for i, (_, _, full) in enumerate(rows)}
    with pytest.raises(ValueError, match="3 rows cannot be aligned with 2"):
        run_experiment(spark, spec, given.limit(2))
    twice = spark.createDataFrame([(0, *answers[0]), (0, *answers[1])], "row_id long, prompt string, language string, response string")
    with pytest.raises(ValueError, match="occurs 2 times"):
        run_experiment(spark, spec, twice)


def test_wrong_prompt_stops_the_run(spark):
    d = scratch("exp")
    spec = ExperimentSpec(dataset=write_dataset(d, ROWS), save_path=os.path.join(d, "out"), key="id", scoring=False)
    wrong = [(1, "another", *ANSWERS[0][2:]), ANSWERS[1]]
    with pytest.raises(ValueError, match="row 1"):
        run_experiment(spark, spec, spark.createDataFrame(wrong, ANSWER_SCHEMA))


def test_external_scores_reproduce_recorded_results(spark):
    """Recorded probabilities through the job; row 3 has no scores and so has failed."""
    d = scratch("exp")
    rows = [(1, "p", "python", "p s", "p x"), (2, "q", "rust", "q s", "q x"), (3, "r", "go", "r s", "r x")]
    data = write_dataset(d, rows, "row_id,prompt,language,source,prediction")
    given = [(r, side, i + 1, f"t{i}", v) for (r, side), vs in GOLDEN.items() for i, v in enumerate(vs)]
    given += [(2, "prediction", None, None, None)]  # scored, nothing after the prompt
    path = os.path.join(d, "scores")
    spark.createDataFrame(given, "row_id string, side string, pos int, token string, prob double").write.parquet(path)
    spec = ExperimentSpec(dataset=data, save_path=os.path.join(d, "out"), generation=False, token_scores=path)
    out = run_experiment(spark, spec)
    assert "instructions" not in out and "generated_code" not in out
    res = {int(r.row_id): r.asDict() for r in read_csv(spark, out["results"]).collect()}
    for (row, side), by_threshold in EXPECTED_PPL.items():
        mark = "" if side == "prediction" else "source_"
        for t, v in by_threshold.items():
            assert float(res[row][f"{t}_{mark}perplexity"]) == pytest.approx(v, rel=1e-5)
            run = EXPECTED_RUN[(row, side)].get(t, 0.0)
            assert float(res[row][f"{t}_{mark}longest_filtered_sequence"]) == pytest.approx(run, abs=1e-9)
    assert res[2]["1.01_perplexity"] is None
    # imputed from the rows before it: the only prediction with a perplexity, and both runs
    assert float(res[3]["0.5_perplexity"]) == pytest.approx(EXPECTED_PPL[(1, "prediction")][0.5], rel=1e-5)
    assert float(res[3]["0.5_longest_filtered_sequence"]) == pytest.approx((2 / 7 + 0) / 2)
    assert json.loads(res[3]["token_probabilities"]) == [0.0]
    shares = {r.threshold: r for r in spark.read.json(out["token_percentages"]).collect()}
    for i, t in enumerate(DEFAULT_THRESHOLDS):
        assert shares[t].filtered_token_percentage == pytest.approx(PREDICTION_SHARE[i], abs=5e-10)
        assert shares[t].source_filtered_token_percentage == pytest.approx(SOURCE_SHARE[i], abs=5e-10)


def test_short_texts_are_rejected_with_a_reason(spark):
    d = scratch("exp")
    data = write_dataset(d, [(1, "a", "x", "a b"), (2, "c", "x", "c d")], "row_id,prompt,language,prediction")
    spec = ExperimentSpec(dataset=data, save_path=os.path.join(d, "out"), generation=False, add_start_token=False)
    assert read_csv(spark, run_experiment(spark, spec)["rejected"]).count() == 0
    data = write_dataset(scratch("exp"), [(1, "a", "x", "a"), (2, "c", "x", "c d")], "row_id,prompt,language,prediction")
    spec = ExperimentSpec(dataset=data, save_path=os.path.join(d, "out2"), generation=False, add_start_token=False)
    out = run_experiment(spark, spec)
    assert [(r.row_id, r.side, r.reason) for r in read_csv(spark, out["rejected"]).collect()] == [
        ("1", "prediction", "fewer than 2 tokens")]
    assert read_csv(spark, out["results"]).count() == 2


def tables(spark):
    base = checkpoint_dir(spark).removeprefix("file:") + "/textlens-tables/" + spark.sparkContext.applicationId
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def test_score_stream_leaves_no_tables(spark):
    d = scratch("stream")
    src = os.path.join(d, "in")
    rows = spark.createDataFrame([(1, "a b", "a b c d"), (2, "x", "x y")], "row_id long, prompt string, prediction string")
    rows.write.parquet(src)
    lm = LM.fit_bigram_lm(spark.createDataFrame([("a b c d x y",)], "text string"), "text")
    before = tables(spark)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    q = score_stream(spark, stream, lm, os.path.join(d, "out"), os.path.join(d, "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(d, "out"))
    assert out.count() == 2 * 12
    assert {r.row_id: r.total_tokens for r in out.filter(F.col("threshold_idx") == 0).collect()} == {1: 2, 2: 1}
    assert before and tables(spark) == before
