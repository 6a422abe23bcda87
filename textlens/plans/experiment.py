"""The whole evaluation run as one Spark job function.

``ExperimentSpec`` carries the run's parameters (what a settings file would hold), with a
switch for each of the two sections. ``run_experiment`` then:

1. reads the prompt dataset (``row_id, prompt, language[, source][, prediction]``); a row
   is known by its position, or by a stated key that must not repeat;
2. generation: renders every prompt with the chat template for the model (a sink). When
   ``responses`` (raw model outputs, by ``row_id`` or in the order of the dataset) are given,
   they must carry the dataset's prompts; they are parsed into ``generated_code`` / ``prediction`` = prompt + generated
   code and written;
3. scoring: takes token scores from ``token_scores`` (a table scored elsewhere: ``row_id,
   side, pos, token, prob[, weight]``), or fits the bigram LM on the LM corpus (default: the
   predictions) and scores prediction and, when the dataset has it, source in one pass;
4. texts that are too short to score are written with a reason and get no metrics; a row
   whose external scores are missing or invalid has failed: its metrics are imputed from
   earlier rows, its probabilities are 0;
5. optionally weights tokens by IDF: document frequency from the predictions, vocabulary
   from all scored texts;
6. writes the wide per-row results and the per-threshold filtered-token shares.

No driver loop over languages or rows: language is a column in every expression. Tables
made on the way go at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.functions import metrics as M
from textlens.functions import text as T
from textlens.functions.template import render_template
from textlens.operators import idf as I
from textlens.operators import lm as LM
from textlens.operators import scoring as S
from textlens.operators.align import align_by_position, require_unique
from textlens.session import materialize, scratch_tables
from textlens.sources import io as IO


@dataclass(frozen=True)
class ExperimentSpec:
    dataset: str
    save_path: str
    dataset_format: str = "csv"
    key: str | None = None  # column that identifies a row; default: its position in the data set
    generation: bool = True
    scoring: bool = True
    chat_template: str | None = None  # in the language of textlens.functions.template; default: DEFAULT_CHAT_TEMPLATE
    thresholds: tuple = M.DEFAULT_THRESHOLDS
    idf_enabled: bool = False
    add_start_token: bool = True
    lm_corpus: str | None = None  # table with a ``text`` column; default: predictions
    lm_corpus_format: str = "parquet"
    token_scores: str | None = None  # table of external token scores
    token_scores_format: str = "parquet"
    results_format: str = "csv"
    percentages_orient: str = "records"  # or "columns": one document, values by position


def parse_responses(responses: DataFrame) -> DataFrame:
    """``row_id, prompt, language, response`` -> ``.., generated_code, prediction``."""
    code = T.extract_code(T.response_part("response"), F.col("language"))
    gen = T.strip_prompt(code, "prompt")
    return responses.select("*", gen.alias("generated_code")).withColumn(
        "prediction", T.complete_code("prompt", "generated_code")
    )


def generate(ds: DataFrame, spec: ExperimentSpec, responses: DataFrame | None, out: dict) -> DataFrame:
    """Renders the prompts and, with responses, completes the dataset."""
    if spec.chat_template is None:
        rendered = ds.select("row_id", "language", T.render_prompt("prompt", "language").alias("instruction"))
    else:
        filled = render_template(ds.select("row_id", "language", "prompt"), spec.chat_template, {"messages": "prompt", "language": "language"},
                                 {"bos_token": T.BOS, "eos_token": T.EOS, "add_generation_prompt": True}, "instruction")
        rendered = filled.select("row_id", "language", "instruction")
    out["instructions"] = IO.write_table(rendered, spec.save_path, "instructions")
    if responses is None:
        return ds
    if "row_id" not in responses.columns:  # in the order of the dataset
        if spec.key:
            raise ValueError("responses without row_id are aligned by position, which a dataset with a key has not")
        responses = align_by_position(ds.select("row_id"), responses, "row_id")
    require_unique(responses, "row_id", "the responses' column")
    wrong = LM.prompt_mismatches(ds, responses).limit(1).collect()
    if wrong:
        raise ValueError(f"the response of row {wrong[0].row_id} belongs to another prompt")
    parsed = parse_responses(responses).select("row_id", "generated_code", "prediction")
    ds = ds.drop("prediction", "generated_code").join(parsed, ["row_id"], "left")
    out["generated_code"] = IO.write_generated(ds, spec.save_path)
    return ds


def sides_of(ds: DataFrame) -> DataFrame:
    """``row_id, side, prompt, text`` of the predictions and, where present, the sources."""
    sides = ds.select("row_id", F.lit("prediction").alias("side"), "prompt", F.col("prediction").alias("text"))
    if "source" in ds.columns:
        source = ds.filter(F.col("source").isNotNull())
        sides = sides.unionByName(source.select("row_id", F.lit("source").alias("side"), "prompt", F.col("source").alias("text")))
    return sides


def model_scores(spark: SparkSession, ds: DataFrame, sides: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """``row_id, side, scores, failed`` from the bigram LM (which never fails)."""
    if spec.lm_corpus:
        corpus = spark.read.format(spec.lm_corpus_format).load(spec.lm_corpus).select("text")
    else:
        corpus = ds.select(F.col("prediction").alias("text"))
    lm = LM.fit_bigram_lm(corpus, "text", add_bos=spec.add_start_token)
    weights = None
    if spec.idf_enabled:
        preds = ds.select(F.col("prediction").alias("text"))
        weights = I.vocab_weights(I.corpus_vocabulary(sides, "text", T.tokenize_words), I.idf(preds, "text"), "token")
    scored = LM.score_rows(lm, sides, "row_id", "text", "prompt", add_bos=spec.add_start_token, weights=weights,
                           extra_cols=("side",))
    return scored.withColumn("failed", F.lit(False))


def external_scores(spark: SparkSession, sides: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """``row_id, side, scores, failed`` from the table of token scores: a row without scores
    or with an invalid one has failed."""
    given = spark.read.format(spec.token_scores_format).load(spec.token_scores)
    bad = LM.validate_scores(given).select("row_id", "side").distinct().withColumn("__bad", F.lit(True))
    arrays = LM.assemble_scores(given, ["row_id", "side"])
    j = sides.select("row_id", "side").join(arrays, ["row_id", "side"], "left").join(bad, ["row_id", "side"], "left")
    failed = F.col("scores").isNull() | F.coalesce("__bad", F.lit(False))
    return j.select("row_id", "side", F.when(~failed, F.col("scores")).alias("scores"), failed.alias("failed"))


def run_experiment(spark: SparkSession, spec: ExperimentSpec, responses: DataFrame | None = None) -> dict:
    """Paths of what the run wrote."""
    out: dict = {}
    with scratch_tables(spark):
        ds = IO.read_prompts(spark, spec.dataset, spec.dataset_format, key=spec.key)
        if spec.generation:
            ds = generate(ds, spec, responses, out)
        if spec.scoring:
            score(spark, ds, spec, out)
    return out


def score(spark: SparkSession, ds: DataFrame, spec: ExperimentSpec, out: dict) -> None:
    valid, rejected = LM.split_valid(sides_of(ds), "text", add_bos=spec.add_start_token)
    out["rejected"] = IO.write_table(rejected.select("row_id", "side", "reason"), spec.save_path, "rejected")
    scored = external_scores(spark, valid, spec) if spec.token_scores else model_scores(spark, ds, valid, spec)
    scored = materialize(scored)
    rows = S.row_metrics(scored, spec.thresholds, weighted=spec.idf_enabled)
    rows = materialize(S.impute_failed(rows, "row_id", group_cols=("side", "threshold")))
    wide = ds
    for side in ("prediction", "source") if "source" in ds.columns else ("prediction",):
        own = F.col("side") == side
        wide = wide.join(S.wide_from_long(rows.filter(own), "row_id", spec.thresholds, side), ["row_id"], "left")
        probs = S.failed_probs(scored.filter(own))
        if side == "prediction":
            probs = probs.select("row_id", "token_probabilities", "tfidf_scaled_token_probabilities")
        else:
            probs = probs.select("row_id", F.col("token_probabilities").alias("source_token_probabilities"))
        wide = wide.join(probs, ["row_id"], "left")
    out["results"] = IO.write_results(wide, spec.save_path, spec.results_format)
    out["token_percentages"] = IO.write_percentages(S.paired_share(rows, "source" in ds.columns), spec.save_path, spec.percentages_orient)
