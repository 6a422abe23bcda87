"""Inputs of the evaluation jobs, derived by Spark from the driver's parquet tables.

* ``documents``: the corpus (LM fit, IDF, shingles, MinHash, near duplicates).
* ``eval_rows(conversations)``: the prompt dataset. A user turn ``t`` is the prompt; the
  prediction is the prompt, a newline and the assistant turn ``t+1``; the ground-truth
  ``source`` is the prompt, a newline and the assistant turn ``t+3`` of the same
  conversation (NULL when the conversation ends earlier). ``row_id = conv_id*1000000 + t``.
* ``responses(documents)``: raw model outputs to parse: the document's first line is the
  prompt and the response echoes a fenced block holding the document text; blocks of
  German documents are left unclosed to reach the fallback path.
* ``adjacent_pairs(documents)``: ``candidate`` = document ``d``, ``reference`` = document
  ``d+1`` (an equi-join, no window).
* ``external_scores(conversations)``: token scores of the predictions as another tokenizer
  would send them (pieces of up to four characters of a word, ``prob = 1 / (2 + pos)``), with
  one class of fault in seven of eight rows, by conversation and turn.
* ``chats(conversations)``: ``conv_id, messages``, a conversation's turns in order.
* ``benchmark_pairs(benchmark)``: item ``i`` against item ``i+1``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.functions.text import FENCE, RESPONSE_MARKER, first_line, tokenize_words
from textlens.sources.tables import read_parquet

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


#: Set by a caller that knows its files to be single row groups (the bench); see ``read_parquet``.
PARTITIONS: int | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", PARTITIONS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, prompt, language, prediction, source``."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", F.col("turn").alias("a_turn"), F.col("text").alias("a_text"))
    a1 = a.select("conv_id", (F.col("a_turn") - 1).alias("turn"), F.col("a_text").alias("answer"))
    a3 = a.select("conv_id", (F.col("a_turn") - 3).alias("turn"), F.col("a_text").alias("later"))
    j = u.join(a1, ["conv_id", "turn"], "inner").join(a3, ["conv_id", "turn"], "left")
    return j.select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("row_id"),
        F.col("prompt"),
        F.lit("text").alias("language"),
        F.concat(F.col("prompt"), F.lit("\n"), F.col("answer")).alias("prediction"),
        F.when(F.col("later").isNotNull(), F.concat(F.col("prompt"), F.lit("\n"), F.col("later"))).alias("source"),
    )


def doc_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a prompt dataset: ``row_id, prompt, language`` (prompt = the whole text)."""
    d = documents(spark, sf_dir)
    return d.select(F.col("doc_id").alias("row_id"), F.col("text").alias("prompt"), F.col("lang").alias("language"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, prompt, language, response``."""
    d = documents(spark, sf_dir)
    closing = F.when(F.col("lang") == "de", F.lit("")).otherwise(F.lit("\n" + FENCE))
    return d.select(
        F.col("doc_id").alias("row_id"),
        first_line(F.col("text")).alias("prompt"),
        F.col("lang").alias("language"),
        F.concat(F.lit(RESPONSE_MARKER + "\n" + FENCE), F.col("lang"), F.lit("\n"), F.col("text"), closing).alias("response"),
    )


def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair_id, cand_id, ref_id, candidate, reference``."""
    d = documents(spark, sf_dir).select("doc_id", "text")
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("ref_id"), F.col("text").alias("reference"))
    return d.join(nxt, ["doc_id"], "inner").select(
        F.col("doc_id").alias("pair_id"),
        F.col("doc_id").alias("cand_id"),
        "ref_id",
        F.col("text").alias("candidate"),
        "reference",
    )


def benchmark_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("reference"))
    return b.join(nxt, ["item_id"], "inner").select(
        F.col("item_id").alias("pair_id"), F.col("text").alias("candidate"), "reference"
    )


def external_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, pos, token, prob``. Fault 0 none (but scores for an unknown row too), 1 a
    missing position, 2 a repeated one, 3 a foreign token, 4 a probability over 1, 5 no
    scores, 6 no last token, 7 one token too many."""
    ev = eval_rows(spark, sf_dir).select("row_id", tokenize_words("prediction").alias("w"))
    fault = F.pmod(F.floor(F.col("row_id") / 1_000_000) + F.col("row_id") % 1_000_000, F.lit(8))
    cut = F.flatten(F.transform("w", lambda w: F.regexp_extract_all(w, F.lit(".{1,4}"), F.lit(0))))
    rows = ev.select("row_id", fault.alias("f"), cut.alias("t")).select("row_id", "f", F.size("t").alias("n"), F.posexplode("t").alias("pos", "token"))
    f, pos = F.col("f"), F.col("pos")
    kept = rows.where(~(((f == 1) & (pos == 3)) | (f == 5) | ((f == 6) & (pos == F.col("n") - 1))))
    scored = kept.select("row_id", "pos", F.when((f == 3) & (pos == 2), "#").otherwise(F.col("token")).alias("token"),
                         F.when((f == 4) & (pos == 1), F.lit(1.5)).otherwise(1 / (pos + 2)).alias("prob"))
    more = rows.where(((f == 2) & (pos == 2)) | ((f == 7) & (pos == F.col("n") - 1)) | ((f == 0) & (pos == 0))).select(
        F.when(f == 0, -F.col("row_id") - 1).otherwise(F.col("row_id")).alias("row_id"), F.when(f == 7, F.col("n")).otherwise(pos).alias("pos"),
        "token", (1 / (pos + 2)).alias("prob"))
    return scored.unionByName(more)


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.col("text").alias("content")).alias("m"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("messages"))
