"""Inverse document frequency weights for token-level scoring.

* ``document_frequency``: per term, the number of documents containing it (each document
  contributes a term once: ``array_distinct`` before the explode, then a partially
  aggregated count, so a term present everywhere is combined map-side).
* ``idf``: smoothed ``ln((1 + N) / (1 + df)) + 1``; only document frequency is involved.
* ``vocab_weights``: each vocabulary entry is re-tokenised into pieces, the IDF of its
  known pieces is aggregated (mean by default; sum, max or a grouped-aggregate pandas UDF),
  and an entry without a known piece gets 0.001.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.functions.metrics import DEFAULT_IDF_WEIGHT
from textlens.functions.text import tokenize_code
from textlens.operators.skew import lookup_join, with_freq
from textlens.session import materialize

# --- fixed values ---------------------------------------------------------------------
# Term admission of the default vectorizer: two or more word characters.
ADMIT_PATTERN = "^[A-Za-z0-9_]{2,}$"
# --- end of fixed values ------------------------------------------------------------------


def document_frequency(docs: DataFrame, text_col: str = "text", tokenizer=tokenize_code, admit: bool = False) -> DataFrame:
    terms = docs.select(F.explode_outer(F.array_distinct(tokenizer(F.col(text_col)))).alias("term")).filter(
        F.col("term").isNotNull()
    )
    if admit:
        terms = terms.filter(F.col("term").rlike(ADMIT_PATTERN))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(docs: DataFrame, text_col: str = "text", tokenizer=tokenize_code, admit: bool = False) -> DataFrame:
    """``term, df, idf``. ``N`` counts every document, also those without admitted terms;
    it is a one-row aggregate joined as a broadcast constant."""
    n = docs.agg(F.count(F.lit(1)).alias("__n_docs"))
    d = document_frequency(docs, text_col, tokenizer, admit)
    return d.crossJoin(F.broadcast(n)).select(
        "term", "df", (F.ln((F.col("__n_docs") + F.lit(1)) / (F.col("df") + F.lit(1))) + F.lit(1.0)).alias("idf")
    )


def vocab_weights(vocab: DataFrame, idf_table: DataFrame, token_col: str = "token", tokenizer=tokenize_code,
                  agg="mean") -> DataFrame:
    """``token, weight``: aggregate IDF of the entry's known pieces, 0.001 without one.

    ``agg`` is ``"mean"``, ``"sum"``, ``"max"`` or a grouped-aggregate pandas UDF
    (``Series -> float``) for a custom aggregation."""
    # entries and their pieces are read four times below
    cut = materialize(vocab.select(F.col(token_col).alias("token"), tokenizer(F.col(token_col)).alias("__terms")))
    pieces = cut.select("token", F.explode("__terms").alias("term"))
    # a frequent piece ("." or ",") occurs in a large share of a word vocabulary: salted
    # and read three times, so counted once
    table = materialize(with_freq(pieces, idf_table.select("term", "idf"), ["term"]).filter(F.col("idf").isNotNull()))
    known = lookup_join(pieces, table, ["term"], "__freq")
    if agg == "mean":
        a = F.avg("idf")
    elif agg == "sum":
        a = F.sum("idf")
    elif agg == "max":
        a = F.max("idf")
    elif callable(agg):
        a = agg(F.col("idf"))
    else:
        raise ValueError(f"unknown aggregation {agg!r}")
    per_token = known.groupBy("token").agg(a.alias("__w"))
    return (
        cut.select("token")
        .join(per_token, ["token"], "left")
        .select("token", F.coalesce(F.col("__w").cast("double"), F.lit(DEFAULT_IDF_WEIGHT)).alias("weight"))
    )


def corpus_vocabulary(docs: DataFrame, text_col: str, tokenizer) -> DataFrame:
    """Distinct tokens of a corpus (the scoring vocabulary)."""
    toks = docs.select(F.explode_outer(tokenizer(F.col(text_col))).alias("token"))
    return toks.filter(F.col("token").isNotNull()).distinct()
