"""A training corpus from raw documents: quality classifier, near duplicates, secrets,
mixing and byte-level BPE, each by one operator of ``textlens.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``, whatever they are named. ``run`` writes each stage's rows as Parquet
in the shared checkpoint folder and reads them back for the next one.

Decisions are made by row, under a key: the id where it is one row's own, else a hash of
id and text. Defined results: null and empty texts go through every stage (the quality
classifier scores them, all of them are one group of copies); rows without an id and rows
that share one are judged each by its text, and a label of a shared id holds for all its
rows; rows that share id and text are one document to the second stage; rows of one id
share the draw of the mixing; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm.bpe import bpe_digests
from textlens.llm.common import small_side, table
from textlens.llm.jaccard_join import jaccard_classes
from textlens.llm.mixing import mix_rows
from textlens.llm.quality import quality_labels, quality_scores
from textlens.llm.secrets import redact_secrets
from textlens.session import materialize

#: Shares of the words that the mixing aims at.
MIX = {"clean": 0.95, "toxic": 0.05}


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, DataFrame | None]:
    """(``docs`` with a key, the key's name, the repeated ids if any). A hashed key has bit 62
    set, which ids have not."""
    key = "_key"
    while key in docs.columns:
        key += "_"
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    own = F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).bitwiseOR(F.lit(1 << 62))
    if repeated.isEmpty():
        return docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), own)), key, None
    repeated = materialize(repeated)
    marked = docs.join(small_side(repeated.toDF(key)), docs["doc_id"] == F.col(key), "left")
    alone = F.col("doc_id").isNotNull() & F.col(key).isNull()
    return marked.withColumn(key, F.when(alone, F.col("doc_id").cast("long")).otherwise(own)), key, repeated


def _without(keyed: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose key is not in ``gone`` (one column of distinct keys), unkeyed."""
    return keyed.join(small_side(gone.toDF(key)), key, "left_anti").drop(key)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (fitted on ``labels.quality``) rejects go."""
    keyed, key, repeated = _keyed(docs)
    labels = quality_labels(spark, sf_dir)
    if repeated is not None:
        shared = keyed.join(small_side(repeated), "doc_id", "left_semi").select("doc_id", F.col(key)).distinct()
        labels = labels.union(labels.join(shared, "doc_id").select(F.col(key), "label"))
    scores = materialize(quality_scores(keyed, labels, id_col=key))
    return _without(keyed, key, scores.where("predicted = 0").select("doc_id").distinct()).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least key."""
    keyed, key, repeated = _keyed(docs)
    if repeated is not None or not docs.where("doc_id IS NULL").isEmpty():
        keyed = materialize(keyed.dropDuplicates([key]))
    classes = materialize(jaccard_classes(keyed, id_col=key).select("doc_id", "kept"))
    return _without(keyed, key, classes.where("NOT kept").select("doc_id")).select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as the rates say that meet ``MIX``."""
    domain = F.when(F.col("toxic") == 1, "toxic").otherwise("clean")
    labels = table(spark, sf_dir, "labels").where("toxic IS NOT NULL").select("doc_id", domain.alias("domain"))
    return mix_rows(docs, labels, MIX)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every taken document."""
    import public_tokenizers

    return bpe_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing", mixing),
    ("byte-level BPE", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs


#: Trained models and the iterative fit have no SQL form; the tests use brute force.
ORACLE_SQL = None
