"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw
corpus.

Words and word pairs of a text are hashed into ``buckets`` bins. Two multinomials are
counted over all rows: the raw corpus (every document) and the target (documents marked
trusted). A document's score is the mean over its n-grams of

    ln p_target(bin) - ln p_raw(bin),

the target being smoothed towards the raw corpus by ``mu`` pseudo-counts, so a bin that
the target never saw keeps a finite, negative weight. The length-normalised score is
compared with a fixed threshold. The bin weights (``buckets`` doubles, 512 kB at the
default, whatever the corpus) are a scalar subquery; the documents are read once to
count and once to score, and only bin counts are shuffled (and written once, as two
branches use them).

Beside the ratio, plain rules count words, symbols, repeated lines and repeated 3-word
windows of each text.

Defined results: a null or empty text has no words, score 0 and fails the rules; an
empty table gives no rows; without trusted rows every weight is 0 and the rules alone
decide; repeated rows give repeated results; a null id is an id like any other and is
never trusted; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm.common import SPACE, let, small_side, table, texts, words
from textlens.session import materialize

BUCKETS = 1 << 16
MU = 100_000.0
THRESHOLD = -0.07
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"


def word_hashes(w: Column) -> Column:
    """The words as 64-bit hashes. Pairs and windows hash these, so a word's characters are
    read once."""
    return F.transform(w, lambda x: F.xxhash64(x))


def _pair(h: Column, x: Column, i: Column) -> Column:
    return F.xxhash64(x, F.get(h, i + 1))


def ngram_bins(h: Column, buckets: int = BUCKETS) -> Column:
    """Bins of the words and of the neighbouring word pairs of an array of word hashes."""
    one = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    two = F.transform(h, lambda x, i: F.pmod(_pair(h, x, i), F.lit(buckets)).cast("int"))
    return F.concat(one, F.slice(two, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))))


def mean_weight(h: Column, weights: Column, buckets: int = BUCKETS) -> Column:
    """The mean of ``weights`` over the bins of ``ngram_bins``, without making their array;
    0 without words."""
    weight = lambda x: F.get(weights, F.pmod(x, F.lit(buckets)).cast("int"))
    last = F.size(h) - 1
    both = F.transform(h, lambda x, i: weight(x) + F.when(i < last, weight(_pair(h, x, i))).otherwise(F.lit(0.0)))
    return F.when(last < 0, F.lit(0.0)).otherwise(F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / (2 * last + 1))


def repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the text; ``w`` is an
    array of word hashes.

    Windows are compared by a 64-bit hash. Only a text with a repeated window sorts its
    (hash, position) pairs; equal neighbours are the repeated windows, and the gaps
    between their sorted positions give the words covered, in O(n log n) at any length.
    """
    def covered(pos):
        return F.aggregate(
            F.transform(pos, lambda p, i: F.coalesce(F.least(F.get(pos, i + 1) - p, F.lit(3)), F.lit(3))),
            F.lit(0).cast("long"), lambda a, x: a + x)

    def of_pairs(q):
        hits = F.transform(q, lambda x, i: F.when(
            (x["h"] == F.get(q, i - 1)["h"]) | (x["h"] == F.get(q, i + 1)["h"]), x["p"]))
        return let(F.sort_array(F.array_compact(hits)), covered)

    def of_windows(g):
        pairs = F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(pairs), of_pairs))

    windows = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
                          lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return let(windows, of_windows)


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def bin_weights(spark: SparkSession, target_bins: DataFrame, buckets: int, mu: float) -> Column:
    """The weight of each bin as one array value (a scalar subquery of ``buckets``
    doubles). ``target_bins``: rows (bin, raw, target) of counts."""
    total = target_bins.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    ratio = F.log((F.col("target") + mu * F.col("raw") / F.col("all_raw")) / (F.col("all_target") + mu)) - F.log(
        F.col("raw") / F.col("all_raw"))
    w = target_bins.crossJoin(F.broadcast(total)).select(  # total is one row
        "bin", F.when(F.col("all_target") > 0, ratio).otherwise(F.lit(0.0)).alias("w"))
    full = spark.range(buckets).select(F.col("id").cast("int").alias("bin")).join(w, "bin", "left").select(
        "bin", F.coalesce("w", F.lit(0.0)).alias("w"))
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "w"))), lambda s: s["w"])).scalar()


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  buckets: int = BUCKETS, mu: float = MU, threshold: float = THRESHOLD,
                  min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, the rule counts, llr_score, base_failed and kept for every row of ``docs``.

    ``trusted``: a DataFrame whose column ``doc_id`` names the trusted documents."""
    spark = docs.sparkSession
    t = texts(docs, id_col, text_col)
    good = small_side(trusted.select(F.col("doc_id").alias("_id")).where("_id IS NOT NULL").distinct()
                      .withColumn("_good", F.lit(1)))
    counts = materialize(t.join(good, F.col("doc_id") == F.col("_id"), "left")
              .select(F.coalesce("_good", F.lit(0)).alias("_good"), word_hashes(words(F.col("text"))).alias("_h"))
              .select("_good", F.explode(ngram_bins(F.col("_h"), buckets)).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("raw"), F.sum("_good").alias("target")))
    weights = bin_weights(spark, counts, buckets, mu)
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    scored = (t.withColumn("_h", word_hashes(words(F.col("text")))).withColumn("_weights", weights).select(
        "doc_id",
        F.size("_h").cast("long").alias("n_words"),
        _without(F.col("text"), SPACE).cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_h")).alias("n_repeat_words"),
        mean_weight(F.col("_h"), F.col("_weights"), buckets).alias("llr_score")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("llr_score") >= threshold))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules(table(spark, sf_dir, "documents"), trusted)
