"""Threshold-filtered scoring: per-row metrics, corpus metrics, imputation, wide output.

Input is a per-row score array (see ``textlens.functions.metrics``). The threshold
fan-out happens *after* the arrays exist, so each text is tokenised and scored once and
the 12 thresholds are 12 cheap array passes per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlens.functions import metrics as M
from textlens.session import materialize

ROW_METRIC_COLS = ["total_tokens", "filtered_tokens", "perplexity", "longest_run"]


def thresholds_col(thresholds) -> F.Column:
    return F.array(*[F.lit(float(t)) for t in thresholds])


def threshold_fanout(scored: DataFrame, thresholds=M.DEFAULT_THRESHOLDS) -> DataFrame:
    """One row per (row, threshold); ``threshold_idx`` keeps the configured order."""
    return scored.select("*", F.posexplode(thresholds_col(thresholds)).alias("threshold_idx", "threshold"))


def row_metrics(
    scored: DataFrame,
    thresholds=M.DEFAULT_THRESHOLDS,
    weighted: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``keys.., threshold, total_tokens, filtered_tokens, perplexity, longest_run``.

    ``scored`` holds key columns and ``scores``; every non-``scores`` column is kept as a
    key. NULL ``scores`` (failed rows) give NULL metrics."""
    keys = [c for c in scored.columns if c != "scores"]
    f = threshold_fanout(scored, thresholds)
    t = F.col("threshold")
    s = F.col("scores")
    return f.select(
        *keys,
        "threshold_idx",
        "threshold",
        M.total_tokens(s).alias("total_tokens"),
        M.filtered_tokens(s, t).alias("filtered_tokens"),
        M.perplexity(s, t, weighted).alias("perplexity"),
        F.when(s.isNotNull(), M.longest_run(s, t)).alias("longest_run"),
        *keep,
    )


def row_metrics_long(
    ts: DataFrame,
    keys: list[str],
    thresholds=M.DEFAULT_THRESHOLDS,
    weighted: bool = False,
    together: bool = False,
) -> DataFrame:
    """Row metrics straight from long-form token scores ``keys.., pos, prob, weight``,
    without assembling arrays: the scores move once, to their rows, and one numpy pass
    (``_metric_pass``) takes counts, negative log-likelihood sums and the longest filtered
    runs of all thresholds. Scores that are ``together`` already (those of a row one after the
    other in one partition, as ``lm.fit_and_score`` gives them) are not moved. Rows are told apart by a 64-bit hash of the keys, which is one to
    one for a single integer key.

    A row with nothing to score has one row with NULL ``pos``: it gets zero counts, NULL
    perplexity and a run of 0.0.
    Output: ``keys.., threshold_idx, threshold, total_tokens, filtered_tokens, perplexity,
    longest_run``.
    """
    ths = [float(t) for t in thresholds]
    named = [F.col("pos").cast("bigint").alias("__pos"), F.col("prob").cast("double").alias("__p")]
    if weighted:
        named.append(F.col("weight").cast("double").alias("__w"))
    placed = ts.select(*keys, *named, F.xxhash64(*keys).alias("__row"))
    if not together:
        placed = placed.repartition(*keys).sortWithinPartitions("__row")
    kinds = ", ".join(f"`{c}` {ts.schema[c].dataType.simpleString()}" for c in keys)
    base = placed.mapInArrow(_metric_pass(keys, ths), f"{kinds}, __n bigint, __m array<struct<t:double,k:bigint,s:double,b:bigint>>")
    long = base.select(*keys, "__n", F.posexplode("__m").alias("threshold_idx", "__m"))
    k = F.col("__m.k")
    return long.select(
        *keys,
        "threshold_idx",
        F.col("__m.t").alias("threshold"),
        F.col("__n").alias("total_tokens"),
        (F.col("__n") - k).alias("filtered_tokens"),
        F.when(k > 0, F.exp(F.col("__m.s") / k)).alias("perplexity"),
        F.when(F.col("__n") > 0, F.col("__m.b") / F.col("__n")).otherwise(F.lit(0.0)).alias("longest_run"),
    )


def _metric_pass(keys: list[str], ths: list[float], chunk: int = 1 << 18):
    """Scores with equal ``__row`` together -> one row of sums for each. Works on ``chunk``
    scores at a time, or on all scores of a row if it has more."""
    m = len(ths)

    def sums(t):
        import numpy as np
        import pyarrow as pa

        row, at = t["__row"].to_numpy(), t["__pos"]
        has, pos = at.is_valid().to_numpy(), at.fill_null(0).to_numpy()
        order = np.lexsort((pos, row))
        row, has, pos = row[order], has[order], pos[order]
        known, p = t["__p"].is_valid().to_numpy()[order], t["__p"].fill_null(np.inf).to_numpy()[order]
        with np.errstate(all="ignore"):
            nll = -np.log(p) * (t["__w"].to_numpy()[order] if "__w" in t.column_names else 1.0)
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        size = np.diff([*starts, len(row)])
        start, place = np.repeat(starts, size), np.arange(len(row))
        # as if the place before a row's first one were kept
        before = np.repeat(np.minimum.reduceat(np.where(has, pos, np.iinfo(np.int64).max), starts), size) - 1
        k, s, b = np.empty((len(starts), m), np.int64), np.empty((len(starts), m)), np.empty((len(starts), m), np.int64)
        for j, t_j in enumerate(ths):
            kept = known & (p < t_j)
            k[:, j] = np.add.reduceat(kept.astype(np.int64), starts)
            s[:, j] = np.add.reduceat(np.where(kept, nll, 0.0), starts)
            near = np.maximum.accumulate(np.where(kept & has, place, -1))
            b[:, j] = np.maximum.reduceat(np.where(has, pos - np.where(near >= start, pos[near], before), 0), starts)
        cells = pa.StructArray.from_arrays(
            [pa.array(np.tile(np.array(ths), len(starts))), pa.array(k.ravel()), pa.array(s.ravel()), pa.array(b.ravel())], ["t", "k", "s", "b"])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * m), cells)
        n = pa.array(np.add.reduceat(known.astype(np.int64), starts))
        out = t.select(keys).take(pa.array(order[starts])).append_column("__n", n).append_column("__m", lists)
        return out.combine_chunks().to_batches()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kept, rows, enough = [], 0, chunk
        for batch in batches:
            kept, rows = [*kept, batch], rows + batch.num_rows
            if rows < enough:
                continue
            t = pa.Table.from_batches(kept)
            row = t["__row"].to_numpy()
            other = np.flatnonzero(row != row[-1])
            cut = int(other[-1]) + 1 if len(other) else 0  # the last row may go on in the next batch
            if cut:
                yield from sums(t.slice(0, cut))
            kept, rows = t.slice(cut).to_batches(), rows - cut
            enough = max(chunk, 2 * rows)  # so that the scores of a long row are not looked through again and again
        if rows:
            yield from sums(pa.Table.from_batches(kept))

    return run


def corpus_metrics(rows: DataFrame, group_cols=("threshold",)) -> DataFrame:
    """Mean perplexity (NULLs ignored, as a NaN-ignoring mean) and filtered-token share
    ``sum(filtered) / (sum(total) + 1e-9)`` per threshold. Partial + final aggregation."""
    return rows.groupBy(*group_cols).agg(
        F.avg("perplexity").alias("mean_perplexity"),
        (F.sum("filtered_tokens") / (F.sum("total_tokens") + F.lit(M.SHARE_EPSILON))).alias("filtered_share"),
    )


def sample_probs(scored: DataFrame, id_cols) -> DataFrame:
    return scored.select(*id_cols, M.probs(F.col("scores")).alias("token_probabilities"))


def impute_failed(rows: DataFrame, order_col: str = "row_id", value_cols=("perplexity", "longest_run"),
                  group_cols=("threshold",), partitions: int | None = None) -> DataFrame:
    """Fill the metrics of failed rows (``failed`` = true) with the mean of the values of
    all earlier rows (by ``order_col``) at the same threshold; NULL values are ignored
    like a NaN-ignoring mean and a row with no earlier value stays NULL. Imputed values
    never change a later mean, so only successful rows feed the prefix sums.

    Two-level prefix sum, so no window runs over all rows in one task: a range partitioning
    by ``order_col`` cuts the rows into even blocks for any distribution of ids (its
    partition number is the block, written once); per-block sums are prefixed over the small
    block table, then a window inside each block adds the in-block part."""
    spark = rows.sparkSession
    n_blocks = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = materialize(rows.repartitionByRange(n_blocks, order_col).withColumn("__blk", F.spark_partition_id()))
    g = list(group_cols)
    ok = ~F.col("failed")
    aggs = []
    for v in value_cols:
        aggs += [
            F.sum(F.when(ok, F.col(v))).alias(f"__s_{v}"),
            F.count(F.when(ok, F.col(v))).alias(f"__n_{v}"),
        ]
    per_block = df.groupBy(*g, "__blk").agg(*aggs)
    wb = Window.partitionBy(*g).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        *g,
        "__blk",
        *[F.coalesce(F.sum(f"__s_{v}").over(wb), F.lit(0.0)).alias(f"__os_{v}") for v in value_cols],
        *[F.coalesce(F.sum(f"__n_{v}").over(wb), F.lit(0)).alias(f"__on_{v}") for v in value_cols],
    )
    wi = Window.partitionBy(*g, "__blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    within = df.select(
        "*",
        *[F.coalesce(F.sum(F.when(ok, F.col(v))).over(wi), F.lit(0.0)).alias(f"__is_{v}") for v in value_cols],
        *[F.coalesce(F.count(F.when(ok, F.col(v))).over(wi), F.lit(0)).alias(f"__in_{v}") for v in value_cols],
    )
    j = within.join(offsets, [*g, "__blk"], "left")
    out_cols = []
    for c in rows.columns:
        if c in value_cols:
            s = F.col(f"__is_{c}") + F.col(f"__os_{c}")
            n = F.col(f"__in_{c}") + F.col(f"__on_{c}")
            out_cols.append(F.when(F.col("failed"), F.when(n > 0, s / n)).otherwise(F.col(c)).alias(c))
        else:
            out_cols.append(F.col(c))
    return j.select(*out_cols)


def failed_probs(scored: DataFrame) -> DataFrame:
    """``token_probabilities`` and ``tfidf_scaled_token_probabilities`` of rows with a column
    ``failed``: a single 0 for a failed row, the scored ones otherwise."""
    zero = F.array(F.lit(0.0))
    bad = F.col("failed")
    return scored.withColumn("token_probabilities", F.when(bad, zero).otherwise(M.probs(F.col("scores")))).withColumn(
        "tfidf_scaled_token_probabilities", F.when(bad, zero).otherwise(M.scaled_probs(F.col("scores"))))


def wide_name(t: float, metric: str, side: str | None = None) -> str:
    side_part = f"{side}_" if side and side != "prediction" else ""
    return f"{t}_{side_part}{metric}"


def results_wide(scored: DataFrame, id_col: str, thresholds=M.DEFAULT_THRESHOLDS, weighted: bool = False,
                 side: str | None = None) -> DataFrame:
    """Wide result columns straight from the score arrays (a projection, no shuffle):
    ``{t}_perplexity`` and ``{t}_longest_filtered_sequence`` per threshold, plus
    ``token_probabilities`` (all scored probabilities)."""
    s = F.col("scores")
    cols = [F.col(id_col)]
    for t in thresholds:
        tl = F.lit(float(t))
        cols.append(M.perplexity(s, tl, weighted).alias(wide_name(t, "perplexity", side)))
        cols.append(F.when(s.isNotNull(), M.longest_run(s, tl)).alias(wide_name(t, "longest_filtered_sequence", side)))
    prefix = "" if not side or side == "prediction" else f"{side}_"
    cols.append(M.probs(s).alias(f"{prefix}token_probabilities"))
    if not side or side == "prediction":
        scale = len(thresholds) > 0 and float(thresholds[0]) == M.SCALE_THRESHOLD
        cols.append(M.scaled_probs(s, scale).alias("tfidf_scaled_token_probabilities"))
    return scored.select(*cols)


def wide_from_long(rows: DataFrame, id_col: str, thresholds=M.DEFAULT_THRESHOLDS, side: str | None = None) -> DataFrame:
    """The wide metric columns from row metrics (one aggregate), imputed values included."""
    cols = []
    for i, t in enumerate(thresholds):
        at = F.col("threshold_idx") == i
        cols.append(F.max(F.when(at, F.col("perplexity"))).alias(wide_name(t, "perplexity", side)))
        cols.append(F.max(F.when(at, F.col("longest_run"))).alias(wide_name(t, "longest_filtered_sequence", side)))
    return rows.groupBy(id_col).agg(*cols)


def paired_share(rows: DataFrame, has_source: bool = True) -> DataFrame:
    """Prediction vs source filtered-token share per threshold (conditional aggregation on
    ``side``); the source column is NULL when the dataset has no source."""
    pred = F.col("side") == "prediction"
    src = F.col("side") == "source"
    eps = F.lit(M.SHARE_EPSILON)
    share_src = (
        F.sum(F.when(src, F.col("filtered_tokens"))) / (F.coalesce(F.sum(F.when(src, F.col("total_tokens"))), F.lit(0)) + eps)
        if has_source
        else F.lit(None).cast("double")
    )
    return rows.groupBy("threshold_idx", "threshold").agg(
        (F.sum(F.when(pred, F.col("filtered_tokens"))) / (F.sum(F.when(pred, F.col("total_tokens"))) + eps)).alias(
            "filtered_token_percentage"
        ),
        share_src.alias("source_filtered_token_percentage"),
    )
