"""Corpus metrics and imputation kept as mergeable tables.

Row metrics arrive in batches (a stream's micro-batches, later runs) in any order of rows.
Three tables under one folder, each written once for a batch and never rewritten, hold what
later results need:

* ``sums``: per group and block of row ids the number of rows, token sums, and for each
  metric the sum and count of its known values. Sums merge by addition, so corpus means and
  shares read one row a (batch, group, block), never the rows again.
* ``failed``: the rows whose scorer failed; their metrics depend on earlier rows.
* ``rows``: id and metrics of the others, in folders by block, so that imputation reads only
  the blocks in which a row failed.

A block is ``block_rows`` consecutive ids, which bounds the window inside it for any number
of batches. A batch that is delivered again replaces its own files (exactly once). A result
is that of all batches written before, whatever the split into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlens.functions import metrics as M

VALUES = ("perplexity", "longest_run")


class RunningMetrics:
    """``path``: a folder that all executors share. Row ids are integers; ``group_cols`` name
    the groups (threshold, side)."""

    def __init__(self, spark: SparkSession, path: str, group_cols: tuple[str, ...] = ("threshold",), id_col: str = "row_id",
                 block_rows: int = 1_000_000):
        self.spark, self.path, self.groups, self.id, self.block_rows = spark, path.rstrip("/"), list(group_cols), id_col, block_rows

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Adds a batch: ``id, group_cols.., total_tokens, filtered_tokens, perplexity,
        longest_run[, failed]``. Failed rows count for the imputation only."""
        if "failed" not in rows.columns:
            rows = rows.withColumn("failed", F.lit(False))
        rows = rows.withColumn("block", F.floor(F.col(self.id) / F.lit(self.block_rows)).cast("bigint"))
        good = rows.where("NOT failed")
        sums = good.groupBy(*self.groups, "block").agg(
            F.count(F.lit(1)).alias("n"), F.sum("total_tokens").alias("total_tokens"), F.sum("filtered_tokens").alias("filtered_tokens"),
            *[f(c).alias(f"{k}_{c}") for c in VALUES for k, f in (("sum", F.sum), ("count", F.count))])
        sums.write.mode("overwrite").parquet(f"{self.path}/sums/batch={batch_id}")
        rows.where("failed").select(self.id, *self.groups, "block").write.mode("overwrite").parquet(f"{self.path}/failed/batch={batch_id}")
        good.select(self.id, *self.groups, *VALUES, "block").write.mode("overwrite").partitionBy("block").parquet(
            f"{self.path}/rows/batch={batch_id}")

    def _table(self, name: str, schema: str | None = None) -> DataFrame:
        read = self.spark.read.option("basePath", f"{self.path}/{name}")
        return (read.schema(schema) if schema else read).parquet(f"{self.path}/{name}/batch=*")

    def corpus(self) -> DataFrame:
        """``group_cols.., n, mean_perplexity, filtered_share``: like ``corpus_metrics`` over
        all rows so far."""
        return self._table("sums").groupBy(*self.groups).agg(
            F.sum("n").alias("n"), F.try_divide(F.sum("sum_perplexity"), F.sum("count_perplexity")).alias("mean_perplexity"),
            (F.sum("filtered_tokens") / (F.sum("total_tokens") + F.lit(M.SHARE_EPSILON))).alias("filtered_share"))

    def imputed(self) -> DataFrame:
        """``id, group_cols.., perplexity, longest_run`` of the failed rows: the means over the
        rows with smaller ids, as ``impute_failed`` gives over all rows so far."""
        failed = self._table("failed").select(self.id, *self.groups, "block")
        per_block = self._table("sums").groupBy(*self.groups, "block").agg(
            *[F.sum(f"{k}_{c}").alias(f"{k}_{c}") for c in VALUES for k in ("sum", "count")])
        marks = failed.select(*self.groups, "block").distinct().withColumn("__mark", F.lit(True))
        before = Window.partitionBy(*self.groups).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        totals = per_block.join(marks, [*self.groups, "block"], "full").select(
            *self.groups, "block", "__mark",
            *[F.coalesce(F.sum(f"{k}_{c}").over(before), F.lit(0)).alias(f"{k}_{c}") for c in VALUES for k in ("sum", "count")])
        offsets = totals.where("__mark").drop("__mark")
        kinds = [f"`{c}` {failed.schema[c].dataType.simpleString()}" for c in (self.id, *self.groups)]
        rows = self._table("rows", ", ".join([*kinds, *[f"{c} double" for c in VALUES], "block bigint"]))  # a batch may have none
        own = rows.join(failed.select("block").distinct(), ["block"], "left_semi")  # prunes the folders
        none = [F.lit(None).cast("double").alias(c) for c in VALUES]
        inside = own.select(self.id, *self.groups, "block", *VALUES, F.lit(False).alias("__f")).unionByName(
            failed.select(self.id, *self.groups, "block", *none, F.lit(True).alias("__f")))
        w = Window.partitionBy(*self.groups, "block").orderBy(self.id).rowsBetween(Window.unboundedPreceding, -1)
        parts = inside.select(self.id, *self.groups, "block", "__f",
                              *[F.coalesce(F.sum(c).over(w), F.lit(0.0)).alias(f"__s_{c}") for c in VALUES],
                              *[F.count(c).over(w).alias(f"__n_{c}") for c in VALUES]).where("__f")
        j = parts.join(offsets, [*self.groups, "block"])
        return j.select(self.id, *self.groups, *[
            F.try_divide(F.col(f"__s_{c}") + F.col(f"sum_{c}"), F.col(f"__n_{c}") + F.col(f"count_{c}")).alias(c) for c in VALUES])
