"""Scoring on a Structured Streaming source.

Completions that land as files (or any streaming source) are scored against a fitted,
static LM: each micro-batch goes through the same batch operators via ``foreachBatch``
(stream-static joins against the LM tables, then the threshold metrics), and the row
metrics are appended to a sink table. Scoring is per row, so no streaming state is
needed; exactly-once output comes from the checkpointed source offsets plus an
idempotent write keyed by ``batch_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlens.functions.metrics import DEFAULT_THRESHOLDS
from textlens.operators import lm as LM
from textlens.operators import scoring as S
from textlens.operators.running import RunningMetrics
from textlens.session import scratch_tables


def score_stream(
    spark: SparkSession,
    stream: DataFrame,
    lm: LM.BigramLM,
    out_path: str,
    checkpoint_location: str,
    text_col: str = "prediction",
    prompt_col: str | None = "prompt",
    thresholds=DEFAULT_THRESHOLDS,
    trigger_once: bool = True,
    running: RunningMetrics | None = None,
):
    """Start a query scoring ``stream`` (``row_id, prompt, prediction``) into parquet
    rows ``row_id, threshold_idx, threshold, total_tokens, filtered_tokens, perplexity,
    longest_run, batch_id`` under ``out_path``. With ``running`` each batch also goes into
    its tables, so corpus means, shares and imputed rows of all batches so far are at hand
    without reading the rows again. Returns the ``StreamingQuery``."""
    from pyspark.sql import functions as F

    def batch(df: DataFrame, batch_id: int):
        with scratch_tables(spark):
            rm = S.row_metrics_long(LM.score_long(lm, df, "row_id", text_col, prompt_col), ["row_id"], thresholds)
            rm.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
            if running:
                running.add(spark.read.parquet(f"{out_path}/batch_id={batch_id}"), batch_id)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="10 seconds")
    return w.start()
