"""Table readers. Parquet is the default format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A parquet table. ``partitions`` deals its rows out round-robin, which the caller asks
    for where files are known to be a single row group (one split); by default the scan's
    splits stay as they are and no text is shuffled."""
    df = spark.read.parquet(path)
    return df.repartition(partitions) if partitions else df
