"""Positions of rows, and the alignment of tables that have no key in common.

Results that come back "in the same order" (a model's outputs, a scorer's) are aligned by
position. A position is assigned in two levels: a row's place inside its file, plus the
number of rows in the files before, prefix-summed over one row a file. No window runs over
the rows, and positions do not depend on how a scan is split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlens.session import materialize


def file_offsets(counts: DataFrame, name_col: str, n_col: str) -> DataFrame:
    """``name_col, __offset``: rows in the files before, by name. The window runs over one
    row a file."""
    before = Window.orderBy(name_col).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(name_col, F.coalesce(F.sum(n_col).over(before), F.lit(0)).alias("__offset"))


def with_positions(df: DataFrame, position: str = "position", written: bool = False) -> DataFrame:
    """``df`` with the position of each row, from 0, in the order of its partitions.

    The rows are written once, a part file a task, so that a later read (or one repeated
    after a lost executor) numbers them alike. ``written`` says that ``df`` reads parquet
    files as they are: then the files' own order (by name) counts and nothing is written."""
    table = df if written else materialize(df)
    placed = table.select(*[F.col(f"`{c}`") for c in table.columns], F.col("_metadata.file_path").alias("__file"),
                          F.col("_metadata.row_index").alias("__at"))
    counts = table.select(F.col("_metadata.file_path").alias("__file")).groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    joined = placed.join(file_offsets(counts, "__file", "__n"), ["__file"])
    return joined.select(*[F.col(f"`{c}`") for c in table.columns], (F.col("__offset") + F.col("__at")).alias(position))


def align_by_position(left: DataFrame, right: DataFrame, position: str = "position") -> DataFrame:
    """Rows of ``left`` (with a column ``position``) beside those of ``right``, which gets its
    positions from its own order; columns that both have are taken from ``right``. Raises if
    the tables differ in length, as one missing row would shift all rows after it."""
    numbered = right if position in right.columns else with_positions(right, position)
    n, m = left.count(), numbered.count()
    if n != m:
        raise ValueError(f"{n} rows cannot be aligned with {m} by position")
    kept = [c for c in left.columns if c == position or c not in numbered.columns]
    return left.select(*[F.col(f"`{c}`") for c in kept]).join(numbered, [position])


def require_unique(df: DataFrame, key: str, what: str = "key") -> DataFrame:
    """``df``, if its column ``key`` has no null and no value twice; raises otherwise."""
    bad = df.groupBy(F.col(f"`{key}`").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR k IS NULL").limit(1).collect()
    if bad:
        raise ValueError(f"{what} {key!r} does not identify rows: {bad[0].k!r} occurs {bad[0].n} times")
    return df
