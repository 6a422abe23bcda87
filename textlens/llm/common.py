"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters between words: space, tab, \n, \v, \f, \r.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

#: Sides up to this many rows of plain numbers (at most 32 MB) may be broadcast.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that no other column of the input can
    clash with a name used later."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; no word: an empty array."""
    t = F.btrim(text, F.lit(SPACE))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN))


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(k)).cast("int")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``df`` (a few numbers a row) has at most ``rows`` rows,
    counted now; otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def chunks(values: list, size: int, measure=len):
    """(start, stop) of slices of about ``size`` in total measure, one value at least."""
    first = held = 0
    for i, x in enumerate(values):
        if held and held + measure(x) > size:
            yield first, i
            first, held = i, 0
        held += measure(x)
    if first < len(values):
        yield first, len(values)


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the least hash of ``key``. A first cut by the hash
    keeps about twice as many over all tasks, so that no task gathers more than that."""
    total = df.count()
    h = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30))
    near = df.where(h < F.lit(int(min(1.0, 2.0 * rows / max(total, 1)) * (1 << 30))))
    return near.orderBy(h, key).limit(rows)
