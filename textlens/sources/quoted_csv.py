"""A splittable reader of CSV files with quoted multi-line fields.

Spark's ``multiLine`` CSV reader hands a whole file to one task, as a newline inside quotes
cannot be told from a record's end without reading from the start. Here files are scanned
in splits like any text:

1. Each split yields its physical lines with their quote characters counted. Inside a
   split, running sums give every line the number of quotes before it and, for either
   parity at the split's start, the number of records begun.
2. One row a split (its file, place and sums) is prefixed per file: an odd number of quotes
   before a split means that it starts inside a quoted field, and picks the right sums.
3. Each line now knows its record. The lines of a record, which may lie in two splits, are
   joined again and parsed by Spark's CSV parser.

A record is (file, ordinal), and ``row_id`` is its position in the data set: files by name,
records in order. It does not depend on the splits and never repeats, whatever the texts.

Quotes inside a quoted field are doubled. Records end with a newline, or a carriage return
and a newline. Empty lines between records are no records. Each file starts with the same
header. Work per task is a split; the prefix sums run over one row a split, per file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlens.operators.align import file_offsets
from textlens.session import materialize

QUOTE = '"'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``__file, __start, __line, __text, __q``: physical lines in reading order with their
    number of quotes. Only the order of the lines inside a split is used of ``__line``."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__line"), F.col("value").alias("__text"),
        (F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))).alias("__q"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, ordinal, record``: the text of every record, ordinal 0 being the header."""
    blank = F.col("__text").isin("", "\r")
    inside = Window.partitionBy("__file", "__start").orderBy("__line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quoted = _lines(spark, path).withColumn("__before", F.sum("__q").over(inside) - F.col("__q"))
    even = (F.col("__before") % 2 == 0) & ~blank  # a record begins here if the split starts outside quotes
    odd = (F.col("__before") % 2 == 1) & ~blank
    lines = materialize(quoted.select("*", even.alias("__even"), odd.alias("__odd")).select(
        "__file", "__start", "__line", "__text", "__q", "__before", "__even", "__odd",
        F.count_if("__even").over(inside).alias("__begun_even"), F.count_if("__odd").over(inside).alias("__begun_odd")))
    splits = lines.groupBy("__file", "__start").agg(
        F.sum("__q").alias("__quotes"), F.count_if("__even").alias("__n_even"), F.count_if("__odd").alias("__n_odd"))
    earlier = Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    parity = splits.withColumn("__odd_start", F.coalesce(F.sum("__quotes").over(earlier), F.lit(0)) % 2 == 1)
    begun = F.when(F.col("__odd_start"), F.col("__n_odd")).otherwise(F.col("__n_even"))
    offsets = parity.select("__file", "__start", "__odd_start", F.coalesce(F.sum(begun).over(earlier), F.lit(0)).alias("__records"))
    placed = lines.join(offsets, ["__file", "__start"])
    pick = lambda a, b: F.when(F.col("__odd_start"), F.col(b)).otherwise(F.col(a))
    number = F.col("__records") + pick("__begun_even", "__begun_odd") - 1
    open_before = (F.col("__before") % 2 == 1) != F.col("__odd_start")  # the line starts inside quotes
    own = placed.select("__file", "__start", "__line", "__text", pick("__even", "__odd").alias("__begins"), open_before.alias("__open"),
                        number.alias("ordinal")).where("__begins OR __open")
    whole = own.groupBy(F.col("__file").alias("file"), "ordinal").agg(
        F.array_sort(F.collect_list(F.struct("__start", "__line", "__text"))).alias("__l"))
    text = F.array_join(F.transform("__l", lambda x: x["__text"]), "\n")
    return whole.select("file", "ordinal", F.regexp_replace(text, "\r$", "").alias("record"))


_OPTIONS = {"quote": QUOTE, "escape": QUOTE, "mode": "PERMISSIVE", "multiLine": "true"}


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The column names, from the first record of one file (Spark stops reading there)."""
    return spark.read.option("header", True).options(**_OPTIONS).csv(path).columns


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, places: bool = False) -> DataFrame:
    """The records' fields, by the header's names (``schema`` gives types by name; string
    otherwise), and ``row_id``, the position in the data set, where the header has none;
    with ``places`` also ``__file`` and ``__ordinal`` (from 0). Files without a record below
    the header give no rows."""
    names = header_of(spark, path)
    types = {f.name: f.dataType.simpleString() for f in (schema.fields if schema else [])}
    body = materialize(records(spark, path)).where("ordinal > 0").withColumn("ordinal", F.col("ordinal") - 1)
    ddl = ", ".join(f"`{n.replace('`', '``')}` {types.get(n, 'string')}" for n in names) or "none string"
    parsed = body.select("file", "ordinal", F.from_csv("record", ddl, _OPTIONS).alias("__r"))
    offsets = file_offsets(body.groupBy("file").agg(F.count(F.lit(1)).alias("n")), "file", "n")
    own = [] if "row_id" in names else [(F.col("__offset") + F.col("ordinal")).alias("row_id")]
    own += [F.col("file").alias("__file"), F.col("ordinal").alias("__ordinal")] if places else []
    return parsed.join(offsets, ["file"]).select(*own, *[F.col("__r").getField(n).alias(n) for n in names])
