"""Readers and writers of the evaluation tables.

* ``read_prompts``: the CSV prompt dataset (header row, quoted multi-line fields, doubled
  quotes as escape, explicit schema, ``NA``-style strings to NULL), read in splits.
* ``read_json`` / ``parse_json_column``: whole JSON documents or a JSON text column.
* ``write_generated``, ``write_results``, ``write_percentages``: the sinks. Arrays are
  serialised with ``to_json`` for CSV, which has no array type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlens.operators.align import require_unique, with_positions
from textlens.sources.quoted_csv import header_of, read_quoted_csv

PROMPT_SCHEMA = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("prediction", T.StringType()),
    ]
)

# --- fixed values ---------------------------------------------------------------------
# Strings a CSV reader of the original tool maps to missing values.
NA_STRINGS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
              "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# --- end of fixed values ------------------------------------------------------------------


def read_prompts(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = None,
                 key: str | None = None) -> DataFrame:
    """Prompt dataset with a ``row_id``. For CSV the header decides which of the schema's
    columns exist (``source`` and ``prediction`` are optional).

    ``key`` names the column that identifies a row; it must not repeat. Without one (and
    without a column ``row_id``, for which the same holds) a row's position in the data set
    is its id: files by name, rows in order. Rows that repeat a prompt stay apart."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
        key = key or ("row_id" if "row_id" in df.columns else None)
        if not key:
            return with_positions(df, "row_id", written=True)
    else:
        named = header_of(spark, path)
        df = read_quoted_csv(spark, path, schema or PROMPT_SCHEMA)
        df = df.select(*[F.when(F.col(f"`{c}`").isin(*NA_STRINGS), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c)
                         if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes])
        key = key or ("row_id" if "row_id" in named else None)
        if not key:
            return df
    df = require_unique(df, key)
    return df if key == "row_id" else df.drop("row_id").withColumnRenamed(key, "row_id")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def parse_json_column(df: DataFrame, col: str, schema: str) -> DataFrame:
    return df.withColumn(f"{col}_parsed", F.from_json(F.col(col), schema))


def arrays_to_json(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out.append(F.to_json(F.col(f"`{f.name}`")).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Quoted CSV; leading and trailing white space is part of a text and stays."""
    w = arrays_to_json(df).write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"')
    w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_table(df: DataFrame, save_path: str, name: str) -> str:
    path = save_path.rstrip("/") + "/" + name
    write_csv(df, path)
    return path


def write_generated(df: DataFrame, save_path: str) -> str:
    path = save_path.rstrip("/") + "/generated_code"
    write_csv(df, path)
    return path


def write_results(df: DataFrame, save_path: str, fmt: str = "csv") -> str:
    path = save_path.rstrip("/") + "/results"
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        write_csv(df, path)
    return path


def write_percentages(df: DataFrame, save_path: str, orient: str = "records") -> str:
    """The shares of each threshold, to 10 decimals. ``records``: one JSON line per threshold
    (``threshold_idx, threshold, filtered_token_percentage, source_filtered_token_percentage``);
    ``columns``: one JSON document that maps each column to its values by position."""
    path = save_path.rstrip("/") + "/token_percentages"
    shares = ("filtered_token_percentage", "source_filtered_token_percentage")
    out = df.select("threshold_idx", "threshold", *[F.round(c, 10).alias(c) for c in shares])
    if orient == "records":
        out.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif orient == "columns":
        listed = out.agg(F.sort_array(F.collect_list(F.struct("threshold_idx", *shares))).alias("l"))  # a row a threshold

        def by_place(share):
            pairs = F.transform("l", lambda x: F.struct(x["threshold_idx"].cast("string"), x[share]))
            return F.map_from_entries(pairs).alias(share + "s")

        listed.select(F.to_json(F.struct(*map(by_place, reversed(shares)))).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    else:
        raise ValueError("orient must be 'records' or 'columns'")
    return path
