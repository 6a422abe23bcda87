"""Sources, sinks and the driver contract."""

import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlens.operators import align as A
from textlens.sources import io as IO
from textlens.sources import quoted_csv as Q


def test_read_prompts_csv_multiline_and_quotes(spark):
    d = tempfile.mkdtemp(prefix="textlens-test-", dir="/tmp")
    p = os.path.join(d, "prompts.csv")
    with open(p, "w") as f:
        f.write('prompt,language,source\n')
        f.write('"def f():\n    return ""x""",python,NA\n')
        f.write('fn main() {},rust,"fn main() {\n}"\n')
    rows = IO.read_prompts(spark, p).orderBy("language").collect()
    assert rows[0].prompt == 'def f():\n    return "x"' and rows[0].source is None
    assert rows[1].source == "fn main() {\n}"
    assert "row_id" in rows[0].asDict()


def test_sinks_round_trip(spark):
    d = tempfile.mkdtemp(prefix="textlens-test-", dir="/tmp")
    df = spark.createDataFrame([(1, [0.5, 0.25])], "row_id long, token_probabilities array<double>")
    path = IO.write_results(df, d)
    back = spark.read.option("header", True).option("escape", '"').csv(path).collect()[0]
    assert json.loads(back.token_probabilities) == [0.5, 0.25]
    share = spark.createDataFrame([(0, 1.01, 0.0, None)], "threshold_idx int, threshold double, filtered_token_percentage double, source_filtered_token_percentage double")
    jp = IO.write_percentages(share, d)
    line = spark.read.json(jp).collect()[0]
    assert line.source_filtered_token_percentage is None
    rows = [(i, t, 0.1 * i, v) for i, (t, v) in enumerate([(1.01, None), (0.5, 0.25)] + [(0.4, 1 / 3)] * 10)]
    share = spark.createDataFrame(rows[::-1], share.schema)
    text = spark.read.text(IO.write_percentages(share, d, "columns")).collect()
    assert len(text) == 1 and json.loads(text[0].value) == {
        "source_filtered_token_percentages": {str(i): v and round(v, 10) for i, _, _, v in rows},
        "filtered_token_percentages": {str(i): round(p, 10) for i, _, p, _ in rows}}
    with pytest.raises(ValueError):
        IO.write_percentages(share, d, "rows")


def test_json_column(spark):
    df = spark.createDataFrame([('{"k": 3}',)], "props string")
    assert IO.parse_json_column(df, "props", "k BIGINT").select(F.col("props_parsed.k")).collect()[0][0] == 3


def test_read_json_document(spark):
    p = os.path.join(tempfile.mkdtemp(prefix="textlens-test-", dir="/tmp"), "settings.json")
    with open(p, "w") as f:
        json.dump({"name": "run", "thresholds": [1.01, 0.5]}, f, indent=2)
    row = IO.read_json(spark, p, "name string, thresholds array<double>").first()
    assert row.name == "run" and row.thresholds == [1.01, 0.5]


def test_rows_are_known_by_position_or_by_a_key_that_does_not_repeat(spark):
    d = tempfile.mkdtemp(prefix="textlens-test-", dir="/tmp")
    for name, lines in (("a.csv", ["p,x,1", "p,x,2", "q,y,3"]), ("b.csv", ["p,x,4"])):
        with open(os.path.join(d, name), "w") as f:
            f.write("\n".join(["prompt,language,source", *lines]) + "\n")
    rows = IO.read_prompts(spark, d).collect()
    assert sorted((r.row_id, r.source) for r in rows) == [(0, "1"), (1, "2"), (2, "3"), (3, "4")]
    keyed = IO.read_prompts(spark, os.path.join(d, "a.csv"), key="source")
    assert sorted(r.row_id for r in keyed.collect()) == ["1", "2", "3"] and "source" not in keyed.columns
    with pytest.raises(ValueError, match="'p' occurs 2 times"):
        IO.read_prompts(spark, os.path.join(d, "a.csv"), key="prompt")
    own = spark.createDataFrame([("p", 5), ("p", 5)], "prompt string, row_id long")
    path = os.path.join(d, "rows")
    own.write.parquet(path)
    with pytest.raises(ValueError, match="5 occurs 2 times"):
        IO.read_prompts(spark, path, "parquet")
    own.select("prompt").write.parquet(path + "2")
    assert sorted(r.row_id for r in IO.read_prompts(spark, path + "2", "parquet").collect()) == [0, 1]


TRICKY = ["", "plain", 'a "quoted" word', "two\nlines", "\n\n", 'ends with quote"', '"', ",", "x,y\n\"z\",\n", "\r\nwindows", "é ü", " spaces ",
          "a" * 300, "\n".join(f'line {i} "{i}"' for i in range(40)), "NA", "trailing\n"]


def write_quoted(path, rows, end="\n"):
    with open(path, "w", newline="") as f:
        f.write("prompt,language,n" + end)
        for r in rows:
            f.write(",".join('"' + str(v).replace('"', '""') + '"' for v in r) + end)
            if len(str(r[0])) % 5 == 0:
                f.write(end)  # an empty line between records


@pytest.mark.parametrize("split", [64, 500, 10_000_000])
def test_quoted_csv_is_read_in_splits(spark, split):
    """Several files, fields with newlines and quotes: equal to Spark's whole-file reader, in
    several tasks, with the position of every record."""
    rnd = random.Random(split)
    d = tempfile.mkdtemp(prefix="textlens-test-", dir="/tmp")
    written = []
    for name in ("1.csv", "2.csv", "3.csv"):
        rows = [(rnd.choice(TRICKY) + rnd.choice(TRICKY), f"l{rnd.randrange(3)}", len(written) + i) for i in range(60 if name != "2.csv" else 0)]
        write_quoted(os.path.join(d, name), rows, "\r\n" if name == "3.csv" else "\n")
        written += rows
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = Q.read_quoted_csv(spark, d, places=True).collect()
        tasks = Q._lines(spark, d).rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks > 10 or split > 500
    assert [(r.row_id, r.prompt or "", r.language, int(r.n)) for r in sorted(got, key=lambda r: r.row_id)] == [
        (i, *r) for i, r in enumerate(written)]
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(d)
    key = lambda r: (int(r.n), (r.prompt or "").replace("\r\n", "\n"), r.language)  # noqa: E731  (Spark's reader makes \n of both)
    assert sorted(map(key, got)) == sorted(map(key, whole.collect()))
    assert {(os.path.basename(r["__file"]), r["__ordinal"]) for r in got} == {(f, i) for f in ("1.csv", "3.csv") for i in range(60)}


def test_quoted_csv_without_rows_and_with_types(spark):
    d = tempfile.mkdtemp(prefix="textlens-test-", dir="/tmp")
    write_quoted(os.path.join(d, "none.csv"), [])
    none = Q.read_quoted_csv(spark, os.path.join(d, "none.csv"))
    assert none.columns == ["row_id", "prompt", "language", "n"] and none.count() == 0
    write_quoted(os.path.join(d, "one.csv"), [("x", "y", 7)])
    typed = Q.read_quoted_csv(spark, os.path.join(d, "one.csv"), T.StructType([T.StructField("n", T.IntegerType())]))
    assert typed.dtypes[-1] == ("n", "int") and typed.first().n == 7


def test_alignment_by_position(spark):
    left = spark.range(1000).repartition(7).selectExpr("id * 3 AS value")
    numbered = A.with_positions(left)
    rows = numbered.collect()
    assert sorted(r.position for r in rows) == list(range(1000)) and {r.value for r in rows} == {3 * i for i in range(1000)}
    again = A.align_by_position(numbered, left.selectExpr("value + 1 AS other"))
    assert all(r.other == r.value + 1 for r in again.collect()) and again.count() == 1000
    with pytest.raises(ValueError, match="1000 rows cannot be aligned with 999"):
        A.align_by_position(numbered, left.limit(999))
    assert A.with_positions(left.limit(0)).count() == 0


def test_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = conf = Context()

    from textlens import session

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert set(df.columns) == {"row_id", "threshold", "total_tokens", "filtered_tokens", "perplexity", "longest_run"}
    assert df.count() == 200 * 12
    qs, os_ = E.queries(), E.oracle_sql()
    assert set(os_) <= set(qs)
