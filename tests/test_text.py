"""Prompt rendering, response parsing, tokenizers."""

from pyspark.sql import functions as F

from textlens.functions import text as T


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("v")).collect()[0].v


def test_unclosed_fence_strip_and_complete(spark):
    prompt = "  fn area(w: u32, h: u32) -> u32 {"
    resp = "echo ### Response\nA short one:\n```rust\nfn area(w: u32, h: u32) -> u32 {\n    w * h\n}"
    code = one(spark, T.extract_code(T.response_part(F.col("r")), F.col("l")), r=resp, l="rust")
    assert code == "fn area(w: u32, h: u32) -> u32 {\n    w * h\n}"  # the fence is never closed
    gen = one(spark, T.strip_prompt(F.lit(code), F.col("p")), p=prompt)
    assert gen == "\n    w * h\n}"
    assert one(spark, T.complete_code(F.col("p"), F.lit(gen)), p=prompt) == prompt + gen


def test_extract_first_closed_block_and_language_is_literal(spark):
    resp = "x ```c++\nA\n``` y ```c++\nB\n```"
    assert one(spark, T.extract_code(F.col("r"), F.col("l")), r=resp, l="c++") == "A"
    assert one(spark, T.response_part(F.col("r")), r="a ### Response b ### Response c") == " c"
    assert one(spark, T.response_part(F.col("r")), r="no marker") == "no marker"


def test_render_prompt_fills_language_first_and_prompt_last(spark):
    out = one(spark, T.render_prompt(F.col("p"), F.col("l")), p="f({language})", l="rust")
    assert out.startswith("<s> You are an exceptionally intelligent coding assistant")
    assert "```rust\nf({language})\n```" in out
    assert out.endswith("```rust\nf({language})")


def test_tokenizers(spark):
    assert one(spark, T.tokenize_words(F.col("t")), t="  a\tb c\n\nd ") == ["a", "b", "c", "d"]
    assert one(spark, T.tokenize_words(F.col("t")), t="") == []
    assert one(spark, T.tokenize_code(F.col("t")), t="def f(x1): return 42") == ["def", "f", "(", "x1", ")", ":", "return", "42"]
    assert one(spark, T.shingles(T.tokenize_words(F.col("t")), 5), t="a b c d") == []
    assert one(spark, T.shingles(T.tokenize_words(F.col("t")), 5), t="a b c d e f") == ["a b c d e", "b c d e f"]
