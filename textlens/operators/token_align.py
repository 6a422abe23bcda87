"""Alignment of externally scored tokens with the texts they claim to score.

A table of token scores (``keys.., pos, token, prob``) may come from any tokenizer. Its
tokens must spell the text: read in the order of ``pos``, without white space (and without
the tokenizer's mark for it), they equal the text without white space. Offsets count such
characters, so they are prefix sums of token lengths on one side and of word lengths on the
other; this is what ties a sub-word token to its word, and its score to the word's weight.

``score_defects`` reports where a table breaks the contract; ``words_of_tokens`` gives each
token the word it begins in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlens.functions.text import WS_RUN, tokenize_words

#: Classes of defects, in the order of a row's report.
DEFECTS = ("unknown_row", "no_scores", "bad_prob", "repeated_pos", "missing_pos", "foreign_token", "unread_text")


def visible(text: Column, mark: str | None = None) -> Column:
    """The characters that count: a text without white space and the tokenizer's mark of it."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), WS_RUN, "")
    return F.replace(t, F.lit(mark), F.lit("")) if mark else t


def _bad(p: Column) -> Column:
    return p.isNull() | F.isnan(p) | (p <= 0) | (p > 1)


def score_defects(texts: DataFrame, scores: DataFrame, keys: list[str], text_col: str = "text", mark: str | None = None) -> DataFrame:
    """``keys.., defect, pos, at``: one row a defect.

    * ``unknown_row``: scores for keys that ``texts`` lacks; ``no_scores``: a text with
      characters and without tokens.
    * ``bad_prob``: a probability outside (0, 1], null or NaN, at ``pos``.
    * ``repeated_pos``, ``missing_pos``: a position that occurs twice (only the first token is
      read on), the first of some that do not occur. Positions start anywhere.
    * ``foreign_token``: the first token that departs from the text, at ``pos``, and the offset
      of the character; also a token past the text's end. ``unread_text``: the tokens end at
      the offset, the text goes on.

    Rows with a NULL ``pos`` say that nothing was to be scored. A row's tokens meet in one
    array, bounded by its text; those that spell the text are compared as one string, only
    the others character by character."""
    text = texts.select(*keys, visible(F.col(text_col), mark).alias("__v"))
    tokens = scores.where("pos IS NOT NULL").select(
        *keys, F.struct(F.col("pos").cast("int").alias("pos"), visible(F.col("token"), mark).alias("t"), _bad(F.col("prob")).alias("bad")).alias("__x"))
    lists = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list("__x")).alias("__l"))
    rows = text.join(lists, keys, "full")
    before = lambda i: F.get(F.col("__l"), i - 1)["pos"]
    read = F.filter("__l", lambda x, i: (i == 0) | (x["pos"] != before(i)))
    rows = rows.select(*keys, "__v", "__l", read.alias("__r"))
    rows = rows.select("*", F.array_join(F.transform("__r", lambda x: x["t"]), "").alias("__j"))
    letters = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))  # noqa: E731  (code points)
    equal = F.zip_with(letters("__j"), letters("__v"), lambda a, b: a.eqNullSafe(b))
    empty = F.least(F.length("__j"), F.length("__v")) == 0
    first = F.when(empty, F.lit(0)).otherwise(F.array_position(equal, F.lit(False)).cast("int") - 1)
    rows = rows.select("*", F.when(F.col("__j") != F.col("__v"), first).alias("__at"))
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("int").alias("pos"))
    holder = F.aggregate("__r", start, lambda s, x: F.struct(
        (s["n"] + F.length(x["t"])).alias("n"),
        F.coalesce(s["pos"], F.when(s["n"] + F.length(x["t"]) > F.col("__at"), x["pos"])).alias("pos")))["pos"]
    none = F.lit(None).cast("int")

    def defect(name, pos=none, at=none):
        return F.struct(F.lit(name).alias("defect"), pos.alias("pos"), at.alias("at"))

    def each(when, name, pos):
        return F.transform(F.filter("__l", when), lambda x: defect(name, pos(x)))

    def one(when, struct):
        return F.when(when, F.array(struct)).otherwise(F.array().cast("array<struct<defect:string,pos:int,at:int>>"))

    known, scored = F.col("__v").isNotNull(), F.col("__l").isNotNull()
    departs = known & scored & F.col("__at").isNotNull()
    twice = F.array_distinct(F.transform(F.filter("__l", lambda x, i: (i > 0) & (x["pos"] == before(i))), lambda x: x["pos"]))
    gaps = F.transform(F.filter(F.transform("__r", lambda x, i: F.struct(
        (F.get(F.col("__r"), i - 1)["pos"] + 1).alias("want"), x["pos"].alias("got"))), lambda g: g["want"] < g["got"]), lambda g: g["want"])
    found = F.concat(
        one(~known, defect("unknown_row")),
        one(known & ~scored & (F.length("__v") > 0), defect("no_scores")),
        F.when(known & scored, F.concat(
            each(lambda x: x["bad"], "bad_prob", lambda x: x["pos"]),
            F.transform(twice, lambda p: defect("repeated_pos", p)),
            F.transform(gaps, lambda p: defect("missing_pos", p)))).otherwise(F.array().cast("array<struct<defect:string,pos:int,at:int>>")),
        one(departs & (F.col("__at") < F.length("__j")), defect("foreign_token", holder, F.col("__at"))),
        one(departs & (F.col("__at") >= F.length("__j")), defect("unread_text", none, F.col("__at"))))
    return rows.select(*keys, F.explode(found).alias("d")).select(*keys, "d.defect", "d.pos", "d.at")


def words_of_tokens(texts: DataFrame, scores: DataFrame, keys: list[str], text_col: str = "text", mark: str | None = None,
                    tokenizer=tokenize_words) -> DataFrame:
    """``scores`` with the column ``word``: the text's word in which the token begins (NULL
    past the text's end). For rows without defects of order or spelling; the words are those
    of ``tokenizer``, whose tokens must hold all visible characters.

    One window a row brings words and tokens into the order of their offsets; the work is
    linear in the text and nothing is joined."""
    extra = [c for c in scores.columns if c not in (*keys, "pos")]
    empty = [F.lit(None).cast(scores.schema[c].dataType).alias(c) for c in extra]
    words = texts.select(*keys, F.posexplode(tokenizer(F.col(text_col))).alias("__pos", "word"))
    words = words.select(*keys, "__pos", "word", F.lit(0).alias("__kind"), F.length(visible(F.col("word"))).alias("__n"), F.lit(None).cast("int").alias("pos"), *empty)
    tokens = scores.where("pos IS NOT NULL").select(
        *keys, F.col("pos").cast("int").alias("__pos"), F.lit(None).cast("string").alias("word"), F.lit(1).alias("__kind"),
        F.length(visible(F.col("token"), mark)).alias("__n"), F.col("pos").cast("int").alias("pos"), *[F.col(c) for c in extra])
    by_kind = Window.partitionBy(*keys, "__kind").orderBy("__pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = words.unionByName(tokens).withColumn("__end", F.sum("__n").over(by_kind)).withColumn("__off", F.col("__end") - F.col("__n"))
    place = Window.partitionBy(*keys).orderBy("__off", "__kind", "__pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("__kind") == 0, F.struct("word", "__end")), ignorenulls=True).over(place)
    placed = both.withColumn("__w", last).where("__kind = 1")
    inside = F.col("__off") < F.col("__w.__end")
    return placed.select(*keys, "pos", *extra, F.when(inside, F.col("__w.word")).alias("word"))
