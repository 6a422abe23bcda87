"""External token scores against the texts they claim to score."""

import random

import pytest
from pyspark.sql import functions as F

from textlens.operators import token_align as A
from textlens.operators.lm import with_weights

SCHEMA = "row_id long, pos int, token string, prob double"


def pieces(text, size, mark=""):
    out = []
    for w in text.split():
        out += [(mark if k == 0 else "") + w[k:k + size] for k in range(0, len(w), size)]
    return out


def report(spark, texts, scores, **options):
    t = spark.createDataFrame(texts, "row_id long, text string")
    s = spark.createDataFrame(scores, SCHEMA)
    return sorted(((r.row_id, r.defect, r.pos, r.at) for r in A.score_defects(t, s, ["row_id"], **options).collect()), key=str)


def test_each_class_of_defect(spark):
    text = "one two three"
    good = list(enumerate(pieces(text, 2), 4))  # on e tw o th re e from position 4
    rows = {
        1: [(p, t, 0.5) for p, t in good],
        2: [(p, t, 0.5) for p, t in good if p != 6],  # tw is missing
        3: [(p, t, 0.5) for p, t in good] + [(6, "tw", 0.5)],
        4: [(p, "XX" if p == 8 else t, 0.5) for p, t in good],
        5: [(p, t, {5: 0.0, 6: 1.5, 7: float("nan"), 8: None}.get(p, 1.0)) for p, t in good],
        6: [],
        7: [(p, t, 0.5) for p, t in good if p < 8],
        8: [(p, t, 0.5) for p, t in good] + [(11, "more", 0.5)],
        9: [(1, "x", 0.5)],
        10: [(None, None, None)],
        11: [(1, "é", 0.5), (2, "\U0001f600", 0.5), (3, " ", 0.5), (4, "z\n", 0.5)],
    }
    rows[14] = [(1, "\U0001f600\U0001f600", 0.5), (2, "zy", 0.5)]
    texts = [(14, "\U0001f600\U0001f600zz")] + [(i, text) for i in range(1, 9)] + [(10, " \n"), (11, "é\U0001f600 z"), (12, ""), (13, None)]
    got = report(spark, texts, [(i, *x) for i, r in rows.items() for x in r])
    assert got == sorted([
        (2, "missing_pos", 6, None), (2, "foreign_token", 7, 3), (3, "repeated_pos", 6, None), (4, "foreign_token", 8, 6),
        (5, "bad_prob", 5, None), (5, "bad_prob", 6, None), (5, "bad_prob", 7, None), (5, "bad_prob", 8, None),
        (6, "no_scores", None, None), (7, "unread_text", None, 6), (8, "foreign_token", 11, 11), (9, "unknown_row", None, None),
        (14, "foreign_token", 2, 3)], key=str)


def test_marks_and_random_breaks(spark):
    rnd = random.Random(4)
    texts, scores, want = [], [], []
    for i in range(40):
        text = " ".join("".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(1, 30)))
        t = pieces(text, 3, "▁")
        texts.append((i, text))
        if i % 2:
            k = rnd.randrange(len(t))
            want.append((i, "foreign_token", k, sum(len(x.replace("▁", "")) for x in t[:k])))
            t[k] = t[k].replace("▁", "").replace("a", "A").replace("b", "B").replace("c", "C")
        scores += [(i, p, x, 0.25) for p, x in enumerate(t)]
    assert report(spark, texts, scores, mark="▁") == sorted(want, key=str)
    assert report(spark, [], []) == []


def test_words_and_weights_of_sub_words(spark):
    text = "the idea of the ideas"
    t = spark.createDataFrame([(1, text), (2, "xy z"), (3, "")], "row_id long, text string")
    tokens = pieces(text, 3)
    s = spark.createDataFrame([(1, p, x, 0.5) for p, x in enumerate(tokens)] + [(2, 0, "x", 0.5), (2, 1, "yz", 0.5), (2, 2, "past", 0.5)], SCHEMA)
    got = {(r.row_id, r.pos): r for r in A.words_of_tokens(t, s, ["row_id"]).collect()}
    want = [w for w in text.split() for _ in range(0, len(w), 3)]
    assert [got[1, p].word for p in range(len(tokens))] == want
    assert [got[2, p].word for p in range(3)] == ["xy", "xy", None]
    assert got[1, 1].token == "ide" and got[1, 1].prob == 0.5
    idf = spark.createDataFrame([("the", 1.0), ("ideas", 3.0)], "token string, weight double")
    placed = A.words_of_tokens(t, s, ["row_id"]).where("row_id = 1").select("row_id", "pos", F.col("word").alias("token"))
    weights = [r.weight for r in sorted(with_weights(placed, idf).collect(), key=lambda r: r.pos)]
    assert weights == pytest.approx([{"the": 1.0, "ideas": 3.0}.get(w, 0.001) for w in want])
