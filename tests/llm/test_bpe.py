"""Byte-level BPE against tiktoken."""

import base64
import hashlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from textlens.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RAW = open(PATH, "rb").read()
V = bpe.Vocabulary(RAW)
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={}, mergeable_ranks={
    base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())})
ODD = ["", " ", "a", "don't we'll  \n\n x", "é😀ñ" * 50, "a" * 300, "ab" * 5000, "supercalifragilisticexpialidocious" * 9,
       "\x00\x01", "𝔘𝔫𝔦𝔠𝔬𝔡𝔢 中文字符測試", "x" * 255 + " " + "y" * 256 + " " + "z" * 257, "<|endoftext|>"]


def encoded(texts):
    ids, ends = bpe.Encoder(V, P.PATTERN)(texts)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def test_odd_texts():
    assert encoded(ODD) == [TIK.encode_ordinary(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(t):
    assert encoded([t]) == [TIK.encode_ordinary(t)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abetionhr", min_size=1, max_size=600))
def test_heap_equals_rounds(t):
    import numpy as np

    piece = t.encode()
    rows = V.byte_ids[np.frombuffer(piece, np.uint8)][None].copy()
    assert V.merge_long(piece).tolist() == V.merge_rows(rows)[0].tolist()


def test_query_on_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, ODD[4]), (-3, ODD[4])], "doc_id long, text string")
    df = df.select("doc_id", "text").union(extra)
    got = sorted(map(tuple, bpe.bpe_digests(df, PATH, P.PATTERN).collect()))
    want = []
    for r in df.collect():
        ids = TIK.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_empty_table(spark):
    assert bpe.bpe_digests(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0
