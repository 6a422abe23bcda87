"""Byte-level BPE encoding and decoding with length-bucketed numpy matrices.

A text is split by the vocabulary's pattern. Pieces that are tokens themselves take their
id. The others, each distinct piece once, are laid out as rows of padded matrices, one
matrix a length bucket. In each round every row merges its leftmost pair of minimum rank:
the ranks of neighbouring pairs come from an open-addressing hash table of all pairs that
make a token, the merged neighbour is cut out by compaction (every row loses exactly one
cell), and only the two pairs that touch the new token are looked up again. Rows without
a pair are done and leave the matrix. Pieces over ``LONG`` bytes, for which rounds over a
whole row would take quadratic time, keep their pairs in a heap instead (the same merges
in the same order).

Whole texts are encoded on the executors in chunks of about ``CHUNK`` characters, one
text at least; the vocabulary file is read on the driver and sent once to each executor
(its size is that of the file). No shuffle. Pieces are remembered up to ``KNOWN`` a task.

Defined results: a null or empty text has no ids and decodes to an empty text; ids may be
null or repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm.common import chunks, table, texts

CHUNK = 1_000_000
KNOWN = 150_000
LONG = 256
NONE = np.iinfo(np.int32).max
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Ranks (which are the ids) of byte strings, and the pair table made from them."""

    def __init__(self, raw: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        self.size = tokens[-1][1] + 1
        lengths = np.zeros(self.size, np.int64)
        for t, i in tokens:
            lengths[i] = len(t)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.lengths = lengths
        self.blob = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary has no token for some byte")
        self._hash_pairs(tokens)

    def _hash_pairs(self, tokens):
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], i) for t, i in tokens for k in range(1, len(t))
                 if t[:k] in self.ranks and t[k:] in self.ranks]
        a, b, i = np.array(pairs, np.int64).T
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(len(key) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << bits, NONE, np.int32)
        at, left = self._slot(key), np.arange(len(key))
        while len(left):  # linear probing, all keys at once: the first to claim a free slot keeps it
            free = self.keys[at[left]] == np.iinfo(np.uint64).max
            _, first = np.unique(at[left[free]], return_index=True)
            won = left[free][first]
            self.keys[at[won]], self.values[at[won]] = key[won], i[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, key):
        return ((key * _MIX) >> self.shift).astype(np.int64)

    def pair_ranks(self, a, b):
        """Rank of each pair of ids, NONE where they make no token (or an id is -1)."""
        key = ((a.astype(np.int64).astype(np.uint64) << np.uint64(32)) | b.astype(np.int64).astype(np.uint64)).ravel()
        out = np.full(key.shape, NONE, np.int32)
        todo = np.flatnonzero(((a >= 0) & (b >= 0)).ravel())
        at = self._slot(key[todo])
        while len(todo):
            seen = self.keys[at]
            hit = seen == key[todo]
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (seen != np.iinfo(np.uint64).max)
            todo, at = todo[go], (at[go] + 1) & self.mask
        return out.reshape(a.shape)

    def merge_rows(self, m):
        """Ids of each row of a matrix of byte ids (padding: -1 at the end)."""
        out: list[np.ndarray | None] = [None] * len(m)
        rows = np.arange(len(m))
        ranks = self.pair_ranks(m[:, :-1], m[:, 1:])
        while len(rows):
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            low = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), NONE)
            done = low == NONE
            if done.any():
                for r, ids in zip(rows[done], m[done]):
                    out[r] = ids[ids >= 0]
                go = ~done
                rows, m, ranks, best, low = rows[go], m[go], ranks[go], best[go], low[go]
                if not len(rows):
                    break
            n, each = len(rows), np.arange(len(rows))
            m[each, best] = low
            stay = np.ones(m.shape, bool)
            stay[each, best + 1] = False
            m = m[stay].reshape(n, -1)
            stay = np.ones(ranks.shape, bool)
            stay[each, best] = False
            ranks = ranks[stay].reshape(n, -1)
            left = best > 0
            ranks[each[left], best[left] - 1] = self.pair_ranks(m[each[left], best[left] - 1], low[left])
            right = best < ranks.shape[1]
            ranks[each[right], best[right]] = self.pair_ranks(low[right], m[each[right], best[right] + 1])
        return out

    def merge_long(self, piece: bytes):
        """The same merges for one long piece, with its pairs in a heap."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        tokens = [bytes([b]) for b in piece]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i) for i in range(len(ids) - 1) if (r := self.ranks.get(tokens[i] + tokens[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if tokens[i] is None or j == len(ids) or self.ranks.get(tokens[i] + tokens[j]) != r:
                continue  # a token of this pair has changed since
            tokens[i], tokens[j], ids[i] = tokens[i] + tokens[j], None, r
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(ids) and (s := self.ranks.get(tokens[k] + tokens[after[k]])) is not None:
                    heapq.heappush(heap, (s, k))
        return np.array([x for x, t in zip(ids, tokens) if t is not None], np.int32)

    def encode_pieces(self, pieces: list[bytes]):
        """Ids of each byte string."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(p) > LONG:
                out[i] = self.merge_long(p)
            else:
                buckets.setdefault(-(-len(p) // 4) * 4, []).append(i)
        for width, rows in buckets.items():
            text = b"".join(pieces[i].ljust(width, b"\0") for i in rows)
            m = self.byte_ids[np.frombuffer(text, np.uint8)].reshape(len(rows), width)
            m[np.arange(width) >= np.array([len(pieces[i]) for i in rows])[:, None]] = -1
            for i, ids in zip(rows, self.merge_rows(m)):
                out[i] = ids
        return out

    def decode(self, ids):
        """Bytes of a flat id array, and the first byte of each id (one more at the end)."""
        n = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.starts[ids] - ends[:-1], n) + np.arange(ends[-1])
        return self.blob[at], ends


class Encoder:
    """Encodes lists of texts; remembers the ids of the pieces seen so far."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.v, self.find = vocabulary, regex.compile(pattern).findall
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, docs: list[str]):
        """Flat ids of the texts and where each text ends in them."""
        if len(self.known) > KNOWN:
            self._forget()
        known, n_known, sizes, number = self.known, len(self.known), [], []
        for t in docs:
            pieces = self.find(t)
            sizes.append(len(pieces))
            number += [known.setdefault(p, len(known)) for p in pieces]
        if len(known) > n_known:
            import itertools

            new = self.v.encode_pieces([p.encode() for p in itertools.islice(known, n_known, None)])
            self.flat = np.concatenate([self.flat, *new])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in new])])
        number = np.array(number, np.int64)
        n = self.ends[number + 1] - self.ends[number]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.ends[number] - total[:-1], n) + np.arange(total[-1])]
        return ids, total[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]


_MADE: dict[int, Vocabulary] = {}


def _vocabulary(raw: bytes) -> Vocabulary:
    """Built once in each Python worker."""
    key = hash(raw)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Vocabulary(raw)
    return _MADE[key]


def _vocabulary_bytes(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) and decoded (binary, made from the ids) for every row."""
    raw = _vocabulary_bytes(docs.sparkSession, path)
    t = texts(docs, id_col, text_col)
    kind = t.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        v = _vocabulary(raw.value)
        encode = Encoder(v, pattern)
        for batch in batches:
            doc_ids, all_texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in chunks(all_texts, CHUNK):
                ids, ends = encode(all_texts[a:b])
                data, byte_ends = v.decode(ids)
                yield pa.RecordBatch.from_arrays([
                    doc_ids.slice(a, b - a),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                    pa.Array.from_buffers(pa.binary(), b - a, [
                        None, pa.py_buffer(byte_ends[ends].astype(np.int32)), pa.py_buffer(data)]),
                ], ["doc_id", "ids", "decoded"])

    return t.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    return encode_decode(docs, path, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
