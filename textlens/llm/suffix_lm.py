"""Language-model scoring with a probabilistic suffix tree.

The tree's symbols are word classes: a word with at least ``MIN_COUNT`` training
occurrences is a class of its own, every other word belongs to one of ``TAIL`` classes by
its last two bytes, and the end of a text is a class. A text's probability is the product
over its tokens of

    p(class | context) * p(word | class),

the second factor being 1 for a word that is its class, (c + 0.1) / (n + 0.1 * (v + 1))
for the c, n and v of its word, tokens and distinct words in its tail class.

A context is the last 1 to ``depth`` classes, seen ``MIN_COUNT`` times at least. It becomes
a state of the tree if its next-symbol distribution diverges from that of its suffix:

    sum over symbols of n * ln(p_counted / p_suffix)  >=  PENALTY * distinct symbols.

A state's distribution is smoothed towards its suffix's by as many pseudo-counts as it
has distinct symbols (Witten-Bell), the root's towards the uniform one. A symbol is
scored in the longest suffix of its context that is a state. The bound is a count, not a
share of the corpus: classes, contexts and states grow with it.

Counts follow the corpus and cover all of it:

1. Texts are dealt into blocks of about ``BLOCK_CHARS`` by a hash of id and text. A block
   lists its distinct words with their training counts; the vocabulary sums the lists.
   Each text is written as numbers, places in its block's list.
2. The vocabulary's counts and classes return to the lists of the blocks that hold the words.
3. For each depth one pass over the blocks counts their distinct (context, symbol) pairs with
   numpy (0 for those of other texts only) and deals them by a hash of the context's last
   symbol (and of the symbol, if the former is frequent), so that a pair meets those of other
   blocks and the one of its suffix.
   There they are summed; Spark sums the parts of each context and decides on states.
4. A pair's answer goes back in the order in which its block asked: the change of its log10
   probability, 0 unless the context is a state, and whether it was seen ``MIN_COUNT`` times
   and so is a context of the next depth. The block adds the changes to its texts' scores.

Between blocks and deals pairs travel as numpy arrays, one row of zstd bytes for each block
and deal, and each depth's tables go when the next has been counted. No token occurrence is ever
a row; blocks and deals keep their size as the corpus grows, only their number follows it.

Contexts are named by 64-bit hashes. A table of at most ``SMALL`` rows of plain numbers or
words up to ``OWN_BYTES`` may be broadcast; the driver holds the ``TAIL`` classes' counts only.

Defined results: a null or empty text has its end token only; ids may be null (they count
as the empty text when folds are dealt) or repeat; rows equal in id and text are in one
block; an empty table gives no rows; without training texts the base score is log10 of
0.1 / 0.1 = 0 a token and the tree is its root, uniform; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm.common import fold, small_side, table, texts
from textlens.session import drop_tables, materialize, scratch_tables, table_scope

MIN_COUNT = 128
TAIL = 1024
DEPTH = 4
PENALTY = 1.0
BLOCK_CHARS = 12_000_000
DEAL_BLOCKS = 2  # pairs of so many blocks go to one deal
OWN_BYTES = 64  # a longer word is never a class of its own
START, END, FIRST = 0, 1, 2
OWN = 1 << 62  # a bit of the symbols that are words
ROOT = 0
SMALL = 200_000
_P = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words; bytes.split() cuts at the six ASCII spaces only."""
    return text.encode().lower().split()


@dataclass
class Root:
    """What every task knows: sums over the corpus and the counts of the small symbols
    (start, end and the tail classes)."""

    n: int  # training tokens
    v: int  # distinct ones
    least: float  # count of a context or an own symbol
    tokens: np.ndarray
    words: np.ndarray
    own: int  # number of own symbols

    @property
    def kinds(self) -> int:
        return max(1, self.own + int((self.tokens > 0).sum()))

    @property
    def size(self) -> int:
        return len(self.tokens) + self.own

    def p(self, tokens):
        return (tokens + self.kinds / self.size) / (self.n + self.kinds)


def _is_own(symbols):
    return (symbols < 0) | (symbols >= OWN)


def _mix(key, symbol):
    """Hash of a context (or root) followed by a symbol."""
    with np.errstate(over="ignore"):
        h = (key.astype(np.uint64) + np.uint64(1)) * _P + symbol.astype(np.uint64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (h ^ (h >> np.uint64(31))).astype(np.int64)


def _block_words(block):
    """A block's texts as places in the list of its distinct words, and a row for each word with its
    place and training count (b"" is the end token)."""
    import pyarrow as pa

    index = defaultdict()
    index.default_factory = index.__len__
    end = index[b""]
    codes = []
    for text in block["text"].to_pylist():
        codes.append(np.array([index[w] for w in tokens(text)] + [end], np.int32))
    learnt = [code for code, learns in zip(codes, block["learn"].to_pylist()) if learns]
    n = np.bincount(np.concatenate([np.empty(0, np.int32), *learnt]), minlength=len(index))
    m, k = len(codes), len(index)

    def after(column):
        return pa.concat_arrays([pa.nulls(m, column.type), column])

    return pa.table({
        "block": pa.array([block["block"][0].as_py()] * (m + k), pa.int64()), "at": pa.array([*range(m)] + [None] * k, pa.int64()),
        **{c: pa.concat_arrays([*block[c].chunks, pa.nulls(k, block[c].type)]) for c in ("doc_id", "learn")},
        "codes": _bytes([*codes, *[None] * k], np.int32), "nth": after(pa.array(np.arange(k))),
        "word": after(pa.array(list(index), pa.binary())), "n": after(pa.array(n))})


def _bytes(arrays, kind):
    """Numpy arrays as a column of bytes, compressed."""
    import pyarrow as pa

    codec = pa.Codec("zstd", 1)

    def packed(a):
        a = np.ascontiguousarray(a, kind)
        return a.nbytes.to_bytes(8, "little") + codec.compress(a, asbytes=True)

    return pa.array([None if a is None else packed(a) for a in arrays], pa.binary())


def _numbers(column, kind):
    """The arrays of a column of bytes."""
    import pyarrow as pa

    codec = pa.Codec("zstd")
    return [np.frombuffer(codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True), kind)
            for x in column.to_pylist()]


def _joined(column, kind):
    """Those arrays, one after another."""
    return np.concatenate([np.empty(0, kind), *_numbers(column, kind)])


def _distinct(keys):
    """(number of each key, place of each number's key): equal keys share a number."""
    import pandas as pd

    number, values = pd.factorize(keys)
    first = np.empty(len(values), np.int64)
    first[number[::-1]] = np.arange(len(keys))[::-1]
    return number, first


def _block_list(words):
    """Symbols and training counts of a block's words, by place."""
    import pyarrow as pa

    words = words.sort_by("nth")
    return pa.table({"block": words["block"][:1], "symbols": _bytes([words["symbol"].to_numpy()], np.int64),
                     "counts": _bytes([words["n"].to_numpy()], np.int64)})


class Places:
    """The tokens of a block's texts, one after another."""

    def __init__(self, coded, root: Root, deals: int):
        import pyarrow.compute as pc

        self.texts = coded.filter(pc.is_valid(coded["at"])).sort_by("at")
        code = _numbers(self.texts["codes"], np.int32)
        self.sizes = np.array([len(x) for x in code], np.int64)
        self.code, self.root, self.deals = np.concatenate([np.empty(0, np.int32), *code]), root, deals
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.first = np.zeros(len(self.code), bool)  # of their texts
        self.first[self.starts] = True
        listed = coded.filter(pc.is_null(coded["at"]))
        self.words, self.counts = _joined(listed["symbols"], np.int64), _joined(listed["counts"], np.int64)
        self.symbol = self.words[self.code]
        self.before = np.where(self.first, START, np.roll(self.symbol, 1))
        self.depth, self.context, self.suffix, self.key = 0, np.full(len(self.code), ROOT), None, None

    def deeper(self):
        """Names the contexts of the next depth, their suffixes and their pairs."""
        self.suffix = self.context
        self.context = np.roll(self.key, 1) if self.depth else _mix(self.context, self.before)
        self.key, self.depth = _mix(self.context, self.symbol), self.depth + 1
        if self.depth == 1:  # a symbol's contexts go to one deal, a frequent one's to more
            own = _is_own(self.words)
            c = np.where(own, self.counts, self.root.tokens[np.where(own, END, self.words)])
            share = 4 * self.deals / max(1, self.root.n)
            spread = np.where(self.first, self.root.tokens[END], np.roll(c[self.code], 1)) * share
            context, key = (x.view(np.uint64) >> np.uint64(33) for x in (self.context, self.key))
            self.deal = ((context + key % (1 + spread.astype(np.uint64))) % np.uint64(self.deals)).astype(np.int32)

    def texts_of(self, which):
        return np.repeat(np.arange(len(self.sizes)), self.sizes)[which]

    def summed(self, of_word):
        """Sums over the tokens of each text."""
        return np.add.reduceat(of_word[self.code], self.starts)

    def at_root(self):
        """Probabilities of the words' symbols at the root, and the texts' scores by them."""
        c, own = self.counts.astype(np.float64), _is_own(self.words)
        k = np.where(own, END, self.words)
        inside = np.log10((c + 0.1) / (self.root.tokens[k] + 0.1 * (self.root.words[k] + 1)))
        p = self.root.p(np.where(own, c, self.root.tokens[k]))
        return p, self.summed(np.where(own | (self.words == END), 0.0, inside) + np.log10(p))

    def sums(self):
        """What each text has of the columns that need no context."""
        base = np.log10((self.counts + 0.1) / (self.root.n + 0.1 * (self.root.v + 1)))
        return {"n_tokens": self.sizes, "n_known": self.summed((self.counts > 0).astype(np.int64)), "base_score": self.summed(base)}


class Pairs:
    """The distinct pairs of a block at the places ``has``, in the order in which they are dealt; a
    context's are neighbours."""

    def __init__(self, places: Places, has):
        self.at = np.flatnonzero(has)
        number, first = _distinct(places.key[self.at])
        deal = places.deal[self.at[first]]
        order = np.lexsort((places.context[self.at[first]], deal))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.number, self.first = rank[number], self.at[first[order]]
        self.sizes = np.bincount(deal, minlength=places.deals)

    def messages(self, column):
        """(deal, its part of a column) of the deals that have pairs."""
        return np.split(column, np.cumsum(self.sizes[self.sizes > 0])[:-1]) if len(column) else []


def _block_step(root: Root, depth: int, deals: int, last: bool = False):
    """A block's texts, and (``depth`` > 1) its scores and contexts of the depth below with the
    answers to its pairs -> the same for this depth, and its pairs; ``last``: the texts' scores."""
    def run(coded, packets):
        import pyarrow as pa
        import pyarrow.compute as pc

        places = Places(coded, root, deals)
        if depth == 1:
            p, score = places.at_root()
            b = places.before  # a text begins as often as one ends
            has = _is_own(b) | (root.tokens[np.where(_is_own(b) | (b == START), END, b)] >= root.least)
        else:
            for _ in range(depth - 1):
                places.deeper()
            own = packets.filter(pc.is_null(packets["deal"]))
            answers = packets.filter(pc.is_valid(packets["deal"])).sort_by("deal")
            had = np.unpackbits(_joined(own["flag"], np.uint8), count=len(places.code)).astype(bool)
            pairs = Pairs(places, had)
            change, often = _joined(answers["score"], np.float64), _joined(answers["flag"], np.uint8)
            score = _joined(own["score"], np.float64) + np.bincount(
                places.texts_of(pairs.at), change[pairs.number], len(places.sizes))
            has = np.zeros(len(had) + 1, bool)
            has[pairs.at[often[pairs.number] > 0] + 1] = True
            has = has[:-1] & ~places.first
        if last:
            return pa.table({"doc_id": places.texts["doc_id"], "learn": places.texts["learn"],
                             **{k: pa.array(x) for k, x in places.sums().items()}, "score": pa.array(score)})
        places.deeper()
        pairs = Pairs(places, has)
        learn = places.texts["learn"].to_numpy()[places.texts_of(pairs.at)]
        n = np.bincount(pairs.number, learn, len(pairs.first))
        context, suffix, symbol, n = (pairs.messages(x) for x in (
            places.context[pairs.first], places.suffix[pairs.first], places.symbol[pairs.first], n))
        # the root's probabilities are looked up here, those of deeper suffixes where they were counted
        q = pairs.messages(p[places.code[pairs.first]]) if depth == 1 else [None] * len(n)
        block = coded["block"][0].as_py()
        deal = [*np.flatnonzero(pairs.sizes), block % deals]  # the last row only passes through its deal
        return pa.table({
            "block": pa.array([block] * len(deal), pa.int64()), "deal": pa.array(deal, pa.int64()),
            "context": _bytes([*context, None], np.int64), "suffix": _bytes([*suffix, None], np.int64),
            "symbol": _bytes([*symbol, None], np.int64), "n": _bytes([*n, None], np.int32), "q": _bytes([*q, None], np.float64),
            "score": _bytes([*[None] * len(n), score], np.float64), "flag": _bytes([*[None] * len(n), np.packbits(has)], np.uint8)})

    return run


_PACKETS = ("block long, deal long, context binary, suffix binary, symbol binary, n binary, q binary, "
            "score binary, flag binary")
_SUMS = ("deal long, block long, number binary, contexts binary, of binary, symbol binary, n binary, q binary, "
         "context long, total double, distinct double, logs double, score binary, flag binary")
_ANSWERS = ("deal long, block long, score binary, flag binary, contexts binary, of binary, symbol binary, p binary")


def _deal_sums(sent, below):
    """The pairs that the blocks sent to one deal, and the probabilities of those of the depth
    below -> the pairs' sums in one row, the numbers of each block's pairs among them, and a row of
    plain numbers for each context: this deal's part of its divergence. Blocks' own rows stay."""
    import pyarrow as pa
    import pyarrow.compute as pc

    names, kinds = _columns(_SUMS)
    own = sent.filter(pc.is_null(sent["context"]))
    own = pa.table({c: own[c] if c in ("deal", "block", "score", "flag") else pa.nulls(len(own), t) for c, t in zip(names, kinds)})
    sent = sent.filter(pc.is_valid(sent["context"]))
    if not len(sent):
        return own
    sizes = [len(x) for x in _numbers(sent["n"], np.int32)]
    context, symbol = _joined(sent["context"], np.int64), _joined(sent["symbol"], np.int64)
    number, first = _distinct(_mix(context, symbol))
    n = np.bincount(number, _joined(sent["n"], np.int32), len(first))
    context, symbol = context[first], symbol[first]
    if len(below):
        known = _mix(_joined(below["contexts"], np.int64)[_joined(below["of"], np.int32)], _joined(below["symbol"], np.int64))
        order = np.argsort(known)
        at = np.searchsorted(known[order], _mix(_joined(sent["suffix"], np.int64)[first], symbol))
        q = _joined(below["p"], np.float64)[order[at]]
    else:
        q = _joined(sent["q"], np.float64)[first]
    of, at = _distinct(context)
    contexts = context[at]
    seen = n > 0
    logs = n * np.log(np.where(seen, n, 1) / q)
    parts = [np.bincount(of, x, len(contexts)) for x in (n, seen, logs)]
    m, k, deal = len(sizes), len(contexts), sent["deal"][0].as_py()
    blank = [None] * (m + k)

    def row(array, kind):
        return _bytes([array, *blank], kind)

    numbers = np.split(number, np.cumsum(sizes)[:-1])
    sums = pa.table({
        "deal": pa.array([deal] * (1 + m + k), pa.int64()),
        "block": pa.array([None, *sent["block"].to_pylist(), *[None] * k], pa.int64()),
        "number": _bytes([None, *numbers, *[None] * k], np.int32), "contexts": row(contexts, np.int64),
        "of": row(of, np.int32), "symbol": row(symbol, np.int64), "n": row(n, np.int64), "q": row(q, np.float64),
        "context": pa.concat_arrays([pa.nulls(1 + m, pa.int64()), pa.array(contexts)]),
        **{name: pa.concat_arrays([pa.nulls(1 + m, pa.float64()), pa.array(x)])
           for name, x in zip(("total", "distinct", "logs"), parts)},
        "score": pa.nulls(1 + m + k, pa.binary()), "flag": pa.nulls(1 + m + k, pa.binary())})
    return pa.concat_tables([sums, own])


def _deal_answers(least: float):
    """A deal's sums and the states among its contexts -> the answers to each block, and a row of
    the pairs' probabilities."""
    def run(sums, states):
        import pyarrow as pa
        import pyarrow.compute as pc

        blocks = sums.filter(pc.is_valid(sums["block"]))
        contexts = _joined(sums["contexts"].drop_null(), np.int64)
        if not len(contexts):
            return pa.table({k: pa.array([], t) for k, t in zip(*_columns(_ANSWERS))})
        of, n = _joined(sums["of"].drop_null(), np.int32), _joined(sums["n"].drop_null(), np.int64)
        q = _joined(sums["q"].drop_null(), np.float64)
        total, distinct = np.zeros(len(contexts)), np.zeros(len(contexts))
        order = np.argsort(contexts)
        at = order[np.searchsorted(contexts[order], states["context"].to_numpy())]
        total[at], distinct[at] = states["total"].to_numpy(), states["distinct"].to_numpy()
        state = total[of] > 0
        p = np.where(state, (n + distinct[of] * q) / np.where(state, total[of] + distinct[of], 1), q)
        change, often = np.where(state, np.log10(p / q), 0.0), n >= least
        numbers = _numbers(blocks["number"], np.int32)
        m, kept = len(numbers), sums.filter(pc.is_null(sums["block"]))
        return pa.table({
            "deal": pa.array([sums["deal"][0].as_py()] * (m + 1), pa.int64()),
            "block": pa.array([*blocks["block"].to_pylist(), None], pa.int64()),
            "score": _bytes([*(change[x] for x in numbers), None], np.float64),
            "flag": _bytes([*(often[x] for x in numbers), None], np.uint8),
            **{k: pa.concat_arrays([pa.nulls(m, pa.binary()), *kept[k].chunks]) for k in ("contexts", "of", "symbol")},
            "p": _bytes([*[None] * m, p], np.float64)})

    return run


def _columns(schema: str):
    """Names and Arrow types of a schema."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return [n for n, _ in names], [kinds[t] for _, t in names]


def count_vocabulary(vocabulary: DataFrame, p_min: float | None, min_count: int, tail: int) -> tuple[DataFrame, Root]:
    """``vocabulary`` with each word's symbol, and the root's sums."""
    n, v = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    least = float(max(1, min_count if p_min is None else p_min * n))
    size = F.length("word")
    own = (size <= OWN_BYTES) & (F.col("n") >= least)
    symbol = F.when(size == 0, F.lit(END)).when(own, F.xxhash64("word").bitwiseOR(F.lit(OWN))).otherwise(
        F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(tail)) + FIRST).cast("long")
    coded = vocabulary.withColumn("symbol", symbol)
    known = coded.where("n > 0")
    alone = (F.col("symbol") < 0) | (F.col("symbol") >= OWN)
    root = Root(n, v, least, np.zeros(FIRST + tail), np.zeros(FIRST + tail), known.where(alone).count())
    for r in known.where(~alone).groupBy("symbol").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        root.tokens[r.symbol], root.words[r.symbol] = r.n, r.v  # at most ``tail`` + 1 rows
    return coded, root


def _states(sums: DataFrame, penalty: float) -> DataFrame:
    """context, total, distinct and state of a depth's contexts, summed over the deals."""
    parts = sums.where("context is not null").groupBy("context").agg(
        *(F.sum(c).alias(c) for c in ("total", "distinct", "logs")))
    gain = F.col("logs") - F.col("total") * F.log("total")
    return parts.select("context", "total", "distinct",
                        ((F.col("total") > 0) & (gain >= penalty * F.col("distinct"))).alias("state"))


def _cogrouped(left: DataFrame, right: DataFrame, key: str, run, schema: str) -> DataFrame:
    right = right.toDF(*right.columns)  # columns of its own, as both may come from one table
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(run, schema)


@contextmanager
def _lean(spark: SparkSession):
    """A job's shuffle files go with the job, not when the driver happens to collect garbage; rows
    of many numbers are read few at a time."""
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
                "spark.sql.parquet.columnarReaderBatchSize": "256"}
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def score_documents(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
                    p_min: float | None = None, tail: int = TAIL, depth: int = 2, penalty: float = PENALTY,
                    block_chars: int = BLOCK_CHARS, min_count: int = MIN_COUNT, audit: dict | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.
    ``learn``: a condition on ``doc_id``; the model is counted on the rows that meet it.
    ``p_min``: a share of the training tokens to use instead of ``min_count``. ``audit``
    receives the number of own symbols and the contexts and states of each depth."""
    spark, outer = docs.sparkSession, table_scope()
    t = texts(docs, id_col, text_col).withColumn("learn", F.coalesce(learn, F.lit(False)))
    with _lean(spark), scratch_tables(spark):
        chars = t.agg(F.sum(F.length("text"))).first()[0] or 0
        blocks = max(1, -(-chars // block_chars))
        out, n = _scored(t, blocks, p_min, tail, depth, penalty, min_count, audit)
        out = materialize(out.select(
            "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known",
            F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"), outer)
    return out


def _scored(t: DataFrame, blocks: int, p_min: float | None, tail: int, depth: int, penalty: float, min_count: int,
            audit: dict | None) -> tuple[DataFrame, int]:
    """The scores of ``t``, still to be computed, and the number of training tokens."""
    spark, kind, scope = t.sparkSession, t.schema["doc_id"].dataType.simpleString(), table_scope()
    dealt = t.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long"))
    with scratch_tables(spark):
        cut = materialize(dealt.groupBy("block").applyInArrow(
            _block_words, f"block long, at long, doc_id {kind}, learn boolean, codes binary, nth long, word binary, n long"))
        words = cut.where("nth is not null")
        vocabulary, root = count_vocabulary(
            materialize(words.groupBy("word").agg(F.sum("n").alias("n"))), p_min, min_count, tail)
        places = words.select("block", "nth", "word").join(vocabulary, "word").select("block", "nth", "n", "symbol")
        lists = materialize(places.groupBy("block").applyInArrow(
            _block_list, "block long, symbols binary, counts binary"), scope)
        coded = materialize(cut.where("at is not null").select("block", "at", "doc_id", "learn", "codes"), scope)
    coded = coded.unionByName(lists, allowMissingColumns=True)
    if audit is not None:
        audit["own"] = root.own

    deals = -(-blocks // DEAL_BLOCKS)
    below = spark.createDataFrame([], _ANSWERS)
    packets = spark.createDataFrame([], "block long, deal long, score binary, flag binary")
    reached, old = 0, []  # old: what the depth below has left
    for d in range(1, depth + 1 if root.n else 1):
        reached, kept = d, len(scope)
        with scratch_tables(spark):
            lower = below.where("block is null").select("deal", "contexts", "of", "symbol", "p")
            sums = materialize(_cogrouped(
                _cogrouped(coded, packets, "block", _block_step(root, d, deals), _PACKETS), lower, "deal", _deal_sums, _SUMS))
            packets = materialize(sums.where("score is not null").select(
                "block", F.lit(None).cast("long").alias("deal"), "score", "flag"), scope)
            sums = sums.where("score is null").drop("score", "flag")
            drop_tables(spark, old)
            contexts = materialize(_states(sums, penalty))
            if audit is not None:
                audit[d] = tuple(contexts.agg(F.count(F.lit(1)), F.count_if("state")).first())
            if contexts.isEmpty():
                break
            states = contexts.where("state").select("context", "total", "distinct")
            back = sums.where("context is not null").select("deal", "context").join(small_side(states, SMALL), "context")
            below = materialize(_cogrouped(
                sums.where("context is null").drop("context", "total", "distinct", "logs"),
                back, "deal", _deal_answers(root.least), _ANSWERS), scope)
        packets = packets.unionByName(below.where("block is not null").select("block", "deal", "score", "flag"))
        old = scope[kept:]
    return _cogrouped(
        coded, packets, "block", _block_step(root, reached + 1, deals, last=True),
        f"doc_id {kind}, learn boolean, n_tokens long, n_known long, base_score double, score double"), root.n


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) != 0, depth=DEPTH)
