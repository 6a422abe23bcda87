"""Interpolated n-gram language model with modified Kneser-Ney smoothing, orders 1 to 5 (or
more), fitted and applied as Spark aggregations and joins.

For a gram ``h w`` of order m, with ``a`` its adjusted count and ``h'`` its context without
the first token:

    p_m(w | h) = max(a(h w) - D(a(h w)), 0) / a(h .) + gamma(h) * p_{m-1}(w | h')

``a`` is the number of occurrences for the highest order; below, the number of distinct
tokens before the gram, the text's start being one more for each occurrence there.
``D`` is one of three discounts a order, for counts of 1, 2 and more, from the counts of
counts t1 to t4; ``gamma`` gives the discounted mass to the lower order. Order 0 is uniform
over the V tokens seen and one unknown token, so p sums to 1 over them in any context. A
context that was not seen passes to the next lower order unchanged.

Tokens are 64-bit hashes: ``t0`` is a gram's last one, ``t1``, ``t2``, .. those before it
(NULL, in arrays ``NONE``, before the text's start). Blocks of texts send their distinct grams
of the highest order as compressed arrays to deals, by the token before the last one (and the
one before that, if it is hot). So the grams of an order over 1 that end alike, and those of an
order over 1 after one context, are in one deal, where a numpy pass counts them; only the
pairs after a hot token and single tokens are counted across deals. A model holds the grams of
each deal, again as arrays; the distinct grams that are asked for go to their deals, where all
orders are looked up.

Texts are padded with the start token for the fit. A text word equal to it counts like it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.functions.text import BOS, tokenize_words
from textlens.operators.lm import first_scored_position, with_weights
from textlens.operators.packed import mixed, unzipped, zipped
from textlens.operators.skew import lookup_join, with_freq
from textlens.session import materialize, scratch_tables, table_scope

#: Discounts where the counts of counts do not give any (tiny or artificial corpora).
FALLBACK = (0.5, 1.0, 1.5)
#: Grams of one deal.
TASK_GRAMS = 1 << 21
#: A token with this share of a deal's even part is hot: its grams are dealt by two tokens.
HOT = 1 / 4
#: Tokens of a block of texts (at least one text) whose grams are packed together.
BLOCK_TOKENS = 1 << 21
#: Hash of no token, before the text's start.
NONE = -(1 << 63)

_PACKET = "deal int, words binary, grams binary, n binary"


def _names(m: int) -> list[str]:
    return [f"t{j}" for j in range(m)]


@dataclass(frozen=True)
class GramCounts:
    """The texts' tokens as hashes (``coded``), whose grams of up to ``order`` tokens are
    counted in ``deals`` deals; ``hot``: tokens after which pairs are counted across them."""

    order: int
    coded: DataFrame
    deals: int
    hot: tuple[int, ...]
    bos: int

    def dealt(self):
        """The packets of each deal."""
        packets = self.coded.mapInArrow(_pack(self.order, self.deals, self.hot, self.bos, BLOCK_TOKENS), _PACKET)
        return packets.repartition(self.deals, "deal").groupBy("deal")

    def counted(self, packets: bool) -> DataFrame:
        """``m, t0, t1, a`` and the columns of a packet: the counts of counts (``m`` is the order,
        ``t0`` the count up to 4, ``a`` its grams; for pairs, those after other than hot tokens);
        parts of the counts of pairs after hot tokens (NULL ``m``); parts of those of single tokens
        (NULL ``t1`` too). With ``packets`` a packet of each deal's distinct grams as well."""
        return self.dealt().applyInArrow(_deal_counts(self.order, self.hot, packets), f"m int, t0 long, t1 long, a long, {_PACKET}")

    @cached_property
    def tables(self) -> dict[int, DataFrame]:
        """order -> ``t0 .., a`` (adjusted counts), each written once."""
        kinds = ", ".join(f"{t} long" for t in _names(self.order))
        parts = self.dealt().applyInArrow(_deal_grams(self.order), f"m int, {kinds}, a long")
        rows, out = materialize(parts), {}
        for m in range(self.order, 0, -1):
            if m > 1 or self.order == 1:  # pairs after a hot token are in several deals, by those before
                out[m] = materialize(rows.where(F.col("m") == m).groupBy(*_names(m)).agg(F.sum("a").alias("a")))
            else:
                out[m] = materialize(out[2].groupBy("t0").agg(F.count(F.lit(1)).alias("a")))
        return out


@dataclass(frozen=True)
class NgramLM:
    order: int
    packets: DataFrame  # deal, words, grams, n: the distinct grams of each deal
    pairs: DataFrame  # t0, t1, a: the counts of pairs after a hot token
    tokens: DataFrame  # t0, a: the counts of single tokens
    deals: int
    hot: tuple[int, ...]
    empty: tuple[float, float, int]  # total, backoff and tokens of the empty context
    discounts: DataFrame  # order, d1, d2, d3
    rates: dict  # order -> (d1, d2, d3)


# ---------------------------------------------------------------------------------------
# Grams as arrays
# ---------------------------------------------------------------------------------------


def _packet(words: np.ndarray, grams: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """``grams``: a row for each token of them, as places in ``words``."""
    used = np.zeros(len(words), bool)
    used[grams] = True
    at = np.cumsum(used) - 1
    kind = np.uint16 if used.sum() <= 1 << 16 else np.uint32
    return zipped(words[used].view(np.uint64)), zipped(at[grams].astype(kind)), zipped(n.astype(np.uint64))


def _packets(order: int, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, grams, n) of all packets, ``words`` sorted; grams may repeat."""
    lists = [unzipped(x.as_py()).view(np.int64) for x in table["words"]]
    words, at = np.unique(np.concatenate([[np.int64(NONE)], *lists]), return_inverse=True)
    grams, begin = [], 1
    for x, own in zip(table["grams"], lists):
        grams.append(at[begin:begin + len(own)].astype(np.int32)[unzipped(x.as_py())].reshape(order, -1))
        begin += len(own)
    n = [unzipped(x.as_py()).view(np.int64) for x in table["n"]]
    empty = np.zeros((order, 0), np.int32)
    return words, np.concatenate([empty, *grams], axis=1), np.concatenate([np.zeros(0, np.int64), *n])


def _deals_of(tokens, order: int, deals: int, hot: tuple[int, ...]) -> np.ndarray:
    """The deal of grams; ``tokens(j)``: the hashes of their t{j}."""
    first = tokens(min(1, order - 1))
    with np.errstate(over="ignore"):
        h = mixed(first.view(np.uint64))
        if hot and order > 1:
            second = tokens(2 if order > 2 else 0)
            h = np.where(np.isin(first, hot), mixed(h + second.view(np.uint64)), h)
    return (h % np.uint64(deals)).astype(np.int32)


def _pack(order: int, deals: int, hot: tuple[int, ...], bos: int, chunk: int):
    """Arrow pass over texts (arrays of token hashes) -> packets of their distinct grams, a
    block of ``chunk`` tokens (or one text) at a time."""
    first = [j for j in (1, 2, 0) if j < order]
    columns = first + list(range(3, order))

    def block(values, sizes):
        words, codes = np.unique(np.concatenate([[np.int64(NONE), np.int64(bos)], values]), return_inverse=True)
        codes = codes.astype(np.int32)
        start, own = codes[1], codes[2:]
        place = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        grams = np.zeros((order, len(own)), np.int32)  # 0: NONE, the least
        grams[0] = own
        for j in range(1, order):
            grams[j, j:] = own[:-j]
            grams[j][place < j] = 0
            grams[j][place == j - 1] = start
        deal = _deals_of(lambda j: words[grams[j]], order, deals, hot)
        by = np.lexsort([*(grams[j] for j in reversed(columns)), deal])
        grams, deal = grams[:, by], deal[by]
        new = np.concatenate([[True], (deal[1:] != deal[:-1]) | (grams[:, 1:] != grams[:, :-1]).any(axis=0)])
        starts = np.flatnonzero(new)
        n = np.diff(np.concatenate([starts, [len(deal)]]))
        grams, deal = grams[:, starts], deal[starts]
        cuts = np.flatnonzero(np.concatenate([[True], deal[1:] != deal[:-1], [True]]))
        rows = [(int(deal[a]), *_packet(words, grams[:, a:b], n[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))],
            ["deal", "words", "grams", "n"])

    def run(batches):
        held, total = [], 0
        for batch in batches:
            lists = batch.column(0)
            values, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(sizes), 0
            while at < len(sizes):
                done = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, done + chunk - total, "right")))
                held.append((values[done:ends[stop - 1]], sizes[at:stop]))
                total, at = total + int(ends[stop - 1]) - done, stop
                if total >= chunk or at < len(sizes):
                    if total:
                        yield block(*map(np.concatenate, zip(*held)))
                    held, total = [], 0
        if total:
            yield block(*map(np.concatenate, zip(*held)))

    return run


class _Levels:
    """The grams of all orders in a deal. ``last[j]``: the number of each gram's context of
    ``j`` tokens. ``keys[m]``, ``a[m]``: the grams of order ``m`` (those at a text's start that
    are shorter too, not ``whole``) and their adjusted counts; ``at[m]``: a gram of the highest
    order that ends with each."""

    def __init__(self, order: int, words: np.ndarray, grams: np.ndarray, n: np.ndarray):
        self.order, self.words, self.grams, self.v = order, words, grams, len(words)
        self.last, self.known = [np.zeros(grams.shape[1], np.int64)], [None]
        for j in range(1, order):
            known, at = np.unique(self.last[-1] * self.v + grams[j], return_inverse=True)
            self.last.append(at.astype(np.int64))
            self.known.append(known)
        self.keys, self.a, self.at, self.whole = {}, {}, {}, {}
        rows, a = np.arange(grams.shape[1]), n
        for m in range(order, 0, -1):
            self.keys[m], first, own = np.unique(self.last[m - 1][rows] * self.v + grams[0, rows], return_index=True, return_inverse=True)
            self.a[m] = np.bincount(own, a, len(first)).astype(np.int64)
            self.at[m] = rows = rows[first]
            self.whole[m] = grams[m - 1, rows] > 0
            # each gram is one more token before its suffix; at a text's start its occurrences count
            a = np.where(self.whole[m], 1, self.a[m])

    def contexts(self, m: int, rate: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Total and back-off of each context of grams of order ``m``, by its number."""
        whole = self.whole[m]
        of, a, size = self.last[m - 1][self.at[m][whole]], self.a[m][whole], len(self.known[m - 1])
        total = np.bincount(of, a, size)
        off = np.bincount(of, np.minimum(np.array((0, *rate))[np.minimum(a, 3)], a), size)
        return total, np.divide(off, total, out=np.zeros(size), where=total > 0)


def _deal_counts(order: int, hot: tuple[int, ...], packets: bool):
    def run(table):
        words, grams, n = _packets(order, table)
        levels, rows, parts = _Levels(order, words, grams, n), [], []
        for m in range(order, 0, -1):
            a, at = levels.a[m][levels.whole[m]], levels.at[m][levels.whole[m]]
            if m == 2:
                after = np.isin(words[grams[1, at]], hot)
                parts.append((words[grams[0, at[after]]], words[grams[1, at[after]]], a[after]))
                token, own = np.unique(grams[0, at[~after]], return_counts=True)  # each other pair is whole here
                parts.append((words[token], None, own))
                a = a[~after]
            if m > 1:
                rows += [(m, k, int((a == k).sum())) for k in (1, 2, 3, 4)]
            elif order == 1:
                parts.append((words[grams[0, at]], None, a))
        deal = table["deal"][0].as_py()
        made = [pa.table({"m": pa.array([r[0] for r in rows], pa.int32()), "t0": pa.array([r[1] for r in rows], pa.int64()),
                          "a": pa.array([r[2] for r in rows], pa.int64())})]
        for t0, t1, a in parts:
            made.append(pa.table({"t0": pa.array(t0), "a": pa.array(a.astype(np.int64))} | ({} if t1 is None else {"t1": pa.array(t1)})))
        if packets:
            top = levels.at[order]
            one = _packet(words, grams[:, top], levels.a[order])
            made.append(pa.table({"deal": pa.array([deal], pa.int32())} | {c: pa.array([x], pa.binary()) for c, x in zip(("words", "grams", "n"), one)}))
        schema = pa.schema([("m", pa.int32()), ("t0", pa.int64()), ("t1", pa.int64()), ("a", pa.int64()), ("deal", pa.int32()),
                            ("words", pa.binary()), ("grams", pa.binary()), ("n", pa.binary())])
        return pa.concat_tables([pa.table({f.name: t[f.name] if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in schema}, schema)
                                 for t in made])

    return run


def _deal_grams(order: int):
    def run(table):
        words, grams, n = _packets(order, table)
        levels, made = _Levels(order, words, grams, n), []
        for m in range(order, 0, -1):
            at = levels.at[m][levels.whole[m]]
            made.append(pa.table({"m": pa.array(np.full(len(at), m, np.int32))} | {
                t: pa.array(words[grams[j, at]]) if j < m else pa.nulls(len(at), pa.int64()) for j, t in enumerate(_names(order))
            } | {"a": pa.array(levels.a[m][levels.whole[m]])}))
        return pa.concat_tables(made)

    return run


def _asked_columns(order: int) -> list[str]:
    return [f"{c}{m}" for m in range(2, order + 1) for c in ("a", "total", "backoff")]


def _deal_answers(order: int, hot: tuple[int, ...], rates: dict):
    """``__g, t0, t1, a2, total2, backoff2, ..`` of the grams asked of a deal, NULL where it
    saw none. Pairs after hot tokens are counted across deals and not looked up here."""
    def run(asked, table):
        words, grams, n = _packets(order, table if asked.num_rows else table.slice(0, 0))
        levels = _Levels(order, words, grams, n)

        def place(values, known):
            at = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
            return np.where(known[at] == values, at, -1) if len(known) else np.full(len(values), -1)

        tokens = [asked[t].fill_null(NONE).to_numpy() for t in _names(order)]
        codes = [place(t, words) for t in tokens]
        codes = [np.where(t == NONE, -1, c) for t, c in zip(tokens, codes)]
        out, context = {"__g": asked["__g"], "t0": asked["t0"], "t1": asked["t1"]}, np.zeros(len(tokens[0]), np.int64)
        across = np.isin(tokens[1], hot)
        for m in range(2, order + 1):
            context = np.where((context >= 0) & (codes[m - 1] >= 0), place(context * levels.v + codes[m - 1], levels.known[m - 1]), -1)
            seen = (context >= 0) & ~(across & (m == 2))
            own = np.where(seen & (codes[0] >= 0), place(context * levels.v + codes[0], levels.keys[m]), -1)
            total, backoff = levels.contexts(m, rates[m])
            total, backoff, a = np.append(total, 0), np.append(backoff, 0), np.append(levels.a[m], 0)  # so that -1 is a place
            out |= {f"a{m}": pa.array(a[own], pa.int64(), mask=own < 0), f"total{m}": pa.array(total[context], pa.float64(), mask=~seen),
                    f"backoff{m}": pa.array(backoff[context], pa.float64(), mask=~seen)}
        return pa.table(out)

    return run


# ---------------------------------------------------------------------------------------
# Tables
# ---------------------------------------------------------------------------------------


def _hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _gram_lists(order: int, add_bos: bool = True, *more: Column) -> Column:
    """The grams that end in each token of ``__h``, as an array of structs; ``more``: arrays
    zipped with it."""
    n, none = F.size("__h"), F.lit(None).cast("bigint")
    before = F.concat(F.array(F.xxhash64(F.lit(BOS))), F.col("__h")) if add_bos else F.col("__h")
    lists = [F.col("__h").alias("t0")]
    for j in range(1, order):
        lost = j - 1 if add_bos else j
        lists.append(F.concat(F.array_repeat(none, lost), F.slice(before, 1, F.greatest(n - lost, F.lit(0)))).alias(f"t{j}"))
    return F.slice(F.arrays_zip(*lists, *more), 1, n)


def ngram_occurrences(df: DataFrame, keep: list[Column], text_col: str, order: int, tokenizer=tokenize_words, add_bos: bool = True,
                      prompt_col: str | None = None, outer: bool = False) -> DataFrame:
    """One row per scored token: the columns ``keep``, ``pos``, ``token`` and the hashes ``t0``
    .. of the token and of up to ``order`` - 1 before it. ``outer`` keeps texts without one as
    a row of nulls."""
    start = first_scored_position(df, prompt_col, tokenizer, add_bos)
    toks = df.select(*keep, tokenizer(F.col(text_col)).alias("__w"), start.alias("__from"))
    names = [c for c in toks.columns if not c.startswith("__")]
    coded = toks.select(*names, "__w", _hashed(F.col("__w")).alias("__h"), "__from")
    n = F.size("__h")
    grams = coded.select(*names, "__from", n.alias("__n"), _gram_lists(order, add_bos, F.col("__w").alias("token")).alias("__l"))
    some = F.slice("__l", F.col("__from"), F.greatest(F.col("__n") - F.col("__from") + 1, F.lit(0)))
    rows = grams.select(*names, "__from", F.posexplode_outer(some).alias("__i", "__g"))
    rows = rows if outer else rows.where("__i IS NOT NULL")
    return rows.select(*names, (F.col("__i") + F.col("__from")).alias("pos"), "__g.token", *[f"__g.{t}" for t in _names(order)])


def adjusted_counts(df: DataFrame, text_col: str, order: int, tokenizer=tokenize_words) -> GramCounts:
    """The counts of all grams of the texts. Each block of texts sends a gram once, and a deal
    gets those after one other than hot token or after one pair."""
    coded = materialize(df.select(_hashed(tokenizer(F.col(text_col))).alias("__h")))
    total = coded.agg(F.sum(F.size("__h"))).first()[0] or 0
    deals = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_GRAMS))
    bos = df.sparkSession.range(1).select(F.xxhash64(F.lit(BOS))).first()[0]
    # the start is before each text's first token
    tokens = coded.select(F.explode(F.concat(F.array(F.lit(bos)), F.col("__h"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    hot = [r.t for r in tokens.where(F.col("n") >= F.lit(total * HOT / deals)).collect()]  # at most 2 * deals / HOT rows
    return GramCounts(order, coded, deals, tuple(hot), bos)


def _pairs_and_tokens(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``t0, t1, a`` of the pairs after hot tokens; ``t0, a`` of single tokens, given those."""
    parts = counted.where("m IS NULL AND t0 IS NOT NULL")
    pairs = materialize(parts.where("t1 IS NOT NULL").groupBy("t0", "t1").agg(F.sum("a").alias("a")))
    own = parts.where("t1 IS NULL").select("t0", "a").unionByName(pairs.select("t0", F.lit(1).cast("bigint").alias("a")))
    return pairs, materialize(own.groupBy("t0").agg(F.sum("a").alias("a")))


def _counts_of_counts(rows: DataFrame) -> DataFrame:
    """``order, t1 .., t4`` from ``m, t0, a``: how many grams (``a``) have a count (``t0``)."""
    return rows.groupBy(F.col("m").alias("order")).agg(*[
        F.coalesce(F.sum(F.when(F.col("t0") == k, F.col("a"))), F.lit(0)).alias(f"t{k}") for k in (1, 2, 3, 4)])


def discounts(counts: GramCounts, counted: DataFrame | None = None) -> DataFrame:
    """``order, d1, d2, d3``: one row an order. The counts of counts of all orders come from
    the written tables, or else, with the grams' counts, from one pass that writes none.
    ``counted``: what ``counts.counted`` gave."""
    if counted is None and "tables" in counts.__dict__:
        out = reduce(DataFrame.unionByName, [
            t.agg(*[F.count_if(F.col("a") == k).alias(f"t{k}") for k in (1, 2, 3, 4)]).withColumn("order", F.lit(m))
            for m, t in counts.tables.items()])
    else:
        def step(rows, told):
            """Sums of ``m, t0, t1, a``, each then told as the rows of ``told``."""
            sums = rows.groupBy("m", "t0", "t1").agg(F.sum("a").alias("a"))
            return sums.select(F.explode(told).alias("__r")).select("__r.*")

        def row(m, t0, a):
            return F.struct(m.cast("int").alias("m"), t0.cast("bigint").alias("t0"), F.lit(None).cast("bigint").alias("t1"), a.cast("bigint").alias("a"))

        m, a, none, one = F.col("m"), F.col("a"), F.lit(None), F.lit(1)
        same = F.array(row(m, F.col("t0"), a))
        rows = (counts.counted(False) if counted is None else counted).where("t0 IS NOT NULL").select("m", "t0", "t1", "a")
        rows = step(rows, F.when(F.col("t1").isNotNull(), F.array(row(F.lit(2), a, one), row(none, F.col("t0"), one))).otherwise(same))
        rows = step(rows, F.when(m.isNull(), F.array(row(F.lit(1), a, one))).otherwise(same))
        out = _counts_of_counts(rows)
    y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))
    d = [F.lit(float(k)) - F.try_divide((k + 1) * y * F.col(f"t{k + 1}"), F.col(f"t{k}")) for k in (1, 2, 3)]
    sound = (F.col("t1") > 0) & (F.col("t2") > 0) & (F.col("t3") > 0)
    for k, x in zip((1, 2, 3), d):
        sound = sound & (x >= 0) & (x <= k)
    every = counts.coded.sparkSession.range(1, counts.order + 1).select(F.col("id").cast("int").alias("order"))
    return every.join(F.broadcast(out), ["order"], "left").select("order", *[F.when(sound, x).otherwise(F.lit(f)).alias(f"d{k}") for k, x, f in zip((1, 2, 3), d, FALLBACK)])


def _off(a: Column, rate: tuple) -> Column:
    return F.when(a == 1, F.lit(rate[0])).when(a == 2, F.lit(rate[1])).otherwise(F.lit(rate[2]))


def fit_ngram_lm(df: DataFrame, text_col: str = "text", order: int = 5, tokenizer=tokenize_words) -> NgramLM:
    """The model of the texts in ``df``; at least one of them must have a token."""
    if order < 1:
        raise ValueError("order must be at least 1")
    outer = table_scope()
    with scratch_tables(df.sparkSession):  # the texts go when their grams are counted
        counts = adjusted_counts(df, text_col, order, tokenizer)
        counted = materialize(counts.counted(True), outer)
    pairs, tokens = _pairs_and_tokens(counted)
    rates = materialize(discounts(counts, counted))
    d = {r["order"]: (r.d1, r.d2, r.d3) for r in rates.collect()}  # one row an order
    one = tokens.agg(*_sums(d[1]), F.count(F.lit(1)).alias("n")).first()
    packets = counted.where("deal IS NOT NULL").select("deal", "words", "grams", "n")
    return NgramLM(order, packets, pairs, tokens, counts.deals, counts.hot, (one["total"], one["__off"] / one["total"], one["n"]), rates, d)


def _sums(rate: tuple) -> tuple[Column, Column]:
    """A context's total and the mass of its discounts, each at most the gram's own count."""
    a = F.col("a")
    return F.sum("a").alias("total"), F.sum(F.least(_off(a, rate), a)).alias("__off")


def _probabilities(lm: NgramLM, used: DataFrame) -> DataFrame:
    """``__g, prob`` of distinct grams ``__g, t0 ..``: from the empty context up, each order that
    saw the context adds its own share to its back-off's."""
    names, order, deals, hot = _names(lm.order), lm.order, lm.deals, lm.hot
    found = used.select("__g", *names)
    if order > 1:
        def dealt(batches):
            for batch in batches:
                deal = _deals_of(lambda j: batch.column(f"t{j}").fill_null(NONE).to_numpy(zero_copy_only=False), order, deals, hot)
                yield batch.append_column("deal", pa.array(deal))

        kinds = ", ".join(f"{t} bigint" for t in names)
        asked = found.mapInArrow(dealt, f"__g bigint, {kinds}, deal int")
        shown = "".join(f", a{m} bigint, total{m} double, backoff{m} double" for m in range(2, order + 1))
        found = asked.groupBy("deal").cogroup(lm.packets.groupBy("deal")).applyInArrow(
            _deal_answers(order, hot, lm.rates), f"__g bigint, t0 bigint, t1 bigint{shown}")
    found = materialize(found)
    single = with_freq(found, lm.tokens.withColumnRenamed("a", "a1"), ["t0"])
    flat = lookup_join(found, single, ["t0"], "__freq")
    if order > 1 and hot:
        totals = lm.pairs.groupBy("t1").agg(*_sums(lm.rates[2])).select(
            "t1", F.col("total").cast("double").alias("__total"), (F.col("__off") / F.col("total")).alias("__backoff"))
        pairs = with_freq(found, lm.pairs.withColumnRenamed("a", "__a"), ["t0", "t1"])
        flat = lookup_join(flat, pairs, ["t0", "t1"], "__freq", how="left").join(F.broadcast(totals), ["t1"], "left")
        both = {c: F.coalesce(c, f"__{c[:-1]}").alias(c) for c in ("a2", "total2", "backoff2")}
        flat = flat.select("__g", "a1", *[both.get(c, F.col(c)) for c in _asked_columns(order)])

    def share(m, total, backoff, low):
        a = F.col(f"a{m}")
        own = F.when(a.isNotNull(), F.greatest(a - _off(a, lm.rates[m]), F.lit(0.0)) / total).otherwise(F.lit(0.0))
        return own + backoff * low

    total, backoff, n = lm.empty
    flat = flat.withColumn("prob", share(1, F.lit(total), F.lit(backoff), F.lit(1.0 / (n + 1))))
    for m in range(2, order + 1):
        higher = share(m, F.col(f"total{m}"), F.col(f"backoff{m}"), F.col("prob"))
        flat = flat.withColumn("prob", F.when(F.col(f"total{m}").isNotNull(), higher).otherwise(F.col("prob")))
    return flat.select("__g", "prob")


def _whole_gram(order: int) -> Column:
    """Key of a row's gram, whatever its length."""
    length = sum(F.col(t).isNotNull().cast("int") for t in _names(order))
    return F.xxhash64(length, *_names(order))


def gram_probabilities(lm: NgramLM, grams: DataFrame) -> DataFrame:
    """``ctx, token, n_occ, prob`` of distinct grams (``ctx`` of up to ``lm.order`` - 1 tokens,
    joined by spaces)."""
    before = F.reverse(F.filter(F.split("ctx", " "), lambda w: w != ""))
    hashes = grams.select("ctx", "token", "n_occ", F.xxhash64("token").alias("t0"), *[
        F.when(F.size(before) >= j, F.xxhash64(F.get(before, F.lit(j - 1)))).alias(f"t{j}") for j in range(1, lm.order)])
    used = materialize(hashes.withColumn("__g", _whole_gram(lm.order)))
    return used.join(_probabilities(lm, used), ["__g"]).select("ctx", "token", "n_occ", "prob")


def ngram_token_scores(lm: NgramLM, df: DataFrame, id_col: str = "row_id", text_col: str = "text", prompt_col: str | None = None,
                       tokenizer=tokenize_words, add_bos: bool = True, weights: DataFrame | None = None,
                       extra_cols: tuple[str, ...] = ()) -> DataFrame:
    """``token_scores`` of every input row, like ``lm.score_long``: ``id_col, [extra], pos,
    token, prob, weight``; a row without a scored token has one row with NULL ``pos``.

    The distinct grams of the texts are scored, then each occurrence looks up its own."""
    keep = [F.col(id_col), *[F.col(c) for c in extra_cols]]
    args = (df, keep, text_col, lm.order, tokenizer, add_bos, prompt_col)
    names = _names(lm.order)
    used = ngram_occurrences(*args).groupBy(*names).agg(F.first("token").alias("token"), F.count(F.lit(1)).alias("n_occ"))
    used = materialize(used.withColumn("__g", _whole_gram(lm.order)))
    known = used.select("__g", "token", "n_occ").join(_probabilities(lm, used), ["__g"])
    probs = materialize(with_weights(known, weights).drop("token"))
    occ = ngram_occurrences(*args, outer=True)
    # texts without a scored token spread over the tasks by their ids
    key = F.when(F.col("pos").isNull(), F.xxhash64(F.lit(-1), id_col)).otherwise(_whole_gram(lm.order))
    placed = occ.select(id_col, *extra_cols, "pos", "token", key.alias("__g"))
    return lookup_join(placed, probs, ["__g"], "n_occ", how="left").select(id_col, *extra_cols, "pos", "token", "prob", "weight")
