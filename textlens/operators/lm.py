"""Interpolated bigram language model, fitted and applied as Spark aggregations and joins.

This is the table-level stand-in for the neural model's forward pass: it fills the
``token_scores`` contract ``(row_id, pos, token, prob)``, the probability that the model
gives the observed token at that position, conditioned on the preceding token.

    p(tok | prev) = lam(prev) * c(prev, tok) / c(prev) + (1 - lam(prev)) * (c(tok) + 1) / (N + V + 1)

``c(prev)`` is the number of bigrams starting with ``prev`` (the start token included),
``N`` the number of predicted tokens, ``V`` the number of distinct predicted tokens (the
``+1`` reserves mass for an unknown token, so ``0 < p < 1``), and ``lam(prev)`` is
``lam`` when ``prev`` was seen as a context and 0 otherwise.

Positions: a row's full sequence is ``[<s>?] t1 .. tn``. With the start token every
``t_i`` is predicted from ``t_{i-1}`` (``t_0 = <s>``); without it ``t1`` has no context
and is never scored. With a prompt of ``p`` tokens (tokenised alone) the scored tokens
are ``t_{p+1} .. t_n`` with the start token and ``t_{p+2} .. t_n`` without it; the
context of the first scored token still comes from the prompt.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.functions.metrics import DEFAULT_IDF_WEIGHT
from textlens.functions.text import BOS, tokenize_words
from textlens.operators.packed import increasing, mixed, unzipped, zipped
from textlens.operators.skew import lookup_join, with_freq
from textlens.session import materialize, table_scope

# Interpolation weight of the bigram estimate.
DEFAULT_LAMBDA = 0.7

# Tokens of texts that are scored in common, as one block.
COMMON = 1 << 20
# Tokens of one deal.
DEAL_TOKENS = 1 << 21
# Not used any more: a block asks for a bigram once, so none is hot.
HOT = 1 / 500

SCORE_STRUCT = "array<struct<pos:int,token:string,prob:double,weight:double>>"


@dataclass(frozen=True)
class BigramLM:
    """Counted from ``steps`` (``prev, token``: one row an occurrence), each table when it is
    first asked for and then written once; a table that only needs tokens costs no count of
    bigrams. The tables last as long as those of the ``scope`` that the model was made in.
    Texts are scored from ``counts`` and ``types``, where tokens are 64-bit hashes."""

    steps: DataFrame
    lam: float = DEFAULT_LAMBDA
    scope: list[str] | None = None

    @cached_property
    def counts(self) -> DataFrame:
        """``__p, __t, cb``: all bigrams by their hashes; ``__p`` is NULL like ``prev``."""
        p = F.when(F.col("prev").isNotNull(), F.xxhash64("prev"))
        hashed = self.steps.select(p.alias("__p"), F.xxhash64("token").alias("__t"))
        return materialize(hashed.groupBy("__p", "__t").agg(F.count(F.lit(1)).alias("cb")), self.scope)

    @cached_property
    def types(self) -> DataFrame:
        """``__t, cu, cc``: all tokens by their hashes, as predicted ones and as contexts (NULL:
        never)."""
        none = F.lit(None).cast("bigint")
        as_token = self.counts.select("__t", F.col("cb").alias("cu"), none.alias("cc"))
        as_context = self.counts.where("__p IS NOT NULL").select(F.col("__p").alias("__t"), none.alias("cu"), F.col("cb").alias("cc"))
        both = as_token.unionByName(as_context)
        return materialize(both.groupBy("__t").agg(F.sum("cu").alias("cu"), F.sum("cc").alias("cc")), self.scope)

    @cached_property
    def pairs(self) -> DataFrame:
        """``prev, token, cnt``; ``prev`` is NULL for a first token without a start."""
        return materialize(self.steps.groupBy("prev", "token").agg(F.count(F.lit(1)).alias("cnt")), self.scope)

    @property
    def bigrams(self) -> DataFrame:
        """``prev, token, cnt`` (``prev`` = context token, ``<s>`` included)."""
        return self.pairs.filter(F.col("prev").isNotNull())

    @cached_property
    def unigrams(self) -> DataFrame:
        """``token, cnt`` (predicted tokens)."""
        if "pairs" in self.__dict__:
            return materialize(self.pairs.groupBy("token").agg(F.sum("cnt").alias("cnt")), self.scope)
        return materialize(self.steps.groupBy("token").agg(F.count(F.lit(1)).alias("cnt")), self.scope)

    @property
    def totals(self) -> DataFrame:
        """One row: ``n_tokens, n_types``."""
        return self.types.agg(F.sum("cu").alias("n_tokens"), F.count("cu").alias("n_types"))


def sequence_pairs(tokens: Column, add_bos: bool = True, bos: str = BOS) -> Column:
    """``array<struct<prev, token>>`` aligning each token with its predecessor
    (``<s>`` or NULL for the first token)."""
    first = F.lit(bos) if add_bos else F.lit(None).cast("string")
    prevs = F.slice(F.concat(F.array(first), tokens), 1, F.size(tokens))
    return F.arrays_zip(prevs.alias("prev"), tokens.alias("token"))


def occurrences(
    df: DataFrame,
    id_col: str,
    text_col: str,
    tokenizer=tokenize_words,
    add_bos: bool = True,
    prompt_col: str | None = None,
    scored_only: bool = True,
    extra_cols: tuple[str, ...] = (),
    keep_empty: bool = False,
) -> DataFrame:
    """One row per (scored) token: ``id_col, pos, prev, token`` (pos is 1-based in the
    text's token sequence). With ``keep_empty`` a row without such a token gives one row
    with NULL ``pos``, so that one pass yields every input row.

    With ``scored_only`` the sequence is sliced *before* the explode to the positions the
    model scores (prompt excluded, first token dropped without a start token)."""
    # Token arrays are materialised in their own projection and referenced by name, so
    # the tokenizer runs once per row (the optimizer keeps a projection whose expensive
    # output is used more than once).
    start = first_scored_position(df, prompt_col, tokenizer, add_bos) if scored_only else F.lit(1)
    toks = df.select(
        F.col(id_col), *[F.col(c) for c in extra_cols], tokenizer(F.col(text_col)).alias("__toks"), start.alias("__start")
    )
    base = toks.select(
        F.col(id_col), *[F.col(c) for c in extra_cols], sequence_pairs(F.col("__toks"), add_bos).alias("__pairs"), "__start"
    )
    pairs, start = F.col("__pairs"), F.col("__start")
    n = F.size(pairs)
    if scored_only:
        pairs = F.when(n >= start, F.slice(pairs, start, n - start + 1)).otherwise(
            F.array().cast("array<struct<prev:string,token:string>>")
        )
    # ``posexplode_outer`` + a filter on the generated column: a plain explode makes the
    # optimizer infer ``size(input) > 0`` and push it below the input's repartition,
    # which would tokenise every text twice, once in the scan's tasks.
    exploded = base.select(
        F.col(id_col), *[F.col(c) for c in extra_cols], (start - 1).alias("__off"), F.posexplode_outer(pairs).alias("__i", "__pt")
    )
    if not keep_empty:
        exploded = exploded.filter(F.col("__i").isNotNull())
    return exploded.select(
        F.col(id_col),
        *[F.col(c) for c in extra_cols],
        (F.col("__off") + F.col("__i") + 1).cast("int").alias("pos"),
        F.col("__pt.prev").alias("prev"),
        F.col("__pt.token").alias("token"),
    )


def first_scored_position(df: DataFrame, prompt_col: str | None, tokenizer, add_bos: bool) -> Column:
    """1-based position of the first scored token: ``p + 1`` with the start token and
    ``p + 2`` without, ``p`` = token count of the prompt tokenised alone (0 without one)."""
    p = F.size(tokenizer(F.col(prompt_col))) if prompt_col else F.lit(0)
    return p + F.lit(1 if add_bos else 2)


def long_enough(text: Column, tokenizer=tokenize_words, add_bos: bool = True) -> Column:
    """Whether a text can be scored: one token with the start token, two without."""
    return F.size(tokenizer(text)) >= F.lit(1 if add_bos else 2)


def split_valid(df: DataFrame, text_col: str = "text", tokenizer=tokenize_words, add_bos: bool = True):
    """(rows that can be scored, the others with a ``reason``)."""
    marked = df.withColumn("__ok", long_enough(F.coalesce(F.col(text_col), F.lit("")), tokenizer, add_bos))
    why = F.lit(f"fewer than {1 if add_bos else 2} tokens")
    return marked.filter("__ok").drop("__ok"), marked.filter("NOT __ok").drop("__ok").withColumn("reason", why)


def prompt_mismatches(dataset: DataFrame, results: DataFrame, key: str = "row_id", prompt: str = "prompt") -> DataFrame:
    """Rows of ``results`` whose prompt is not that of the dataset row with their key (also
    where the dataset has no such row): ``key, prompt, expected``."""
    want = dataset.select(key, F.col(prompt).alias("expected"))
    got = results.select(key, prompt).join(want, [key], "left")
    return got.filter(~F.col(prompt).eqNullSafe(F.col("expected")))


def fit_bigram_lm(
    df: DataFrame,
    text_col: str = "text",
    tokenizer=tokenize_words,
    add_bos: bool = True,
    lam: float = DEFAULT_LAMBDA,
    lazy: bool = False,
) -> BigramLM:
    """The model of the texts in ``df``. Its counts are partially aggregated, so a hot bigram
    never reaches one task un-combined; once the bigrams are counted, unigrams and contexts
    are derived from them, not from the occurrences again. What scoring needs is counted here,
    or, with ``lazy``, when it is first asked for."""
    occ = occurrences(df.withColumn("__rid", F.lit(0)), "__rid", text_col, tokenizer, add_bos, scored_only=False)
    lm = BigramLM(occ.select("prev", "token"), lam, table_scope())
    if not lazy:
        _ = lm.types
    return lm


def bigram_prob(cb: Column, cc: Column, cu: Column, n: Column, v: Column, lam: float) -> Column:
    """Probability of one (prev, token) pair from its counts (NULL counts = unseen)."""
    uni = (F.coalesce(cu, F.lit(0)) + F.lit(1)) / (n + v + F.lit(1))
    bi = F.coalesce(cb, F.lit(0)) / cc
    lam_c = F.lit(float(lam))
    one_minus = F.lit(float(1.0 - lam))
    return F.when(cc.isNotNull() & (cc > 0), lam_c * bi + one_minus * uni).otherwise(uni)


def with_weights(probs: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Adds ``weight``: 1.0 without weighting, else the token's weight, and the default of an
    unknown vocabulary entry (0.001) for a token that ``weights`` lacks."""
    if weights is None:
        return probs.withColumn("weight", F.lit(1.0))
    table = with_freq(probs, weights.select("token", F.col("weight").cast("double").alias("weight")), ["token"])
    table = table.withColumn("weight", F.coalesce("weight", F.lit(DEFAULT_IDF_WEIGHT)))
    return lookup_join(probs, table, ["token"], "__freq")


def pair_probabilities(lm: BigramLM, pairs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Score each distinct bigram that the texts use.

    ``pairs``: ``__p, __t, n_occ`` and, for ``weights``, ``token``. The joins run on distinct
    keys (one row per pair or token), so their size is bounded by the vocabulary, not by the
    corpus; those on one token, which many pairs can share, are salted."""
    j = pairs.join(lm.counts, ["__p", "__t"], "left")
    contexts, tokens = lm.types.select(F.col("__t").alias("__p"), "cc"), lm.types.select("__t", "cu")
    j = lookup_join(j, with_freq(pairs, contexts, ["__p"]), ["__p"], "__freq")
    j = lookup_join(j, with_freq(pairs, tokens, ["__t"]), ["__t"], "__freq")
    prob = bigram_prob(F.col("cb"), F.col("cc"), F.col("cu"), F.col("n_tokens"), F.col("n_types"), lm.lam)
    out = j.crossJoin(F.broadcast(lm.totals)).select(*pairs.columns, prob.alias("prob"))
    # weights are looked up by how often a token occurs in ``out``, so it is read twice
    return with_weights(out if weights is None else materialize(out), weights)


def token_scores(
    lm: BigramLM,
    df: DataFrame,
    id_col: str = "row_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    tokenizer=tokenize_words,
    add_bos: bool = True,
    weights: DataFrame | None = None,
    extra_cols: tuple[str, ...] = (),
    keep_empty: bool = False,
) -> DataFrame:
    """Long-form ``token_scores``: ``id_col, [extra], pos, token, prob, weight``; with
    ``keep_empty`` one row with NULL ``pos`` and ``prob`` for each input row without a scored
    token.

    The texts are read once for their distinct pairs and once for the join of each
    occurrence with its pair's probability, which is the only shuffle of occurrences."""
    args = (df, id_col, text_col, tokenizer, add_bos, prompt_col, True, extra_cols)
    p, t = F.xxhash64("prev").alias("__p"), F.xxhash64("token").alias("__t")
    shown = [] if weights is None else [F.first("token").alias("token")]
    used = occurrences(*args).select(p, t, "token").groupBy("__p", "__t").agg(F.count(F.lit(1)).alias("n_occ"), *shown)
    probs = materialize(pair_probabilities(lm, materialize(used), weights).drop("token"))
    # rows without a scored token spread over the tasks by their ids
    alone = F.when(F.col("pos").isNull(), F.xxhash64(F.lit(-1), id_col, *extra_cols)).otherwise(p)
    occ = occurrences(*args, keep_empty=keep_empty).select(id_col, *extra_cols, "pos", "token", alone.alias("__p"), t)
    scored = lookup_join(occ, probs, ["__p", "__t"], "n_occ", how="left" if keep_empty else "inner")
    scored = scored.select(id_col, *extra_cols, "pos", "token", "prob", "weight")
    return scored if keep_empty else scored.sortWithinPartitions(id_col, "pos")


def assemble_scores(scores: DataFrame, id_cols: list[str]) -> DataFrame:
    """Re-assemble long-form scores into one ordered array per row:
    ``id_cols, scores`` (``array<struct<pos, token, prob, weight>>`` sorted by ``pos``;
    empty for a row whose only ``pos`` is NULL).

    A row's array is bounded by the row's own text length."""
    if "weight" not in scores.columns:
        scores = scores.withColumn("weight", F.lit(1.0))
    return scores.groupBy(*id_cols).agg(
        F.array_sort(
            F.collect_list(
                F.when(F.col("pos").isNotNull(), F.struct(
                    F.col("pos").cast("int").alias("pos"),
                    F.col("token"),
                    F.col("prob").cast("double").alias("prob"),
                    F.col("weight").cast("double").alias("weight"),
                ))
            )
        ).alias("scores")
    )


def score_rows(
    lm: BigramLM,
    df: DataFrame,
    id_col: str = "row_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    tokenizer=tokenize_words,
    add_bos: bool = True,
    weights: DataFrame | None = None,
    extra_cols: tuple[str, ...] = (),
) -> DataFrame:
    """Per-row score arrays: ``id_col, [extra], scores``; every input row appears once, with
    an empty array if it has nothing to score."""
    return assemble_scores(score_long(lm, df, id_col, text_col, prompt_col, tokenizer, add_bos, weights, extra_cols),
                           [id_col, *extra_cols])


def score_long(
    lm: BigramLM,
    df: DataFrame,
    id_col: str = "row_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    tokenizer=tokenize_words,
    add_bos: bool = True,
    weights: DataFrame | None = None,
    extra_cols: tuple[str, ...] = (),
) -> DataFrame:
    """``token_scores`` of every input row: rows without a scored token have one row with
    NULL ``pos``."""
    return token_scores(lm, df, id_col, text_col, prompt_col, tokenizer, add_bos, weights, tuple(extra_cols), True)


def mark_failed(rows: DataFrame, failed: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``failed``: whether the scorer reported an error for the row (its keys are in
    ``failed``, one row for each)."""
    return rows.join(failed.select(*keys, F.lit(True).alias("failed")), keys, "left").withColumn(
        "failed", F.coalesce("failed", F.lit(False)))


def tokens_and_probs(lm: BigramLM, df: DataFrame, id_col: str, text_col: str, as_log_probs: bool = False,
                     tokenizer=tokenize_words) -> DataFrame:
    """(token, probability) pairs of a text scored without a start token: the first
    token has no context and is not returned. ``as_log_probs`` returns ``ln(p)``."""
    s = token_scores(lm, df, id_col, text_col, None, tokenizer, add_bos=False)
    v = F.ln("prob") if as_log_probs else F.col("prob")
    return s.select(id_col, "pos", "token", v.alias("logprob" if as_log_probs else "prob"))


def drop_special(pairs: Column, specials=None) -> Column:
    """Drop (token, prob) structs whose token is a special token."""
    from textlens.functions.text import SPECIAL_TOKENS

    sp = F.array(*[F.lit(s) for s in (specials or SPECIAL_TOKENS)])
    return F.filter(pairs, lambda x: ~F.array_contains(sp, x["token"]))


def validate_scores(scores: DataFrame) -> DataFrame:
    """Rows of an external ``token_scores`` table whose probability is outside (0, 1]; a row
    with NULL ``pos`` says that nothing was to be scored and is valid."""
    p = F.col("prob")
    return scores.filter(F.col("pos").isNotNull() & (p.isNull() | F.isnan(p) | (p <= 0) | (p > 1)))


def _bounds(deals: int) -> np.ndarray:
    """Deals are ranges of hashes: the least hash of each, so hashes in order are in the order of deals."""
    return np.array([-(-(d << 64) // deals) for d in range(deals)], np.uint64)


def _text_blocks(bos: int, tokens: bool, chunk: int):
    """Arrow pass over ``id, __key, __h[, __w]``, ordered by ``__key``, -> blocks of about ``chunk``
    tokens. Texts with one key are in one block, one after the other."""
    def block(number, parts):
        ids, sizes, values, shown = zip(*parts)
        sizes = np.concatenate(sizes)
        words, first, at = np.unique(np.concatenate([np.array([bos], np.int64), *values]).view(np.uint64), return_index=True, return_inverse=True)
        kind = np.uint16 if len(words) <= 1 << 16 else np.uint32
        cells = {"block": number, "n": len(at) - 1, "ids": pa.concat_arrays(ids), "sizes": zipped(sizes.astype(np.uint32)),
                 "words": zipped(words), "codes": zipped(at[1:].astype(kind)),
                 "shown": pa.concat_arrays([pa.array([BOS]), *shown]).take(pa.array(first)) if tokens else None}
        lists = {c: pa.ListArray.from_arrays([0, len(cells[c])], cells[c]) for c in ("ids", "shown") if cells[c] is not None}
        none = pa.nulls(1, pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([cells["n"]], pa.int64()), lists["ids"],
             *(pa.array([cells[c]], pa.binary()) for c in ("sizes", "words", "codes")), lists.get("shown", none)], list(cells))

    def run(batches):
        from pyspark import TaskContext

        number, parts, total, last = TaskContext.get().partitionId() << 32, [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, keys, lists = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
            shown = batch.column(3).flatten().cast(pa.string()) if tokens else None
            cuts = [int(x) for x in np.flatnonzero(keys[1:] != keys[:-1]) + 1] + [len(keys)]
            at = 0
            for i, cut in enumerate(cuts):  # texts from ``at`` on are not in ``parts`` yet; a key ends at each cut
                if at == 0 and i == 0 and parts and keys[0] != last and total >= chunk:
                    yield block(number, parts)
                    number, parts, total = number + 1, [], 0
                if total + ends[cut] - ends[at] >= chunk or cut == len(keys):
                    a, b = ends[at], ends[cut]
                    parts.append((ids.slice(at, cut - at), sizes[at:cut], values[a:b], shown.slice(a, b - a) if tokens else None))
                    total, at = total + int(b - a), cut
                    if cut < len(keys):
                        yield block(number, parts)
                        number, parts, total = number + 1, [], 0
            last = keys[-1]
        if parts:
            yield block(number, parts)

    return run


class _Block:
    """A block's tokens: ``words`` (their hashes in order), ``codes`` (places in them), ``text`` (which
    text each is in), ``place`` (from 0 on). ``scored``: those with a token or the start before them,
    ``pairs``: the hashes of these two in order, ``pair``: the place of each scored one's in them."""

    def __init__(self, row, bos: int, add_bos: bool):
        self.words, self.codes = unzipped(row["words"]), unzipped(row["codes"]).astype(np.int64)
        self.sizes = unzipped(row["sizes"]).astype(np.int64)
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(self.codes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        start = np.searchsorted(self.words, np.array([bos], np.int64).view(np.uint64))
        self.scored = np.full(len(self.codes), add_bos) | (self.place > 0)
        before = np.where(self.place > 0, np.concatenate([start, self.codes])[:-1], start)
        self.before = before[self.scored]
        with np.errstate(over="ignore"):
            hashes = mixed(mixed(self.words[self.before] ^ np.uint64(0xD1B54A32D192ED03)) + self.words[self.codes[self.scored]])
        self.pairs, self.pair, self.counts = np.unique(hashes, return_inverse=True, return_counts=True)


def _requests(bos: int, add_bos: bool, deals: int):
    """Blocks -> what each asks of the deals: its tokens (``cu`` times there, ``cc`` times as a
    context) and its pairs (``cb`` times)."""
    def run(batches):
        bounds = _bounds(deals)
        for batch in batches:
            for row in batch.select(["block", "sizes", "words", "codes"]).to_pylist():
                b = _Block(row, bos, add_bos)
                cu, cc = np.bincount(b.codes, minlength=len(b.words)), np.bincount(b.before, minlength=len(b.words))
                w, p = ([*np.searchsorted(x, bounds), len(x)] for x in (b.words, b.pairs))
                out = [(row["block"], d, increasing(b.words[w[d]:w[d + 1]]), zipped(cu[w[d]:w[d + 1]].astype(np.uint32)),
                        zipped(cc[w[d]:w[d + 1]].astype(np.uint32)), increasing(b.pairs[p[d]:p[d + 1]]),
                        zipped(b.counts[p[d]:p[d + 1]].astype(np.uint32))) for d in range(deals) if w[d] < w[d + 1] or p[d] < p[d + 1]]
                kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["block", "deal", "words", "cu", "cc", "pairs", "cb"])

    return run


def _answers(weighted: bool):
    """A deal's requests (and weights) -> each block's tokens' and pairs' counts in the corpus, in the order
    asked; one row without a block has the deal's occurrences and types."""
    def run(asked, weights=None):
        def totals(keys, *counts):
            keys = [unzipped(x.as_py(), True) for x in asked[keys]]
            known, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
            ends = np.cumsum([0, *map(len, keys)])
            sums = [np.bincount(at, np.concatenate([np.zeros(0), *(unzipped(x.as_py()) for x in asked[c])]), len(known)).astype(np.uint64) for c in counts]
            return known, sums, lambda values: pa.array([zipped(values[at[a:b]]) for a, b in zip(ends[:-1], ends[1:])], pa.binary())

        words, (cu, cc), told = totals("words", "cu", "cc")
        _, (cb,), of_pair = totals("pairs", "cb")
        weight = np.full(len(words), DEFAULT_IDF_WEIGHT)
        if weighted and len(words):
            at = np.searchsorted(words, key := weights["key"].to_numpy().view(np.uint64))
            hit = words[np.minimum(at, len(words) - 1)] == key
            weight[at[hit]] = weights["weight"].fill_null(DEFAULT_IDF_WEIGHT).to_numpy()[hit]
        none = pa.nulls(1, pa.binary())
        columns = [told(cu), told(cc), told(weight.view(np.uint64)) if weighted else pa.nulls(len(asked), pa.binary()), of_pair(cb)]
        rows = [asked["block"].combine_chunks(), asked["deal"].combine_chunks(), *columns, pa.nulls(len(asked), pa.int64()), pa.nulls(len(asked), pa.int64())]
        own = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), none, none, none, none, pa.array([int(cu.sum())]), pa.array([int((cu > 0).sum())])]
        return pa.table([pa.chunked_array([a, b]) for a, b in zip(rows, own)], ["block", "deal", "cu", "cc", "weight", "cb", "n", "v"])

    return run if weighted else lambda asked: run(asked)


def _block_scores(bos: int, add_bos: bool, n: int, v: int, lam: float, weighted: bool, id_col: str):
    """A block and its answers -> its scores, those of a text one after the other."""
    def run(blocks, answers):
        row = blocks.select(["sizes", "words", "codes"]).to_pylist()[0]
        b, answers = _Block(row, bos, add_bos), answers.sort_by("deal")
        cu, cc, cb = (np.concatenate([np.zeros(0), *(unzipped(x.as_py()) for x in answers[c])]) for c in ("cu", "cc", "cb"))
        token = b.codes[b.scored]
        prob = lam * (cb[b.pair] / cc[b.before]) + (1.0 - lam) * ((cu[token] + 1) / (n + v + 1))
        weight = np.concatenate([unzipped(x.as_py()) for x in answers["weight"]]).view(np.float64)[token] if weighted and len(token) else np.ones(len(token))
        text = b.text[b.scored]
        alone = np.setdiff1d(np.arange(len(b.sizes)), text)
        order, short = np.argsort(np.concatenate([text, alone]), kind="stable"), pa.nulls(len(alone), pa.float64())
        shown = blocks["shown"].combine_chunks()
        strings = pa.nulls(len(token), pa.string()) if shown.null_count else shown.flatten().take(pa.array(token))
        columns = [blocks["ids"].combine_chunks().flatten().take(pa.array(np.concatenate([text, alone])[order])),
                   *(pa.concat_arrays([x, short.cast(x.type)]).take(pa.array(order)) for x in (
                       pa.array((b.place[b.scored] + 1).astype(np.int32)), strings, pa.array(prob), pa.array(weight)))]
        return pa.table(columns, [id_col, "pos", "token", "prob", "weight"])

    return run


def fit_and_score(
    df: DataFrame,
    id_col: str = "row_id",
    text_col: str = "text",
    tokenizer=tokenize_words,
    add_bos: bool = True,
    lam: float = DEFAULT_LAMBDA,
    weights: DataFrame | None = None,
    tokens: bool = True,
) -> DataFrame:
    """In-sample scoring: fit the LM on the texts of ``df`` and score those same texts
    (no prompt). Returns the scores like ``score_long``, those of an id one after the other in
    one partition; without ``tokens`` the column ``token`` is NULL and no token string is moved.

    Texts move once, as 64-bit token hashes, to the others with their id, and are written as
    blocks of about ``COMMON`` tokens. A block asks for each of its tokens and pairs once, in
    compressed arrays of hashes and counts that are dealt by hash; there the counts of all
    blocks are summed (and weights looked up) and told to each block in the order asked. So
    no token occurrence is a row before its score is known, and no key is hot."""
    spark = df.sparkSession
    kind, bos = df.schema[id_col].dataType.simpleString(), df.sparkSession.range(1).select(F.xxhash64(F.lit(BOS))).first()[0]
    if weights is not None:  # written first, so that what leads to them is gone when texts move
        own = materialize(weights.select(F.xxhash64("token").alias("key"), F.col("weight").cast("double").alias("weight")))
    cut = df.select(id_col, F.xxhash64(id_col).alias("__key"), tokenizer(F.col(text_col)).alias("__w"))
    coded = cut.select(id_col, "__key", F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"), *(["__w"] if tokens else []))
    blocks = materialize(coded.repartition("__key").sortWithinPartitions("__key").mapInArrow(
        _text_blocks(bos, tokens, COMMON), f"block long, n long, ids array<{kind}>, sizes binary, words binary, codes binary, shown array<string>"))
    total = blocks.agg(F.sum("n")).first()[0] or 0
    deals = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // DEAL_TOKENS))
    asked = blocks.mapInArrow(_requests(bos, add_bos, deals), "block long, deal int, words binary, cu binary, cc binary, pairs binary, cb binary").groupBy("deal")
    answer = "block long, deal int, cu binary, cc binary, weight binary, cb binary, n long, v long"
    if weights is None:
        told = asked.applyInArrow(_answers(False), answer)
    else:
        def dealt(batches):
            for batch in batches:
                deal = np.searchsorted(_bounds(deals), batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64), "right") - 1
                yield batch.append_column("deal", pa.array(deal.astype(np.int32)))

        told = asked.cogroup(own.mapInArrow(dealt, "key long, weight double, deal int").groupBy("deal")).applyInArrow(_answers(True), answer)
    told = materialize(told)
    n, v = told.where("block IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    return blocks.groupBy("block").cogroup(told.where("block IS NOT NULL").groupBy("block")).applyInArrow(
        _block_scores(bos, add_bos, n, v, float(lam), weights is not None, id_col), f"`{id_col}` {kind}, pos int, token string, prob double, weight double")
