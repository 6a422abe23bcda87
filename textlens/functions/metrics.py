"""Column expressions over a row's scored-token array.

A *score array* is ``array<struct<pos:int, token:string, prob:double, weight:double>>``
in sequence order. A token is **kept** at threshold ``t`` when ``prob < t`` (strict) and
**filtered** otherwise. Everything here is a higher-order array expression evaluated in
the JVM, one pass per metric.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------
# Threshold list of the evaluation configs, in configured order.
DEFAULT_THRESHOLDS = (1.01, 0.999, 0.99, 0.98, 0.97, 0.96, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5)
# Threshold at which the IDF-scaled probabilities are reported scaled.
SCALE_THRESHOLD = 1.01
# Default IDF weight of a vocabulary entry without a known piece.
DEFAULT_IDF_WEIGHT = 0.001
# Smoothing added to the corpus token total of the filtered share.
SHARE_EPSILON = 1e-9
# --- end of fixed values ------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def kept(scores, t) -> Column:
    return F.filter(_c(scores), lambda x: x["prob"] < t)


def total_tokens(scores) -> Column:
    s = _c(scores)
    return F.when(s.isNotNull(), F.size(s).cast("bigint"))  # size(NULL) is -1 without ANSI mode


def filtered_tokens(scores, t) -> Column:
    s = _c(scores)
    return F.when(s.isNotNull(), F.size(F.filter(s, lambda x: x["prob"] >= t)).cast("bigint"))


def kept_tokens(scores, t) -> Column:
    s = _c(scores)
    return F.when(s.isNotNull(), F.size(kept(s, t)).cast("bigint"))


def perplexity(scores, t, weighted: bool = False) -> Column:
    """``exp(sum over kept of -ln(p) [* w] / n_kept)``; NULL when nothing is kept.

    The divisor is the kept-token count also in the weighted form."""
    k = kept(scores, t)
    if weighted:
        nll = F.aggregate(k, F.lit(0.0), lambda acc, x: acc - F.ln(x["prob"]) * x["weight"])
    else:
        nll = F.aggregate(k, F.lit(0.0), lambda acc, x: acc - F.ln(x["prob"]))
    n = F.size(k)
    return F.when(n > 0, F.exp(nll / n))


def longest_run(scores, t) -> Column:
    """Longest stretch of consecutive filtered tokens divided by the token count;
    0.0 for an empty row. One pass with a (current, best) accumulator."""
    s = _c(scores)
    init = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("best"))

    def step(acc, x):
        cur = F.when(x["prob"] >= t, acc["cur"] + 1).otherwise(F.lit(0))
        return F.struct(cur.alias("cur"), F.greatest(acc["best"], cur).alias("best"))

    best = F.aggregate(s, init, step, lambda acc: acc["best"])
    n = F.size(s)
    return F.when(n > 0, best / n).otherwise(F.lit(0.0))


def probs(scores) -> Column:
    return F.transform(_c(scores), lambda x: x["prob"])


def scaled_probs(scores, scale: bool = True) -> Column:
    if scale:
        return F.transform(_c(scores), lambda x: x["prob"] * x["weight"])
    return probs(scores)
