"""Skew-aware equi-join of a large fact table with a one-row-per-key lookup table.

Token occurrences follow a Zipf law: a handful of keys (``the``, ``(the, of)``, a
boilerplate shingle bucket) can hold a large share of all rows. A plain shuffle join
sends every row of such a key to one task. Here the lookup carries, per key, the number
of fact rows that use it (``freq``). Keys holding at least ``hot_fraction`` of all rows
are *hot*; since the frequencies sum to the total, there are at most ``1/hot_fraction``
hot keys and at most twice as many salts, so broadcasting the hot keys with their number
of salts has a proven bound. A fact row of a hot key draws one of the key's salts, the
lookup row is repeated for each, and one join on key and salt does the rest: the fact
table is evaluated once, and no (key, salt) holds more than ``hot_fraction`` of its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# At most 1/HOT_FRACTION = 20,000 keys are broadcast.
HOT_FRACTION = 5e-5


def hot_salts(lookup: DataFrame, keys: list[str], freq_col: str, hot_fraction: float = HOT_FRACTION,
              rows: DataFrame | None = None) -> DataFrame:
    """``keys, __salts``: the hot keys and the number of parts their rows are cut into.

    The total is a one-row aggregate joined as a broadcast constant (no driver round trip);
    ``rows`` (``__rows``, one row) has it, else it is summed from ``lookup``."""
    total = lookup.agg(F.sum(freq_col).alias("__rows")) if rows is None else rows
    total = total.select((F.col("__rows") * F.lit(float(hot_fraction))).alias("__share"))
    salts = F.ceil(F.col(freq_col) / F.col("__share")).cast("int")
    return lookup.select(*keys, freq_col).crossJoin(F.broadcast(total)).filter(
        F.col(freq_col) >= F.col("__share")
    ).select(*keys, salts.alias("__salts"))


def lookup_join(
    big: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    freq_col: str,
    hot_fraction: float = HOT_FRACTION,
    how: str = "inner",
) -> DataFrame:
    """Join ``big`` to ``lookup`` on ``keys`` (``how`` is ``inner`` or ``left``).

    Output columns: ``big``'s columns, then ``lookup``'s value columns (``freq_col``
    dropped)."""
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    values = [c for c in lookup.columns if c not in keys and c != freq_col]
    salts = F.broadcast(hot_salts(lookup, keys, freq_col, hot_fraction))
    others = [F.col(c) for c in big.columns if c not in keys]
    dealt = big.join(salts, keys, "left").select(
        *big.columns, F.pmod(F.xxhash64(*others), F.coalesce("__salts", F.lit(1))).cast("int").alias("__salt")
    )
    last = F.coalesce("__salts", F.lit(1)) - 1
    repeated = lookup.join(salts, keys, "left").select(
        *keys, *values, F.explode(F.sequence(F.lit(0), last)).alias("__salt")
    )
    return dealt.join(repeated, [*keys, "__salt"], how).select(*big.columns, *values)


def with_freq(big: DataFrame, lookup: DataFrame, keys: list[str], freq_col: str = "__freq") -> DataFrame:
    """The keys that ``big`` uses with their number of rows and ``lookup``'s values (NULL for
    a key it lacks): a lookup table for ``lookup_join``."""
    used = big.groupBy(*keys).agg(F.count(F.lit(1)).alias(freq_col))
    return used.join(lookup, keys, "left")


def skewed_join(big: DataFrame, small: DataFrame, keys: list[str], hot_fraction: float = HOT_FRACTION) -> DataFrame:
    """Inner join of two tables that both may have many rows a key. The rows of ``big`` with
    a key that holds at least ``hot_fraction`` of them draw one of the key's salts; those of
    ``small`` are repeated for each salt. ``big`` is counted in one pass before."""
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("__freq"))
    salts = F.broadcast(hot_salts(counts, keys, "__freq", hot_fraction, big.agg(F.count(F.lit(1)).alias("__rows"))))
    others = [F.col(c) for c in big.columns if c not in keys]
    dealt = big.join(salts, keys, "left").select(
        *big.columns, F.pmod(F.xxhash64(*others), F.coalesce("__salts", F.lit(1))).cast("int").alias("__salt"))
    last = F.coalesce("__salts", F.lit(1)) - 1
    repeated = small.join(salts, keys, "left").select(*small.columns, F.explode(F.sequence(F.lit(0), last)).alias("__salt"))
    return dealt.join(repeated, [*keys, "__salt"]).drop("__salt")
