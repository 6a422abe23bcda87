"""Connected components of a link table, spanning forests and set overlaps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.session import materialize


def connected(edges: DataFrame) -> DataFrame:
    """(id, root) of every node that is not the least of its component, from rows (a, b).

    Each round links the greater neighbours of a node to its least neighbour, then the
    smaller ones (the two star operations), which ends in one star a component. A round
    moves the links once for each operation; a node's links are joined with its least
    neighbour, never collected, so a node of any degree is split like any skewed key. Each
    round's links are written to the shared folder."""
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .where("u <> v").distinct())
    before = None
    while True:
        state = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before or state[0] == 0:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        e = materialize(large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                        .union(small.select("u", F.col("m").alias("v"))).distinct())


def spanning_forest(a, b):
    """The pairs that join two trees, in order."""
    root: dict[int, int] = {}

    def find(i):
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(a, b):
        u, v = find(i), find(j)
        if u != v:
            root[max(u, v)] = min(u, v)
            out.append((i, j))
    return out


def shared_counts(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """|A & B| for the sets numbered ``first`` (rows) and ``second`` (columns)."""
    both = np.unique(np.concatenate([first, second]))
    place = {s: i for i, s in enumerate(both)}
    row = np.repeat(np.arange(len(both)), [len(sets[s]) for s in both])
    _, col, df = np.unique(np.concatenate([sets[s] for s in both]), return_inverse=True, return_counts=True)
    m = len(both)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    starts = np.cumsum(df) - df
    pairs = [np.zeros(0, np.int64)]
    for d in range(2, 9):  # a shingle of few sets: its pairs, lower number first
        at = starts[df == d]
        pairs += [row[at + i] * m + row[at + j] for i in range(d) for j in range(i + 1, d)]
    out = np.bincount(np.concatenate(pairs), minlength=m * m).reshape(m, m).astype(np.int32)
    many = np.flatnonzero(df > 8)  # of many sets: matrix products over blocks of shingles
    number = np.full(len(df), -1)
    number[many] = np.arange(len(many))
    use = number[col] >= 0
    row, col = row[use], number[col[use]]
    upper = out + out.T
    for a in range(0, len(many), 4096):
        inside = (col >= a) & (col < a + 4096)
        has = np.zeros((m, min(4096, len(many) - a)), np.float32)
        has[row[inside], col[inside] - a] = 1
        upper += np.rint(has @ has.T).astype(np.int32)
    np.fill_diagonal(upper, [len(sets[s]) for s in both])
    return upper[np.ix_([place[s] for s in first], [place[s] for s in second])]
