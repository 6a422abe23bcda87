"""Embedding whitening by shifted CholeskyQR.

Vectors become integers x = floor(SCALE * c) + OFFSET, entry by entry, so their sums are
exact. With the mean taken off, the rows are a tall matrix A, one row a vector.

1. A Gram pass sums Q'Q over all rows, Q being A at first. Each task adds its own rows and
   writes one small matrix; the matrices are summed in two steps, a matrix row a group.
2. The driver factors the Gram matrix (dims x dims) as R'R. The first factor is taken of the
   Gram matrix plus a small shift of its diagonal, which no rounding can make indefinite.
3. The next pass solves Q R = A row by row with the factors so far (forward substitution)
   and sums again. It ends when Q'Q is the identity to rounding; three passes do.
4. R, the product of the factors, has A's singular values and right vectors: an SVD of R
   gives the eigenvectors of the covariance without squaring its condition number.
5. One more pass sums the covariance of the whitened rows, whose distance from the identity
   is returned with them.

Only matrices of dims x dims reach the driver, and their size is checked. No pass needs
another's rows: a lost task is run again from the table.

Defined results: null vectors, empty ones and those that hold null or non-finite entries are
left out, as are vectors of another length than the most frequent one (of equally frequent
ones the longer). Repeated rows count as often as they occur, ids may be null or repeat,
other columns are ignored. Components whose singular value is under 1e-7 of the greatest
are not returned (a constant column, fewer rows than dimensions), so a table whose vectors
are all equal, or an empty one, gives no rows. ``deviation`` is null where it exceeds a long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm.common import table

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
MAX_DIMS = 8192  # a Gram matrix of 512 MB, the most the driver and a task hold
PASSES = 6
RANK = 1e-7  # a direction of a smaller share of the greatest singular value is none
ROWS = 4096  # rows that a task works on at once
SALTS = 64
EPS = np.finfo(float).eps


def clean_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that count, as arrays of doubles without nulls."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    kept = rows.select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") > 0)).where(~bad)
    common = kept.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims = common[0].dims if common else 0
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} dimensions; at most {MAX_DIMS} are supported")
    return kept.where(F.size("v") == dims)


def _integers(batch, a, b):
    column = batch["v"].slice(a, b - a)
    c = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return np.floor(SCALE * c).astype(np.int64) + OFFSET


def _blocks(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch, a, min(a + ROWS, batch.num_rows)


def solve_rows(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q with Q R = A for an upper triangular R, column by column."""
    q = np.empty_like(a)
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _summed(vectors: DataFrame, matrix, kind: str) -> np.ndarray | None:
    """The sum over all blocks x of integers of ``matrix(x)`` (2-D, ``kind`` int64 or
    float64). Each task writes its own sum by row; rows are summed in two steps."""
    schema = "row int, salt int, sums binary"

    def partial(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = None
        for batch, a, b in _blocks(batches):
            m = matrix(_integers(batch, a, b))
            total = m if total is None else total + m
        if total is not None:
            salt = TaskContext.get().partitionId() % SALTS
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([salt] * len(total), pa.int32()),
                                              pa.array([r.tobytes() for r in total], pa.binary())], ["row", "salt", "sums"])

    def merge(t):
        import pyarrow as pa

        total = sum(np.frombuffer(s.as_py(), kind) for s in t["sums"])
        return pa.table({"row": t["row"][:1], "salt": t["salt"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    rows = (vectors.select("v").mapInArrow(partial, schema).groupBy("row", "salt").applyInArrow(merge, schema)
            .groupBy("row").applyInArrow(merge, schema).collect())  # as many rows as dimensions
    return np.array([np.frombuffer(bytes(r.sums), kind) for r in sorted(rows, key=lambda r: r.row)]) if rows else None


def factor(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Upper triangular R with R'R = gram, plus the shift where it is the first factor or
    rounding has made the matrix indefinite."""
    d, size = len(gram), np.linalg.norm(gram, 2)
    shift = 11 * (n * d + d * (d + 1)) * EPS * size if first else 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, 10 * d * EPS * size)


def whitening_fit(vectors: DataFrame, components: int = COMPONENTS) -> dict | None:
    """n, S, mean, trace, eigenvalues and vectors (rows) of the covariance, greatest first;
    None without a direction of positive variance. ``vectors`` as of ``clean_vectors``."""
    head = _summed(vectors, lambda x: np.vstack([x.sum(0), np.full(x.shape[1], len(x))]), "int64")
    if head is None:
        return None
    n, total = int(head[1, 0]), head[0]
    mean = total / n
    r, basis, trace = None, None, 0.0
    for _ in range(PASSES):
        def gram_of(x, r=r, basis=basis):
            q = x - mean
            if basis is not None:
                q = q @ basis
            if r is not None:
                q = solve_rows(q, r)
            return q.T @ q

        gram = _summed(vectors, gram_of, "float64")
        gram = (gram + gram.T) / 2
        if r is not None:
            if np.abs(gram - np.eye(len(gram))).max() < 100 * len(gram) * EPS:
                break
            r = factor(gram, n, False) @ r
            continue
        trace = float(np.trace(gram)) / n
        if trace == 0:
            return None
        value, vector = np.linalg.eigh(gram)
        full = value > RANK ** 2 * value[-1]
        if not full.all():  # the rest goes on in the directions that A extends in
            basis = vector[:, full]
            gram = basis.T @ gram @ basis
        r = factor(gram, n, True)
    _, size, right = np.linalg.svd(r)
    keep = min(components, len(size))
    right = right if basis is None else right @ basis.T
    right = right[:keep]
    right *= np.sign(right[np.arange(keep), np.abs(right).argmax(1)])[:, None]
    return {"n": n, "sums": total, "mean": mean, "trace": trace, "e": size[:keep] ** 2 / n, "vectors": right}


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each
    vector that counts and each component (1 is that of the greatest variance)."""
    spark, vectors = rows.sparkSession, clean_vectors(rows, id_col, vec_col)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    fitted = whitening_fit(vectors, components)
    if fitted is None:
        return spark.createDataFrame([], schema)
    n, sums, mean = fitted["n"], fitted["sums"], fitted["mean"]
    project = fitted["vectors"].T / np.sqrt(fitted["e"])
    explained = fitted["e"] / fitted["trace"]
    count = len(explained)

    def spread(x):
        w = (x - mean) @ project
        return w.T @ w

    error = float(np.abs(_summed(vectors, spread, "float64") / n - np.eye(count)).max())

    def deviations(x):
        far = np.abs(x - mean).max(initial=0) * n + n
        if far < 2 ** 62 and x.shape[1] * float(far) ** 2 < 2 ** 63:
            return list(((n * x - sums) ** 2).sum(1).tolist())
        exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums.tolist())) for row in x.tolist()]
        return [v if v < 2 ** 63 else None for v in exact]

    def run(batches):
        import pyarrow as pa

        for batch, a, b in _blocks(batches):
            x, m = _integers(batch, a, b), b - a
            own = np.repeat(np.arange(m), count)
            yield pa.RecordBatch.from_arrays([
                batch["vec_id"].slice(a, m).take(pa.array(own)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                pa.array(np.full(m * count, n)), pa.array(deviations(x), pa.int64()).take(pa.array(own)),
                pa.array(((x - mean) @ project).ravel()), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * count, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
