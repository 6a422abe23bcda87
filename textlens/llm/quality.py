"""Quality classifier: random-indexing word vectors pooled per document, a two-layer
numpy network and temperature-calibrated probabilities.

1. Word vectors. A unit (a run of word characters or of punctuation) is hashed into one of
   ``SLOTS`` slots; a slot has a fixed sparse ternary index vector of ``DIMS`` dimensions.
   A slot's context vector is the sum of the index vectors around its occurrences, up to
   ``REACH`` units away, over *all* documents. Each task adds its own integer table; the
   tables are summed by slot group in two steps, so no task holds more than its share.
   The summed table (SLOTS x DIMS integers, whatever the corpus) is centred, scaled to
   unit rows and sent to the executors.
2. Pooling. A document's vector holds the mean and the spread of its units' vectors, the
   mean cosine of neighbouring units and the share of distinct slots. It is written once;
   both the fit and the scores read it.
3. The network is fitted by Adam on at most ``FIT_ROWS`` labelled rows (the documented
   bound of the fit, taken by hash), on the driver; a fifth of them, taken by hash too,
   sets the temperature that calibrates the probabilities.

Only the text enters a score. Defined results: null and empty texts pool to zeros and get
a score like any text; ids may be null or repeat; a label that repeats counts once, the
greater if they differ; without labels every score is 0.5, with one class only its share
smoothed by one row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm.common import chunks, fold, hash_sample, table, texts
from textlens.session import materialize

SLOTS, DIMS, NONZERO, REACH = 4096, 32, 4, 2
GROUPS, SALTS = 32, 64
FIT_ROWS = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 24, 60, 0.01, 1e-4
CHUNK = 2_000_000
KNOWN = 200_000
UNIT = re.compile(r"\w+|[^\w\s]+")
FEATURES = 2 * DIMS + 2


def index_vectors():
    """Fixed (positions, signs) of the nonzero entries of each slot's index vector."""
    rng = np.random.default_rng(20_240)
    at = np.array([rng.choice(DIMS, NONZERO, replace=False) for _ in range(SLOTS)])
    return at, rng.choice([-1.0, 1.0], (SLOTS, NONZERO))


class Slots(dict):
    """Unit -> slot; remembers the units asked for, up to KNOWN."""

    def __missing__(self, unit):
        if len(self) > KNOWN:
            self.clear()
        s = self[unit] = zlib.crc32(unit.encode()) % SLOTS
        return s

    def of(self, docs: list[str]):
        """Flat slots of the texts and the number of units of each."""
        get, flat, sizes = self.__getitem__, [], []
        for t in docs:
            units = UNIT.findall(t)
            sizes.append(len(units))
            flat.extend(map(get, units))
        return np.array(flat, np.int64), np.array(sizes, np.int64)


def add_contexts(total, slots, sizes, at, sign):
    """Adds to ``total`` (SLOTS x DIMS) the index vectors around each unit of each text."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for reach in range(1, REACH + 1):
        same = doc[:-reach] == doc[reach:]
        left, right = slots[:-reach][same], slots[reach:][same]
        for a, b in ((left, right), (right, left)):
            for k in range(NONZERO):
                total += np.bincount(a * DIMS + at[b, k], sign[b, k], SLOTS * DIMS).astype(np.int64).reshape(total.shape)


def _task_tables(batches):
    import pyarrow as pa

    slots, total, (at, sign) = Slots(), np.zeros((SLOTS, DIMS), np.int64), index_vectors()
    for batch in batches:
        docs = batch["text"].to_pylist()
        for a, b in chunks(docs, CHUNK):
            s, sizes = slots.of(docs[a:b])
            if len(s) > REACH:
                add_contexts(total, s, sizes, at, sign)
    rows = [g.tobytes() for g in np.split(total, GROUPS)]
    yield pa.RecordBatch.from_arrays([pa.array(range(GROUPS), pa.int32()), pa.array(
        [zlib.crc32(r) % SALTS for r in rows], pa.int32()), pa.array(rows, pa.binary())], ["part", "salt", "sums"])


def _sum_tables(t):
    import pyarrow as pa

    total = np.zeros(SLOTS // GROUPS * DIMS, np.int64)
    for row in t["sums"]:
        total += np.frombuffer(row.as_py(), np.int64)
    return pa.table({"part": t["part"][:1], "salt": t["salt"][:1], "sums": pa.array([total.tobytes()], pa.binary())})


def word_vectors(rows: DataFrame) -> np.ndarray:
    """SLOTS x DIMS unit rows, from the contexts in all texts of ``rows`` (doc_id, text)."""
    schema = "part int, salt int, sums binary"
    tables = rows.select("text").mapInArrow(_task_tables, schema)
    summed = (tables.groupBy("part", "salt").applyInArrow(_sum_tables, schema)
              .groupBy("part").applyInArrow(_sum_tables, schema).collect())  # GROUPS rows
    m = np.zeros((SLOTS, DIMS))
    for r in summed:
        m[r.part * (SLOTS // GROUPS):(r.part + 1) * (SLOTS // GROUPS)] = np.frombuffer(bytes(r.sums), np.int64).reshape(-1, DIMS)
    size = np.abs(m).sum(1, keepdims=True)
    m = np.where(size > 0, m / np.maximum(size, 1), 0)
    m -= m.mean(0)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(norm > 0, m / np.maximum(norm, 1e-12), 0).astype(np.float32)


def pool(slots, sizes, vectors):
    """One row of FEATURES for each text."""
    out = np.zeros((len(sizes), FEATURES), np.float32)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full].astype(np.float32)[:, None]
    start = (np.cumsum(sizes) - sizes)[full]
    v = vectors[slots]
    mean = np.add.reduceat(v, start, dtype=np.float64) / n
    out[full, :DIMS] = mean
    out[full, DIMS:2 * DIMS] = np.sqrt(np.maximum(np.add.reduceat(v * v, start, dtype=np.float64) / n - mean ** 2, 0))
    cos = np.zeros(len(slots), np.float32)
    cos[1:] = np.einsum("ij,ij->i", v[1:], v[:-1])
    cos[start] = 0
    out[full, 2 * DIMS] = np.add.reduceat(cos, start, dtype=np.float64) / np.maximum(n[:, 0] - 1, 1)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    seen = np.unique(doc * SLOTS + slots) // SLOTS
    out[:, 2 * DIMS + 1] = np.bincount(seen, minlength=len(sizes)) / np.maximum(sizes, 1)
    return out


def _pool_texts(vectors):
    def run(batches):
        import pyarrow as pa

        slots, v = Slots(), vectors.value
        for batch in batches:
            docs = batch["text"].to_pylist()
            for a, b in chunks(docs, CHUNK):
                x = pool(*slots.of(docs[a:b]), v)
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(a, b - a),
                    pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float32()))],
                    ["doc_id", "x"])

    return run


class Network:
    """x -> tanh layer -> logit; probabilities are sigmoid(logit / temperature)."""

    def __init__(self, x, y, weight):
        rng = np.random.default_rng(7)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-3
        self.temperature = 1.0
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
        self._adam((x - self.mean) / self.spread, y, weight, rng)

    def _adam(self, x, y, weight, rng):
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            rate = RATE * (1 - epoch / EPOCHS)
            for a in range(0, len(x), 256):
                b = order[a:a + 256]
                h = np.tanh(x[b] @ self.w[0] + self.w[1])
                d = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - y[b]) * weight[b] / len(b)
                dh = np.outer(d, self.w[2]) * (1 - h * h)
                grads = [x[b].T @ dh + DECAY * self.w[0], dh.sum(0), h.T @ d + DECAY * self.w[2], d.sum()]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)

    def logit(self, x):
        return np.tanh(((x - self.mean) / self.spread) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def calibrate(self, x, y):
        """The temperature of least log loss on held-back rows (a grid of factors)."""
        z = np.clip(self.logit(x), -30, 30)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.logaddexp(0, np.where(y == 1, -1, 1) * z / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def __call__(self, x):
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


class Constant:
    def __init__(self, share: float):
        self.share = share

    def __call__(self, x):
        return np.full(len(x), self.share)


def fit(x, y):
    """A calibrated network, or a constant if a class is missing."""
    if not len(y):
        return Constant(0.5)
    if y.min() == y.max():
        return Constant((y.sum() + 1) / (len(y) + 2))
    back = np.arange(len(y)) % 5 == 4
    if len(set(y[~back])) < 2 or len(set(y[back])) < 2:
        back[:] = False
    model = Network(x[~back], y[~back], np.ones((~back).sum()))
    if back.any():
        model.calibrate(x[back], y[back])
    return model


def _score(model):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array(batch["x"].flatten(), np.float64).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.value(x), pa.float64())],
                                             ["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, score and predicted for every row; ``labels``: (doc_id, label 0/1) to learn from."""
    spark = docs.sparkSession
    t = texts(docs, id_col, text_col)
    vectors = spark.sparkContext.broadcast(word_vectors(t))
    kind = t.schema["doc_id"].dataType.simpleString()
    pooled = materialize(t.mapInArrow(_pool_texts(vectors), f"doc_id {kind}, x array<float>"))
    known = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = F.broadcast(hash_sample(known, "doc_id", fit_rows))  # fit_rows rows of two numbers at most
    rows = hash_sample(pooled.join(sample, "doc_id"), "doc_id", fit_rows).toPandas()
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, FEATURES)
    model = spark.sparkContext.broadcast(fit(x, rows["label"].to_numpy(np.int64)))
    return pooled.mapInArrow(_score(model), f"doc_id {kind}, score double").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 3) == 1
    scores = quality_scores(table(spark, sf_dir, "documents"), quality_labels(spark, sf_dir).where(~held_out))
    return scores.select("doc_id", held_out.alias("held_out"), "score", "predicted")
