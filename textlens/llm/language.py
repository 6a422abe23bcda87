"""Language identification: a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes, all of them. In each window
one gated recurrent network reads forwards and one backwards; their states label every
byte with a probability for each language, and the document's probabilities are the mean
over all its bytes. Windows of many texts form one (feature, window) matrix, so a step is
a few numpy operations on whole rows; batches hold ``BATCH`` windows, whatever a text's
length. No shuffle: the texts are read once.

Training is backpropagation through time in numpy, on the driver, on a sample bounded by
its parameters: ``FIT_DOCS`` texts with a language, taken by hash, at most
``WINDOWS_PER_DOC`` windows of each, spread evenly over the text. The gates are clipped
linear functions, the candidate is x / (1 + |x|); both are cheap and have simple
derivatives.

Only the text enters a prediction. Defined results: a null text or one without a letter
is ``und`` with score 0; without a training text every text is ``und`` with score 0;
languages are ordered by name and ties go to the first; ids may be null or repeat; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm.common import chunks, fold, hash_sample, table, texts

WINDOW, HIDDEN, BATCH = 64, 8, 4096
FIT_DOCS, WINDOWS_PER_DOC = 1_200, 16
EPOCHS, FIT_BATCH, RATE = 4, 256, 0.02
CHUNK = 2_000_000
UNKNOWN = "und"


def windows(docs: list[bytes]):
    """(bytes as a windows x WINDOW matrix, valid bytes of each window, text of each)."""
    sizes = np.array([len(d) for d in docs], np.int64)
    count = -(-sizes // WINDOW)
    flat = np.zeros(count.sum() * WINDOW, np.uint8)
    first = (np.cumsum(count) - count) * WINDOW
    source = np.frombuffer(b"".join(docs), np.uint8)
    flat[np.arange(len(source)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)] = source
    doc = np.repeat(np.arange(len(docs)), count)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return flat.reshape(-1, WINDOW), np.minimum(sizes[doc] - rank * WINDOW, WINDOW), doc


class Direction:
    """One gated recurrent network; rows are features, columns are windows.

    z and r are clip(., 0, 1), n = s / (1 + |s|), h' = n + z * (h - n)."""

    def __init__(self, rng):
        h = HIDDEN
        self.x = rng.normal(0, 0.3, (3 * h, 256)).astype(np.float32)
        self.x[:2 * h] += 0.5
        self.u = rng.normal(0, 0.5 / np.sqrt(h), (3 * h, h)).astype(np.float32)

    def step(self, x, h):
        a, b = np.take(self.x, x, axis=1), self.u @ h
        k = HIDDEN
        gates = a[:2 * k]
        gates += b[:2 * k]
        np.minimum(np.maximum(gates, 0, out=gates), 1, out=gates)
        s = a[2 * k:]
        s += gates[k:] * b[2 * k:]
        n = s / (1 + np.abs(s))
        return n + gates[:k] * (h - n), (gates, b[2 * k:], s, n)

    def backward(self, x, before, kept, dh):
        """Gradients of one step: adds to du, returns (d of the input rows, d before)."""
        gates, bn, s, n = kept
        k = HIDDEN
        z, r = gates[:k], gates[k:]
        ds = dh * (1 - z) / (1 + np.abs(s)) ** 2
        da = np.concatenate([dh * (before - n), ds * bn, ds])
        da[:2 * k] *= (gates > 0) & (gates < 1)
        db = np.concatenate([da[:2 * k], ds * r])
        return da, db @ before.T, dh * z + self.u.T @ db


class Tagger:
    """Labels bytes; ``langs`` in order of the output rows."""

    def __init__(self, langs: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.ahead, self.back = Direction(rng), Direction(rng)
        self.out = rng.normal(0, 0.3, (len(langs), 2 * HIDDEN)).astype(np.float32)
        self.bias = np.zeros((len(langs), 1), np.float32)

    def parameters(self):
        return [self.ahead.x, self.ahead.u, self.back.x, self.back.u, self.out, self.bias]

    @staticmethod
    def _softmax(z):
        z = np.exp(z - z.max(0))
        return z / z.sum(0)

    def label(self, matrix, valid):
        """Sum over the valid bytes of each window of their probabilities (languages x windows)."""
        steps, total = matrix.T.astype(np.intp), np.zeros((len(self.langs), len(matrix)), np.float64)
        part = np.empty((WINDOW, len(self.langs), len(matrix)), np.float32)
        h = np.zeros((HIDDEN, len(matrix)), np.float32)
        left, right = self.out[:, :HIDDEN], self.out[:, HIDDEN:]
        for t in range(WINDOW):
            h, _ = self.ahead.step(steps[t], h)
            np.matmul(left, h, out=part[t])
        h = np.zeros((HIDDEN, len(matrix)), np.float32)
        short = valid < WINDOW
        for t in range(WINDOW - 1, -1, -1):
            h, _ = self.back.step(steps[t], h)
            if short.any():
                h *= t < valid  # the padding leaves no state
            total += self._softmax(part[t] + right @ h + self.bias) * (t < valid)
        return total

    def gradients(self, matrix, valid, target):
        """(loss, gradients) of the mean cross entropy over the valid bytes."""
        steps, n = matrix.T.astype(np.intp), len(matrix)
        tape = {}
        for name, net, order in (("ahead", self.ahead, range(WINDOW)), ("back", self.back, range(WINDOW - 1, -1, -1))):
            h = np.zeros((HIDDEN, n), np.float32)
            states, kept, before = [None] * WINDOW, [None] * WINDOW, [None] * WINDOW
            for t in order:
                before[t] = h
                h, kept[t] = net.step(steps[t], h)
                h = h * (t < valid)
                states[t] = h
            tape[name] = (states, kept, before)
        grads = [np.zeros_like(p, dtype=np.float64) for p in self.parameters()]
        loss, scale, dstates = 0.0, 1.0 / valid.sum(), []
        for t in range(WINDOW):
            both = np.concatenate([tape["ahead"][0][t], tape["back"][0][t]])
            p = self._softmax(self.out @ both + self.bias)
            ok = t < valid
            loss -= (np.log(p[target, np.arange(n)] + 1e-12) * ok).sum() * scale
            p[target, np.arange(n)] -= 1
            p *= ok * scale
            grads[4] += p @ both.T
            grads[5] += p.sum(1, keepdims=True)
            dstates.append(self.out.T @ p)
        for i, (name, net, order) in enumerate((("ahead", self.ahead, range(WINDOW - 1, -1, -1)),
                                                ("back", self.back, range(WINDOW)))):
            _, kept, before = tape[name]
            rows = slice(i * HIDDEN, (i + 1) * HIDDEN)
            d, inputs = np.zeros((HIDDEN, n), np.float32), [None] * WINDOW
            for t in order:
                d = (d + dstates[t][rows]) * (t < valid)
                inputs[t], du, d = net.backward(steps[t], before[t], kept[t], d)
                grads[2 * i + 1] += du
            flat, at = np.concatenate(inputs, axis=1), steps.ravel()
            for r in range(3 * HIDDEN):
                grads[2 * i][r] = np.bincount(at, flat[r], 256)
        return loss, grads

    def fit(self, matrix, valid, target, seed: int = 3):
        rng, params, step = np.random.default_rng(seed), self.parameters(), 0
        m, v = [np.zeros(p.shape) for p in params], [np.zeros(p.shape) for p in params]
        batches = max(1, EPOCHS * -(-len(matrix) // FIT_BATCH))
        for _ in range(EPOCHS):
            order = rng.permutation(len(matrix))
            for a in range(0, len(matrix), FIT_BATCH):
                b = order[a:a + FIT_BATCH]
                _, grads = self.gradients(matrix[b], valid[b], target[b])
                step += 1
                norm = np.sqrt(sum((g * g).sum() for g in grads))
                rate = RATE * (1 - (step - 1) / batches)
                for p, g, mi, vi in zip(params, grads, m, v):
                    g = g * min(1.0, 1.0 / (norm + 1e-12))
                    mi += 0.1 * (g - mi)
                    vi += 0.001 * (g * g - vi)
                    p -= (rate * (mi / (1 - 0.9 ** step)) / (np.sqrt(vi / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self

    def documents(self, docs: list[bytes]):
        """Mean probabilities over all bytes of each text (texts x languages)."""
        matrix, valid, doc = windows(docs)
        out = np.zeros((len(docs), len(self.langs)))
        for a in range(0, len(matrix), BATCH):
            b = slice(a, a + BATCH)
            sums = self.label(matrix[b], valid[b])
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(doc[b], sums[k], len(docs))
        return out / np.maximum(np.array([len(d) for d in docs]), 1)[:, None]


def fit_tagger(rows: list[tuple[str, str]]) -> Tagger | None:
    """From (text, lang) pairs: at most WINDOWS_PER_DOC windows of each, evenly spread."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    matrix, valid, doc = windows([t.encode() for t, _ in rows])
    count = np.bincount(doc, minlength=len(rows))
    rank = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    take = np.minimum(count, WINDOWS_PER_DOC)[doc]
    use = (rank * take // count[doc]) != ((rank - 1) * take // count[doc])
    target = np.array([langs.index(lang) for _, lang in rows])[doc]
    return Tagger(langs).fit(matrix[use], valid[use], target[use])


def _predict(model):
    def run(batches):
        import pyarrow as pa

        tagger = model.value
        for batch in batches:
            docs = [t.encode() for t in batch["text"].to_pylist()]
            for a, b in chunks(docs, CHUNK):
                p = tagger.documents(docs[a:b])
                best = p.argmax(1)
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(a, b - a), batch["letters"].slice(a, b - a),
                    pa.array([tagger.langs[i] for i in best]), pa.array(p.max(1)),
                    pa.array(p.tolist(), pa.list_(pa.float64()))], ["doc_id", "letters", "lang", "score", "p"])

    return run


def predict_language(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang", fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, lang_pred, score and langs (language -> probability) of every row. ``learn``: a
    condition on ``doc_id``; the network is trained on rows that meet it and have a language."""
    spark = docs.sparkSession
    t = texts(docs, id_col, text_col)
    known = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                        F.col(f"`{lang_col}`").alias("lang")).where(learn & F.col("lang").isNotNull())
    sample = hash_sample(known.where(F.rlike("text", F.lit("\\p{L}"))).select(
        "doc_id", "lang", _spread_windows(F.col("text")).alias("text")), "doc_id", fit_docs)
    tagger = fit_tagger([(r.text, r.lang) for r in sample.collect()])
    if tagger is None:
        return t.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                        F.lit(None).cast("map<string,double>").alias("langs"))
    kind = t.schema["doc_id"].dataType.simpleString()
    model = spark.sparkContext.broadcast(tagger)  # a few thousand numbers
    out = t.withColumn("letters", F.rlike("text", F.lit("\\p{L}"))).mapInArrow(
        _predict(model), f"doc_id {kind}, letters boolean, lang string, score double, p array<double>")
    names = F.array(*map(F.lit, tagger.langs))
    return out.select("doc_id", F.when(F.col("letters"), F.col("lang")).otherwise(UNKNOWN).alias("lang_pred"),
                      F.when(F.col("letters"), F.least("score", F.lit(1.0))).otherwise(0.0).alias("score"),
                      F.map_from_arrays(names, "p").alias("langs"))


def _spread_windows(text: Column) -> Column:
    """At most WINDOWS_PER_DOC pieces of WINDOW characters, evenly spread over the whole text:
    what the driver gets of a text is bounded."""
    size = F.length(text)
    step = F.greatest(F.lit(WINDOW), F.floor(size / WINDOWS_PER_DOC).cast("int"))
    at = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)), step)
    return F.array_join(F.transform(F.slice(at, 1, WINDOWS_PER_DOC), lambda a: F.substring(text, a + 1, F.lit(WINDOW))), "")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = fold(F.col("doc_id"), 5) != 0
    out = predict_language(table(spark, sf_dir, "documents"), learn)
    return out.select("doc_id", (~learn).alias("held_out"), "lang_pred", "score")
