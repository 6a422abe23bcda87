"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

Kernel. A unit is a word in lower case without anything but its letters;
letters set apart by spaces are one unit, units of more than ``PIECE`` letters are
overlapping pieces. A unit's features are its subsequences of three and four symbols (its
letters, after a mark for its start) that span ``SPANS`` symbols at most, each weighted by
``DECAY`` for every symbol left out; repeats add up. The kernel of two units is the dot
product of their features, divided by the lengths that both would have without repeats. So
"i.d.i.o.t" and "i d i o t" equal "idiot", and "idxiot" stays close to it.

Machine. f(unit) is linear in its kernel values to the landmark units, whitened by the
inverse root of the landmarks' own kernel matrix (Nyström). As it is linear in the unit's
features too, the fitted machine is one table of feature weights: no kernel is evaluated
while scoring. A sentence's value is that of its highest unit, a text's that of its highest
sentence plus a share of the next highest unit (a chance hit comes alone); the share is 0
unless held-back documents speak for more. Platt's sigmoid turns the value into a
probability for the labels' own share of classes.

Fit, on labelled sentences. Sentences take the label of their document. A toxic document's
sentences are not all toxic, so rounds alternate: the highest units of each toxic document
are its witnesses, sentences without one are left out; the machine learns to part witnesses
from the units of clean sentences, the highest of which come in first; then all are valued
anew. The first round takes the log odds of document counts as values.

The fit takes at most ``FIT_DOCS`` documents a label and ``FIT_SENTENCES`` sentences a label
(both by hash; the documented bounds of the fit) to the driver, a fifth of the documents for
the sigmoid. Every text is scored whole.

Only the text enters a score. Defined results: null, empty and letterless texts have the
value 0 kernel values give; ids may be null or repeat; a label that repeats counts once, the
greater if they differ; without labels every score is 0.5, with one class only its share
smoothed by one row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm.common import chunks, fold, hash_sample, table, texts

FIT_DOCS, FIT_SENTENCES = 1_500, 50_000
SENTENCE_WORDS = 64  # longer sentences are cut after so many words
DECAY, SPANS = 0.5, {3: 5, 4: 6}
PIECE, STRIDE = 24, 12
LANDMARKS = 128  # of witnesses, and of clean units
NEGATIVES = 8_000  # clean units by hash, and of the highest values
ROUNDS, PENALTY = 5, 1e-4
WITNESSES = 8  # of a document at most
#: Values from which a document's highest unit, and its next ones, are witnesses. The next
#: ones, and any that a clean document holds, need the first round's log odds in every round.
FIRST, LATER = (np.log(5.0), np.log(40.0)), (-0.5, 0.0)
POOLS = (0.0, 0.25, 0.5, 1.0)  # weights of a text's second highest unit to choose from
THRESHOLD = 0.3
CHUNK = 1_000_000

#: Symbols: 0 nothing, 1 to 26 a to z, then the other letters by their code point modulo
#: OTHERS (which tells the accented letters of one language apart), the start of a unit.
OTHERS = 13
MARK, ALPHABET = 27 + OTHERS, 28 + OTHERS
SPACE, DROPPED = 0, 255
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


@cache
def symbol_table() -> np.ndarray:
    """Code point -> symbol; SPACE ends a unit, DROPPED symbols are passed over."""
    out = np.full(0x110000, DROPPED, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isspace():
            out[c] = SPACE
        elif x.isalpha():
            out[c] = c - 96 if "a" <= x <= "z" else 27 + c % OTHERS
    return out


@cache
def feature_shapes() -> list[tuple[tuple[int, ...], float]]:
    """(offsets of the symbols after the first, weight) of the subsequences of a unit."""
    out = [((a, b), DECAY ** (b - 2)) for b in range(2, SPANS[3]) for a in range(1, b)]
    return out + [((a, b, c), DECAY ** (c - 3)) for c in range(3, SPANS[4]) for b in range(2, c) for a in range(1, b)]


CODES = ALPHABET ** 3 + ALPHABET ** 4


class Units:
    """The distinct units of texts: symbols of all of them in ``flat``, from ``start`` on
    ``size`` symbols each; ``unit`` and ``doc`` say which one occurs in which text."""

    def __init__(self, docs: list[str]):
        lower = [t.lower() for t in docs]
        sizes = np.array([len(t) + 1 for t in lower], np.int64)
        points = np.frombuffer("".join(t + "\n" for t in lower).encode("utf-32-le"), "<u4")
        symbol = symbol_table()[points]
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        used = symbol != DROPPED
        symbol, doc = symbol[used], doc[used]
        letter = symbol != SPACE
        first = letter.copy()
        first[1:] &= ~letter[:-1]  # the first letter of a word
        letters, begin = symbol[letter], np.flatnonzero(first[letter])
        length = np.diff(np.append(begin, len(letters)))
        owner = doc[letter][begin]
        del points, symbol, doc, used, letter, first
        new = np.ones(len(begin), bool)  # single letters in a row are one unit
        new[1:] = ~((length[1:] == 1) & (length[:-1] == 1) & (owner[1:] == owner[:-1]))
        begin, owner = begin[new], owner[new]
        length = np.diff(np.concatenate([begin, [len(letters)]]))
        parts = np.where(length <= PIECE, 1, -(-(length - PIECE) // STRIDE) + 1)
        of = np.repeat(np.arange(len(begin)), parts)
        part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, size = begin[of] + part * STRIDE, np.minimum(PIECE, length[of] - part * STRIDE)
        key = self._hash(letters, begin, size, part == 0)
        _, at, self.unit = np.unique(key, return_index=True, return_inverse=True)
        self.doc = owner[of]
        self.begin, self.letters = begin[at], letters
        self.size = size[at] + 1  # with the mark
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.empty(int(self.size.sum()), np.int32)
        inside = np.arange(len(self.flat)) - np.repeat(self.start, self.size)
        body = inside > 0
        self.flat[~body] = np.where(part[at] == 0, MARK, 0)
        self.flat[body] = letters[(np.repeat(self.begin - 1, self.size) + inside)[body]]

    @staticmethod
    def _hash(letters, begin, size, marked):
        """A 64-bit hash of each piece, the sum of a random number for each (place, symbol)."""
        rng = np.random.default_rng(17)
        numbers = rng.integers(0, 2 ** 64, (PIECE, ALPHABET), np.uint64)
        out = np.where(marked, np.uint64(0x9E3779B97F4A7C15), np.uint64(0)) + size.astype(np.uint64)
        for place in range(min(PIECE, int(size.max(initial=0)))):
            own = np.flatnonzero(size > place)
            out[own] += numbers[place, letters[begin[own] + place]]
        return out

    def __len__(self):
        return len(self.size)

    def features(self):
        """For each shape: (unit numbers, codes, weight) of the features of that shape."""
        unit = np.repeat(np.arange(len(self)), self.size)
        left = np.repeat(self.start + self.size, self.size) - np.arange(len(self.flat))
        for offsets, weight in feature_shapes():
            at = np.flatnonzero(left > offsets[-1])
            code = self.flat[at].astype(np.int64)
            for d in offsets:
                code = code * ALPHABET + self.flat[at + d]
            yield unit[at], code + (ALPHABET ** 3 if len(offsets) == 3 else 0), weight

    def norms(self) -> np.ndarray:
        """The length of each unit's feature vector, were no feature repeated."""
        by_size = np.zeros(PIECE + 2)
        for offsets, weight in feature_shapes():
            by_size += weight ** 2 * np.maximum(np.arange(PIECE + 2) - offsets[-1], 0)
        return np.sqrt(np.maximum(by_size, 1))[self.size]

    def values(self, weights: np.ndarray) -> np.ndarray:
        """The dot product of each unit's features, scaled, with a table of weights."""
        out = np.zeros(len(self))
        for unit, code, weight in self.features():
            out += weight * np.bincount(unit, weights[code], len(self))
        return out / self.norms()

    def text(self, i: int) -> str:
        return "".join(chr(96 + s) if s <= 26 else "*" for s in self.flat[self.start[i] + 1:self.start[i] + self.size[i]])

    def take(self, numbers) -> Units:
        """Some of the units, without their occurrences."""
        out = object.__new__(Units)
        numbers = np.asarray(numbers, np.int64)
        out.size = self.size[numbers]
        out.start = np.cumsum(out.size) - out.size
        place = np.arange(int(out.size.sum())) + np.repeat(self.start[numbers] - out.start, out.size)
        out.flat = self.flat[place]
        return out

    def kernel(self, other: Units) -> np.ndarray:
        """Kernel values, a row a unit, a column a unit of ``other``."""
        theirs = [x for x in other.features()]
        code = np.unique(np.concatenate([c for _, c, _ in theirs])) if theirs else np.zeros(0, np.int64)
        place = np.full(CODES, -1, np.int32)
        place[code] = np.arange(len(code))
        columns = np.zeros((len(code), len(other)), np.float32)
        for unit, c, weight in theirs:
            np.add.at(columns, (place[c], unit), weight)
        found = [(u[hit], p[hit], np.full(int(hit.sum()), weight, np.float32))
                 for u, c, weight in self.features() for p in [place[c]] for hit in [p >= 0]]
        unit, at, weight = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(unit, kind="stable")
        unit, at, weight = unit[order], at[order], weight[order]
        out = np.zeros((len(self), len(other)))
        bound = np.searchsorted(unit, np.arange(0, len(self) + 1000, 1000))
        for a, b in zip(bound[:-1], bound[1:]):
            if a < b:
                begin = np.flatnonzero(np.diff(unit[a:b], prepend=-1))
                out[unit[a:b][begin]] = np.add.reduceat(columns[at[a:b]] * weight[a:b, None], begin)
        return out / self.norms()[:, None] / other.norms()


def highest(units: Units, values: np.ndarray, docs: int) -> np.ndarray:
    """The greatest value of each text's units and the next one, of another occurrence; 0
    for each that is missing. Occurrences come in the order of the texts."""
    out, v = np.zeros((docs, 2)), values[units.unit]
    begin = np.flatnonzero(np.diff(units.doc, prepend=-1))
    if len(begin):
        own = units.doc[begin]
        out[own, 0] = np.maximum.reduceat(v, begin)
        top = np.flatnonzero(v == out[units.doc, 0])
        v[top[np.unique(units.doc[top], return_index=True)[1]]] = -np.inf
        second = np.maximum.reduceat(v, begin)
        out[own, 1] = np.where(np.isinf(second), 0.0, second)
    return out


def support_vectors(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights and, last, the bias of least squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], PENALTY)
    ridge[-1] = 1e-9
    for _ in range(20):
        inside = y * (x @ w) < 1
        a = x[inside] * weight[inside, None]
        new = np.linalg.solve(a.T @ x[inside] + np.diag(ridge), a.T @ y[inside])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


def sigmoid_fit(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's (slope, offset), with his smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.stack([f, np.ones(len(f))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (t - p) - 1e-6 * w)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
    return float(w[0]), float(w[1])


class Machine:
    """A table of feature weights, a bias and a sigmoid."""

    def __init__(self, sentences: list[str], doc: np.ndarray, label: np.ndarray, back: np.ndarray, share: float):
        """``doc`` numbers each sentence's document, ``label`` (0, 1) and ``back`` (kept for the
        sigmoid) belong to documents; ``share`` is that of label 1 among all labelled ones."""
        units = Units(sentences)
        number = {}
        part = np.array([number.setdefault(s, len(number)) for s in sentences], np.int32)[units.doc]
        units.doc = doc[units.doc]
        self._learn(units, part, label, ~back)
        f = highest(units, units.values(self.table), len(label)) + self.bias
        use = back if len(set(label[back])) == 2 else ~back
        y, self.pool, self.slope, self.offset, least = label[use], 0.0, 0.0, 0.0, np.inf
        for pool in POOLS:
            slope, offset = sigmoid_fit(f[use] @ [1, pool], y)
            loss = np.logaddexp(0, np.where(y == 1, -1, 1) * (slope * (f[use] @ [1, pool]) + offset)).mean()
            if loss < 0.9 * least:
                self.pool, self.slope, self.offset, least = pool, slope, offset, loss
        odds = lambda p: np.log(p / (1 - p))
        self.offset += odds(share) - odds(y.mean())

    def _learn(self, units, part, label, use):
        """``part`` numbers the sentence of each unit's occurrence, equal ones alike, so that
        copies of a document count once."""
        pair = np.unique(np.stack([units.doc, units.unit], 1)[use[units.doc]], axis=0)
        toxic = label[pair[:, 0]] == 1
        count = [np.bincount(pair[toxic == k, 1], minlength=len(units)) for k in (False, True)]
        n = [int((label[use] == k).sum()) for k in (0, 1)]
        once = np.unique(np.stack([part, units.unit], 1)[use[units.doc] & (label[units.doc] == 1)], axis=0)
        count[1] = np.minimum(count[1], np.bincount(once[:, 1], minlength=len(units)))
        value = odds = np.log((count[1] + 0.5) / (n[1] + 1)) - np.log((count[0] + 0.5) / (n[0] + 1))
        clean = np.flatnonzero(count[0] > 0)
        some = np.random.default_rng(5).permutation(clean)[:NEGATIVES]
        able = (count[0] == 0) | (odds >= FIRST[1])  # to be a witness
        self.table, self.bias = np.zeros(CODES, np.float32), 0.0
        doc, unit = pair[toxic & able[pair[:, 1]]].T
        floor, sure = FIRST
        for _ in range(ROUNDS):
            order = np.lexsort((unit, -value[unit], doc))
            head = np.flatnonzero(np.diff(doc[order], prepend=-1))
            rank = np.arange(len(order)) - np.repeat(head, np.diff(np.concatenate([head, [len(order)]])))
            high = value[unit[order]]
            chosen = (rank == 0) & (high >= floor) | (rank < WITNESSES) & (high >= sure) & (odds[unit[order]] >= FIRST[1])
            if not chosen.any():
                chosen = rank == 0  # too few rows for any evidence
            if not len(chosen):
                break  # no unit tells the classes apart
            witness, votes = np.unique(unit[order][chosen], return_counts=True)
            hard = clean[np.argsort(-value[clean], kind="stable")[:NEGATIVES]]
            against = np.setdiff1d(np.union1d(some, hard), np.flatnonzero(able))
            by_votes = witness[np.argsort(-votes, kind="stable")[:LANDMARKS]]
            marks = units.take(np.concatenate([by_votes, hard[:LANDMARKS // 2], some[:LANDMARKS // 2]]))
            e, v = np.linalg.eigh(marks.kernel(marks))
            keep = e > 1e-8 * e[-1]
            root = v[:, keep] / np.sqrt(e[keep])
            rows = units.take(np.concatenate([witness, against]))
            y = np.where(np.arange(len(rows)) < len(witness), 1.0, -1.0)
            weight = np.concatenate([(1 + np.log(votes)) / (1 + np.log(votes)).sum(), np.full(len(against), 4 / max(len(against), 1))])
            w = support_vectors(rows.kernel(marks) @ root, y, weight)
            self.table, self.bias = np.zeros(CODES, np.float32), float(w[-1])
            alpha = root @ w[:-1] / marks.norms()
            for number, code, size in marks.features():
                np.add.at(self.table, code, size * alpha[number])
            value = units.values(self.table) + self.bias
            floor, sure = LATER

    def __call__(self, docs: list[str]) -> np.ndarray:
        units = Units(docs)
        f = (highest(units, units.values(self.table), len(docs)) + self.bias) @ [1, self.pool]
        return 1 / (1 + np.exp(-np.clip(self.slope * f + self.offset, -30, 30)))


class Constant:
    def __init__(self, share: float):
        self.share = share

    def __call__(self, docs):
        return np.full(len(docs), self.share)


def _sentences(batches):
    import pyarrow as pa

    for batch in batches:
        doc, label, out = [], [], []
        for i, y, t in zip(*(batch[c].to_pylist() for c in ("doc", "label", "text"))):
            for s in SENTENCE.split(t):
                words = s.split()
                for a in range(0, len(words), SENTENCE_WORDS):
                    doc.append(i)
                    label.append(y)
                    out.append(" ".join(words[a:a + SENTENCE_WORDS]))
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(label, pa.int32()), pa.array(out, pa.string())],
                                         ["doc", "label", "sentence"])


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_sentences: int = FIT_SENTENCES):
    """A machine, or a constant if a class is missing. ``docs``: (doc_id, text); ``labels``:
    (doc_id, label 0/1)."""
    known = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    n = {r.label: r.n for r in known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
         .groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 + n1:
        return Constant(0.5)
    if not n0 or not n1:
        return Constant((n1 + 1) / (n0 + n1 + 2))
    rows = []
    for y in (0, 1):
        chosen = hash_sample(known.where(F.col("label") == y), "doc_id", fit_docs)  # two numbers a row
        own = docs.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id").alias("doc"), "label", "text")
        split = own.mapInArrow(_sentences, "doc bigint, label int, sentence string").withColumn("key", F.xxhash64("doc", "sentence"))
        rows.append(hash_sample(split, "key", fit_sentences).drop("key").toPandas())
    import pandas as pd

    sample = pd.concat(rows).sort_values(["doc", "sentence"], kind="stable", ignore_index=True)
    ids, number = np.unique(sample["doc"].to_numpy(np.int64), return_inverse=True)
    label = np.zeros(len(ids), np.int64)
    label[number] = sample["label"].to_numpy(np.int64)
    if label.min(initial=1) == label.max(initial=0):  # one class has no words at all
        return Constant((n1 + 1) / (n0 + n1 + 2))
    back = ids % 5 == 4
    if len(set(label[~back])) < 2:
        back[:] = False
    return Machine(sample["sentence"].tolist(), number, label, back, n1 / (n0 + n1))


def _score(model):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            docs = batch["text"].to_pylist()
            for a, b in chunks(docs, CHUNK):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(model.value(docs[a:b]), pa.float64())],
                                                 ["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    fit_docs: int = FIT_DOCS, fit_sentences: int = FIT_SENTENCES) -> DataFrame:
    """doc_id, score and predicted for every row; ``labels``: (doc_id, label 0/1) to learn from."""
    t = texts(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit(t, labels, fit_docs, fit_sentences))
    kind = t.schema["doc_id"].dataType.simpleString()
    return t.mapInArrow(_score(model), f"doc_id {kind}, score double").withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 4) == 2
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("label"))
    scores = toxicity_scores(table(spark, sf_dir, "documents"), labels)
    return scores.select("doc_id", held_out.alias("held_out"), "score", "predicted")
