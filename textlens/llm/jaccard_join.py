"""N-gram Jaccard join: a MinHash LSH forest with exact verification.

Shingles are runs of ``WORDS`` words (a shorter text has one shingle, all its words); two
texts link if the Jaccard similarity of their shingle sets is at least ``threshold``.

1. One pass over the texts computes for each row a 128-bit fingerprint of its shingle set
   and a MinHash signature. Rows of equal sets are one class: copies meet once, in a
   partially aggregated count, and never again.
2. The forest has ``TREES`` tries; in each a class is placed by a prefix of its part of the
   signature. The prefix is shortened from ``DEPTH`` values until a pair at the threshold
   meets in some tree with probability ``RECALL`` (``prefix_depth``). Classes that share a
   node of a trie are compared by their signatures; pairs that may reach the threshold
   (``SIGMAS`` standard errors below it) give a spanning forest of each node.
3. The forests' components are the groups to verify. Each class's text is read once more,
   and all pairs of a component are verified on exact shingle sets. Components and nodes
   over ``CHUNK`` members are cut into chunks, and each task compares two chunks, so no
   task holds a large group; a task returns link counts and a spanning forest of the exact
   links, never the pairs.
4. The recall reached is estimated from the exact similarities of the links (each link
   stands for 1 / P(found) links); below ``RECALL`` the prefix is shortened by one more
   value and the steps from 2 on are repeated.
5. Components of the exact links are the near-duplicate classes.

Defined results: a null text is empty; texts without a word are copies of one another and
link with nothing else; rows that repeat an id and its text are copies; a row without an
id cannot be named by a link: its class is null and it has no links; an empty table gives
no rows; other columns are ignored. Ids are integers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm.common import chunks, small_side, table, texts
from textlens.operators.groups import connected, shared_counts, spanning_forest
from textlens.session import materialize

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH = 24, 5
RECALL, SIGMAS = 0.999, 4.5
CHUNK = 1024
GROUP_ROWS = 4096  # rows that a task of small groups gets on average
TEXT_CHUNK = 2_000_000
KNOWN = 200_000
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h):
    """A bijection of 64-bit integers that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(dict):
    """Word -> 64-bit hash; remembers up to KNOWN words."""

    def __missing__(self, word):
        import xxhash

        if len(self) > KNOWN:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_sets(docs: list[str], words: Words, n: int = WORDS):
    """(sorted distinct shingle hashes of all texts, one after another; number of each)."""
    lists = [t.encode().split() for t in docs]
    sizes = np.array([len(w) for w in lists], np.int64)
    flat = np.array([words[w] for ws in lists for w in ws], np.uint64)
    short = sizes < n
    count = np.where(short, np.minimum(sizes, 1), sizes - n + 1)
    doc = np.repeat(np.arange(len(docs)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.cumsum(sizes) - sizes, count)
    h = np.minimum(sizes, n)[doc].astype(np.uint64)
    for k in range(n):
        inside = k < sizes[doc]
        word = flat[np.minimum(at + k, len(flat) - 1)] if len(flat) else flat
        h = np.where(inside, _mix(h * _P + word), h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(docs))


def signatures(h, count, size: int):
    """(texts x size) MinHash values of shingle sets; empty sets have none (all zero)."""
    rng = np.random.default_rng(1_234)
    a = rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    out = np.zeros((len(count), size), np.uint32)
    full = np.flatnonzero(count)
    if len(full):
        start = (np.cumsum(count) - count)[full]
        for i in range(size):
            out[full, i] = np.minimum.reduceat(((h * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32), start)
    return out


def fingerprints(h, count):
    """128 bits of each shingle set, as bytes."""
    full = np.flatnonzero(count)
    key = np.zeros((len(count), 2), np.uint64)
    if len(full):
        start = (np.cumsum(count) - count)[full]
        key[full, 0] = np.add.reduceat(_mix(h), start)
        key[full, 1] = _mix(np.add.reduceat(_mix(h ^ _P), start) + count[full].astype(np.uint64))
    return [r.tobytes() for r in key]


def prefix_depth(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The prefix length, shortened from ``depth`` until a pair at the threshold shares a node
    with probability ``recall``."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def _sign(batches):
    import pyarrow as pa

    words = Words()
    for batch in batches:
        docs = batch["text"].to_pylist()
        for a, b in chunks(docs, TEXT_CHUNK):
            h, count = shingle_sets(docs[a:b], words)
            sig = signatures(h, count, TREES * DEPTH)
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"].slice(a, b - a), pa.array(fingerprints(h, count), pa.binary()),
                pa.array(count, pa.int32()), pa.array([r.tobytes() for r in sig], pa.binary())],
                ["doc_id", "cid", "n", "sig"])


def _groups(*columns):
    """Slices of equal rows in (already sorted) columns."""
    n = len(columns[0])
    if not n:
        return []
    edge = np.ones(n, bool)
    edge[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    starts = np.flatnonzero(edge)
    return list(zip(starts, [*starts[1:], n]))


def _node_links(least: float):
    """Rows of nodes -> a spanning forest of each node's pairs of similar signatures."""
    def run(t):
        import pyarrow as pa

        t = t.sort_by([("node", "ascending"), ("low", "ascending"), ("high", "ascending"), ("chunk", "ascending")])
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(len(t), -1)
        low, high, chunk = (t[c].to_numpy() for c in ("low", "high", "chunk"))
        need = int(np.ceil(least * sig.shape[1]))
        links = []
        for a, b in _groups(t["node"].to_numpy(), low, high):
            first = np.flatnonzero(chunk[a:b] == low[a]) + a
            second = first if low[a] == high[a] else np.flatnonzero(chunk[a:b] == high[a]) + a
            pairs = []
            for i in range(0, len(first), 64):  # 64 rows against the chunk at a time
                same = (sig[first[i:i + 64], None] == sig[None, second]).sum(2) >= need
                x, y = np.nonzero(same)
                pairs += [(u, v) for u, v in zip(first[i + x], second[y]) if low[a] != high[a] or u < v]
            links += spanning_forest(*zip(*pairs)) if pairs else []
        ids = t["cid"]
        return pa.table({k: ids.take(pa.array([link[i] for link in links], pa.int64())) for i, k in enumerate("ab")})

    return run


def _read_sets(batches):
    """(doc_id, text, cid, ...) -> the shingle set of each row whose text has the fingerprint."""
    import pyarrow as pa

    words = Words()
    for batch in batches:
        docs, cids = batch["text"].to_pylist(), batch["cid"].to_pylist()
        for a, b in chunks(docs, TEXT_CHUNK):
            h, count = shingle_sets(docs[a:b], words)
            ends = np.cumsum(count)
            good = [i for i, c in enumerate(fingerprints(h, count)) if c == cids[a + i]]
            part = batch.slice(a, b - a).take(pa.array(good, pa.int64()))
            sets = [h[ends[i] - count[i]:ends[i]].tobytes() for i in good]
            yield pa.RecordBatch.from_arrays([part["cid"], part["root"], part["copies"], part["cut"],
                                              pa.array(sets, pa.binary())], ["cid", "root", "copies", "cut", "shingles"])


def _verify(threshold: float, depth: int):
    """Rows of components -> link counts, forest links and the recall's two sums."""
    def run(t):
        import pyarrow as pa

        t = t.sort_by([(c, "ascending") for c in ("root", "low", "high", "chunk", "cid")])
        cid, copies = t["cid"].to_pylist(), t["copies"].to_numpy()
        low, high, chunk = (t[c].to_numpy() for c in ("low", "high", "chunk"))
        sets = [np.frombuffer(s, np.uint64) for s in t["shingles"].to_pylist()]
        size = np.array([len(s) for s in sets], np.int64)
        weight, links, found, expected = np.zeros(len(cid), np.int64), [], 0, 0.0
        root = np.array(t["root"].to_pylist(), object)
        repeated = np.array([i > 0 and cid[i] == cid[i - 1] and low[i] == low[i - 1] and high[i] == high[i - 1]
                             for i in range(len(cid))], bool)  # rows that repeat an id and its text
        for a, b in _groups(root, low, high):
            first = np.flatnonzero((chunk[a:b] == low[a]) & ~repeated[a:b]) + a
            second = first if low[a] == high[a] else np.flatnonzero((chunk[a:b] == high[a]) & ~repeated[a:b]) + a
            if not len(first) or not len(second):
                continue
            both = shared_counts(sets, first, second)
            union = size[first][:, None] + size[second][None] - both
            hit = both >= threshold * union - 1e-9
            if low[a] == high[a]:
                hit = np.triu(hit, 1)
            i, j = np.nonzero(hit)
            p = 1 - (1 - (both[i, j] / union[i, j]) ** depth) ** TREES
            found, expected = found + len(p), expected + float((1 / p).sum())
            i, j = first[i], second[j]
            np.add.at(weight, i, copies[j])
            np.add.at(weight, j, copies[i])
            links += spanning_forest(i, j)
        # forest links as rows (cid, other); counts as rows (cid, null); the sums as one row
        return pa.table({
            "cid": pa.array([*cid, *(cid[i] for i, _ in links), None], pa.binary()),
            "other": pa.array([None] * len(cid) + [cid[j] for _, j in links] + [None], pa.binary()),
            "links": pa.array([*weight, *[0] * len(links), found], pa.int64()),
            "expected": pa.array([None] * (len(cid) + len(links)) + [expected], pa.float64())})

    return run


def _chunked(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """Deals members (cid, cut) of ``key`` groups out: each pair of chunks (low, high) of a cut
    group is a task's, groups of one chunk go to ``buckets`` tasks together."""
    dealt = (rows.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("cut")).cast("int"))
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
             .withColumn("low", F.least("chunk", "with")).withColumn("high", F.greatest("chunk", "with")).drop("with"))
    one = F.pmod(F.xxhash64(key), F.lit(buckets))
    return dealt.withColumn("task", F.when(F.col("cut") > 1, F.xxhash64(key, "low", "high")).otherwise(one))


def _cut(n: Column) -> Column:
    return F.ceil(n / CHUNK).cast("int")


def _links(classes: DataFrame, rows: DataFrame, threshold: float, depth: int) -> DataFrame:
    """(cid, other, links, expected) of all exact links at this prefix length."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    keyed = classes.where("n > 0").select("cid", "sig", tree.alias("tree")).select("cid", F.xxhash64(
        "tree", F.expr(f"substring(sig, tree * {4 * DEPTH} + 1, {4 * depth})")).alias("node"))
    nodes = keyed.groupBy("node").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("node", _cut(F.col("m")).alias("cut"))
    members = materialize(keyed.join(nodes, "node"))
    buckets = max(1, members.count() // GROUP_ROWS)
    least = threshold - SIGMAS * np.sqrt(threshold * (1 - threshold) / (TREES * DEPTH))
    pairs = (_chunked(members.join(classes.select("cid", "sig"), "cid"), "node", buckets)
             .groupBy("task").applyInArrow(_node_links(least), "a binary, b binary"))
    roots = connected(pairs)
    sizes = roots.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("m"))
    active = (roots.select("root", F.col("id").alias("cid")).union(sizes.select("root", F.col("root").alias("cid")))
              .join(sizes.select("root", _cut(F.col("m")).alias("cut")), "root")
              .join(classes.select("cid", "copies", "min_id"), "cid"))
    active = materialize(active.select(F.col("min_id").alias("doc_id"), "cid", "root", "copies", "cut"))
    sets = rows.join(small_side(active), "doc_id").select("text", "cid", "root", "copies", "cut").mapInArrow(
        _read_sets, "cid binary, root binary, copies long, cut int, shingles binary")
    buckets = max(1, active.count() * 8 // GROUP_ROWS)
    return materialize(_chunked(sets, "root", buckets).groupBy("task").applyInArrow(
        _verify(threshold, depth), "cid binary, other binary, links long, expected double"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    recall: float = RECALL, audit: dict | None = None) -> DataFrame:
    """doc_id, class_id (the least id reachable by links), n_links (other rows linked
    directly, copies included), copy_id (the least id of an equal shingle set) and kept
    (doc_id = class_id) of every row. ``audit`` receives the estimated recall and the depth."""
    t = texts(docs, id_col, text_col)
    rows = t.where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = materialize(rows.mapInArrow(_sign, "doc_id long, cid binary, n int, sig binary"))
    classes = materialize(signed.groupBy("cid").agg(
        F.min("doc_id").alias("min_id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("sig").alias("sig")))
    depth = prefix_depth(threshold, recall)
    while True:
        found = _links(classes, rows, threshold, depth)
        got, expected = found.agg(F.sum(F.when(F.col("expected").isNotNull(), F.col("links"))), F.sum("expected")).first()
        reached = got / expected if expected else 1.0
        if audit is not None:
            audit |= {"recall": reached, "depth": depth}
        if reached >= recall or depth == 1:
            break
        depth -= 1
    counts = found.where("cid IS NOT NULL AND other IS NULL").groupBy("cid").agg(F.sum("links").alias("links"))
    roots = connected(found.where("other IS NOT NULL").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    own = (classes.select("cid", "min_id", "copies").join(counts, "cid", "left")
           .join(roots.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    least = own.groupBy("root").agg(F.min("min_id").alias("class_id"))
    decided = own.join(least, "root").select("cid", "class_id", F.col("min_id").alias("copy_id"), (
        F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = signed.select("doc_id", "cid").join(decided, "cid").select(
        "doc_id", "class_id", "n_links", "copy_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    nameless = t.where("doc_id IS NULL").select(
        F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(True))
    return out.union(nameless)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
