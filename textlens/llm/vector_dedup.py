"""Embedding near-duplicates on a robust-pruned flat graph.

1. Vectors that can link (no null, zero or non-finite component) collapse to one
   representative for each distinct vector; copies never meet again.
2. At most ``FIT_ROWS`` representatives, taken by hash, fit the cluster centres (spherical
   k-means, on the driver; the documented bound of the fit). Every representative joins
   the ``overlap`` nearest clusters, so neighbouring shards overlap. A cluster over
   ``CHUNK`` members is cut into chunks by hash.
3. Build: each chunk's graph links a vector to candidates that robust pruning (``ALPHA``)
   leaves, at most ``DEGREE``; a vector's adjacency lists from all its shards are united.
4. Search: in each shard every vector is a query. A greedy search starts at the medoid,
   expands the best ``BEAM`` vectors and then every vector in range, until none is left
   unexpanded. In a cut cluster each pair of chunks searches each other's graphs, so no
   task holds more than two chunks. Pairs found are verified in double precision; of the
   shards that a pair shares only the first counts it.
5. Each task returns link counts and a spanning forest of its links, never the pairs. The
   forests give the components.
6. Audit: the links of ``AUDIT_ROWS`` vectors, taken by hash, are counted by brute force
   against all vectors; a sample with fewer than ``AUDIT_LINKED`` linked vectors grows up to
   ``AUDIT_MOST``. Recall is the mean over the linked ones of the share of their links that
   the search found, so a large group counts no more than its vectors. Below the target the
   search is made again with one more shard a vector, and after ``MAX_OVERLAP`` exactly:
   every vector then goes to each shard whose centre is at most twice the linking distance
   farther than its own, which holds all its partners at home, and is compared with them.

Vectors of different length never link. Defined results: rows that repeat both id and
vector are one vector; rows of one id with different vectors are vectors of their own, with
links of their own; an id may be null; a vector that cannot link is its own component; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm.common import hash_sample, table
from textlens.operators.groups import connected, spanning_forest
from textlens.session import materialize

THRESHOLD = 0.95
FIT_ROWS, SHARD, MAX_CENTRES = 4096, 400, 1024
OVERLAP, MAX_OVERLAP = 3, 6
CHUNK, DEGREE, CANDIDATES, ALPHA = 1024, 16, 32, 1.2
GUESTS = 4096  # vectors that a task of the exact comparison holds beside a chunk
BEAM, EXPAND, SLACK = 16, 4, 0.02
AUDIT_ROWS, AUDIT_LINKED, AUDIT_MOST, RECALL = 256, 64, 4096, 0.97


def unit_rows(column) -> np.ndarray:
    """A list column of one vector length as unit rows in double precision."""
    flat = column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten()
    x = np.asarray(flat, np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from the first k rows (they come in hash order)."""
    c = x[:k].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(k):
            if (near == j).any():
                c[j] = x[near == j].sum(0)
                c[j] /= max(np.linalg.norm(c[j]), 1e-12)
    return c


def prune(x: np.ndarray) -> np.ndarray:
    """Adjacency (rows x DEGREE, -1: none) by robust pruning of the nearest candidates and a
    few fixed far ones: a candidate goes if a kept one is ALPHA times nearer to it."""
    n = len(x)
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    c = min(CANDIDATES, n - 1)
    if c < 1:
        return np.full((n, DEGREE), -1)
    cand = np.argpartition(-sims, c - 1, axis=1)[:, :c]
    far = (np.arange(n)[:, None] + np.array([1, n // 3 + 1, n // 2 + 1, 2 * n // 3 + 1])) % n
    cand = np.concatenate([cand, far], axis=1)
    s = np.take_along_axis(sims, cand, 1)
    order = np.argsort(-s, axis=1, kind="stable")
    cand, s = np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1)
    far_from = np.sqrt(np.maximum(2 - 2 * s, 0))  # distance to the row's own vector
    alive, kept = np.isfinite(s), np.zeros(s.shape, bool)
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    for j in range(cand.shape[1]):
        take = alive[:, j] & (kept.sum(1) < DEGREE)
        kept[:, j] = take
        between = np.sqrt(np.maximum(2 - 2 * sims[cand[:, j][:, None], cand], 0))
        alive &= ~(take[:, None] & (ALPHA * between <= far_from))
    out = np.full((n, DEGREE), -1)
    rows, cols = np.nonzero(kept)
    out[rows, (np.cumsum(kept, 1) - 1)[rows, cols]] = cand[rows, cols]
    return out


def range_search(q: np.ndarray, x: np.ndarray, adjacency: np.ndarray, threshold: float) -> np.ndarray:
    """(queries x rows) booleans: what the greedy search from the medoid finds in range."""
    n = len(x)
    q32, x32 = q.astype(np.float32), x.astype(np.float32)
    start = int((x @ x.mean(0)).argmax())
    sims = np.full((len(q), n), -np.inf, np.float32)
    sims[:, start] = q32 @ x32[start]
    expanded = np.zeros(sims.shape, bool)
    active = np.arange(len(q))
    width = min(EXPAND, n)
    while len(active):
        seen = sims[active]
        floor = np.partition(seen, n - BEAM, axis=1)[:, n - BEAM] if n > BEAM else np.full(len(active), -np.inf)
        seen[expanded[active]] = -np.inf
        best = np.argpartition(-seen, width - 1, axis=1)[:, :width]
        value = np.take_along_axis(seen, best, 1)
        go = np.isfinite(value) & ((value >= floor[:, None]) | (value >= threshold - SLACK))
        row, col = np.nonzero(go)
        if not len(row):
            break
        query, node = active[row], best[row, col]
        expanded[query, node] = True
        near = adjacency[node]
        i, j = np.nonzero(near >= 0)
        query, node = query[i], near[i, j]
        new = ~np.isfinite(sims[query, node])
        query, node = query[new], node[new]
        sims[query, node] = np.einsum("ij,ij->i", q32[query], x32[node])
        active = active[np.unique(row)]
    return sims >= threshold - 1e-4


def _adjacency(lists, index: dict[int, int]) -> np.ndarray:
    """United lists of row ids as a padded matrix of the rows present here."""
    rows = [[index[v] for v in (ids or ()) if v in index] for ids in lists]
    out = np.full((len(rows), max(1, max(map(len, rows), default=1))), -1)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _build(t):
    import pyarrow as pa

    t = t.sort_by("rep")  # the far candidates depend on the order
    ids = t["rep"].to_numpy()
    near = prune(unit_rows(t["vec"]))
    return pa.table({"rep": t["rep"], "near": pa.array([ids[r[r >= 0]].tolist() for r in near], pa.list_(pa.int64()))})


def _search(threshold):
    def run(t):
        import pyarrow as pa

        t = t.sort_by([("chunk", "ascending"), ("rep", "ascending")])
        ids, copies, chunk = t["rep"].to_numpy(), t["copies"].to_numpy(), t["chunk"].to_numpy()
        x, shards, near, own = unit_rows(t["vec"]), t["shards"].to_pylist(), t["near"].to_pylist(), t["shard"][0].as_py()
        parts = [np.flatnonzero(chunk == c) for c in np.unique(chunk)]
        low, high = t["low"][0].as_py(), t["high"][0].as_py()
        a, b = parts[0], parts[-1]
        if low != high and len(parts) < 2:
            a = b = np.zeros(0, np.int64)  # the other chunk is empty
        links, weight = [], np.zeros(len(ids), np.int64)
        if len(a):
            def found(q, r):
                graph = _adjacency([near[i] for i in r], {int(ids[i]): k for k, i in enumerate(r)})
                return range_search(x[q], x[r], graph, threshold)

            hit = found(a, b)
            hit = (hit | hit.T) if low == high else (hit | found(b, a).T)
            i, j = np.nonzero(hit)
            if low == high:
                i, j = i[i < j], j[i < j]
            i, j = a[i], b[j]
            good = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            i, j = i[good], j[good]
            first = np.array([min(set(shards[p]) & set(shards[r])) == own for p, r in zip(i, j)], bool)
            i, j = i[first], j[first]
            np.add.at(weight, i, copies[j])
            np.add.at(weight, j, copies[i])
            links = spanning_forest(i, j)
        return pa.table({
            "rep": pa.array([*ids, *(ids[i] for i, _ in links)], pa.int64()),
            "other": pa.array([None] * len(ids) + [ids[j] for _, j in links], pa.int64()),
            "links": pa.array([*weight, *[0] * len(links)], pa.int64())})

    return run


def _assign(centres, overlap):
    """Batches of vectors -> their nearest centres (of the same length), nearest first."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            t = pa.Table.from_batches([batch])
            dims = t["dim"].to_numpy()
            out = [None] * len(dims)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                c = centres.value.get(int(dim))
                if c is None:  # no vector of this length in the sample
                    near = np.zeros((len(rows), 1), np.int64)
                else:
                    sims = unit_rows(t["vec"].take(pa.array(rows))) @ c.T
                    near = np.argsort(-sims, axis=1, kind="stable")[:, :overlap]
                for r, s in zip(rows, near.tolist()):
                    out[r] = s
            yield pa.RecordBatch.from_arrays([batch["rep"], batch["copies"], batch["dim"], batch["vec"],
                                              pa.array(out, pa.list_(pa.int32()))],
                                             ["rep", "copies", "dim", "vec", "shards"])

    return run


def _searched(reps: DataFrame, centres, overlap: int, threshold: float) -> DataFrame:
    """Rows (rep, other, links): partial link counts and forest links of every task."""
    placed = reps.mapInArrow(_assign(centres, overlap),
                             "rep long, copies long, dim int, vec array<double>, shards array<int>")
    members = placed.withColumn("shard", F.explode("shards"))
    sizes = members.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("cut"))
    members = materialize(members.join(F.broadcast(sizes), ["dim", "shard"]).withColumn(
        "chunk", F.pmod(F.xxhash64("rep"), F.col("cut")).cast("int")))  # sizes: MAX_CENTRES rows a vector length
    graph = (members.groupBy("dim", "shard", "chunk").applyInArrow(_build, "rep long, near array<long>")
             .groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    met = (members.join(graph, "rep").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
           .withColumn("low", F.least("chunk", "with")).withColumn("high", F.greatest("chunk", "with")))
    return materialize(met.groupBy("dim", "shard", "low", "high").applyInArrow(
        _search(threshold), "rep long, other long, links long"))


def _exact(reps: DataFrame, centres, threshold: float) -> DataFrame:
    """Rows like those of ``_searched``, by comparing every vector with those at home in the
    shards that can hold a partner. A pair is counted where the greater of the two is at home."""
    reach = 2 * np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            t = pa.Table.from_batches([batch])
            dims, out = t["dim"].to_numpy(), [None] * len(t)
            for dim in np.unique(dims):
                rows, c = np.flatnonzero(dims == dim), centres.value.get(int(dim))
                far = np.zeros((len(rows), 1)) if c is None else np.sqrt(np.maximum(
                    2 - 2 * np.clip(unit_rows(t["vec"].take(pa.array(rows))) @ c.T, -1, 1), 0))
                for r, f in zip(rows, far):
                    home = int(f.argmin())
                    out[r] = [home, *np.flatnonzero((f <= f[home] + reach) & (np.arange(len(f)) != home)).tolist()]
            yield pa.RecordBatch.from_arrays([batch["rep"], batch["copies"], batch["dim"], batch["vec"], pa.array(out, pa.list_(pa.int32()))],
                                             ["rep", "copies", "dim", "vec", "shards"])

    placed = materialize(reps.mapInArrow(place, "rep long, copies long, dim int, vec array<double>, shards array<int>"))
    at_home = placed.select("rep", "copies", "dim", "vec", F.get("shards", F.lit(0)).alias("shard"))
    sizes = at_home.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("cut"))  # a row a centre
    cut = F.broadcast(sizes)
    home = at_home.join(cut, ["dim", "shard"]).select(
        "rep", "copies", "dim", "vec", "shard", F.pmod(F.xxhash64("rep"), F.col("cut")).cast("int").alias("chunk"), F.lit(True).alias("home"))
    visits = placed.select("rep", "copies", "dim", "vec", F.explode("shards").alias("shard"))
    slots = visits.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / GUESTS).cast("int").alias("slots")).join(sizes, ["dim", "shard"])
    slots = F.broadcast(materialize(slots))  # a row a centre
    guests = visits.join(slots, ["dim", "shard"]).select(
        "rep", "copies", "dim", "vec", "shard", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("chunk"), F.lit(False).alias("home"),
        F.pmod(F.xxhash64("rep", F.lit(1)), F.col("slots")).cast("int").alias("slot"))
    hosts = home.join(slots.drop("cut"), ["dim", "shard"]).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")

    def compare(t):
        import pyarrow as pa

        t = t.sort_by("rep")
        ids, copies, home, x = t["rep"].to_numpy(), t["copies"].to_numpy(), t["home"].to_numpy(zero_copy_only=False), unit_rows(t["vec"])
        hosts, guests = np.flatnonzero(home), np.flatnonzero(~home)
        weight, links = np.zeros(len(ids), np.int64), []
        for a in range(0, len(guests), CHUNK):
            g = guests[a:a + CHUNK]
            i, j = np.nonzero((x[g] @ x[hosts].T >= threshold) & (ids[g][:, None] < ids[hosts]))
            i, j = g[i], hosts[j]
            np.add.at(weight, i, copies[j])
            np.add.at(weight, j, copies[i])
            links += spanning_forest(i, j)
        return pa.table({"rep": pa.array([*ids, *(ids[i] for i, _ in links)], pa.int64()),
                         "other": pa.array([None] * len(ids) + [ids[j] for _, j in links], pa.int64()),
                         "links": pa.array([*weight, *[0] * len(links)], pa.int64())})

    return materialize(hosts.unionByName(guests).groupBy("dim", "shard", "chunk", "slot").applyInArrow(
        compare, "rep long, other long, links long"))


def _true_links(reps: DataFrame, sample: DataFrame, threshold: float) -> DataFrame:
    """(rep, n): exact number of linked other vectors (with copies) of the sampled ones."""
    import pyarrow as pa

    rows = sample.select("rep", "dim", "vec").toArrow()  # AUDIT_ROWS vectors
    known = {int(d): (rows.filter(pa.array(rows["dim"].to_numpy() == d))["rep"].to_numpy(),
                      unit_rows(rows.filter(pa.array(rows["dim"].to_numpy() == d))["vec"]))
             for d in np.unique(rows["dim"].to_numpy())}
    sent = reps.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            out = {}
            for d, (ids, x) in sent.value.items():
                part = t.filter(pa.array(t["dim"].to_numpy() == d))
                if len(part):
                    hit = (x @ unit_rows(part["vec"]).T >= threshold) & (ids[:, None] != part["rep"].to_numpy())
                    for i, n in zip(ids, hit @ part["copies"].to_numpy()):
                        out[int(i)] = int(n)
            yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.int64()), pa.array(out.values(), pa.int64())],
                                             ["rep", "n"])

    return reps.mapInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                 overlap: int = OVERLAP, recall: float = RECALL, audit: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector. ``audit`` receives the last
    audited recall and the overlap."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec")).distinct()
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = F.col("vec").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda c: c != 0)
    v = materialize(v.withColumn("usable", F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False))))
    key = F.xxhash64("vec")  # of the vector, as an id may have several
    reps = materialize(v.where("usable").groupBy("vec").agg(
        F.min("vec_id").cast("long").alias("least"), F.count(F.lit(1)).alias("copies"))
        .select(key.alias("rep"), "least", "copies", F.size("vec").alias("dim"), "vec"))

    total = reps.count()
    sample = hash_sample(reps, "rep", FIT_ROWS).toArrow()
    centres = {}
    dims = sample["dim"].to_numpy()
    for d in np.unique(dims):
        import pyarrow as pa

        x = unit_rows(sample["vec"].filter(pa.array(dims == d)))
        k = int(np.clip(np.ceil(total * len(x) / len(dims) / SHARD), 1, min(MAX_CENTRES, len(x))))
        centres[int(d)] = fit_centres(x, k)
    sent = spark.sparkContext.broadcast(centres)
    audited = reps.withColumn("salted", F.xxhash64(F.lit("audit"), "rep"))
    rows = AUDIT_ROWS
    while True:
        probe = _true_links(reps, materialize(hash_sample(audited, "salted", rows)), threshold)
        probe = materialize(probe.where("n > 0"))  # AUDIT_MOST rows at most
        if rows >= min(total, AUDIT_MOST) or probe.count() >= AUDIT_LINKED:
            break
        rows *= 4
    while True:
        exact = overlap > MAX_OVERLAP
        found = _exact(reps, sent, threshold) if exact else _searched(reps, sent, overlap, threshold)
        counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
        share = F.least("n", F.coalesce("links", F.lit(0))) / F.col("n")
        reached = 1.0 if exact else probe.join(counts, "rep", "left").agg(F.avg(share)).first()[0]
        reached = 1.0 if reached is None else reached  # no linked vector among those sampled
        if audit is not None:
            audit |= {"recall": reached, "overlap": overlap, "exact": exact}
        if exact or reached >= recall:
            break
        overlap += 1

    roots = connected(found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    placed = materialize(reps.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select(
        "rep", "vec", "copies", "least", F.coalesce("root", "rep").alias("root")))
    names = placed.groupBy("root").agg(F.min("least").alias("component"))
    classes = (placed.join(counts, "rep").join(names, "root")
               .select("vec", F.col("copies") - 1 + F.col("links"), "component").toDF("vec", "links", "component"))
    linked = v.where("usable").join(classes, "vec").select("vec_id", "links", "component")
    alone = v.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    return linked.union(alone).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"),
                                      F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))
