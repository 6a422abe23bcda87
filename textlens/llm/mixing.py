"""Mixing sources to target weights with soft domain membership.

1. A labelled table names the domain of some documents. A naive Bayes classifier over the
   hashed words that a text holds is counted on at most ``FIT_ROWS`` of them, taken by hash
   (the documented bound of the fit). A word is expected in a domain as often as the domain
   holds distinct words of documents (not documents: long ones hold more words of any
   kind). It has weight only if it tells, its count being off by ``Z`` standard errors and
   by ``RATIO`` in its logarithm: weak words (those of a domain's main language, say) depend
   on each other, and their sum would drown the telling ones. It gives every document a
   posterior.
2. Each document gets a rate r >= 0. With n its words and P its posterior, the expected
   domain totals T_k = sum of n * r * P_k shall be the target shares of all words. The
   rates minimise the weighted least squares

       sum over k of (T_k / N - target_k)^2 / share_k  +  RIDGE * sum of n * (r - 1)^2 / N

   by accelerated projected gradient steps in the metric of n, from r = y = 1:

       r' <- max(0, y - STEP * (sum over k of P_k * (T_k / N - target_k) / share_k + RIDGE * (y - 1)))
       y' <- r' + t / (t + 3) * (r' - r)          (T_k at y; t counts the steps).

   A step's gradient is one number a domain, summed over all documents by Spark. Rates are
   refolded from the list of gradients; every ``FOLD`` steps a table of (n, P, r, y) takes
   them in. The steps end when all shares are within ``TOLERANCE`` of their targets, when
   no share has moved by ``STILL`` for ``WAIT`` steps, or after ``MAX_STEPS``; the shares
   reached are returned beside the targets.
3. A document is taken floor(r) times, once more if a hash of its id falls below the rest.

All of it is DataFrame expressions; texts are read once for the fit and once to score,
and the fits run on a table of (id, words, posterior).

Domains without a labelled document can't be met: their targets go to the others in
proportion. Defined results: a null or empty text has no words and the prior as its
posterior; ids may be null or repeat (rows of one id share the draw of step 3); a label
that repeats counts once, the least domain if they differ; without labels all domains are
equally likely; an empty table gives no rows; other columns are ignored, ``mix_rows``
keeps them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm.common import hash_sample, let, table, words
from textlens.session import materialize

BINS = 1 << 12
FIT_ROWS = 20_000
SMOOTH, Z, RATIO = 50.0, 6.0, 1.2
STEP, RIDGE, TOLERANCE, MAX_STEPS = 1.0, 1e-3, 5e-4, 200
STILL, WAIT, FOLD = 1e-5, 5, 8

#: Target share of each domain of the query, named by quality and toxicity.
TARGETS = {"q0t0": 0.07, "q0t1": 0.01, "q1t0": 0.86, "q1t1": 0.06}


def _hashes(w: Column) -> Column:
    """Hashes of the distinct words: a word that a text repeats is one piece of evidence."""
    return F.array_distinct(F.transform(w, lambda x: F.xxhash64(x)))


def _bin(h: Column) -> Column:
    return F.pmod(h, F.lit(BINS)).cast("int")


def domain_weights(docs: DataFrame, labels: DataFrame, domains: list[str], fit_rows: int = FIT_ROWS):
    """(array column: by bin, the telling words as structs of hash and a weight for each
    domain, null for a bin without; priors; which domains are labelled; the sample). ``docs``: (doc_id, text); ``labels``: (doc_id,
    domain)."""
    known = (labels.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.min("domain").alias("domain")))
    sample = materialize(hash_sample(known, "doc_id", fit_rows))  # broadcast below: fit_rows ids at most
    tokens = (docs.join(F.broadcast(sample), "doc_id").select("domain", _hashes(words(F.col("text"))).alias("b"))
              .select("domain", F.explode("b").alias("h")))
    counts = materialize(tokens.groupBy("h").agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)]))
    rows = {r.domain: r.n for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    priors = [(rows.get(d, 0) + 1) / (sum(rows.values()) + len(domains)) for d in domains]
    pairs = counts.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(len(domains))]).first()
    expected = [F.col("n") * F.lit(n / max(1, sum(pairs))) for n in pairs]
    pseudo = F.col("n") * F.lit(SMOOTH / max(1, sum(rows.values())))
    weights = [F.log((F.col(f"n{i}") + pseudo) / (e + pseudo)) for i, e in enumerate(expected)]
    tells = [(F.abs(F.col(f"n{i}") - e) >= Z * F.sqrt(e + 1)) & (F.abs(w) >= RATIO) for i, (e, w) in enumerate(zip(expected, weights))]
    listed = counts.where(reduce(or_, tells)).select(_bin(F.col("h")).alias("bin"), F.struct(
        "h", F.array(*[F.when(t, w).otherwise(F.lit(0.0)) for t, w in zip(tells, weights)]).alias("w")).alias("e")).groupBy("bin").agg(F.sort_array(F.collect_list("e")).alias("w"))
    full = docs.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin")).join(listed, "bin", "left")
    array = full.agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "w"))), lambda s: s["w"])).scalar()
    return array, priors, [d in rows for d in domains], sample


def evidence(weights: str, text: Column, k: int) -> Column:
    """struct (n: number of words, e: the summed weights of the telling words by domain, c: the
    domain of the greatest sum, ``k`` without telling words) of a text; ``weights`` names the
    array column of ``domain_weights``."""
    def total(hits, i):
        return F.aggregate(hits, F.lit(0.0), lambda a, w: a + w[i])

    def score(hits):
        return let(F.array(*[total(hits, i) for i in range(k)]), lambda e: F.struct(e.alias("e"), F.when(
            F.size(hits) == 0, F.lit(k)).otherwise((F.array_position(e, F.array_max(e)) - 1).cast("int")).alias("c")))

    def of_words(w):
        hits = F.filter(F.transform(_hashes(w), lambda h: F.get(
            F.filter(F.get(weights, _bin(h)), lambda e: e["h"] == h), F.lit(0))["w"]), lambda x: x.isNotNull())
        return let(let(hits, score), lambda s: F.struct(F.size(w).cast("long").alias("n"), s["e"].alias("e"), s["c"].alias("c")))

    return let(words(text), of_words)


def posterior(e: Column, c: Column, table: list[list[float]]) -> Column:
    """Posterior array of a document from its evidence, with the row of ``table`` for its
    greatest domain as the prior: how the labelled documents of that kind are spread, so
    that the lack of telling words counts too."""
    rows = F.array(*[F.array(*[F.log(F.lit(x)) for x in row]) for row in table])
    return let(F.zip_with(e, F.get(rows, c), lambda x, y: x + y), lambda s: let(F.array_max(s), lambda m: let(
        F.transform(s, lambda x: F.exp(x - m)), lambda z: F.transform(
            z, lambda x: x / F.aggregate(z, F.lit(0.0), lambda a, y: a + y)))))


def _after(p: Column, gradients: list[list[float]], at: Column | None = None, first: int = 0) -> Column:
    """struct (r, y) after the given steps from ``at`` (default: both 1), the first of which is
    step number ``first``."""
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")) if at is None else at
    if not gradients:
        return start
    steps = F.array(*[F.struct(F.array(*map(F.lit, g)).alias("g"), F.lit(t / (t + 3)).alias("b"))
                      for t, g in enumerate(gradients, first)])

    def step(at, s):
        pull = F.aggregate(F.zip_with(p, s["g"], lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return let(F.greatest(F.lit(0.0), at["y"] - STEP * (pull + RIDGE * (at["y"] - 1))), lambda r: F.struct(
            r.alias("r"), (r + s["b"] * (r - at["r"])).alias("y")))

    return F.aggregate(steps, start, step)


def rate(p: Column, gradients: list[list[float]]) -> Column:
    """Rates after the given steps."""
    return _after(p, gradients)["r"]


def fit_rates(scored: DataFrame, targets: list[float], labelled: list[bool] | None = None) -> dict:
    """``gradients`` of all steps, and by domain the ``targets`` (of those that can be met) and
    the ``shares`` reached. ``scored``: rows (n, p); ``labelled``: which domains can be met."""
    k = len(targets)
    base = scored.select("n", "p", _after(F.col("p"), []).alias("a"))

    def shares(pending, first):
        now = base.select("n", "p", _after(F.col("p"), pending, F.col("a"), first).alias("a"))
        got = now.agg(F.sum("n"), *[F.sum(F.col("n") * F.col(f"a.{x}") * F.get("p", F.lit(i))) for x in "ry" for i in range(k)]).first()
        return now, [(x or 0.0) / got[0] for x in got[1:]] if got[0] else None

    _, now = shares([], 0)
    if now is None:
        return {"gradients": [], "targets": list(targets), "shares": [None] * k}
    at_one = now[:k]
    present = [s > 0 and (labelled is None or labelled[i]) for i, s in enumerate(at_one)]
    whole = sum(t for t, ok in zip(targets, present) if ok) or 1.0
    goals = [t / whole * sum(targets) if ok else 0.0 for t, ok in zip(targets, present)]

    def off(now):
        return [s - t if ok else 0.0 for s, t, ok in zip(now, goals, present)]

    gradients, folded, quiet = [], 0, 0
    while max(map(abs, off(now[:k]))) > TOLERANCE and len(gradients) < MAX_STEPS and quiet < WAIT:
        gradients.append([o / s if ok else 0.0 for o, s, ok in zip(off(now[k:]), at_one, present)])
        before = now
        state, now = shares(gradients[folded:], folded)
        quiet = quiet + 1 if max(abs(x - y) for x, y in zip(now[:k], before[:k])) < STILL else 0
        if len(gradients) - folded == FOLD:
            base, folded = materialize(state), len(gradients)
    return {"gradients": gradients, "targets": goals, "shares": now[:k]}


def _scored(docs: DataFrame, keep: Column, id_col: str, text_col: str, labels: DataFrame, targets: dict[str, float]):
    """(rows with their words and posterior, the fit of their rates)."""
    domains = sorted(targets)
    t = docs.select(keep.alias("_row"), F.col(f"`{id_col}`").alias("doc_id"),
                    F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    weights, priors, labelled, sample = domain_weights(t.select("doc_id", "text"), labels, domains)
    seen = evidence("_weights", F.col("text"), len(domains))
    told = materialize(t.withColumn("_weights", weights).select("_row", "doc_id", seen.alias("_s"))
                       .select("_row", "doc_id", F.col("_s.n").alias("n"), F.col("_s.e").alias("e"), F.col("_s.c").alias("c")))
    kinds = told.select("doc_id", "c").join(F.broadcast(sample), "doc_id").groupBy("c", "domain").agg(F.count(F.lit(1)).alias("n")).collect()
    table = [list(priors) for _ in range(len(domains) + 1)]  # one pseudo-document a row
    for r in kinds:
        table[r.c][domains.index(r.domain)] += r.n
    table = [[x / sum(row) for x in row] for row in table]
    scored = told.select("_row", "doc_id", "n", posterior(F.col("e"), F.col("c"), table).alias("p"))
    states = materialize(scored.select("n", "p"))
    return scored, fit_rates(states, [targets[d] for d in domains], labelled if any(labelled) else None)


def _copies(doc_id: Column, r: Column) -> Column:
    u = F.pmod(F.xxhash64(F.lit("mix"), F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(r + u).cast("int")


def mix_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """doc_id, n_words, posteriors (domain -> probability), rate and copies of every row, and
    each domain's target and reached share (the same in all rows; null without words)."""
    scored, fit = _scored(docs, F.lit(None).cast("string"), id_col, text_col, labels, targets)
    domains = sorted(targets)
    return scored.select(
        "doc_id", F.col("n").alias("n_words"), *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)],
        rate(F.col("p"), fit["gradients"]).alias("rate"),
        *[F.lit(x).cast("double").alias(f"{name}_{d}") for name in ("targets", "shares") for d, x in zip(domains, fit[name])]
    ).withColumn("copies", _copies(F.col("doc_id"), F.col("rate"))).withColumnsRenamed(
        {f"{a}_{d}": f"{b}_{d}" for a, b in (("targets", "target"), ("shares", "reached")) for d in domains})


def mix_rows(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as its rate says."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    scored, fit = _scored(docs, row, id_col, text_col, labels, targets)
    r = rate(F.col("p"), fit["gradients"])
    taken = scored.select("_row", _copies(F.col("doc_id"), r).alias("_k")).where("_k > 0").select(
        "_row", F.explode(F.array_repeat(F.lit(1), F.col("_k"))))
    return taken.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain) of the labelled documents."""
    return table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").select(
        "doc_id", F.concat(F.lit("q"), F.col("quality"), F.lit("t"), F.col("toxic")).alias("domain"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rates(table(spark, sf_dir, "documents"), domain_labels(spark, sf_dir), TARGETS)
