"""What jobs leave on disk while they run."""

import itertools
import os
import random
import time

from textlens.operators import lm as LM
from textlens.operators import ngram as N
from textlens.operators import scoring as S
from textlens.operators import simjoin as J
from textlens.session import materialize, scratch_tables, table_scope


def bytes_of(paths):
    return sum(os.path.getsize(f"{d}/{f}") for p in paths for d, _, names in os.walk(p.removeprefix("file:")) for f in names)


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def test_a_tables_shuffle_files_go_with_its_job(spark):
    before = shuffle_files(spark)
    table = materialize(spark.range(5000).selectExpr("id % 97 AS k").groupBy("k").count().repartition(3, "count"))
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert table.count() == 97


def test_a_model_of_grams_takes_few_bytes_a_token(spark):
    rnd = random.Random(5)
    texts = [(" ".join(f"w{int(3000 * rnd.random() ** 3)}" for _ in range(2000)),) for _ in range(40)]
    with scratch_tables(spark):
        N.fit_ngram_lm(spark.createDataFrame(texts, "text string").coalesce(1), "text", 5)
        assert bytes_of(table_scope()) < 40 * 80_000  # a table of grams for each order: over 100


def test_grams_do_not_depend_on_blocks_deals_and_hot_tokens(spark, monkeypatch):
    rnd = random.Random(6)
    texts = [" ".join(f"w{int(12 * rnd.random() ** 2)}" for _ in range(rnd.randrange(40))) for _ in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    grams = spark.createDataFrame([(c, f"w{i}", 1) for c in ("", "w0", "w1 w0", "w0 w0 w1", "w9 w0", "no w0") for i in (0, 1, 11, 99)],
                                  "ctx string, token string, n_occ long")
    seen = []
    for block, hot in ((1 << 21, 1 / 4), (1, 1e-9), (60, 1e9), (7, 8 / 5)):
        monkeypatch.setattr(N, "BLOCK_TOKENS", block)
        monkeypatch.setattr(N, "HOT", hot)
        lm = N.fit_ngram_lm(df, "text", 3)
        seen.append((sorted((r.ctx, r.token, round(r.prob, 12)) for r in N.gram_probabilities(lm, grams).collect()),
                     [(r.order, round(r.d1, 12), round(r.d2, 12), round(r.d3, 12)) for r in lm.discounts.orderBy("order").collect()],
                     sorted((m, t.count(), t.agg({"a": "sum"}).first()[0]) for m, t in N.adjusted_counts(df, "text", 3).tables.items())))
    assert all(x == seen[0] for x in seen[1:])


def test_scores_of_a_text_stay_together_and_move_no_more(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([i, i, 3, None]), rnd.choice([None, "", " ".join(f"w{rnd.randrange(9)}" for _ in range(rnd.randrange(30)))])) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id long, text string").repartition(3)
    weights = spark.createDataFrame([(f"w{i}", i / 3) for i in range(7)], "token string, weight double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    size = LM.COMMON
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        for LM.COMMON in (1, 40, size):
            ts = LM.fit_and_score(df, weights=weights, tokens=False)
            plan = S.row_metrics_long(ts, ["row_id"], weighted=True, together=True)
            moved = [x for x in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
            assert moved and all("hashpartitioning(block" in x for x in moved)  # blocks of texts and their answers only
            told = [sorted((str(r.row_id), r.threshold, r.total_tokens, r.filtered_tokens, str(r.longest_run), f"{r.perplexity or 0:.9f}") for r in x.collect())
                    for x in (plan, S.row_metrics_long(ts, ["row_id"], weighted=True))]
            assert told[0] == told[1] and len(told[0]) == 12 * len({i for i, _ in rows})
    finally:
        LM.COMMON = size
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_edit_join_in_rounds_and_chunks_equals_all_pairs(spark, monkeypatch):
    rnd = random.Random(8)
    rows = []
    for family in range(4):
        base = [f"f{family}w{rnd.randrange(60)}" for _ in range(40)]
        for _ in range(9):
            own = list(base)
            for _ in range(rnd.randrange(9)):
                own[rnd.randrange(len(own))] = f"x{rnd.randrange(500)}"
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    for tokens, chunk, texts in ((J.ROUND_TOKENS, J.FAMILY_CHUNK, J.DEAL_TEXTS), (500, 2, 3)):
        for name, value in (("ROUND_TOKENS", tokens), ("FAMILY_CHUNK", chunk), ("DEAL_TEXTS", texts)):
            monkeypatch.setattr(J, name, value)
        links, _ = J.edit_join(df, 0.2)
        seen.append({(r.id_a, r.id_b): r.distance for r in links.collect()})
    want = {(i, j): d for (i, a), (j, b) in itertools.combinations(rows, 2) if (d := edits(a.split(), b.split())) <= 8}
    assert seen == [want, want] and len(want) > 30


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_a_text_moves_once_for_its_family_not_for_each_pair(spark):
    n = 60  # all pairs of 60 texts: 1770
    texts = spark.range(n).selectExpr("id AS __id", "transform(sequence(0, 1999), i -> xxhash64(i, if(i = id, 1, 0))) AS __t")
    pairs = materialize(texts.alias("a").crossJoin(texts.alias("b")).where("a.__id < b.__id").selectExpr("a.__id AS id_a", "b.__id AS id_b"))
    found = J._pair_edits(pairs, materialize(texts), 0.2)
    assert "__a" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.distance, r["__m"]) for r in found.collect()} == {(2, 2000)} and found.count() == n * (n - 1) // 2
