"""Sharding by a hierarchical weighted hash tree.

The tree has three levels: regions hold racks, racks hold shards, and a node weighs the
sum of the shards below it. A document descends from the root: at each level every child
draws ``-ln(u) / weight`` with ``u`` hashed from the document's id, the level and the
child's name, and the least draw wins. A child's draw depends on its own weight only, so

* a node is chosen with a chance in proportion to its weight, and
* when weights change, documents move only into or out of the subtrees whose weights
  changed; the order of two unchanged siblings never changes.

Growth by one shard opens a region of its own (``tree``): all other subtrees keep their
weights, so documents move into the new shard only.

Placement needs the id alone and no shuffle; ids, sizes and shards are written once. The gapless slots of a shard come from two
levels: documents fall into ``blocks`` hash blocks a shard; the (shard, block) counts, at
most ``shards * blocks`` rows, are summed up to first slots, and rows are numbered inside
their own block. No window holds a whole shard, and the text never moves.

Defined results: a null text has size 1 and crc32 0; a null id hashes as the empty text,
so all rows without an id share a shard; rows that repeat an id share its shard and get
slots of their own (equal rows are interchangeable); an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlens.llm.common import small_side, table
from textlens.session import materialize

BASE_SHARDS, RACKS, PER_RACK = 16, 2, 4
BLOCKS = 256


def tree(shards: int, base: int = BASE_SHARDS, racks: int = RACKS, per_rack: int = PER_RACK,
         weights: dict[int, float] | None = None) -> dict[str, dict[str, dict[int, float]]]:
    """Region -> rack -> shard -> weight. The first ``base`` shards fill regions of
    ``racks`` racks of ``per_rack`` shards; each later one is a region of its own."""
    out: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        region = f"r{s // (racks * per_rack)}" if s < base else f"g{s}"
        rack = f"k{s // per_rack}" if s < base else f"g{s}"  # names are unique over the tree
        out.setdefault(region, {}).setdefault(rack, {})[s] = float((weights or {}).get(s, 1.0))
    return out


def _draw(key: Column, parent: str, child: str, weight: float) -> Column:
    """struct (``-ln(u) / weight``, child) with u in (0, 1) from 52 hashed bits."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(parent), F.lit(child), key), 12).cast("double")
    return F.struct((-F.log((bits + 0.5) / float(1 << 52)) / F.lit(weight)).alias("d"), F.lit(child).alias("c"))


def _descend(df: DataFrame, out: str, key: Column, parent: Column, children: dict[str, dict[str, float]]) -> DataFrame:
    """Column ``out``: the child with the least weighted draw below ``parent`` (ties: the
    first name; null without a child of positive weight). ``children``: parent -> child ->
    weight. Only the children of a row's own parent draw."""
    best = F
    for p, kids in children.items():
        draws = [_draw(key, p, c, w) for c, w in kids.items() if w > 0]
        if draws:
            best = best.when(parent == p, F.least(*draws)["c"] if len(draws) > 1 else draws[0]["c"])
    return df.withColumn(out, F.lit(None).cast("string") if best is F else best)


def place(df: DataFrame, out: str, key: Column, nodes: dict[str, dict[str, dict[int, float]]]) -> DataFrame:
    """Adds column ``out``, the shard of ``key``: one weighted draw a level."""
    total = {r: {k: sum(leaves.values()) for k, leaves in racks.items()} for r, racks in nodes.items()}
    df = _descend(df, "_region", key, F.lit("root"), {"root": {r: sum(racks.values()) for r, racks in total.items()}})
    df = _descend(df, "_rack", key, F.col("_region"), total)
    leaves = {k: {str(s): w for s, w in shards.items()} for racks in nodes.values() for k, shards in racks.items()}
    return _descend(df, "_leaf", key, F.col("_rack"), leaves).withColumn(
        out, F.col("_leaf").cast("int")).drop("_region", "_rack", "_leaf")


def shard_rows(docs: DataFrame, shards: int = BASE_SHARDS, id_col: str = "doc_id", text_col: str = "text",
               blocks: int = BLOCKS, weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("text_crc32"))
    rows = place(rows, "shard", key, tree(shards, weights=weights))
    rows = place(rows, "grown_shard", key, tree(shards + 1, weights=weights))
    # a few numbers a row, written once: the counts and the numbering read them
    rows = materialize(rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")))
    counts = rows.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = materialize(counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    inside = Window.partitionBy("shard", "_block").orderBy("doc_id", "size", "text_crc32")
    return (rows.withColumn("_rank", F.row_number().over(inside)).join(small_side(first), ["shard", "_block"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("_first") + F.col("_rank") - 1).cast("long").alias("slot"),
                    "grown_shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
