"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Sources share a budget by weight, none above twice its size; what is above goes to the
   others by weight. With sources sorted by the level at which they fill up, running sums
   give the common level at once.
2. Each source's documents are dealt by hash into blocks, in a permuted order. A target is
   met by whole passes over all blocks and, for the rest, by the first blocks of the order;
   of the block the rest ends in, only the first documents are drawn.
3. The drawn blocks of all sources are split among output shards by a binary tree. A node
   holds exact block quotas per source; the quotas of its left half are those of a random
   half of its block tickets, which is a multivariate hypergeometric draw. Every node and
   ticket has its own hash, so reruns agree.
4. Shards take disjoint runs of a source's permuted draws, as many as their quotas say, and
   documents are shuffled by hash inside their shard.

All of it is DataFrame code. Unpartitioned windows see one row per source, and the tree's top
one row per drawn block; documents are only windowed within the one cut block of a source.

Defined results: null and blank texts have size 0 and are never drawn for words, but pass
with the blocks they lie in; a null source is a source, last in order; rows equal in id and
text share one decision; an empty table gives an empty result; the columns of `mixed` are
those of the documents, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlark.llm.common import packed, table, words_column
from orderlark.session import stored

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
BUDGET = 1.5  # of all sizes
MOST_PASSES = 2
BLOCK_DOCUMENTS = 512
#: Grain of a very large source: beyond this many blocks they get larger instead.
MOST_BLOCKS = 16_384
#: Output shards are 2 ** LEVELS.
LEVELS = 4
SEED = 71
#: Rounds in which the documents of a cut block are fitted to what is left of the target.
FILL_ROUNDS = 4


def sized(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """doc_id, source, size in words, and a hash of id and text."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.size(words_column(text_col)).cast("long").alias("size"),
        F.xxhash64(F.lit(SEED), id_col, text_col).alias("h"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """One row per source: source, n_docs, source_size, target."""
    totals = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = totals.withColumn("place", F.row_number().over(by_name))
    ranked = ranked.withColumn("w", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(MOST_PASSES)) * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("w"), "place")
    before, onward = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    left = F.lit(budget) * F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / F.sum("w").over(onward)).withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    common = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), "place", "level"))).over(all_)["level"]
    target = F.coalesce(F.least("cap", common * F.col("w")), F.col("cap"))
    return level.select("source", "place", "n_docs", "source_size", target.alias("target"))


def same_source(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Join on source, null matching null, and further keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in ("source", *keys)})
    on = F.col("source").eqNullSafe(F.col("_r_source"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(renamed, on).drop(*[f"_r_{k}" for k in ("source", *keys)])


def shard_quotas(blocks: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(shard, place, n): the splitting tree's leaves, from (place, n) drawn blocks a source."""
    tickets = blocks.select("place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("ticket")).withColumn("shard", F.lit(0))
    for level in range(levels):
        node = Window.partitionBy("shard")
        shuffled = node.orderBy(F.xxhash64(F.lit(SEED), F.lit(level), "shard", "place", "ticket"), "place", "ticket")
        halved = tickets.withColumns({"_at": F.row_number().over(shuffled), "_n": F.count(F.lit(1)).over(node)})
        # Odd counts give the extra ticket to the left or the right half by the node's hash.
        half = F.floor((F.col("_n") + F.pmod(F.xxhash64(F.lit(SEED), F.lit(level), "shard"), F.lit(2))) / 2)
        tickets = halved.withColumn("shard", 2 * F.col("shard") + (F.col("_at") > half).cast("int")).drop("_at", "_n")
    return tickets.groupBy("shard", "place").agg(F.count(F.lit(1)).alias("n"))


def draws(sizes: DataFrame, shares: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Per block (source, block): shards of its draws in order, and the words to draw of it
    in its last pass (null: all)."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = shares.withColumns({"passes": passes, "n_blocks": n_blocks()})
    plan = plan.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    dealt = same_source(sizes, plan.select("source", "n_blocks")).withColumn("block", F.pmod("h", F.col("n_blocks")))
    words = dealt.groupBy("source", "block").agg(F.sum("size").alias("words"))
    permuted = same_source(words, plan.select("source", "place", "passes", "rest")).withColumn("_p", F.xxhash64(F.lit(SEED + 1), "place", "block"))
    order = Window.partitionBy("place").orderBy("_p", "block")
    at = permuted.withColumns(
        {"at": F.row_number().over(order), "before": F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"), "n_all": F.count(F.lit(1)).over(Window.partitionBy("place"))}
    )
    at = at.withColumns({"more": F.col("before") < F.col("rest"), "cut": F.when(F.col("before") + F.col("words") > F.col("rest"), F.col("rest") - F.col("before"))})
    at = stored(at.withColumn("n", F.col("passes") + F.col("more").cast("long")), "blocks")

    quotas = shard_quotas(at.groupBy("place").agg(F.sum("n").alias("n")).where("n > 0"), levels)
    upto = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    runs = quotas.withColumn("_end", F.sum("n").over(upto)).select("place", "shard", (F.col("_end") - F.col("n")).alias("_start"), "_end")
    each = at.where("n > 0").select("source", "place", "block", "at", "n_all", F.explode(F.expr("sequence(1L, n)")).alias("pass"))
    each = each.withColumn("_draw", (F.col("pass") - 1) * F.col("n_all") + F.col("at") - 1)
    placed = each.join(runs, "place").where("_draw >= _start AND _draw < _end")
    shards = placed.groupBy("place", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("shards"))
    plain = at.select("source", "place", "block", F.when(F.col("more"), F.col("cut")).alias("cut"))
    return plain.join(shards, ["place", "block"]).drop("place")


def n_blocks() -> Column:
    """The number of blocks of a source of n_docs documents."""
    return F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("n_docs") / BLOCK_DOCUMENTS))


@dataclass(frozen=True)
class Plan:
    """What decides where a document goes: one row a source, one a block, and one for each
    document of the block that is cut in each source."""

    sizes: DataFrame
    shares: DataFrame
    blocks: DataFrame  # source, block, cut, shards
    parted: DataFrame  # doc_id, h, shards: of the documents of cut blocks

    def placed(self, rows: DataFrame) -> DataFrame:
        """Add source_size, target and shards to rows with doc_id, source and h. All joined tables
        are short beside the documents, so Spark can broadcast them and no row moves."""
        known = self.shares.withColumn("n_blocks", n_blocks())
        dealt = same_source(rows, known.select("source", "source_size", "target", "n_blocks")).withColumn("block", F.pmod("h", F.col("n_blocks")))
        at = self.blocks.withColumnsRenamed({"source": "_s", "block": "_b", "shards": "_all"})
        found = dealt.join(at, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left")
        own = self.parted.withColumnsRenamed({"doc_id": "_id", "h": "_ph", "shards": "_own"})
        found = found.join(own, F.col("cut").isNotNull() & (F.col("h") == F.col("_ph")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        shards = F.coalesce(F.when(F.col("cut").isNull(), F.col("_all")).otherwise(F.col("_own")), F.expr("CAST(array() AS array<int>)"))
        return found.withColumn("shards", shards).drop("n_blocks", "block", "cut", "_s", "_b", "_all", "_id", "_ph", "_own")


def planned(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", levels: int = LEVELS) -> Plan:
    sizes = stored(sized(docs, text_col, id_col, source_col), "sizes")
    shares = stored(targets(sizes), "targets")
    blocks = stored(draws(sizes, shares, levels), "draws")
    dealt = same_source(sizes, shares.select("source", n_blocks().alias("n_blocks"))).withColumn("block", F.pmod("h", F.col("n_blocks")))
    cut = blocks.where("cut IS NOT NULL").withColumnsRenamed({"source": "_s", "block": "_b"})
    found = dealt.join(cut, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    # Only the one cut block of each source is ordered. Equal rows stand or fall together.
    # Each round takes documents that still fit, in hashed order; what a long one would
    # overshoot is left to shorter ones in the next round.
    inside = Window.partitionBy("source", "block").orderBy("h").rangeBetween(Window.unboundedPreceding, 0)
    block = Window.partitionBy("source", "block")
    parted = found.withColumns({"_in": F.lit(False), "_left": F.col("cut").cast("double")})
    for _ in range(FILL_ROUNDS):
        open_ = ~F.col("_in") & (F.col("size") <= F.col("_left"))
        parted = parted.withColumn("_now", open_ & (F.sum(F.when(open_, F.col("size")).otherwise(0)).over(inside) <= F.col("_left")))
        used = F.sum(F.when(F.col("_now"), F.col("size")).otherwise(0)).over(block)
        parted = parted.withColumns({"_in": F.col("_in") | F.col("_now"), "_left": F.col("_left") - used})
    parted = parted.withColumn("shards", F.when(F.col("_in"), F.col("shards")).otherwise(F.expr("slice(shards, 1, size(shards) - 1)")))
    once = stored(parted.groupBy("doc_id", "h").agg(F.first("shards").alias("shards")), "parted")
    return Plan(sizes, shares, blocks, once)


def mixture(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", levels: int = LEVELS) -> DataFrame:
    """doc_id, h, size, source_size, target, and the shards that a document goes to, one entry
    for each time it is taken."""
    plan = planned(docs, text_col, id_col, source_col, levels)
    return plan.placed(plan.sizes)


def mixed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", levels: int = LEVELS) -> DataFrame:
    """The documents of the mix, repeated as drawn, dealt to their shards' tasks and shuffled
    there by hash. The texts move once, to their shards."""
    plan = planned(docs, text_col, id_col, source_col, levels)
    rows = packed(docs, doc_id=F.col(id_col), source=F.col(source_col), h=F.xxhash64(F.lit(SEED), id_col, text_col))
    each = plan.placed(rows).select("row", "h", F.posexplode("shards").alias("pass", "shard"))
    # A shard's rows go to several tasks of their own, in hashed order.
    each = each.withColumn("order", F.xxhash64(F.lit(SEED + 2), "h", "pass"))
    out = each.repartition("shard", F.pmod("order", F.lit(4096))).sortWithinPartitions("shard", "order")
    return out.select("row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    found = mixture(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"), "shards")


QUERIES = {"op9_mixing": op9_mixing}
ORACLE = {}
