"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: the sources share a total in proportion to their weights; a source's target stops at
MAX_REPEATS times its size, and what it can't take is shared again by weight among the others until
no target is above its stop.

Quotas: the total is cut into blocks of BLOCK tokens. Blocks go one by one to the source with the
highest quotient target / (2 * blocks so far + 1). That sequence needs no loop: a source with target
t has a quotient above q for floor(t / (2 q) + 1/2) blocks, so the quotas are the counts at the
quotient where they sum to the total. A source's blocks are shared out among its shards in the same
way, in proportion to the shards' tokens. A shard is a hash-dealt part of a source, as many for each
source as its size asks for, so that a source with a third of all tokens is spread over many tasks.

Selection: a shard's documents are laid end to end in a seeded order and cut into blocks. A quota of
q blocks over n takes every block floor(q / n) times, and the q mod n blocks with the smallest
seeded hashes once more. What a document gives is the overlap of its tokens with the blocks taken.

NULL sources are a source of their own, sorted last. Documents of size 0 take part with 0 taken.
Rows that repeat a doc_id are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import WORD_PATTERN, written

BLOCK, MAX_REPEATS, SHARD_TOKENS = 64, 3, 500_000
#: Parts of a document that the rounding to whole documents counts in.
PARTS = 1 << 30
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for NULL, without cutting it up."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), WORD_PATTERN, "w")
    return F.length(spaced) - F.length(F.regexp_replace(spaced, "w", ""))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target from source, source_size: one row per source, so its windows are small.

    Sources that stop are those with the smallest stop per weight; the level that the others share is
    found from running sums in that order.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    number = (F.row_number().over(by_name) - 1) % len(weights)
    got = (
        sizes.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), number + 1))
        .withColumn("_stop", F.col("source_size") * float(max_repeats))
        .withColumn("_ratio", F.col("_stop") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_stop").over(ahead), F.lit(0.0))) / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(ahead), F.lit(0.0))))
        .withColumn("_first", F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", F.row_number().over(order).alias("_at"), "_level"))).over(everything))
        .withColumn("_share", F.col("_first._level"))
    )
    return got.select("source", "source_size", F.least("_stop", F.col("_weight") * F.coalesce("_share", F.lit(float("inf")))).alias("target"))


def apportioned(shares: DataFrame, group: list[str], share: str, seats: str, cap: str, out: str) -> DataFrame:
    """shares with the Sainte-Laguë seats of each row within its group, at most cap each.

    At the divisor sum / (seats - rows / 2) every row has floor(share / divisor + 1/2) seats of the
    sequence, and fewer than one for each row are left; no row can win more of those than its part of
    the rows and one. They go by the highest next quotients.
    """
    whole = Window.partitionBy(*group)
    total, rows = F.sum(share).over(whole), F.count(F.lit(1)).over(whole)
    got = shares.withColumn("_part", F.coalesce(F.col(share) / F.nullif(total, F.lit(0)), F.lit(0.0))).withColumn("_rows", rows)
    base = F.floor(F.col("_part") * F.greatest(F.lit(0.0), F.col(seats) - F.col("_rows") / 2) + F.when(F.col(seats) > F.col("_rows") / 2, 0.5).otherwise(0.0))
    got = got.withColumn(out, F.least(base, F.col(cap)).cast("long"))
    got = got.withColumn("_left", F.col(seats) - F.sum(out).over(whole))
    got = got.withColumn("_next", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("_part") * F.col("_rows")) + 3).cast("int"))))
    quotient = F.when(F.col(out) + F.col("_next") < F.col(cap), F.col(share) / (2 * (F.col(out) + F.col("_next")) + 1))
    names = [c for c in shares.columns if c not in group]
    ranked = got.withColumn("_quotient", quotient).withColumn("_rank", F.row_number().over(whole.orderBy(F.col("_quotient").desc_nulls_last(), *names, "_next")))
    won = F.sum(F.when((F.col("_rank") <= F.col("_left")) & F.col("_quotient").isNotNull(), 1).otherwise(0))
    keys = [*shares.columns, out]
    return ranked.groupBy(*keys).agg(won.alias("_won")).withColumn(out, F.col(out) + F.col("_won")).drop("_won")


def mix(docs: DataFrame, seed: int = 17, block: int = BLOCK, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (and what identifies the row) of each row of docs (doc_id, source, text)."""
    spark = docs.sparkSession
    row = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).cast("long").alias("size"), row.alias("_row")), "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(source_targets(sources, weights), "mix-targets")
    blocks_of = lambda tokens: F.ceil(tokens / F.lit(block)).cast("long")
    plan = sources.withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    plan = plan.withColumn("_cap", blocks_of(F.col("source_size")) * MAX_REPEATS).withColumn("_one", F.lit(0))
    quotas = apportioned(plan.select("_one", "source", "source_size", "target", "_seats", "_cap"), ["_one"], "target", "_seats", "_cap", "quota")
    quotas = quotas.select("source", "source_size", "target", "quota").withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_TOKENS)))

    dealt = sized.join(quotas.select(F.col("source").alias("_source"), "_shards"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_row"), F.col("_shards"))).drop("_shards")
    line = Window.partitionBy("source", "shard").orderBy("_row", "doc_id")
    dealt = dealt.withColumn("_end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_start", F.col("_end") - F.col("size"))
    dealt = written(dealt, "mix-lines")

    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("_tokens"))
    shards = shards.join(quotas.select(F.col("source").alias("_source"), "quota"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    shards = shards.withColumn("_blocks", blocks_of(F.col("_tokens"))).withColumn("_cap", F.col("_blocks") * MAX_REPEATS)
    shards = apportioned(shards, ["source"], "_tokens", "quota", "_cap", "_shard_quota")
    shards = written(shards.select("source", "shard", "_blocks", "_shard_quota"), "mix-quotas")

    every = F.when(F.col("_blocks") > 0, F.floor(F.col("_shard_quota") / F.col("_blocks"))).otherwise(0)
    extra = shards.withColumn("_extra", F.col("_shard_quota") - every * F.col("_blocks")).where("_extra > 0")
    extra = extra.select("source", "shard", "_extra", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"))
    chosen = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "source", "shard", "_block"), "_block")
    extra = extra.withColumn("_rank", F.row_number().over(chosen)).where("_rank <= _extra").select("source", "shard", "_block")

    covered = dealt.where("size > 0").withColumn("_block", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_end") - 1) / block))))
    same = lambda a, b: a.eqNullSafe(b)
    e = extra.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), F.col("_block").alias("_b"))
    overlap = F.least(F.col("_end"), (F.col("_block") + 1) * block) - F.greatest(F.col("_start"), F.col("_block") * block)
    # The planner takes the exploded blocks for as small as what they come from; they grow with the corpus.
    more = covered.join(e.hint("merge"), same(F.col("source"), F.col("_s")) & (F.col("shard") == F.col("_h")) & (F.col("_block") == F.col("_b")))
    more = more.groupBy("doc_id", "_row", "_start", F.col("source").alias("_s"), F.col("shard").alias("_h")).agg(F.sum(overlap).alias("_more"))
    s = shards.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), every.alias("_every"))
    known = dealt.join(s, same(F.col("source"), F.col("_s")) & (F.col("shard") == F.col("_h"))).drop("_s", "_h")
    m = more.select(F.col("doc_id").alias("_d"), F.col("_row").alias("_r"), F.col("_start").alias("_t"), "_s", "_h", "_more")
    known = known.join(m, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r")) & (F.col("_start") == F.col("_t")) & same(F.col("source"), F.col("_s")) & (F.col("shard") == F.col("_h")) & (F.col("size") > 0), "left")
    taken = F.col("size") * F.col("_every") + F.coalesce("_more", F.lit(0))
    known = known.select("doc_id", "source", "shard", "size", "_row", "_start", taken.cast("long").alias("taken"))
    t = sources.select(F.col("source").alias("_s"), "source_size", "target")
    return known.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def copies(taken: DataFrame, seed: int = 17) -> DataFrame:
    """mix's rows with _copies: taken / size by systematic rounding, so that a shard's words are kept but for two documents.

    The parts of taken / size below 1 are summed along each shard from the shortest document to the
    longest; where the sum, from a seeded start, passes a whole number, the document is given once
    more. Short and long documents are so given in the same proportion.
    """
    line = Window.partitionBy("source", "shard").orderBy("size", "_row", "doc_id", "_start").rowsBetween(Window.unboundedPreceding, 0)
    part = F.when(F.col("size") > 0, F.floor((F.col("taken") % F.col("size")) * F.lit(PARTS) / F.col("size"))).otherwise(0).cast("long")
    start = F.pmod(F.xxhash64(F.lit(seed + 3), "source", "shard"), F.lit(PARTS))
    rows = taken.withColumn("_part", part).withColumn("_upto", F.sum("_part").over(line) + start)
    more = F.floor(F.col("_upto") / PARTS) - F.floor((F.col("_upto") - F.col("_part")) / PARTS)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size")) + more).otherwise(1)
    return rows.withColumn("_copies", times.cast("int")).drop("_part", "_upto")


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """docs' rows, each repeated as often as the mix takes it: taken / size, rounded by copies, 0 to 3 times.

    Documents without words stay once. Of rows equal in doc_id, text and source each gets its own count.
    """
    mark = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))
    counts = copies(mix(docs, seed), seed)
    counts = counts.groupBy("_row", F.col("doc_id").alias("_d"), F.col("source").alias("_s")).agg(F.sum("_copies").alias("_sum"), F.count("*").alias("_rows"))
    same = Window.partitionBy("_row", "_d", "_s").orderBy("_row")
    # The rows' own columns are one column meanwhile, so that no name can clash.
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    rows = docs.select(mark.alias("_mark"), F.col("doc_id").alias("_i"), F.col("source").alias("_from"), own.alias("_own"))
    rows = rows.join(counts, (F.col("_mark") == F.col("_row")) & F.col("_i").eqNullSafe(F.col("_d")) & F.col("_from").eqNullSafe(F.col("_s")))
    rows = rows.withColumn("_at", F.row_number().over(same))
    each = F.floor(F.col("_sum") / F.col("_rows")) + F.when(F.col("_at") <= F.col("_sum") % F.col("_rows"), 1).otherwise(0)
    rows = rows.withColumn("_times", each.cast("int")).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return rows.select(*[F.col(f"_own.c{k}").alias(c) for k, c in enumerate(docs.columns)])
