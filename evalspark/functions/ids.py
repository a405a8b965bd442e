"""Identities and deterministic splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def with_occurrence(items: DataFrame, order: str = "pos") -> DataFrame:
    """items with occurrence: how often the same source, figure and question came before, in dataset order."""
    same = Window.partitionBy("source", "figure_id", "question").orderBy(order)
    return items.withColumn("occurrence", F.row_number().over(same) - 1)


def item_id(model: Column, source: Column, figure_id: Column, question: Column, occurrence: Column) -> Column:
    """First 12 hex digits of a hash of the parts; a NULL source is left out."""
    joined = F.concat_ws(SEPARATOR, model, source, figure_id, question, occurrence.cast("string"))
    return F.substring(F.sha1(F.encode(joined, "UTF-8")), 1, 12)


def _figure_hash(figure_id: Column, seed: int) -> Column:
    text = F.concat(F.lit(f"{seed}{SEPARATOR}"), figure_id)
    return F.conv(F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 8), 16, 10).cast("long")


def figure_split(figure_id: Column, seed: int = 42, val: float = 0.2, test: float = 0.2) -> Column:
    """train, val or test, the same for every item of a figure."""
    share = _figure_hash(figure_id, seed) / F.lit(float(0xFFFFFFFF))
    return F.when(share < test, "test").when(share < test + val, "val").otherwise("train")


def fold_of(figure_id: Column, seed: int = 42, folds: int = 5) -> Column:
    return (_figure_hash(figure_id, seed) % folds).cast("int")


def ratio_counts(n: int, ratios: dict[str, float]) -> dict[str, int]:
    """n shared out by largest remainder."""
    quota = {k: n * r / sum(ratios.values()) for k, r in ratios.items()}
    counts = {k: int(q) for k, q in quota.items()}
    for k in sorted(quota, key=lambda k: -(quota[k] - counts[k]))[: n - sum(counts.values())]:
        counts[k] += 1
    return counts


def ratio_splits(figures: DataFrame, ratios: dict[str, float], seed: int = 42) -> DataFrame:
    """figures with split, in exact counts: the hash order is cut at the cumulative counts.

    The cut points come from a rank by hash: ranks are counted in two steps, within hash ranges and
    over their totals, so no window holds all figures.
    """
    counts = ratio_counts(figures.count(), ratios)
    hashed = figures.withColumn("_h", F.sha1(F.encode(F.concat(F.lit(f"{seed}{SEPARATOR}"), "figure_id"), "UTF-8")))
    hashed = hashed.withColumn("_range", F.substring("_h", 1, 3))
    totals = hashed.groupBy("_range").count()
    before = totals.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))
    ranked = hashed.join(before, "_range").withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy("_h", "figure_id")))
    split, edge = F.lit(None).cast("string"), 0
    for name, count in reversed(list(counts.items())):
        edge += count
        split = F.when(F.col("_rank") > sum(counts.values()) - edge, F.coalesce(split, F.lit(name))).otherwise(split)
    return ranked.withColumn("split", split).drop("_h", "_range", "_before", "_rank")
