"""Raters, labels and agreement."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The labels, and the reasons that two of them need.
LABELS = ("structural", "fabrication", "computation", "not_an_error", "ambiguous")
REASONS = {
    "not_an_error": ("format_equivalent", "valid_reading", "gold_error"),
    "ambiguous": ("question_ambiguous", "gold_error", "unreadable", "other"),
}
REAL_ERRORS = ("structural", "fabrication", "computation")
MIN_PAIR_ITEMS, KAPPA_GATE = 30, 0.6


def last_labels(rows: DataFrame, keys: list[str], order: str | Sequence[str] = "seq") -> DataFrame:
    """The last record of each key in the order of one or more columns; equal places go to the larger record."""
    rest, order = [c for c in rows.columns if c not in keys], [order] if isinstance(order, str) else list(order)
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_last"))
    return best.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def kappa_of_cells(cells: DataFrame, keys: list[str], a: str, b: str, n: str = "n", labels: Iterable[str] | None = None) -> DataFrame:
    """keys, n, agreement, kappa from a confusion table; kappa is 1 for full agreement by chance alone, else rounded to 4.

    With labels, a cell of another label is an error.
    """
    if labels is not None:
        known = F.col(a).isin(*labels) & F.col(b).isin(*labels)
        wrong = F.raise_error(F.concat(F.lit("a label is none of the categories: "), F.concat_ws(" or ", a, b)))
        cells = cells.withColumn(a, F.when(F.coalesce(known, F.lit(False)), F.col(a)).otherwise(wrong.cast("string")))
    total = cells.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col(n)).otherwise(0)).alias("same"))
    left = cells.groupBy(*keys, F.col(a).alias("_l")).agg(F.sum(n).alias("_a"))
    right = cells.groupBy(*keys, F.col(b).alias("_l")).agg(F.sum(n).alias("_b"))
    chance = left.join(right, [*keys, "_l"]).groupBy(*keys).agg(F.sum(F.col("_a") * F.col("_b")).alias("_c"))
    joined = total.join(chance, keys, "left") if keys else total.crossJoin(chance)
    return joined.select(*keys, "n", (F.col("same") / F.col("n")).alias("agreement"), kappa(F.col("n"), F.col("same"), F.coalesce("_c", F.lit(0))).alias("kappa"))


def kappa(n: Column, same: Column, products: Column) -> Column:
    """Cohen's kappa from the count, the count of equal labels and the sum of the margins' products; 1 for no items."""
    pe = products / F.nullif(n * n, F.lit(0))
    po = same / F.nullif(n, F.lit(0))
    value = F.when(products >= n * n, F.when(same >= n, 1.0).otherwise(0.0)).otherwise(F.round((po - pe) / F.nullif(1.0 - pe, F.lit(0.0)), 4))
    return F.when(F.coalesce(n, F.lit(0)) == 0, 1.0).otherwise(value)


def pairwise_kappa(ratings: DataFrame) -> DataFrame:
    """rater_a, rater_b, n, agreement, kappa, enough_items for every pair of raters with items in common."""
    left = ratings.select(F.col("rater").alias("rater_a"), "item_id", F.col("label").alias("label_a"))
    right = ratings.select(F.col("rater").alias("rater_b"), "item_id", F.col("label").alias("label_b"))
    cells = left.join(right, "item_id").where("rater_a < rater_b").groupBy("rater_a", "rater_b", "label_a", "label_b").agg(F.count("*").alias("n"))
    got = kappa_of_cells(cells, ["rater_a", "rater_b"], "label_a", "label_b")
    return got.withColumn("agreement", F.round("agreement", 3)).withColumn("enough_items", F.col("n") >= MIN_PAIR_ITEMS)


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """One row n_items, kappa over items with two or more ratings; NULL if chance agreement is total."""
    counts = ratings.groupBy("item_id", "label").agg(F.count("*").alias("c"))
    items = counts.groupBy("item_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq")).where("n >= 2")
    p_bar = items.agg(F.count("*").alias("n_items"), F.avg((F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("p_bar"), F.sum("n").alias("n_all"))
    shares = counts.join(items.select("item_id"), "item_id", "left_semi").groupBy("label").agg(F.sum("c").alias("c"))
    p_e = shares.agg(F.sum(F.col("c") * F.col("c")).alias("sq"))
    joined = p_bar.crossJoin(p_e).withColumn("p_e", F.col("sq") / F.nullif(F.col("n_all") * F.col("n_all"), F.lit(0)))
    return joined.select("n_items", F.when(F.col("p_e") < 1.0 - 1e-9, (F.col("p_bar") - F.col("p_e")) / F.nullif(1.0 - F.col("p_e"), F.lit(0.0))).alias("kappa"))


def majority(ratings: DataFrame, min_raters: int = 1) -> DataFrame:
    """item_id, label, raters, tie: the most frequent label; ambiguous if two are as frequent."""
    counts = ratings.groupBy("item_id", "label").agg(F.count("*").alias("c"))
    top = counts.groupBy("item_id").agg(F.sum("c").alias("raters"), F.max("c").alias("m"))
    best = counts.join(top, "item_id").where("c = m").groupBy("item_id", "raters").agg(F.count("*").alias("k"), F.min("label").alias("one"))
    return best.where(F.col("raters") >= min_raters).select("item_id", F.when(F.col("k") > 1, "ambiguous").otherwise(F.col("one")).alias("label"), "raters", (F.col("k") > 1).alias("tie"))


def majority_stats(ratings: DataFrame, skipped: DataFrame, min_raters: int = 1) -> DataFrame:
    """One row: raters, items, ties of the majority labels, and bad_lines, what read_ratings skipped."""
    found = majority(ratings, min_raters).agg(F.count("*").alias("items"), F.count_if("tie").alias("ties"))
    raters = ratings.agg(F.countDistinct("rater").alias("raters"))
    return raters.crossJoin(found).crossJoin(skipped.agg(F.coalesce(F.sum("skipped"), F.lit(0)).alias("bad_lines")))


def consensus(ratings: DataFrame, adjudicator: str = "adjudicated", humans: Column | None = None) -> DataFrame:
    """item_id, label, how: adjudicated, agreed, single or unresolved (label NULL)."""
    voters = ratings.where(F.col("rater") != adjudicator)
    if humans is not None:
        voters = voters.where(humans)
    votes = voters.groupBy("item_id").agg(F.count("*").alias("votes"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    settled = ratings.where(F.col("rater") == adjudicator).select("item_id", F.col("label").alias("settled"))
    both = votes.join(settled, "item_id", "full")
    agreed = F.col("lo") == F.col("hi")
    how = F.when(F.col("settled").isNotNull(), "adjudicated").when(agreed & (F.col("votes") > 1), "agreed").when(agreed, "single").otherwise("unresolved")
    return both.select("item_id", F.coalesce("settled", F.when(agreed, F.col("lo"))).alias("label"), how.alias("how"))


def two_rater_consensus(ratings: DataFrame, a: str, b: str, adjudicator: str = "adjudicated") -> DataFrame:
    """item_id, label where both raters agree, or where the adjudicator has settled it."""
    votes = ratings.where(F.col("rater").isin(a, b)).groupBy("item_id").agg(F.count("*").alias("votes"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    settled = ratings.where(F.col("rater") == adjudicator).select("item_id", F.col("label").alias("settled"))
    label = F.coalesce("settled", F.when((F.col("votes") == 2) & (F.col("lo") == F.col("hi")), F.col("lo")))
    return votes.join(settled, "item_id", "full").select("item_id", label.alias("label")).where("label is not null")


def disagreements(ratings: DataFrame) -> DataFrame:
    """item_id, votes (rater, label) of items whose raters don't all agree."""
    got = ratings.groupBy("item_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.array_sort(F.collect_list(F.struct("rater", "label"))).alias("votes"))
    return got.where("lo <> hi").select("item_id", "votes")


def confusion(ratings: DataFrame, a: str, b: str, labels: Iterable[str] = LABELS) -> DataFrame:
    """One row a label of rater a, one column a label of rater b, zeros included."""
    left = ratings.where(F.col("rater") == a).select("item_id", F.col("label").alias("label_a"))
    right = ratings.where(F.col("rater") == b).select("item_id", F.col("label").alias("label_b"))
    counts = left.join(right, "item_id").groupBy("label_a").pivot("label_b", list(labels)).agg(F.count(F.lit(1)))
    every = ratings.sparkSession.createDataFrame([(x,) for x in labels], "label_a string")
    return every.join(counts, "label_a", "left").na.fill(0)


def label_counts(ratings: DataFrame, labels: Iterable[str] = LABELS) -> DataFrame:
    return ratings.groupBy("rater").pivot("label", list(labels)).agg(F.count(F.lit(1))).na.fill(0)


def against_truth(annotations: DataFrame, truth: DataFrame) -> DataFrame:
    """label, n_truth, n_given, n_right, precision, recall of annotations (item_id, label) by truth (item_id, label)."""
    both = annotations.join(truth.select("item_id", F.col("label").alias("truth")), "item_id")
    each = both.select(F.inline(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("g"), F.lit(0).alias("r")), F.struct(F.col("label"), F.lit(0).alias("t"), F.lit(1).alias("g"), (F.col("label") == F.col("truth")).cast("int").alias("r")))))
    got = each.groupBy("label").agg(F.sum("t").alias("n_truth"), F.sum("g").alias("n_given"), F.sum("r").alias("n_right"))
    return got.select("*", (F.col("n_right") / F.nullif(F.col("n_given"), F.lit(0))).alias("precision"), (F.col("n_right") / F.nullif(F.col("n_truth"), F.lit(0))).alias("recall"))


def truth_agreement(annotations: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: n, agreement, kappa of annotations (item_id, label) and truth over the labels that occur."""
    both = annotations.select("item_id", F.col("label").alias("a")).join(truth.select("item_id", F.col("label").alias("b")), "item_id")
    return kappa_of_cells(both.groupBy("a", "b").agg(F.count("*").alias("n")), [], "a", "b")


def truth_disagreements(annotations: DataFrame, truth: DataFrame) -> DataFrame:
    """item_id, label, truth of the annotations that differ from the truth."""
    both = annotations.select("item_id", "label").join(truth.select("item_id", F.col("label").alias("truth")), "item_id")
    return both.where(~F.col("label").eqNullSafe(F.col("truth")))


def agreement_intervals(one: DataFrame, other: DataFrame, key: DataFrame, draws: int, seed: int = 42) -> DataFrame:
    """agreement_by_subset with the interval lo, hi of each kappa over draws of items: order statistics of the replicates.

    Items are drawn as counts of the cells (model, label, label), which overall adds up: all subsets see the same draws.
    """
    from evalspark.operators.bootstrap import cell_replicates, order_statistics

    both = one.select("item_id", F.col("label").alias("a")).join(other.select("item_id", F.col("label").alias("c")), "item_id").join(key.select("item_id", "model"), "item_id")
    drawn = cell_replicates(both.groupBy("model", "a", "c").agg(F.count("*").alias("n")), ["model", "a", "c"], "n", draws, seed)
    cells = drawn.select("b", "n", "a", "c", F.explode(F.array("model", F.lit("overall"))).alias("subset")).groupBy("subset", "b", "a", "c").agg(F.sum("n").alias("n"))
    spans = order_statistics(kappa_of_cells(cells, ["subset", "b"], "a", "c"), "kappa", ["subset"])
    return agreement_by_subset(one, other, key).join(spans, "subset", "left")


def agreement_by_subset(one: DataFrame, other: DataFrame, key: DataFrame) -> DataFrame:
    """subset (each model, and overall), n, agreement, kappa, passes of two label tables; key: item_id, model."""
    both = one.select("item_id", F.col("label").alias("a")).join(other.select("item_id", F.col("label").alias("b")), "item_id").join(key.select("item_id", "model"), "item_id")
    cells = both.select("a", "b", F.explode(F.array("model", F.lit("overall"))).alias("subset")).groupBy("subset", "a", "b").agg(F.count("*").alias("n"))
    return kappa_of_cells(cells, ["subset"], "a", "b").withColumn("passes", F.col("kappa") >= KAPPA_GATE)


def allocate(counts: DataFrame, n: int, floor: int, keys: list[str] | None = None) -> DataFrame:
    """counts (label, k) with take: floor of each stratum, the rest in proportion, largest remainder, ties by label."""
    keys = keys or []
    over = Window.partitionBy(*keys) if keys else Window.partitionBy()
    base = counts.withColumn("_floor", F.least("k", F.lit(floor)))
    base = base.withColumn("_left", F.col("k") - F.col("_floor")).withColumn("_total", F.sum("_left").over(over)).withColumn("_rest", n - F.sum("_floor").over(over))
    bad = (F.sum("k").over(over) < n) | (F.col("_rest") < 0)
    base = base.withColumn("_rest", F.when(bad, F.raise_error(F.lit(f"can't draw {n} with a floor of {floor}")).cast("long")).otherwise(F.col("_rest")))
    share = F.col("_rest") * F.col("_left")
    base = base.withColumn("_whole", F.coalesce(F.expr("_rest * _left div nullif(_total, 0)"), F.lit(0))).withColumn("_frac", F.coalesce(share % F.nullif(F.col("_total"), F.lit(0)), F.lit(0)))
    base = base.withColumn("_short", F.when(F.col("_total") > 0, F.col("_rest") - F.sum("_whole").over(over)).otherwise(0))
    base = base.withColumn("_rank", F.row_number().over(over.orderBy(F.col("_frac").desc(), "label")))
    take = F.col("_floor") + F.col("_whole") + (F.col("_rank") <= F.col("_short")).cast("long")
    return base.select(*counts.columns, take.alias("take"))


def hash_order(seed: int, item: str = "item_id") -> Column:
    return F.sha1(F.encode(F.concat(F.lit(f"{seed}\x1f"), F.col(item)), "UTF-8"))


def stratified_sample(errors: DataFrame, n: int, floor: int, seed: int = 42) -> DataFrame:
    """errors (model, label, item_id): n of each model, allocated to labels; those first in hash order.

    Of a label's 4,096 hash ranges only those that the sample reaches into are ranked, each by itself.
    """
    strata, ranged = ["model", "label"], errors.withColumn("_h", hash_order(seed)).withColumn("_r", F.substring("_h", 1, 3))
    counts = ranged.groupBy(*strata, "_r").agg(F.count("*").alias("k"))
    takes = allocate(counts.groupBy(*strata).agg(F.sum("k").alias("k")), n, floor, ["model"]).drop("k")
    ahead = F.coalesce(F.sum("k").over(Window.partitionBy(*strata).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = counts.withColumn("_before", ahead).join(takes, strata).where("_before < take").drop("k")
    rank = F.row_number().over(Window.partitionBy(*strata, "_r").orderBy("_h", "item_id"))
    return ranged.join(F.broadcast(reached), [*strata, "_r"]).withColumn("_rank", rank + F.col("_before")).where("_rank <= take").select(*errors.columns)


def blind_pool(answers: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(pool, key): the wrong answers without what tells their model, and the private table that does."""
    wrong = answers.where(~F.col("correct"))
    pool = wrong.select("item_id", F.col("figure_id").alias("image_path"), "question", F.col("gold").alias("gold_answer"), F.col("prediction").alias("model_answer"), hash_order(seed).alias("shuffle_key"))
    return pool, wrong.select("item_id", "model", "figure_id", "split", "source", "occurrence")


def water_fill(loads: dict[str, int], n: int) -> dict[str, int]:
    """How many of n further items each name gets if each goes to the least loaded, ties by place in loads."""
    level = dict(loads)
    got = dict.fromkeys(loads, 0)
    while n > 0:
        low = min(level.values())
        lowest = [k for k in level if level[k] == low]
        others = [v for v in level.values() if v > low]
        step = min(n // len(lowest), min(others) - low) if others else n // len(lowest)
        if step == 0:
            lowest, step = lowest[:n], 1
        for k in lowest:
            level[k] += step
            got[k] += step
        n -= step * len(lowest)
    return got


def assign(pool: DataFrame, annotators: list[str], overlap: int, seed: int = 42) -> DataFrame:
    """annotator, item_id: the first overlap items in hash order to two annotators each, the rest to the least loaded."""
    pairs = list(combinations(annotators, 2))
    ranges = pool.withColumn("_h", hash_order(seed)).withColumn("_r", F.substring("_h", 1, 3))
    totals = ranges.groupBy("_r").count()
    before = totals.select("_r", (F.sum("count").over(Window.orderBy("_r")) - F.col("count")).alias("_b"))
    ranked = ranges.join(before, "_r").withColumn("_n", F.col("_b") + F.row_number().over(Window.partitionBy("_r").orderBy("_h", "item_id")) - 1)
    loads = dict.fromkeys(annotators, 0)
    for i, pair in enumerate(pairs):
        for name in pair:
            loads[name] += overlap // len(pairs) + (i < overlap % len(pairs))
    quotas = water_fill(loads, max(0, pool.count() - overlap))
    edges, edge = [], overlap
    for name in annotators:
        edge += quotas[name]
        edges.append((name, edge))
    solo = F.lit(None).cast("string")
    for name, edge in reversed(edges):
        solo = F.when(F.col("_n") < edge, name).otherwise(solo)
    both = F.element_at(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in pairs]), (F.col("_n") % len(pairs) + 1).cast("int"))
    return ranked.select(F.explode(F.when(F.col("_n") < overlap, both).otherwise(F.array(solo))).alias("annotator"), "item_id")


def batches(pool: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """pool with batch numbers from 1, of size items each, in hash order within 4,096 hash ranges laid end to end."""
    ranges = pool.withColumn("_h", hash_order(seed)).withColumn("_r", F.substring("_h", 1, 3))
    before = ranges.groupBy("_r").count().select("_r", (F.sum("count").over(Window.orderBy("_r")) - F.col("count")).alias("_b"))
    place = F.col("_b") + F.row_number().over(Window.partitionBy("_r").orderBy("_h", "item_id")) - 1
    return ranges.join(before, "_r").withColumn("batch", (F.floor(place / size) + 1).cast("long")).drop("_h", "_r", "_b")
