"""Ranking and calibration statistics over score tables.

Running sums over all scores are taken in two steps: within ranges of (key, score), into which rows are dealt
once, then over the ranges' totals. No window holds more than a range. Rows with one confidence are one row of
counts; what their risks sum to has a closed form, so that a tie of any size costs no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.sources.shared import written

#: Harmonic numbers up to this one are listed, others computed.
LISTED = 64
#: Rows of a curve that are made at once.
CURVE_STEP = 4096


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """right with its keys renamed, and the condition that they equal left's, NULLs too."""
    right = right.withColumnsRenamed({k: f"_same_{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_same_{i}"))
    return right, on


def ranged(rows: DataFrame, keys: list[str], order: str, descending: bool = False) -> tuple[DataFrame, Column]:
    """rows, written with _part, the number of the range of (keys, order) that they are in; and the direction of order."""
    direction = F.col(order).desc() if descending else F.col(order).asc()
    return written(rows.repartitionByRange(*keys, direction).withColumn("_part", F.spark_partition_id()), "prefix"), direction


def prefix_sums(rows: DataFrame, keys: list[str], order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """rows with before_<s> for each of sums: its total over the rows of the same keys that come before in order.

    rows must have one row for each key and order value. They are cut once into ranges of (keys, order), so that a range holds as much
    of a key as a task can take, however close its values lie; a key's ranges pass on their totals.
    """
    cut, direction = ranged(rows, keys, order, descending)
    totals = cut.groupBy(*keys, "_part").agg(*[F.sum(s).alias(s) for s in sums])
    over = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_part", *[F.coalesce(F.sum(s).over(over), F.lit(0)).alias(f"_before_{s}") for s in sums])
    within = Window.partitionBy(*keys, "_part").orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    before, on = same(cut, before, [*keys, "_part"])
    return cut.join(before, on).select(*rows.columns, *[(F.coalesce(F.sum(s).over(within), F.lit(0)) + F.col(f"_before_{s}")).alias(f"before_{s}") for s in sums])


def quantile_rows(placed: DataFrame, keys: list[str], value: str, count: str, shares: list[float], keep: list[str]) -> DataFrame:
    """keys, place, cut and keep: for each of shares its exact quantile, interpolated as percentile does, and columns of the largest value up to it.

    placed: prefix sums of count over one row for each key and value. Only the rows that hold a rank leave their range; none is
    gathered: a quantile is two rows at most.
    """
    total = placed.groupBy(*keys).agg(F.sum(count).alias("_n"))
    total, on = same(placed, total, keys)
    spots = F.transform(F.array(*map(F.lit, shares)), lambda s: s * (F.col("_n") - 1))
    inside = lambda rank: (rank >= F.col(f"before_{count}")) & (rank < F.col(f"before_{count}") + F.col(count))
    held = lambda step: F.filter(F.transform(spots, lambda x, i: F.struct(i.alias("place"), x.alias("spot"))), lambda x: inside(step(x["spot"])))
    known = placed.join(total, on)
    low = known.select(*keys, F.col(value).alias("_low"), *keep, F.inline(held(F.floor)))
    high = known.select(*keys, F.col(value).alias("_high"), F.inline(held(F.ceil))).drop("spot")
    high, on = same(low, high, [*keys, "place"])
    part = F.col("spot") - F.floor("spot")
    cut = F.when(part == 0, F.col("_low")).otherwise((F.ceil("spot") - F.col("spot")) * F.col("_low") + part * F.col("_high"))
    return low.join(high, on).select(*keys, "place", cut.alias("cut"), *keep)


def average_ranks(rows: DataFrame, score: str, keys: list[str] | None = None) -> DataFrame:
    """rows with rank: the mean of the places that equal scores share, from 1."""
    keys = keys or []
    groups = rows.groupBy(*keys, score).agg(F.count("*").alias("_g"))
    placed = prefix_sums(groups, keys, score, ["_g"])
    placed = placed.withColumn("rank", F.col("before__g") + (F.col("_g") + 1) / 2.0).drop("_g", "before__g")
    placed, on = same(rows, placed, [*keys, score])
    return rows.join(placed, on).select(*rows.columns, "rank")


def auroc(rows: DataFrame, score: str, label: Column, keys: list[str] | None = None) -> DataFrame:
    """keys, n_pos, n_neg, auroc: area under the ROC curve, ties counted half; NULL with one class only."""
    keys = keys or []
    y = label.cast("int")
    groups = rows.where(y.isNotNull() & F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    placed = prefix_sums(groups, keys, score, ["neg"])
    # Twice the area in whole numbers, so that the order of summing can't change it.
    twice = F.sum(F.col("pos") * (2 * F.col("before_neg") + F.col("neg")))
    got = placed.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), twice.alias("_twice"))
    area = F.col("_twice") / F.nullif(2.0 * F.col("n_pos") * F.col("n_neg"), F.lit(0.0))
    return got.select(*keys, "n_pos", "n_neg", area.alias("auroc"))


def calibration(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """One row: ece, brier, mean_p, base_rate over equal-width bins, the last one closed."""
    binned = rows.withColumn("_bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    each = binned.groupBy("_bin").agg(F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(F.col(y).cast("double")).alias("sy"), F.sum((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("sq"))
    n = F.sum("n")
    return each.agg((F.sum(F.abs(F.col("sp") - F.col("sy"))) / n).alias("ece"), (F.sum("sq") / n).alias("brier"), (F.sum("sp") / n).alias("mean_p"), (F.sum("sy") / n).alias("base_rate"))


def harmonic_difference(low: Column, g: Column) -> Column:
    """1 / (low + 1) + ... + 1 / (low + g)."""
    small = [sum(1.0 / i for i in range(1, n + 1)) for n in range(LISTED + 1)]

    def rest(n: Column) -> Column:
        return 1 / (2 * n) - 1 / (12 * n * n) + 1 / (120 * n * n * n * n)

    def whole(n: Column) -> Column:
        x = n.cast("double")
        return F.when(n <= LISTED, F.get(F.array(*map(F.lit, small)), F.least(n, F.lit(LISTED)).cast("int"))).otherwise(F.log(x) + 0.5772156649015329 + rest(x))

    a, b = low.cast("double"), (low + g).cast("double")
    return F.when(low <= LISTED, whole(low + g) - whole(low)).otherwise(F.log1p(g / a) + rest(b) - rest(a))


def tied_area(before_g: Column, before_e: Column, g: Column, e: Column) -> Column:
    """The sum of the risks of a tie of g rows with e errors after before_g rows with before_e errors."""
    return e + (before_e - before_g * e / g) * harmonic_difference(before_g, g)


def stretches(rows: DataFrame, ok: str, conf: str, keys: list[str] | None = None) -> DataFrame:
    """keys, conf, g, e, before_g, before_e, n: rows and errors of each confidence, and of the higher ones."""
    keys = keys or []
    groups = rows.groupBy(*keys, conf).agg(F.count("*").alias("g"), F.sum(F.when(F.col(ok), 0).otherwise(1)).alias("e"))
    placed = prefix_sums(groups, keys, conf, ["g", "e"], descending=True)
    total = groups.groupBy(*keys).agg(F.sum("g").alias("n")) if keys else groups.agg(F.sum("g").alias("n"))
    if not keys:
        return placed.crossJoin(total)
    total, on = same(placed, total, keys)
    return placed.join(total, on).select(*placed.columns, "n")


def _risk_at(k: Column) -> Column:
    return (F.col("before_e") + (k - F.col("before_g")) * F.col("e") / F.col("g")) / k


def risk_coverage(rows: DataFrame, ok: str, conf: str, keys: list[str] | None = None) -> DataFrame:
    """keys, k, n, risk: expected error rate of the k most confident rows; ties share their errors evenly. One row a k, made a few thousand at a time."""
    steps = stretches(rows, ok, conf, keys).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1, F.lit(CURVE_STEP).cast("long"))))
    steps = steps.withColumn("_k", F.explode(F.sequence(F.col("_i") + 1, F.least(F.col("_i") + CURVE_STEP, F.col("g")))))
    k = F.col("before_g") + F.col("_k")
    return steps.select(*(keys or []), k.alias("k"), "n", _risk_at(k).alias("risk"))


def aurc(placed: DataFrame, keys: list[str] | None = None, coverages: tuple[float, ...] = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)) -> DataFrame:
    """keys, n, aurc and risk_100, risk_90 ...: the mean risk and the risk at each coverage, from stretches."""
    at = lambda c: F.greatest(F.lit(1.0), F.rint(F.lit(c) * F.col("n")))
    within = lambda k: (k > F.col("before_g")) & (k <= F.col("before_g") + F.col("g"))
    picks = [F.max(F.when(within(at(c)), _risk_at(at(c)))).alias(f"risk_{round(100 * c)}") for c in coverages]
    area = F.sum(tied_area(F.col("before_g"), F.col("before_e"), F.col("g"), F.col("e"))) / F.sum("g")
    return placed.groupBy(*(keys or [])).agg(F.max("n").alias("n"), area.alias("aurc"), *picks)


def summary(rows: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """keys, mean, sd (of the sample), min, max."""
    return rows.groupBy(*(keys or [])).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
