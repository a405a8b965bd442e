"""Selective prediction: when to look again, when to abstain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators.metrics import aurc, prefix_sums, quantile_rows, stretches
from evalspark.operators.outcomes import BASELINE, REPAIRS
from evalspark.sources.shared import written

POLICIES = ("plain", "binary", "missing", "controller", "relook_binary", "oracle")


def relook_rules(items: DataFrame, repairs: tuple[str, ...] = REPAIRS, steps: int = 51) -> DataFrame:
    """fold, repair, threshold: the rule that is best on the other folds; repair NULL means never to look again.

    Thresholds are quantiles from the median up; candidates must beat the plain answer and each
    other by more than 1e-12, in the order of repairs, then thresholds. Items are counted by score; thresholds, and what looking again
    above them gains, are read off the running sums of these counts, so no task holds a fold's scores.
    """
    gains = [f"_gain{i}" for i in range(len(repairs))]
    own = items.where("misread is not null").groupBy("fold", "misread").agg(F.count("*").alias("_c"), *[F.sum(F.col(r).cast("int") - F.col(BASELINE).cast("int")).alias(g) for r, g in zip(repairs, gains)])
    folds = written(items.select("fold").distinct(), "relook-folds")
    others = own.withColumn("k", F.explode(F.array(*[F.lit(r["fold"]) for r in folds.where("fold is not null").collect()]))).where("k <> fold")
    others = others.groupBy("k", "misread").agg(*[F.sum(c).alias(c) for c in ("_c", *gains)])
    placed = prefix_sums(others, ["k"], "misread", ["_c", *gains])
    upto = [(F.col(f"before_{g}") + F.col(g)).alias(f"_upto{i}") for i, g in enumerate(gains)]
    names = [f"_upto{i}" for i in range(len(gains))]
    cuts = quantile_rows(placed.select("*", *upto), ["k"], "misread", "_c", [0.5 + 0.5 * i / (steps - 1) for i in range(steps)], names)
    whole = others.groupBy(F.col("k").alias("_k")).agg(*[F.sum(g).alias(g) for g in gains])
    each = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(r).alias("repair"), (F.col(g) - F.col(f"_upto{i}")).alias("gain")) for i, (r, g) in enumerate(zip(repairs, gains))])
    total = cuts.join(whole, F.col("k") == F.col("_k")).select("k", F.col("cut").alias("threshold"), F.inline(each))
    first = Window.partitionBy("k").orderBy(F.col("gain").desc(), "at", "threshold")
    best = total.where("gain > 0").withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return folds.join(best.select(F.col("k").alias("fold"), "repair", "threshold"), "fold", "left")


def relooked(items: DataFrame, rules: DataFrame) -> DataFrame:
    """items with relook, final: whether the fold's rule looks again, and whether the final answer is right."""
    joined = items.join(rules, "fold")
    again = F.coalesce(F.col("repair").isNotNull() & (F.col("misread") > F.col("threshold")), F.lit(False))
    value = F.col(BASELINE)
    for r in REPAIRS:
        value = F.when(again & (F.col("repair") == r), F.col(r)).otherwise(value)
    return joined.withColumn("relook", again).withColumn("final", value)


def oracle_plan(items: DataFrame, repairs: tuple[str, ...] = REPAIRS) -> DataFrame:
    """cls, action, accuracy: the best action of each true class; ties go to the plain answer, then to the earlier action."""
    actions = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(a).alias("action"), F.col(a).cast("int").alias("ok")) for i, a in enumerate((BASELINE, *repairs))])
    cells = items.select("cls", F.inline(actions)).groupBy("cls", "at", "action").agg(F.avg("ok").alias("accuracy"))
    best = Window.partitionBy("cls").orderBy(F.col("accuracy").desc(), "at")
    return cells.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("cls", "action", "accuracy")


def policies(items: DataFrame) -> DataFrame:
    """policy, item_id, figure_id, cls, ok, conf of the six policies."""
    rows = relooked(items, relook_rules(items)).join(oracle_plan(items), "cls")
    ideal = F.col(BASELINE)
    for r in REPAIRS:
        ideal = F.when(F.col("action") == r, F.col(r)).otherwise(ideal)
    cells = [
        ("plain", F.col(BASELINE), F.lit(0.0)),
        ("binary", F.col(BASELINE), -F.col("binary")),
        ("missing", F.col(BASELINE), -F.col("missing")),
        ("controller", F.col("final"), -F.col("missing")),
        ("relook_binary", F.col("final"), -F.col("binary")),
        ("oracle", ideal, F.col("accuracy")),
    ]
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("policy"), ok.alias("ok"), conf.cast("double").alias("conf")) for n, ok, conf in cells]))
    return rows.select("item_id", "figure_id", "cls", each)


def evaluate(items: DataFrame) -> DataFrame:
    """policy, n, aurc, risk at the coverages, accuracy."""
    rows = policies(items)
    placed = stretches(rows, "ok", "conf", ["policy"])
    right = rows.groupBy("policy").agg(F.avg(F.col("ok").cast("int")).alias("accuracy"))
    return aurc(placed, ["policy"]).join(right, "policy")
