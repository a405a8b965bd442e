"""Interventions on wrong answers: plans, recovery rates, contrasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import question_targets

# The actions.
BASELINE, ABSTAIN = "I_0", "I_abstain"
REPAIRS = ("I_reask", "I_upsample", "I_crop", "I_verify")
TRANSITIONS = ("rejected", "zero", "fabricated")


def plan(items: DataFrame, repairs: tuple[str, ...] = REPAIRS) -> DataFrame:
    """item_id, intervention, applicable, note: a crop needs the figure's geometry, and shows the whole figure if no bar is named."""
    each = items.withColumn("intervention", F.explode(F.array(*map(F.lit, repairs))))
    crop = F.col("intervention") == "I_crop"
    named = F.size(question_targets(F.col("question"), F.col("categories"))) > 0
    note = F.when(crop & F.col("has_geometry") & ~named, "named category absent; whole figure shown")
    return each.select("item_id", "intervention", (~crop | F.col("has_geometry")).alias("applicable"), note.alias("note"))


def recovery(outcomes: DataFrame) -> DataFrame:
    """failure_type, intervention, n, recovered, rate of each observed cell."""
    r = F.col("recovered").cast("int")
    return outcomes.groupBy("failure_type", "intervention").agg(F.count("*").alias("n"), F.sum(r).alias("recovered"), F.avg(r).alias("rate"))


def cell_rate(kind: str, action: str) -> Column:
    inside = (F.col("failure_type") == kind) & (F.col("intervention") == action)
    return F.sum(F.when(inside, F.col("recovered").cast("double") * F.col("w"))) / F.nullif(F.sum(F.when(inside, F.col("w").cast("double"))), F.lit(0.0))


def did(intervention: str, baseline: str = BASELINE) -> Column:
    """How much more the intervention helps structural than fabricated errors, over rows with weight w."""
    if intervention == ABSTAIN:
        raise ValueError("I_abstain recovers nothing; it belongs to the risk-coverage policies")
    return (cell_rate("structural", intervention) - cell_rate("structural", baseline)) - (cell_rate("fabrication", intervention) - cell_rate("fabrication", baseline))


def difference_in_differences(outcomes: DataFrame, intervention: str, baseline: str = BASELINE) -> DataFrame:
    return outcomes.withColumn("w", F.lit(1)).agg(did(intervention, baseline).alias("delta"))


def best_repairs(outcomes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, failure_type, best: the intervention with the highest rate, of equal ones the larger name."""
    keys = keys or []
    w = F.col("w") if "w" in outcomes.columns else F.lit(1)
    cells = outcomes.where((F.col("intervention") != ABSTAIN) & F.col("failure_type").isin("structural", "fabrication"))
    cells = cells.groupBy(*keys, "failure_type", "intervention").agg((F.sum(F.col("recovered").cast("double") * w) / F.nullif(F.sum(w.cast("double")), F.lit(0.0))).alias("rate"))
    return cells.where("rate is not null").groupBy(*keys, "failure_type").agg(F.max_by("intervention", F.struct("rate", "intervention")).alias("best"))


def transitions(outcomes: DataFrame) -> DataFrame:
    """failure_type, intervention and how many answers became rejected, zero, fabricated or other."""
    kind = F.when(F.col("outcome").isin(*TRANSITIONS), F.col("outcome")).otherwise("other")
    return outcomes.withColumn("_o", kind).groupBy("failure_type", "intervention").pivot("_o", [*TRANSITIONS, "other"]).agg(F.count(F.lit(1))).na.fill(0)


def pivoted(outcomes: DataFrame, actions: tuple[str, ...] = (BASELINE, *REPAIRS)) -> DataFrame:
    """item_id and a boolean column for each action, of applicable outcomes."""
    return outcomes.where("coalesce(applicable, true)").groupBy("item_id").pivot("intervention", list(actions)).agg(F.max("recovered"))


def universe(scores: DataFrame, outcomes: DataFrame) -> DataFrame:
    """scores joined with their five outcomes; an error when a scored item lacks one."""
    wide = scores.join(pivoted(outcomes), "item_id", "left")
    lacks = F.lit(False)
    for action in (BASELINE, *REPAIRS):
        lacks = lacks | F.col(action).isNull()
    return wide.withColumn("item_id", F.when(lacks, F.raise_error(F.concat(F.lit("an outcome is missing for item "), F.col("item_id").cast("string"))).cast(wide.schema["item_id"].dataType)).otherwise(F.col("item_id")))


def relook_effect(rows: DataFrame) -> DataFrame:
    """cls, n, relooked, fixed, broken from rows with cls, relooked, before, after."""
    return rows.groupBy("cls").agg(F.count("*").alias("n"), F.count_if("relooked").alias("relooked"), F.count_if(F.col("after") & ~F.col("before")).alias("fixed"), F.count_if(~F.col("after") & F.col("before")).alias("broken"))


def edge_crossings(edges: DataFrame) -> DataFrame:
    """figure_id, crossings of edges (figure_id, eid, a, b, ax, ay, bx, by): pairs of different eid without a shared node that cross strictly. Figures of one eid have no row.

    Each figure has grids of 1, 4, 16 ... cells, up to about one for each two edges. An edge stands in the grid whose cells are the smallest that its
    box fits into, and so in four cells of it at most, and in the cells of its box in all coarser grids; it meets the edges of its own grid
    and of finer ones. Edges that are far from each other have no cell in common, a figure's cells are dealt to all tasks, and a pair that shares several
    cells counts in the first of them.
    """
    low = lambda c: F.least(F.col(f"a{c}"), F.col(f"b{c}"))
    high = lambda c: F.greatest(F.col(f"a{c}"), F.col(f"b{c}"))
    frames = edges.groupBy("figure_id").agg(F.count("*").alias("_k"), (F.min("eid") < F.max("eid")).alias("_pairs"), F.min(low("x")).alias("_x"), F.min(low("y")).alias("_y"), F.max(high("x")).alias("_xx"), F.max(high("y")).alias("_yy"))
    frames = frames.where("_pairs").select(F.col("figure_id").alias("_f"), "_k", "_x", "_y", F.greatest(F.col("_xx") - F.col("_x"), F.col("_yy") - F.col("_y")).cast("double").alias("_side"))
    size = F.greatest(high("x") - low("x"), high("y") - low("y")).cast("double")
    finest = F.floor(F.log2(F.greatest(F.col("_k") / 2, F.lit(1.0))) / 2)
    fits = F.floor(F.log2(F.col("_side") / F.nullif(F.greatest(size, F.col("_side") * 1e-12), F.lit(0.0))))
    # A figure whose nodes are all at one place, or at none, has the coarsest grid alone.
    level = F.when(F.col("_side") > 0, F.greatest(F.lit(0), F.least(finest, fits))).otherwise(0).cast("int")
    placed = edges.join(frames, F.col("figure_id").eqNullSafe(F.col("_f"))).withColumn("_own", level)
    placed = placed.withColumn("_grid", F.explode(F.sequence(F.lit(0), F.col("_own"))))
    cell = lambda value, edge: F.coalesce(F.floor((value - F.col(edge)) / F.nullif(F.col("_side"), F.lit(0.0)) * F.pow(F.lit(2.0), F.col("_grid"))), F.lit(0)).cast("int")
    placed = placed.select("*", cell(low("x"), "_x").alias("_x0"), cell(high("x"), "_x").alias("_x1"), cell(low("y"), "_y").alias("_y0"), cell(high("y"), "_y").alias("_y1"))
    placed = placed.withColumn("_cx", F.explode(F.sequence("_x0", "_x1"))).withColumn("_cy", F.explode(F.sequence("_y0", "_y1")))
    kept = ["eid", "a", "b", "ax", "ay", "bx", "by", "_own", "_x0", "_y0"]
    p = placed.where("_own = _grid").select("figure_id", "_grid", "_cx", "_cy", *[F.col(c).alias(f"p_{c}") for c in kept])
    q = placed.select(F.col("figure_id").alias("_g"), *[F.col(c).alias(f"q{c}") for c in ("_grid", "_cx", "_cy")], *[F.col(c).alias(f"q_{c}") for c in kept])

    def side(x1: str, y1: str, x2: str, y2: str, x3: str, y3: str) -> Column:
        c = F.col
        return F.signum((c(x2) - c(x1)) * (c(y3) - c(y1)) - (c(y2) - c(y1)) * (c(x3) - c(x1)))

    apart = ~(F.col("p_a").isin(F.col("q_a"), F.col("q_b")) | F.col("p_b").isin(F.col("q_a"), F.col("q_b")))
    one = side("p_ax", "p_ay", "p_bx", "p_by", "q_ax", "q_ay") * side("p_ax", "p_ay", "p_bx", "p_by", "q_bx", "q_by")
    two = side("q_ax", "q_ay", "q_bx", "q_by", "p_ax", "p_ay") * side("q_ax", "q_ay", "q_bx", "q_by", "p_bx", "p_by")
    meet = F.col("figure_id").eqNullSafe(F.col("_g")) & (F.col("_grid") == F.col("q_grid")) & (F.col("_cx") == F.col("q_cx")) & (F.col("_cy") == F.col("q_cy"))
    once = (F.col("p_eid") < F.col("q_eid")) | ((F.col("p_eid") > F.col("q_eid")) & (F.col("q__own") > F.col("p__own")))
    first = (F.col("_cx") == F.greatest("p__x0", "q__x0")) & (F.col("_cy") == F.greatest("p__y0", "q__y0"))
    crossed = p.join(q, meet & once & first).where(apart & (one < 0) & (two < 0)).groupBy(F.col("figure_id").alias("_c")).agg(F.count("*").alias("crossings"))
    return frames.join(crossed, F.col("_f").eqNullSafe(F.col("_c")), "left").select(F.col("_f").alias("figure_id"), F.coalesce("crossings", F.lit(0)).cast("long").alias("crossings"))
