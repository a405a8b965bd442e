"""Scoring of answers, typing of errors, and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions import text as X
from evalspark.operators.labels import REAL_ERRORS, last_labels

# Question templates and class letters.
FAMILY = {"read_value": "value", "absent_value": "value", "absent_category": "value", "compare_present": "compare", "absent_compare": "compare", "neighbor_present": "neighbor", "absent_neighbor": "neighbor"}
VALUE_TEMPLATES = ("read_value", "absent_category", "absent_value")
OUTCOME_CLASS = {"fabricated": "F", "zero": "Z", "rejected": "R", "unclear": "U"}
LABEL_CLASS = {"structural": "S", "computation": "K", "fabrication": "F", "not_an_error": "N"}
TRANSFER_CLASS = {"structural": "S", "computation": "P", "fabrication": "F"}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def score(items: DataFrame, prediction: str = "prediction") -> DataFrame:
    """items with outcome and correct; a question about something absent is right only if it is rejected."""
    p = F.col(prediction)
    outcome = (
        F.when(~F.col("absent"), F.lit(None).cast("string"))
        .when(F.col("template") == "absent_compare", X.classify_compare(p, F.col("asks_about"), F.col("compared_with"), F.col("categories")))
        .when(F.col("template") == "absent_neighbor", X.classify_neighbor(p, F.col("categories")))
        .otherwise(X.classify_absent(p))
    )
    scored = items.withColumn("outcome", outcome)
    return scored.withColumn("correct", F.when(F.col("absent"), F.col("outcome") == "rejected").otherwise(X.is_correct(F.col("gold"), p)))


def rescore(answers: DataFrame, figures: DataFrame) -> DataFrame:
    """answers scored again by the present rules, with their figure's categories."""
    return score(answers.drop("outcome", "correct").join(figures.select("figure_id", "categories"), "figure_id"))


def synthetic_class(scheme: str = "types") -> Column:
    """Class letter of a scored synthetic item. types: C S F Z; scores: and R; pilot: all templates, and U."""
    seen = F.when(F.col("correct"), "C").otherwise("S")
    letters = {"types": "FZ", "scores": "FZR", "pilot": "FZRU"}[scheme]
    kept = {k: v for k, v in OUTCOME_CLASS.items() if v in letters}
    got = F.when(~F.col("absent"), seen).otherwise(lookup(kept, F.col("outcome")))
    return got if scheme == "pilot" else F.when(F.col("template").isin(*VALUE_TEMPLATES), got)


def natural_class(label: Column, table: dict[str, str] | None = None) -> Column:
    """Class letter of a natural item: C if right, else by its label; NULL leaves it out."""
    return F.when(F.col("correct"), "C").otherwise(lookup(table or LABEL_CLASS, label))


def _contrasts() -> dict[str, tuple[Column, Column]]:
    family, outcome = lookup(FAMILY, F.col("template")), F.col("outcome")
    made_up = outcome == "fabricated"
    value = (F.col("template") == "absent_value") & outcome.isin("fabricated", "zero")
    return {
        "absent_value_vs_present": (family == "value", F.col("absent")),
        "absent_compare_vs_present": (family == "compare", F.col("absent")),
        "absent_neighbor_vs_present": (family == "neighbor", F.col("absent")),
        "value_fab_vs_zero": (value, made_up),
        "value_fab_vs_zero_lookalike": (value & F.col("lookalike_of").isNotNull(), made_up),
        "compare_fab_vs_present": ((F.col("template") == "absent_compare") & outcome.isin("fabricated", "picked_present"), made_up),
        "read_misread": (F.col("template") == "read_value", ~F.col("correct")),
    }


def contrast_rows(scored: DataFrame) -> DataFrame:
    """contrast, y and the columns of scored, for each contrast that a row is in: one pass over the rows."""
    cells = [F.when(F.coalesce(rows, F.lit(False)), F.struct(F.lit(name).alias("contrast"), label.cast("int").alias("y"))) for name, (rows, label) in _contrasts().items()]
    each = scored.withColumn("_c", F.explode(F.array_compact(F.array(*cells))))
    return each.select(F.col("_c.contrast").alias("contrast"), F.col("_c.y").alias("y"), *scored.columns)


def relaxed_accuracy(answers: DataFrame, tolerance: float = X.TOLERANCE) -> DataFrame:
    right = X.is_correct(F.col("gold"), F.col("prediction"), tolerance)
    return answers.agg(F.coalesce(F.avg(right.cast("int")), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))


def split_stats(items: DataFrame) -> DataFrame:
    """split, source, questions, figures, questions_per_figure; NULLs are the totals, figures counted across groups."""
    got = items.rollup("split", "source").agg(F.grouping_id().alias("_g"), F.count("*").alias("questions"), F.countDistinct("figure_id").alias("figures"))
    got = got.where("_g in (0, 3)")
    return got.select("split", "source", "questions", "figures", (F.col("questions") / F.col("figures")).alias("questions_per_figure"))


def run_summary(scored: DataFrame) -> DataFrame:
    """kind, name, n, n_correct, error_rate: overall, by source, by template and answerable only, by grouping sets in one pass."""
    base = scored.select(F.col("source"), F.col("template"), F.col("absent"), F.col("correct").cast("int").alias("c"))
    kinds = F.inline(F.array(F.struct(F.lit("overall").alias("kind"), F.lit("all").alias("name")), F.struct(F.lit("source").alias("kind"), F.col("source").alias("name")), F.struct(F.lit("template").alias("kind"), F.col("template").alias("name")), F.struct(F.lit("answerable").alias("kind"), F.when(~F.col("absent"), "all").alias("name"))))
    got = base.select("c", kinds).where("name is not null").groupBy("kind", "name").agg(F.count("*").alias("n"), F.sum("c").alias("n_correct"))
    return got.withColumn("error_rate", F.round(1.0 - F.col("n_correct") / F.col("n"), 4))


def absent_outcomes(scored: DataFrame) -> DataFrame:
    """template, outcome, n of questions about what isn't there."""
    return scored.where("absent").groupBy("template", "outcome").agg(F.count("*").alias("n"))


def vision_tokens(answers: DataFrame, low: int, high: int) -> DataFrame:
    n = F.col("n_vision_tokens")
    return answers.agg(F.min(n).alias("lowest"), F.max(n).alias("highest"), F.avg(n).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"), F.count_if((n < low) | (n > high)).alias("outside"))


def labelled(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """answers with label and reason, the last label of each item; labels NULL where there is none."""
    last = last_labels(labels, ["item_id"]).select("item_id", "label", "reason")
    return answers.join(last, "item_id", "left")


def error_report(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """source, items, errors, error_rate, real_errors, gold_wrong, rescaled and unlabelled errors by source."""
    wrong = ~F.col("correct")
    real = wrong & F.col("label").isin(*REAL_ERRORS)
    return labelled(answers, labels).groupBy("source").agg(
        F.count("*").alias("items"),
        F.count_if(wrong).alias("errors"),
        F.round(F.count_if(wrong) / F.count("*"), 4).alias("error_rate"),
        F.count_if(real).alias("real_errors"),
        F.count_if(wrong & (F.col("reason") == "gold_error")).alias("gold_wrong"),
        F.count_if(wrong & F.col("label").isNotNull() & X.rescaled_match(F.col("gold"), F.col("prediction"))).alias("rescaled"),
        F.count_if(wrong & F.col("label").isNull()).alias("unlabelled"),
    )


def label_histogram(answers: DataFrame, labels: DataFrame, labels_known: tuple[str, ...]) -> DataFrame:
    return labelled(answers, labels).where(~F.col("correct")).groupBy("source").pivot("label", list(labels_known)).agg(F.count(F.lit(1))).na.fill(0)


def reason_counts(answers: DataFrame, labels: DataFrame) -> DataFrame:
    return labelled(answers, labels).where(~F.col("correct") & F.col("label").isNotNull()).groupBy("label", "reason").agg(F.count("*").alias("n"))


def accuracies(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: relaxed accuracy, and with rescaled or not-an-error answers counted right."""
    wrong = ~F.col("correct")
    n, e = F.count("*"), F.count_if(wrong)
    rescaled = F.count_if(wrong & X.rescaled_match(F.col("gold"), F.col("prediction")))
    fine = F.count_if(wrong & (F.col("label") == "not_an_error"))
    rate = lambda k: F.round(1.0 - k / F.nullif(n, F.lit(0)), 4)
    return labelled(answers, labels).agg(rate(e).alias("relaxed"), rate(e - rescaled).alias("rescaled_right"), rate(e - fine).alias("not_an_error_right"))


def coverage_gaps(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: errors without a label, and labels of items that are no errors; both 0 if labels cover the errors exactly."""
    wrong = answers.where(~F.col("correct")).select("item_id", F.lit(1).alias("w"))
    both = wrong.join(labels.select("item_id", F.lit(1).alias("l")).distinct(), "item_id", "full")
    return both.agg(F.count_if(F.col("l").isNull()).alias("unlabelled"), F.count_if(F.col("w").isNull()).alias("extra"))


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of work whose keys aren't done."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def pilot_outcomes(answers: DataFrame, figures: DataFrame, tolerance: float = X.TOLERANCE) -> DataFrame:
    """direction, n, fabricated, copies_bar, near_line: made-up numbers that copy a shown bar, or lie on its extrapolation."""
    joined = answers.join(figures.select("figure_id", "values"), "figure_id").withColumn("p", X.loose_number(F.col("prediction")))
    made_up = F.col("outcome") == "fabricated"
    copies = F.exists("values", lambda v: X.within(v.cast("double"), F.col("p"), tolerance))
    near = X.within(F.col("extrapolated"), F.col("p"), tolerance)
    return joined.groupBy("direction").agg(F.count("*").alias("n"), F.count_if(made_up).alias("fabricated"), F.count_if(made_up & copies).alias("copies_bar"), F.count_if(made_up & near).alias("near_line"))


def ranked(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in an order: each task keeps its n, and one task those of all."""
    return rows.orderBy(*order).limit(n)
