"""Data-quality operators: each returns what is wrong as rows, nothing when all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions import ids
from evalspark.operators.labels import LABELS, REASONS


def _problems(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key, problem for each check that is true of a row."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    return rows.select(key, F.explode(found).alias("problem"))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1 or " + key + " is null")


def check_answers(answers: DataFrame, model: str, required: tuple[str, ...]) -> DataFrame:
    """item_id, problem: missing fields, another model, an id that isn't the hash of its parts."""
    minted = ids.item_id(F.col("model"), F.col("source"), F.col("figure_id"), F.col("question"), F.col("occurrence"))
    checks = {f"no {c}": F.col(c).isNull() for c in required}
    return _problems(answers, "item_id", checks | {"other model": F.col("model") != model, "id differs": F.col("item_id") != minted})


def check_vectors(vectors: DataFrame, width: int) -> DataFrame:
    """layer, position, n, repeated, odd_width, not_finite: what is wrong in each part of a vector table; clean parts are left out."""
    odd = F.exists("vec", lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    got = vectors.groupBy("layer", "position").agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("item_id")).alias("repeated"), F.count_if(F.size("vec") != width).alias("odd_width"), F.count_if(odd).alias("not_finite"))
    return got.where("repeated > 0 or odd_width > 0 or not_finite > 0")


def missing_cells(vectors: DataFrame, expected: DataFrame) -> DataFrame:
    """layer, position of expected that the table lacks."""
    return expected.join(vectors.select("layer", "position").distinct(), ["layer", "position"], "left_anti")


def id_gaps(vectors: DataFrame, answers: DataFrame) -> DataFrame:
    """item_id, side: ids that only one of the tables has."""
    both = vectors.select("item_id").distinct().withColumn("v", F.lit(1)).join(answers.select("item_id").distinct().withColumn("a", F.lit(1)), "item_id", "full")
    return both.where("v is null or a is null").select("item_id", F.when(F.col("v").isNull(), "answers").otherwise("vectors").alias("side"))


def misaligned(vectors: DataFrame, answers: DataFrame) -> DataFrame:
    """item_id, figure_id, other: items that the two tables put on different figures."""
    both = vectors.select("item_id", "figure_id").distinct().join(answers.select("item_id", F.col("figure_id").alias("other")).distinct(), "item_id")
    return both.where(~F.col("figure_id").eqNullSafe(F.col("other")))


def check_labels(labels: DataFrame, batch: DataFrame) -> DataFrame:
    """item_id, problem of a batch of labels: unknown labels, wrong reasons, empty rationales, ids that don't fit the batch."""
    known = F.create_map(*[x for k, v in REASONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    allowed = F.element_at(known, F.col("label"))
    checks = {
        "unknown label": F.col("label").isNull() | ~F.col("label").isin(*LABELS),
        "needs a reason": allowed.isNotNull() & ~F.coalesce(F.array_contains(allowed, F.col("reason")), F.lit(False)),
        "takes no reason": F.col("label").isin(*LABELS) & allowed.isNull() & F.col("reason").isNotNull(),
        "empty rationale": F.trim(F.coalesce("rationale", F.lit(""))) == "",
    }
    rows = _problems(labels, "item_id", checks)
    counts = labels.groupBy("item_id").agg(F.count("*").alias("n")).join(batch.groupBy("item_id").agg(F.count("*").alias("m")), "item_id", "full")
    wrong = _problems(counts, "item_id", {"missing": F.col("n").isNull(), "unexpected": F.col("m").isNull(), "repeated": F.col("n") > 1})
    return rows.union(wrong)


def check_corrections(corrections: DataFrame, done: DataFrame) -> DataFrame:
    """item_id of corrections to items that have no label yet."""
    return corrections.select("item_id").join(done.select("item_id"), "item_id", "left_anti").distinct()


def manifest_warnings(manifest: DataFrame) -> DataFrame:
    """pos, warning: rows that repeat a figure and question, and empty predictions."""
    again = F.row_number().over(Window.partitionBy("figure_id", "question").orderBy("pos")) > 1
    return _problems(manifest.withColumn("_again", again), "pos", {"duplicate": F.col("_again"), "empty prediction": F.trim(F.coalesce("prediction", F.lit(""))) == ""})


def check_figures(figures: DataFrame, gap: int) -> DataFrame:
    """figure_id, problem of bar figures: names that repeat, values off the axis or too close, lengths that differ."""
    values = F.array_sort("values")
    gaps = F.zip_with(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: a - b)
    checks = {
        "repeated category": F.size(F.array_distinct("categories")) < F.size("categories"),
        "lengths differ": F.size("categories") != F.size("values"),
        "off the axis": F.exists("values", lambda v: (v < F.col("axis_min")) | (v > F.col("axis_max"))),
        "values too close": F.exists(gaps, lambda g: g < gap),
        "unknown split": ~F.col("split").isin("train", "val", "test"),
        "partner is shown": F.size(F.array_intersect("categories", F.coalesce("absent_partners", F.array().cast("array<string>")))) > 0,
    }
    return _problems(figures, "figure_id", checks)


def check_questions(figures: DataFrame) -> DataFrame:
    """figure_id, problem of figures with their questions (template, phrasing, asks_about, question, gold_answer): ids that repeat, golds that
    aren't the bar's value, questions of one template and phrasing whose wording differs, values against the trend."""
    value = lambda q: F.get("values", (F.array_position("categories", q["asks_about"]) - 1).cast("int")).cast("string")
    worded = F.array_distinct(F.transform("questions", lambda q: F.struct(q["template"], q["phrasing"], F.replace(q["question"], q["asks_about"], F.lit("*")))))
    kinds = F.array_distinct(F.transform("questions", lambda q: F.struct(q["template"], q["phrasing"])))
    rising = F.array_sort("values")
    checks = {
        "gold differs": F.exists("questions", lambda q: (q["template"] == "read_value") & ~q["gold_answer"].cast("string").eqNullSafe(value(q))),
        "wording differs": F.size(worded) != F.size(kinds),
        "against the trend": ((F.col("trend") == "rising") & (F.col("values") != rising)) | ((F.col("trend") == "falling") & (F.col("values") != F.reverse(rising))),
    }
    again = repeated(figures, "figure_id").select("figure_id", F.lit("repeated id").alias("problem"))
    return _problems(figures, "figure_id", checks).unionByName(again)


def check_pairs(figures: DataFrame) -> DataFrame:
    """pair_id of matched pairs that aren't one easy and one hard figure of one split."""
    got = figures.groupBy("pair_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("pair_variant")).alias("v"), F.countDistinct("split").alias("s"))
    return got.where((F.col("n") != 2) | (F.col("v") != F.array(F.lit("easy"), F.lit("hard"))) | (F.col("s") != 1)).select("pair_id", "n")


def acceptance(scored: DataFrame, floors: dict[str, float]) -> DataFrame:
    """model, accuracy over answerable items, floor, passes."""
    floor = F.element_at(F.create_map(*[F.lit(x) for p in floors.items() for x in p]), F.col("model"))
    got = scored.where(~F.col("absent")).groupBy("model").agg(F.avg(F.col("correct").cast("int")).alias("accuracy")).withColumn("floor", floor)
    return got.withColumn("passes", F.col("accuracy") >= F.col("floor"))


def settings_drift(segments: DataFrame) -> DataFrame:
    """run_id, key, n_values of settings that differ between the segments of a run."""
    each = segments.select("run_id", F.explode("settings").alias("key", "value"))
    return each.groupBy("run_id", "key").agg(F.countDistinct("value").alias("n_values")).where("n_values > 1")


def figure_leaks(rows: DataFrame, figure: str = "figure_id", group: str = "split") -> DataFrame:
    """figure, groups: figures that are in more than one group."""
    got = rows.groupBy(figure).agg(F.sort_array(F.collect_set(group)).alias("groups"))
    return got.where(F.size("groups") > 1)


def group_leaks(rows: DataFrame, figure: str = "figure_id", group: str = "split", sample: int = 5) -> DataFrame:
    """one, other, n, sample: for each two groups that share figures how many they share, and the first of them."""
    pairs = F.array_sort(F.collect_set(group))
    each = rows.groupBy(figure).agg(pairs.alias("g")).where(F.size("g") > 1)
    both = F.flatten(F.transform("g", lambda a: F.transform(F.filter("g", lambda b: b > a), lambda b: F.struct(a.alias("one"), b.alias("other")))))
    pair = each.select(F.col(figure).alias("_f"), F.inline(both))
    rank = F.row_number().over(Window.partitionBy("one", "other", "_r").orderBy("_f"))
    # The first of each of some parts are enough to find the first of all.
    first = pair.withColumn("_r", F.pmod(F.xxhash64("_f"), F.lit(64))).withColumn("_k", rank).where(F.col("_k") <= sample)
    names = first.groupBy("one", "other").agg(F.slice(F.array_sort(F.collect_list("_f")), 1, sample).alias("sample"))
    return pair.groupBy("one", "other").agg(F.count("*").alias("n")).join(names, ["one", "other"])


def require_no_leaks(rows: DataFrame, figure: str = "figure_id", group: str = "split") -> DataFrame:
    """rows, unless a figure is in two groups: that is an error that names five of them."""
    bad = figure_leaks(rows, figure, group).limit(5).collect()
    if bad:
        raise ValueError(f"figures in more than one {group}: {[r[figure] for r in bad]}")
    return rows


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, state: files of the manifest (path, sha256) that are missing or have other content; files: path, content."""
    seen = files.select("path", F.sha2("content", 256).alias("now"))
    both = manifest.join(seen, "path", "left")
    return both.where("now is null or now <> sha256").select("path", F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("state"))
