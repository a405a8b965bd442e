"""Queries that fit probes on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.ids import figure_split, fold_of
from evalspark.operators import answers as A
from evalspark.operators import bootstrap, features, metrics, probes, quality
from evalspark.plans import standins as S
from evalspark.plans.registry import query
from evalspark.sources import tables
from evalspark.sources.shared import shared_path, written

# The penalties of the published sweeps.
L2 = (1.0, 10.0, 100.0, 1000.0, 10000.0)
#: Draws of an interval.
DRAWS = 2000
SEEDS = (42, 1, 2, 3, 4)
TARGETS = {"S_vs_C": (("S",), ("C",)), "F_vs_C": (("F",), ("C",)), "Z_vs_C": (("Z",), ("C",)), "F_vs_Z": (("F",), ("Z",)), "SFZ_vs_CR": (("S", "F", "Z"), ("C", "R"))}
#: The layer column of nested cross-validation numbers layers and positions together.
POSITIONS = ("query_last", "vision_mean")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 4).alias(c) if c in names else F.col(c) for c in df.columns])


def _of_classes(rows: DataFrame, pos: str, neg: str) -> DataFrame:
    """rows with y: 1 for the classes of pos, 0 for those of neg, NULL for others, which are only scored."""
    return rows.withColumn("y", F.when(F.col("cls").isin(*pos), 1).when(F.col("cls").isin(*neg), 0))


def _with_surface(rows: DataFrame) -> DataFrame:
    """rows whose vec ends in two surface features of the item."""
    surface = F.array((F.col("item_id") % 7).cast("float"), (F.col("item_id") % 3).cast("float"))
    return rows.withColumn("vec", F.concat("vec", surface))


@query()
def layer_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(probes.layer_sweep(S.vectors(spark, sf_dir), L2), "auroc")


@query()
def selected_probe_on_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test AUROC of the configuration that is best on validation rows, with its interval over draws of figures."""
    rows = S.vectors(spark, sf_dir)
    choice = probes.selected(probes.layer_sweep(rows, L2))
    return _rounded(bootstrap.auroc_interval(probes.test_scores(rows, choice), "figure_id", "score", F.col("y") == 1, DRAWS), "auroc", "lo", "hi")


@query()
def target_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For four targets the best configuration on validation rows and its AUROC there and on test rows."""
    rows = S.target_vectors(spark, sf_dir)
    choice = probes.selected(probes.layer_sweep(rows, L2, ["target"]), ["target"])
    test = metrics.auroc(probes.test_scores(rows, choice, ["target"]), "score", F.col("y") == 1, ["target"])
    got = choice.select("target", "position", "layer", "l2", F.col("auroc").alias("val_auroc")).join(test.select("target", F.col("auroc").alias("test_auroc")), "target")
    return _rounded(got, "val_auroc", "test_auroc")


@query()
def sanity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a target that a coordinate of each layer tells is found by the sweep."""
    rows = S.vectors(spark, sf_dir).withColumn("y", (F.col("vec")[0] > F.when(F.col("position") == "query_last", 0.0).otherwise(0.1)).cast("int"))
    return _rounded(probes.sanity_gate(probes.layer_sweep(rows, L2)), "best")


@query()
def cross_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(probes.one_vs_rest(S.vectors(spark, sf_dir), ("C", "S", "F"), 10.0), "auroc")


@query()
def cross_transfer_of_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cross_transfer among two classes of errors alone, which is degenerate and says so."""
    return _rounded(probes.one_vs_rest(S.vectors(spark, sf_dir).where("cls in ('S', 'F')"), ("S", "F"), 10.0), "auroc")


@query()
def nested_type_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The S against C probe's out-of-fold scores on each contrast, with intervals, by position."""
    oof = probes.assembled(probes.nested_cv(_of_classes(S.vectors(spark, sf_dir), "S", "C"), L2, keys=["position"]), ["position"])
    return _rounded(probes.type_matrix(oof, TARGETS, ["position"], DRAWS), "auroc", "lo", "hi")


@query()
def auroc_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    oof = probes.nested_cv(_of_classes(S.vectors(spark, sf_dir), "S", "C"), L2, keys=["position"])
    return _rounded(metrics.auroc(oof, "score", F.col("y") == 1, ["position", "layer"]), "auroc")


@query()
def residualised_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep after removing what two surface features explain on training rows."""
    return _rounded(probes.layer_sweep(_with_surface(S.vectors(spark, sf_dir)), L2, surface=2), "auroc")


@query()
def residualised_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested cross-validation after removing what surface features explain, by a projection of each outer fold."""
    rows = _with_surface(_of_classes(S.vectors(spark, sf_dir), "S", "C"))
    oof = probes.assembled(probes.nested_cv(rows, L2, keys=["position"], surface=2), ["position"])
    return _rounded(metrics.auroc(oof, "score", F.col("y") == 1, ["position"]), "auroc")


@query()
def surface_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe on surface features alone, its penalty chosen on validation rows."""
    rows = S.answers(spark, sf_dir).select("item_id", "figure_id", (~F.col("correct")).cast("int").alias("y"), *features.surface_columns())
    rows = rows.withColumn("split", figure_split(F.col("figure_id"))).withColumn("position", F.lit("surface")).withColumn("layer", F.lit(0))
    rows = written(rows.withColumn("vec", F.array("is_human", "question_length", "vision_tokens", "numeric_gold")), "surface-rows")
    choice = written(probes.selected(probes.layer_sweep(rows, L2, repeats=True)), "surface-choice")
    return _rounded(metrics.auroc(probes.test_scores(rows, choice, repeats=True), "score", F.col("y") == 1), "auroc")


@query()
def platt_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration of the selected probe's test scores after a logistic fit on its validation scores."""
    rows = S.vectors(spark, sf_dir)
    choice = written(probes.selected(probes.layer_sweep(rows, L2)), "platt-choice")
    a, b = probes.platt(written(probes.test_scores(rows, choice, split="val"), "platt-scores"), "score", "y")
    test = probes.test_scores(rows, choice).withColumn("p", 1 / (1 + F.exp(-(F.lit(a) * F.col("score") + F.lit(b)))))
    return _rounded(metrics.calibration(test, "p", "y"), "ece", "brier", "mean_p", "base_rate")


@query()
def seeds_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation, least and most test AUROC over five split seeds of three probes at the layer and penalty that are best on
    validation rows: plain, residualised, and plain with the other position's rows as further training rows."""
    base = _with_surface(S.vectors(spark, sf_dir)).where(F.col("position") == POSITIONS[0])
    extra = _with_surface(S.vectors(spark, sf_dir)).where(F.col("position") == POSITIONS[1]).withColumn("position", F.lit(POSITIONS[0]))
    seeds = F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), figure_split(F.col("figure_id"), s).alias("split")) for s in SEEDS]))
    by_seed = lambda rows: rows.drop("split").withColumn("_s", seeds).withColumn("seed", F.col("_s.seed")).withColumn("split", F.col("_s.split")).drop("_s")
    plain, more = by_seed(base), by_seed(extra).where("split = 'train'")
    bare = lambda rows: rows.withColumn("vec", F.slice("vec", 1, F.size("vec") - 2))
    found = []
    for variant, rows, surface in (("plain", bare(plain), 0), ("residualised", plain, 2), ("extra_training", bare(plain.unionByName(more)), 0)):
        choice = written(probes.selected(probes.layer_sweep(rows, L2, ["seed"], surface), ["seed"]), "seed-choice")
        scores = probes.test_scores(rows, choice, ["seed"], surface)
        found.append(metrics.auroc(scores, "score", F.col("y") == 1, ["seed"]).withColumn("variant", F.lit(variant)))
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return _rounded(metrics.summary(every, "auroc", ["variant"]), "mean", "sd", "min", "max")


@query()
def frozen_probe_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The AUROC of the selected probe, frozen, on the items of figures that it never saw."""
    rows = S.vectors(spark, sf_dir)
    other = F.crc32(F.col("figure_id").cast("binary")) % 4 == 0
    seen = rows.where(~other)
    choice = probes.selected(probes.layer_sweep(seen, L2))
    return _rounded(metrics.auroc(probes.frozen_scores(seen, rows.where(other), choice), "score", F.col("y") == 1), "auroc")


@query()
def controller_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, fold, cls and three out-of-fold scores: wrong at all, missing, misread."""
    rows = S.vectors(spark, sf_dir).where(F.col("position") == POSITIONS[0])
    sets = {"binary": ("SFZ", "CR"), "missing": ("FZR", "CS"), "misread": ("S", "C")}
    out = rows.select("item_id", "figure_id", "cls", "fold").distinct()
    for name, (pos, neg) in sets.items():
        oof = probes.assembled(probes.nested_cv(_of_classes(rows, pos, neg), L2))
        out = out.join(oof.select("item_id", F.round("score", 4).alias(name)), "item_id")
    return out


@query(f"""WITH {S.SYNTHETIC}, h AS (SELECT *, ('0x' || substr(sha1('42' || chr(31) || figure_id), 1, 8))::bigint / 4294967295.0 AS h FROM synthetic),
  k AS (SELECT template AS contrast, correct::int AS y, CASE WHEN h < 0.2 THEN 'test' ELSE 'val' END AS split FROM h WHERE h < 0.4),
  c AS (SELECT contrast, split, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM k GROUP BY 1, 2), l AS (SELECT unnest([5, 20, 100]) AS least)
  SELECT least::bigint AS least, contrast FROM c, l WHERE p >= least AND q >= least GROUP BY 1, 2 HAVING count(*) = 2""")
def usable_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The templates with enough right and wrong answers in validation and test rows, for three gates."""
    rows = S.synthetic(spark, sf_dir).select(F.col("template").alias("contrast"), F.col("correct").cast("int").alias("y"), figure_split(F.col("figure_id")).alias("split"))
    parts = [probes.usable(rows, ["contrast"], least=k).withColumn("least", F.lit(k).cast("long")) for k in (probes.MIN_REPORT, probes.MIN_TRAIN, 100)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {S.LABELLED}, v AS (SELECT *, ('0x' || substr(sha1('42' || chr(31) || figure_id), 1, 8))::bigint / 4294967295.0 AS h FROM joined)
  SELECT CASE WHEN h < 0.2 THEN 'test' WHEN h < 0.4 THEN 'val' ELSE 'train' END AS split, (NOT correct AND label = 'structural')::int AS y, count(*) AS n FROM v WHERE correct OR label IS NOT NULL GROUP BY 1, 2""")
def task_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalspark.operators.labels import last_labels

    rows = probes.population(S.answers(spark, sf_dir), last_labels(S.labels(spark, sf_dir), ["item_id"]), "structural", "correct")
    return rows.groupBy("split", "y").agg(F.count("*").alias("n"))


@query("SELECT layer, position, (SELECT count(*) FROM embeddings) AS n, 0::bigint AS repeated, (SELECT count(*) FROM embeddings WHERE vec_id % 5 = 0) AS odd_width, (SELECT count(*) FROM embeddings WHERE vec_id % 7 = 0) AS not_finite FROM (SELECT unnest([0, 1, 2, 3]) AS layer), (SELECT unnest(['query_last', 'vision_mean']) AS position)")
def vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    rows = S.vectors(spark, sf_dir).withColumn("vec", F.when(i % 7 == 0, F.transform("vec", lambda x: x * float("nan"))).otherwise(F.col("vec")))
    return quality.check_vectors(rows.withColumn("vec", F.when(i % 5 == 0, F.slice("vec", 1, 15)).otherwise(F.col("vec"))), 16)


@query("SELECT vec_id AS item_id, 'vectors' AS side FROM embeddings WHERE vec_id % 11 = 0")
def vector_id_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.vectors(spark, sf_dir)
    return quality.id_gaps(rows, rows.where("item_id % 11 <> 0"))


@query("SELECT vec_id AS item_id, 'g' || vec_id % 50 AS figure_id, 'x' AS other FROM embeddings WHERE vec_id % 13 = 0")
def misaligned_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.vectors(spark, sf_dir)
    answers = rows.select("item_id", F.when(F.col("item_id") % 13 == 0, "x").otherwise(F.col("figure_id")).alias("figure_id")).distinct()
    return quality.misaligned(rows, answers)


@query("SELECT layer, position FROM (SELECT unnest([0, 1, 2, 3, 4]) AS layer), (SELECT unnest(['query_last', 'query_mean', 'vision_mean']) AS position) WHERE layer = 4 OR position = 'query_mean'")
def missing_vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.range(5).select(F.col("id").cast("int").alias("layer"), F.explode(F.array(*map(F.lit, ("query_last", "query_mean", "vision_mean")))).alias("position"))
    return quality.missing_cells(S.vectors(spark, sf_dir), cells)


_WITH_ANSWERS = f"WITH {S.ANSWERS} SELECT vec_id AS item_id, position, layer::int AS layer, (NOT correct)::int AS y, length(prediction)::bigint AS answer_length, 16::bigint AS width FROM embeddings JOIN answers ON vec_id = event_id, (SELECT unnest([0, 1, 2, 3]) AS layer), (SELECT unnest(['query_last', 'vision_mean']) AS position) WHERE source = 'human'"


def _answered(spark: SparkSession, sf_dir: str, vectors: DataFrame) -> DataFrame:
    answers = S.answers(spark, sf_dir).where("source = 'human'").select(F.col("event_id").alias("item_id"), (~F.col("correct")).cast("int").alias("wrong"), F.length("prediction").cast("long").alias("answer_length"))
    joined = probes.join_vectors(vectors.drop("y"), answers)
    return joined.select("item_id", "position", "layer", F.col("wrong").alias("y"), "answer_length", F.size("vec").cast("long").alias("width"))


@query(_WITH_ANSWERS)
def vectors_with_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors joined with their answers by item_id; items that weren't answered drop out."""
    return _answered(spark, sf_dir, S.vectors(spark, sf_dir))


@query(_WITH_ANSWERS)
def bucketed_vectors_with_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from vectors in buckets by item_id, which stay where they are."""
    path = shared_path(spark, "vectors")
    tables.write_bucketed(S.vectors(spark, sf_dir), path, 8)
    return _answered(spark, sf_dir, tables.open_bucketed(spark, path))


@query("SELECT count(*) AS shared FROM (SELECT DISTINCT user_id FROM events WHERE event_id % 2 = 0 INTERSECT SELECT DISTINCT user_id FROM events WHERE event_id % 2 = 1)")
def shared_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.read(spark, sf_dir, "events")
    return probes.disjoint(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id")


@query("SELECT item_id, round((x - m) / s, 6) AS x FROM (SELECT p_partkey AS item_id, p_size::double AS x FROM part), (SELECT avg(p_size) AS m, stddev_pop(p_size) AS s FROM part WHERE p_partkey % 3 <> 0)")
def standardised_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").cast("double").alias("x"))
    return features.standardised(rows, ["x"], F.col("item_id") % 3 != 0).select("item_id", F.round("x", 6).alias("x"))


@query()
def transfer_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe of S against C from one half of the figures, on the contrasts of the other half, by position."""
    rows = _of_classes(S.vectors(spark, sf_dir), "S", "C")
    half = F.crc32(F.col("figure_id").cast("binary")) % 2
    found = []
    for position in POSITIONS:
        one = rows.where(F.col("position") == position)
        got = probes.transfer(one.where(half == 0), one.where(half == 1), L2)
        found.append(got.withColumn("position", F.lit(position)))
    return _rounded(probes.type_matrix(found[0].unionByName(found[1]), TARGETS, ["position"]), "auroc")


@query()
def contrast_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe of each contrast of classes, of each position alone, on validation rows."""
    cells = [F.when(F.col("cls").isin(*p, *n), F.struct(F.lit(name).alias("contrast"), F.col("cls").isin(*p).cast("int").alias("y"))) for name, (p, n) in TARGETS.items()]
    rows = S.vectors(spark, sf_dir).drop("y").withColumn("_c", F.explode(F.array_compact(F.array(*cells))))
    rows = rows.withColumn("contrast", F.col("_c.contrast")).withColumn("y", F.col("_c.y")).drop("_c")
    return _rounded(probes.contrast_sweep(rows, L2), "auroc")


@query()
def vision_only_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contrast_probes' best layer and penalty of the vision position, by contrast, with the AUROC on test rows."""
    cells = [F.when(F.col("cls").isin(*p, *n), F.struct(F.lit(name).alias("contrast"), F.col("cls").isin(*p).cast("int").alias("y"))) for name, (p, n) in TARGETS.items()]
    rows = S.vectors(spark, sf_dir).where("position = 'vision_mean'").drop("y").withColumn("_c", F.explode(F.array_compact(F.array(*cells))))
    rows = rows.withColumn("contrast", F.col("_c.contrast")).withColumn("y", F.col("_c.y")).drop("_c")
    choice = written(probes.selected(probes.contrast_sweep(rows, L2), ["contrast"]), "vision-choice")
    test = metrics.auroc(probes.test_scores(rows, choice, ["contrast"]), "score", F.col("y") == 1, ["contrast"])
    return _rounded(choice.select("contrast", "layer", "l2").join(test, "contrast"), "auroc")


def _metadata_rows(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    rows = S.metadata_items(spark, sf_dir).withColumn("_values", F.to_json(F.struct(*columns)))
    # A vector for each row of values that there is, not for each item.
    values = written(rows.select("_values", *columns).distinct(), "metadata-values")
    vec = features.dense_one_hot(features.one_hot(values, columns, "_values"), "_values")
    rows = rows.join(written(vec, "metadata-vectors"), "_values").drop("_values").withColumn("fold", fold_of(F.col("figure_id"))).withColumn("layer", F.lit(0))
    return rows.withColumn("cls", F.lit("-"))


@query()
def metadata_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold AUROC of a probe on six one-hot metadata fields, alone and with the grid features."""
    rows = _metadata_rows(spark, sf_dir, list(S.METADATA))
    wider = rows.withColumn("vec", F.concat("vec", F.array(*features.GRID_FEATURES)))
    both = rows.withColumn("kind", F.lit("metadata")).unionByName(wider.withColumn("kind", F.lit("metadata_and_grid")))
    return _rounded(metrics.auroc(probes.nested_cv(both, L2, keys=["kind"], repeats=True), "score", F.col("y") == 1, ["kind"]), "auroc")


@query()
def text_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold AUROC of a probe on what the question's text says: the bar asked about, the one compared with, the phrasing."""
    oof = probes.nested_cv(_metadata_rows(spark, sf_dir, list(S.QUESTION_TEXT)), L2, repeats=True)
    return _rounded(metrics.auroc(oof, "score", F.col("y") == 1), "auroc")


_METADATA_SQL = " UNION ALL ".join(f"SELECT item_id, '{c}=' || coalesce({c}::varchar, '') AS feature FROM meta" for c in S.METADATA)
_TEXT_SQL = " UNION ALL ".join(f"SELECT item_id, '{c}=' || coalesce({c}::varchar, '') AS feature FROM meta" for c in S.QUESTION_TEXT)
_PLACES = "p AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS place FROM (SELECT DISTINCT feature FROM f))"


@query(f"WITH {S.META}, f AS ({_METADATA_SQL}), {_PLACES} SELECT item_id, feature, place FROM f JOIN p USING (feature)")
def metadata_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.one_hot(S.metadata_items(spark, sf_dir), list(S.METADATA), "item_id").select("item_id", "feature", F.col("place").cast("long").alias("place"))


@query(f"WITH {S.META}, f AS ({_TEXT_SQL}), {_PLACES} SELECT item_id, feature, place FROM f JOIN p USING (feature)")
def question_text_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.one_hot(S.metadata_items(spark, sf_dir), list(S.QUESTION_TEXT), "item_id").select("item_id", "feature", F.col("place").cast("long").alias("place"))


def _single_sql(name: str, value: str) -> str:
    return f"""(WITH g AS (SELECT {value} AS score, sum(y)::bigint AS pos, sum(1 - y)::bigint AS neg FROM meta GROUP BY ALL), c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS nb FROM g)
  SELECT '{name}' AS feature, sum(pos)::bigint AS n_pos, sum(neg)::bigint AS n_neg, round(sum(pos * (2 * nb + neg)) / nullif(2.0 * sum(pos) * sum(neg), 0), 4) AS auroc FROM c)"""


@query(f"WITH {S.META} " + " UNION ALL ".join(_single_sql(n, v) for n, v in (("axis_max", "axis_max"), ("n_bars", "n_bars"), ("lookalike", "lookalike::int"))))
def single_feature_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The AUROC of single numbers of the figure, and of the lookalike flag, without a fit."""
    rows = S.metadata_items(spark, sf_dir)
    each = rows.select("y", F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("long").alias("score")) for n in ("axis_max", "n_bars", "lookalike")])))
    return _rounded(metrics.auroc(each, "score", F.col("y") == 1, ["feature"]), "auroc")


@query(f"WITH {S.ANSWERS} SELECT item_id, source, n FROM (SELECT item_id, source, length(prediction)::bigint AS n FROM answers WHERE NOT correct) ORDER BY n DESC, item_id LIMIT 50")
def longest_wrong_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty wrong answers that are longest: a ranked pick."""
    rows = S.answers(spark, sf_dir).where(~F.col("correct")).select("item_id", "source", F.length("prediction").cast("long").alias("n"))
    return A.ranked(rows, 50, F.col("n").desc(), F.col("item_id"))


@query("""WITH p AS (SELECT p_partkey AS item_id, p_type AS answer, length(p_type)::double AS n, p_type = 'x' AS odd FROM part), s AS (SELECT avg(n) AS m, stddev_pop(n) AS d FROM p)
  SELECT item_id, true AS answer_in_figure, round(CASE WHEN d > 0 THEN (n - m) / d ELSE n END, 6) AS answer_length, 'categorical' AS answer_type FROM p, s""")
def surface_item_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("answer"), F.array(F.col("p_type"), F.lit("7")).alias("texts"))
    got = features.surface_items(rows).select("item_id", "answer_in_figure", F.round("answer_length", 6).alias("answer_length"), "answer_type")
    return got
