"""Evaluation tables derived from the driver's tables, as DataFrames and as the same SQL.

Whole numbers and strings only, so both engines agree to the bit. Each table covers all rows of the
table that it comes from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions import ids
from evalspark.functions.text import is_correct
from evalspark.operators.answers import score
from evalspark.operators.labels import LABELS

MODEL = "m1"
TEMPLATES = ("read_value", "absent_value", "absent_category", "compare_present", "absent_compare", "absent_neighbor")
REPLIES = ("35", "0", "Not shown", "Guava", "view", "click.", "Both", "There is no Guava bar")
CATEGORIES = ("signup", "purchase", "error", "view", "click")
ACTIONS = ("I_0", "I_reask", "I_upsample", "I_crop", "I_verify")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def sql_pick(values: tuple[str, ...], at: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({at}) + 1]"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    cents = F.floor(F.col("value") * 100).cast("long")
    guess = F.concat(
        F.when(i % 11 == 0, "$").otherwise(""),
        F.when(i % 17 == 0, "about ").otherwise(""),
        F.when(i % 23 == 0, F.col("cents") * 100).otherwise(F.expr("cents * (93 + event_id * 7 % 15) div 100")).cast("string"),
        F.when(i % 13 == 0, "%").otherwise(""),
    )
    rows = e.select("event_id", "ts", F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("figure_id"), F.when(i % 2 == 0, "human").otherwise("augmented").alias("source"), cents.alias("cents"), "event_type", F.concat(F.when(i % 5 == 0, "What is the average of ").otherwise("What is the value of "), "event_type").alias("question"))
    rows = rows.withColumn("pos", i).withColumn("model", F.lit(MODEL)).withColumn("split", F.lit("test"))
    rows = rows.withColumn("gold", F.when(i % 7 == 3, "Yes").otherwise(F.col("cents").cast("string")))
    return rows.withColumn("prediction", F.when(i % 7 == 3, F.when(i % 4 == 0, "yes ").otherwise("No")).otherwise(guess))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ids.with_occurrence(items(spark, sf_dir))
    key = ids.item_id(F.col("model"), F.col("source"), F.col("figure_id"), F.col("question"), F.col("occurrence"))
    return rows.withColumn("item_id", key).withColumn("correct", is_correct(F.col("gold"), F.col("prediction"))).withColumn("n_vision_tokens", F.length("question") * 10)


def sql_number(t: str) -> str:
    return rf"try_cast(replace(nullif(regexp_extract({t}, '^\s*[$€£]?\s*([-+]?[\d,]*\.?\d+)\s*%?\s*$', 1), ''), ',', '') AS double)"


ITEMS = rf"""items AS (
  SELECT *, CASE WHEN event_id % 7 = 3 THEN 'Yes' ELSE cents::varchar END AS gold,
    CASE WHEN event_id % 7 = 3 THEN CASE WHEN event_id % 4 = 0 THEN 'yes ' ELSE 'No' END
      ELSE (CASE WHEN event_id % 11 = 0 THEN '$' ELSE '' END) || (CASE WHEN event_id % 17 = 0 THEN 'about ' ELSE '' END)
        || (CASE WHEN event_id % 23 = 0 THEN cents * 100 ELSE cents * (93 + event_id * 7 % 15) // 100 END)::varchar
        || (CASE WHEN event_id % 13 = 0 THEN '%' ELSE '' END) END AS prediction
  FROM (SELECT event_id, ts, 'f' || user_id AS figure_id, CASE WHEN event_id % 2 = 0 THEN 'human' ELSE 'augmented' END AS source,
      floor(value * 100)::bigint AS cents, event_type,
      CASE WHEN event_id % 5 = 0 THEN 'What is the average of ' ELSE 'What is the value of ' END || event_type AS question FROM events))"""
ANSWERS = rf"""{ITEMS}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source, figure_id, question ORDER BY event_id) - 1 AS occurrence,
    {sql_number('gold')} AS g, {sql_number('prediction')} AS p FROM items),
answers AS (
  SELECT *, substr(sha1(concat_ws(chr(31), '{MODEL}', source, figure_id, question, occurrence::varchar)), 1, 12) AS item_id,
    CASE WHEN g IS NOT NULL AND p IS NOT NULL THEN CASE WHEN g = 0 THEN p = 0 ELSE abs(p - g) <= 0.05 * abs(g) + 1e-9 END
      ELSE lower(trim(gold)) = lower(trim(prediction)) END AS correct FROM numbered)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the wrong answers (some with a later correction)."""
    wrong = answers(spark, sf_dir).where(~F.col("correct")).where(F.col("event_id") % 29 != 0)
    i = F.col("event_id")
    first = wrong.select("item_id", pick(LABELS, i * 3 % 5).alias("label"), i.alias("seq"))
    later = wrong.where(i % 19 == 0).select("item_id", pick(LABELS, (i + 1) % 5).alias("label"), (i + 1_000_000_000).alias("seq"))
    rows = first.unionByName(later)
    reason = F.when(F.col("label") == "not_an_error", F.when(F.col("seq") % 2 == 0, "gold_error").otherwise("valid_reading")).when(F.col("label") == "ambiguous", F.when(F.col("seq") % 3 == 0, "gold_error").otherwise("other"))
    return rows.withColumn("reason", reason).withColumn("rationale", F.lit("because"))


LABELLED = rf"""{ANSWERS}, relabelled AS (
  SELECT item_id, CASE WHEN event_id % 19 = 0 THEN {sql_pick(LABELS, '(event_id + 1) % 5')} ELSE {sql_pick(LABELS, 'event_id * 3 % 5')} END AS label,
    CASE WHEN event_id % 19 = 0 THEN event_id + 1000000000 ELSE event_id END AS seq
  FROM answers WHERE NOT correct AND event_id % 29 <> 0),
labels_llm AS (
  SELECT *, CASE WHEN label = 'not_an_error' THEN CASE WHEN seq % 2 = 0 THEN 'gold_error' ELSE 'valid_reading' END
    WHEN label = 'ambiguous' THEN CASE WHEN seq % 3 = 0 THEN 'gold_error' ELSE 'other' END END AS reason FROM relabelled),
joined AS (SELECT a.*, l.label, l.reason,
    coalesce(abs(p * 100 - g) <= 0.05 * abs(g) + 1e-9 OR abs(p * 0.01 - g) <= 0.05 * abs(g) + 1e-9, false) AS rescaled
  FROM answers a LEFT JOIN labels_llm l USING (item_id))"""


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = items(spark, sf_dir).withColumn("template", pick(TEMPLATES, i % 6)).withColumn("absent", F.col("template").startswith("absent"))
    rows = rows.withColumn("asks_about", F.when(F.col("absent"), "Guava").otherwise(F.col("event_type"))).withColumn("compared_with", F.when(F.col("template") == "absent_compare", "view"))
    rows = rows.withColumn("categories", F.array(*map(F.lit, CATEGORIES))).withColumn("lookalike_of", F.when(i % 2 == 0, F.col("event_type")))
    return score(rows.withColumn("prediction", F.when(F.col("absent"), pick(REPLIES, (i / 6).cast("long") % 8)).otherwise(F.col("prediction"))))


SYNTHETIC = rf"""{ITEMS}, s0 AS (
  SELECT * REPLACE (CASE WHEN {sql_pick(TEMPLATES, 'event_id % 6')} LIKE 'absent%' THEN {sql_pick(REPLIES, 'event_id // 6 % 8')} ELSE prediction END AS prediction),
    {sql_pick(TEMPLATES, 'event_id % 6')} AS template, CASE WHEN event_id % 2 = 0 THEN event_type END AS lookalike_of FROM items),
s1 AS (SELECT *, template LIKE 'absent%' AS absent, {sql_number('gold')} AS g, {sql_number('prediction')} AS p, rtrim(trim(prediction), '.') AS t FROM s0),
s2 AS (SELECT *, CASE WHEN NOT absent THEN NULL
    WHEN template = 'absent_compare' THEN CASE WHEN lower(t) = 'view' THEN 'picked_present' WHEN lower(t) IN ('guava', 'signup', 'purchase', 'error', 'click') THEN 'fabricated' WHEN regexp_matches(t, '(?i)\b(no|not)\b') THEN 'rejected' ELSE 'unclear' END
    WHEN template = 'absent_neighbor' THEN CASE WHEN lower(t) IN ('signup', 'purchase', 'error', 'view', 'click') THEN 'fabricated' WHEN regexp_matches(t, '(?i)\b(no|not)\b') THEN 'rejected' ELSE 'unclear' END
    ELSE CASE WHEN t = '0' THEN 'zero' WHEN t = '35' THEN 'fabricated' WHEN regexp_matches(t, '(?i)\b(no|not)\b') THEN 'rejected' ELSE 'unclear' END END AS outcome FROM s1),
synthetic AS (SELECT *, CASE WHEN absent THEN outcome = 'rejected'
    WHEN g IS NOT NULL AND p IS NOT NULL THEN CASE WHEN g = 0 THEN p = 0 ELSE abs(p - g) <= 0.05 * abs(g) + 1e-9 END
    ELSE lower(trim(gold)) = lower(trim(prediction)) END AS correct FROM s2)"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three raters of every document, the third of two thirds of them, and an adjudicator of some."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"))
    i, r = F.col("item_id"), F.col("r")
    each = docs.withColumn("r", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where((r < 2) | (i % 3 != 0))
    bump = F.when(i % (r + 4) == 0, r + 1).otherwise(0)
    votes = each.select(F.concat(F.lit("r"), r.cast("string")).alias("rater"), "item_id", pick(LABELS, (i * 7 + bump) % 5).alias("label"))
    settled = docs.where(i % 30 == 0).select(F.lit("adjudicated").alias("rater"), "item_id", pick(LABELS, i % 5).alias("label"))
    return votes.unionByName(settled)


RATINGS = rf"""ratings AS (
  SELECT 'r' || r AS rater, doc_id AS item_id, {sql_pick(LABELS, '(doc_id * 7 + CASE WHEN doc_id % (r + 4) = 0 THEN r + 1 ELSE 0 END) % 5')} AS label
  FROM documents, (SELECT unnest([0, 1, 2]) AS r) WHERE r < 2 OR doc_id % 3 <> 0
  UNION ALL SELECT 'adjudicated', doc_id, {sql_pick(LABELS, 'doc_id % 5')} FROM documents WHERE doc_id % 30 = 0)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, i = read(spark, sf_dir, "orders"), F.col("item_id"), F.col("i")
    rows = o.select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("figure_id"), F.when(F.col("o_orderstatus") == "F", "structural").when(F.col("o_orderstatus") == "O", "fabrication").otherwise("computation").alias("failure_type"))
    rows = rows.select("*", F.posexplode(F.array(*map(F.lit, ACTIONS))).alias("i", "intervention"))
    shift = F.when(F.col("failure_type") == "structural", i * 2).otherwise(i)
    return rows.withColumn("recovered", (k * 7 + i * 13) % 20 < shift + 3).withColumn("applicable", F.lit(True)).withColumn("outcome", pick(("rejected", "zero", "fabricated", "unclear"), (k + i) % 4)).drop("i")


OUTCOMES = rf"""outcomes AS (
  SELECT *, (item_id * 7 + i * 13) % 20 < CASE WHEN failure_type = 'structural' THEN i * 2 ELSE i END + 3 AS recovered,
    {sql_pick(('rejected', 'zero', 'fabricated', 'unclear'), '(item_id + i) % 4')} AS outcome, {sql_pick(ACTIONS, 'i')} AS intervention
  FROM (SELECT o_orderkey AS item_id, o_custkey AS figure_id, unnest([0, 1, 2, 3, 4]) AS i,
    CASE o_orderstatus WHEN 'F' THEN 'structural' WHEN 'O' THEN 'fabrication' ELSE 'computation' END AS failure_type FROM orders))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored items with tied scores, a class, a fold and a label."""
    e = read(spark, sf_dir, "embeddings")
    tenth = lambda k: F.floor(10 * F.col("embedding")[k].cast("double")) / 10.0
    fig = F.concat(F.lit("g"), (F.col("vec_id") % 50).cast("string"))
    rows = e.select(F.col("vec_id").alias("item_id"), fig.alias("figure_id"), (F.col("label") < 5).cast("int").alias("y"), pick(("C", "S", "F", "Z", "R"), F.col("label") % 5).alias("cls"), tenth(0).alias("binary"), tenth(1).alias("missing"), tenth(2).alias("misread"), F.floor(10 * F.col("embedding")[0].cast("double")).cast("long").alias("score"))
    return rows.withColumn("fold", ids.fold_of(F.col("figure_id")))


SCORES = r"""scores AS (
  SELECT *, ('0x' || substr(sha1('42' || chr(31) || figure_id), 1, 8))::bigint % 5 AS fold FROM (
    SELECT vec_id AS item_id, 'g' || (vec_id % 50) AS figure_id, (label < 5)::int AS y, ['C', 'S', 'F', 'Z', 'R'][label % 5 + 1] AS cls,
      floor(10 * embedding[1]::double) / 10.0 AS "binary", floor(10 * embedding[2]::double) / 10.0 AS missing, floor(10 * embedding[3]::double) / 10.0 AS misread,
      floor(10 * embedding[1]::double)::bigint AS score FROM embeddings))"""


def controller_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scores with the correctness of five actions."""
    i = F.col("item_id")
    rows = scores(spark, sf_dir)
    right = F.col("cls").isin("C", "R")
    rows = rows.withColumn("I_0", right)
    for k, name in enumerate(ACTIONS[1:], 1):
        rows = rows.withColumn(name, F.when(right, i % (7 + k) != 0).otherwise((i % 5) < k))
    return rows


CONTROLLER = SCORES + ", controller AS (SELECT *, cls IN ('C', 'R') AS I_0, " + ", ".join(f"CASE WHEN cls IN ('C', 'R') THEN item_id % {7 + k} <> 0 ELSE item_id % 5 < {k} END AS {n}" for k, n in enumerate(ACTIONS[1:], 1)) + " FROM scores)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four layers of sixteen numbers in two positions, with labels, splits and folds."""
    e = read(spark, sf_dir, "embeddings")
    fig = F.concat(F.lit("g"), (F.col("vec_id") % 50).cast("string"))
    rows = e.select(F.col("vec_id").alias("item_id"), fig.alias("figure_id"), (F.col("label") < 5).cast("int").alias("y"), pick(("C", "S", "F", "Z", "R"), F.col("label") % 5).alias("cls"), "embedding")
    rows = rows.withColumn("layer", F.explode(F.array(*[F.lit(k) for k in range(4)]))).withColumn("vec", F.slice("embedding", 16 * F.col("layer") + 1, 16)).drop("embedding")
    rows = rows.withColumn("split", ids.figure_split(F.col("figure_id"))).withColumn("fold", ids.fold_of(F.col("figure_id")))
    return rows.withColumn("position", F.explode(F.array(F.lit("query_last"), F.lit("vision_mean")))).withColumn("vec", F.when(F.col("position") == "query_last", F.col("vec")).otherwise(F.transform("vec", lambda x: F.abs(x))))


def target_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors with y for each of four targets: the item's source, wrong at all, structural and fabricated errors among the wrong ones."""
    rows = vectors(spark, sf_dir).drop("y")
    wrong = ~F.col("cls").isin("C", "R")
    targets = {"source": (F.col("item_id") % 2 == 0).cast("int"), "binary": wrong.cast("int"), "structural": F.when(wrong, (F.col("cls") == "S").cast("int")), "fabrication": F.when(wrong, (F.col("cls") == "F").cast("int"))}
    each = rows.withColumn("_t", F.explode(F.array(*[F.struct(F.lit(n).alias("target"), y.alias("y")) for n, y in targets.items()])))
    return each.withColumn("target", F.col("_t.target")).withColumn("y", F.col("_t.y")).drop("_t").where("y is not null")


METADATA = ("pilot", "axis_max", "tick_density", "n_bars", "lookalike", "phrasing")
QUESTION_TEXT = ("asks_about", "compared_with", "phrasing")


def metadata_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored synthetic items with what is known of figure and question, and the grid features."""
    from evalspark.operators.features import grid_features

    i, u = F.col("event_id"), F.regexp_extract("figure_id", "[0-9]+", 0).cast("long")
    rows = synthetic(spark, sf_dir).withColumn("item_id", i).withColumn("y", (~F.col("correct")).cast("int"))
    rows = rows.withColumn("pilot", pick(("a", "b"), i % 2)).withColumn("axis_max", pick_long((50, 100, 200), u % 3)).withColumn("tick_density", pick(("sparse", "medium", "dense"), u % 3)).withColumn("n_bars", u % 4 + 3)
    rows = rows.withColumn("lookalike", F.col("lookalike_of").isNotNull()).withColumn("phrasing", pick(("plain", "polite"), i % 5 % 2)).withColumn("axis_min", F.lit(0))
    rows = rows.withColumn("values", F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: (u * 7 + k * 13) % 50))
    kept = ["item_id", "figure_id", "y", *METADATA, "asks_about", "compared_with"]
    return grid_features(rows).select(*kept, "grid_offset", "ten_offset", "rel_grid_offset", "rel_ten_offset")


def pick_long(values: tuple[int, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (at + 1).cast("int"))


META = SYNTHETIC + r""", meta AS (SELECT event_id AS item_id, (NOT correct)::int AS y, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS pilot, [50, 100, 200][replace(figure_id, 'f', '')::bigint % 3 + 1] AS axis_max,
  ['sparse', 'medium', 'dense'][replace(figure_id, 'f', '')::bigint % 3 + 1] AS tick_density, replace(figure_id, 'f', '')::bigint % 4 + 3 AS n_bars, lookalike_of IS NOT NULL AS lookalike,
  CASE WHEN event_id % 5 % 2 = 0 THEN 'plain' ELSE 'polite' END AS phrasing, CASE WHEN absent THEN 'Guava' ELSE event_type END AS asks_about, CASE WHEN template = 'absent_compare' THEN 'view' END AS compared_with FROM synthetic)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars: figure_id is a brand, category a type, value how many parts, place its order."""
    p = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("figure_id"), F.col("p_type").alias("category")).agg(F.count("*").alias("value"))
    from pyspark.sql import Window

    return p.withColumn("place", F.row_number().over(Window.partitionBy("figure_id").orderBy("category")).cast("long"))


POINTS = "points AS (SELECT *, row_number() OVER (PARTITION BY figure_id ORDER BY category) AS place FROM (SELECT p_brand AS figure_id, p_type AS category, count(*) AS value FROM part GROUP BY 1, 2))"


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = F.array_sort(F.collect_list(F.struct("place", "category", "value")))
    rows = points(spark, sf_dir).groupBy("figure_id").agg(bars.alias("b"))
    return rows.select("figure_id", F.transform("b", lambda x: x["category"]).alias("categories"), F.transform("b", lambda x: x["value"]).alias("values"), F.lit(0).alias("axis_min"), F.lit(100).alias("axis_max"), F.lit("medium").alias("tick_density"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    a, b = F.col("l_partkey") % 7, F.col("l_suppkey") % 7
    at = lambda n, k: (n * n * k + 3 * n) % 11
    return li.select(F.col("l_orderkey").alias("figure_id"), F.xxhash64("l_partkey", "l_suppkey").alias("h"), F.col("l_linenumber").alias("eid"), a.alias("a"), b.alias("b"), at(a, 2).alias("ax"), at(a, 5).alias("ay"), at(b, 2).alias("bx"), at(b, 5).alias("by")).drop("h")


EDGES = "edges AS (SELECT *, (a * a * 2 + 3 * a) % 11 AS ax, (a * a * 5 + 3 * a) % 11 AS ay, (b * b * 2 + 3 * b) % 11 AS bx, (b * b * 5 + 3 * b) % 11 AS by_ FROM (SELECT l_orderkey AS figure_id, l_linenumber AS eid, l_partkey % 7 AS a, l_suppkey % 7 AS b FROM lineitem))"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight tokens of eight whole numbers for each embedding; four image, three text, one special."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    kinds = ("image", "image", "image", "image", "text", "text", "text", "special")
    rows = e.select("item_id", F.lit(0).alias("layer"), "embedding", F.posexplode(F.array(*map(F.lit, kinds))).alias("pos", "kind"))
    return rows.withColumn("vec", F.transform(F.slice("embedding", 8 * F.col("pos") + 1, 8), lambda x: F.floor(x.cast("double") * 100))).drop("embedding")
