"""Queries that write the stand-in tables in a reader's format and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators import probes, quality
from evalspark.operators.labels import last_labels
from evalspark.plans import standins as S
from evalspark.plans.registry import query
from evalspark.sources import tables
from evalspark.sources.shared import shared_path

_PART_ITEMS = "SELECT 'f' || p_partkey % 97 AS figure_id, 'Which size has ' || p_type || '?' AS question, p_size::varchar AS gold FROM part"


@query(f"{_PART_ITEMS}")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "lines")
    rows = S.read(spark, sf_dir, "part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 97).cast("string")).alias("figure_id"), F.concat(F.lit("Which size has "), "p_type", F.lit("?")).alias("question"), F.col("p_size").cast("string").alias("gold"))
    tables.write_manifest(rows, path, "json")
    return tables.read_lines(spark, path, "figure_id string, question string, gold string")


@query(f"WITH {S.ANSWERS} SELECT item_id, gold, prediction, correct FROM answers")
def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with unique ids, from their manifest."""
    path = shared_path(spark, "answers")
    tables.write_manifest(S.answers(spark, sf_dir).select("item_id", "gold", "prediction", "correct"), path, "json")
    return tables.read_answers(spark, path, "item_id string, gold string, prediction string, correct boolean")


def _rating_logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """ratings() as one log a rater; some lines are cut short, some have an unknown label."""
    folder = shared_path(spark, "ratings")
    line = F.to_json(F.struct(F.col("item_id").cast("string").alias("item_id"), "label"))
    odd = F.when(F.col("item_id") % 17 == 0, F.substring(line, 1, 12)).when(F.col("item_id") % 19 == 0, F.regexp_replace(line, '"label":"[^"]*"', '"label":"other"')).otherwise(line)
    rows = S.ratings(spark, sf_dir).select("rater", odd.alias("value"))
    for rater in ("r0", "r1", "r2", "adjudicated"):
        rows.where(F.col("rater") == rater).select("value").write.text(f"{folder}/{rater}.jsonl")
    return tables.read_ratings(spark, folder)


@query(f"WITH {S.RATINGS} SELECT rater, item_id::varchar AS item_id, label FROM ratings WHERE item_id % 17 <> 0 AND item_id % 19 <> 0")
def rating_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_labels(_rating_logs(spark, sf_dir)[0], ["rater", "item_id"]).select("rater", "item_id", "label")


@query(f"WITH {S.RATINGS} SELECT rater, count(*) AS skipped FROM ratings WHERE item_id % 17 = 0 OR item_id % 19 = 0 GROUP BY 1")
def skipped_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rating_logs(spark, sf_dir)[1]


@query(f"WITH {S.OUTCOMES} SELECT item_id, intervention, recovered FROM outcomes")
def resumed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes appended in three runs, each of which repeats what the one before it did."""
    path = shared_path(spark, "outcomes")
    rows = S.outcomes(spark, sf_dir).select("item_id", "intervention", "recovered")
    for actions in (S.ACTIONS[:2], S.ACTIONS[:4], S.ACTIONS):
        tables.append_new(rows.where(F.col("intervention").isin(*actions)), path, ["item_id", "intervention"])
    return spark.read.schema(rows.schema).parquet(path)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.vectors(spark, sf_dir).select(F.col("item_id").cast("string").alias("item_id"), "figure_id", "layer", "position", "vec")


@query("SELECT vec_id::varchar AS item_id, layer::int AS layer, floor(embedding[16 * layer + 1]::double * 1000)::bigint AS first FROM embeddings, (SELECT unnest([1, 3]) AS layer)")
def scanned_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One position and two layers of a partitioned vector table."""
    path = shared_path(spark, "vectors")
    tables.write_vectors(_vectors(spark, sf_dir), path)
    got = tables.scan_vectors(spark, path, "query_last", [1, 3])
    return got.select("item_id", "layer", F.floor(F.col("vec")[0].cast("double") * 1000).cast("long").alias("first"))


@query("SELECT layer::int AS layer, position, count(*) AS n FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS layer), (SELECT unnest(['query_last', 'vision_mean']) AS position) GROUP BY 1, 2")
def merged_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    shard = F.crc32(F.col("item_id").cast("binary")) % 3
    merged = tables.merge_shards([rows.where(shard == k) for k in range(3)], rows.select("item_id").distinct())
    return merged.groupBy("layer", "position").agg(F.count("*").alias("n"))


@query(f"""WITH {S.LABELLED} SELECT layer::int AS layer, CASE WHEN h < 0.2 THEN 'test' WHEN h < 0.4 THEN 'val' ELSE 'train' END AS split, y, count(*) AS n
  FROM (SELECT event_id, (NOT correct AND label = 'structural')::int AS y, ('0x' || substr(sha1('42' || chr(31) || figure_id), 1, 8))::bigint / 4294967295.0 AS h FROM joined WHERE correct OR label IS NOT NULL) JOIN embeddings ON vec_id = event_id, (SELECT unnest([0, 1, 2, 3]) AS layer) GROUP BY ALL""")
def task_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a task's probes: vectors joined with the population by item, no figure in two splits."""
    answers = S.answers(spark, sf_dir)
    keyed = S.vectors(spark, sf_dir).where("position = 'query_last'").join(answers.select(F.col("event_id").alias("item_id"), F.col("item_id").alias("_key"), F.col("figure_id").alias("_figure")), "item_id")
    vectors = keyed.select(F.col("_key").alias("item_id"), F.col("_figure").alias("figure_id"), "layer", "position", "vec")
    rows = probes.dataset(vectors, answers, last_labels(S.labels(spark, sf_dir), ["item_id"]), "structural", "correct")
    return rows.groupBy("layer", "split", "y").agg(F.count("*").alias("n"))


_LEAKS = "g AS (SELECT p_brand AS figure_id, CASE WHEN p_size % 3 = 0 THEN 'test' WHEN p_size % 3 = 1 THEN 'train' ELSE 'val' END AS split FROM part), d AS (SELECT DISTINCT * FROM g)"


@query(f"WITH {_LEAKS} SELECT a.split AS one, b.split AS other, count(*) AS n, array_to_string(list(a.figure_id ORDER BY a.figure_id)[1:5], ',') AS sample FROM d a JOIN d b ON a.figure_id = b.figure_id AND a.split < b.split GROUP BY 1, 2")
def leaks_by_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("p_size") % 3 == 0, "test").when(F.col("p_size") % 3 == 1, "train").otherwise("val")
    rows = S.read(spark, sf_dir, "part").select(F.col("p_brand").alias("figure_id"), split.alias("split"))
    return quality.group_leaks(rows).select("one", "other", "n", F.array_join("sample", ",").alias("sample"))


@query(f"""WITH {S.POINTS}, f AS (SELECT *, lag(value) OVER (PARTITION BY figure_id ORDER BY place) > value AS down, count(*) OVER (PARTITION BY figure_id) AS n FROM points)
  SELECT DISTINCT figure_id, 'gold differs' AS problem FROM f WHERE place = 3 AND right(figure_id, 1) IN ('1', '3') UNION ALL SELECT DISTINCT figure_id, 'wording differs' FROM f WHERE place = 7
  UNION ALL SELECT DISTINCT figure_id, 'against the trend' FROM f WHERE down""")
def question_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures whose third gold may be off by one, and whose seventh question is worded otherwise."""
    bad = (F.col("place") == 3) & F.substring("figure_id", -1, 1).isin("1", "3")
    text = F.concat(F.when(F.col("place") % 7 == 0, "Tell the value of ").otherwise("What is the value of "), "category", F.lit("?"))
    q = F.struct("place", F.lit("read_value").alias("template"), F.lit("plain").alias("phrasing"), F.col("category").alias("asks_about"), text.alias("question"), (F.col("value") + bad.cast("int")).cast("string").alias("gold_answer"))
    asked = S.points(spark, sf_dir).groupBy("figure_id").agg(F.array_sort(F.collect_list(q)).alias("questions"))
    return quality.check_questions(S.figures(spark, sf_dir).join(asked, "figure_id").withColumn("trend", F.lit("rising")))
