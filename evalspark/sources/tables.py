"""Readers and writers of the evaluation tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.operators.labels import LABELS
from evalspark.operators.quality import check_labels, repeated

#: Rows of either side that a task of append_new sorts.
ROWS_A_TASK = 1_000_000
ITEM = "imgname string, query string, label string"
RATING = "item_id string, label string, reason string, rationale string, annotator string, timestamp string"


def read_items(spark: SparkSession, root: str, splits: list[str], sources: list[str]) -> DataFrame:
    """figure_id, question, gold, split, source, pos of the question files {split}/{split}_{source}.json; absent files are left out."""
    wanted = "{" + ",".join(f"{s}/{s}_{o}" for s in splits for o in sources) + "}.json"
    raw = spark.read.option("multiLine", True).option("ignoreMissingFiles", True).schema(ITEM).json(f"{root}/{wanted}")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    rows = raw.select(F.col("imgname").alias("figure_id"), F.col("query").alias("question"), F.col("label").alias("gold"), F.substring_index(name, "_", 1).alias("split"), F.regexp_extract(name, r"^[^_]*_(.*)$", 1).alias("source"))
    return rows.withColumn("pos", F.monotonically_increasing_id())


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON object of a line-delimited file; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_ratings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(ratings, skipped): rows of each *.jsonl, a file or a folder of files, rater from its name; rows that can't be used are counted by rater."""
    kept = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(RATING + ", _bad string").json(f"{folder}/*.jsonl")
    rows = kept.withColumn("rater", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl(?:/[^/]*)?$", 1)).withColumn("seq", F.monotonically_increasing_id())
    good = F.col("_bad").isNull() & F.col("item_id").isNotNull() & F.coalesce(F.col("label").isin(*LABELS), F.lit(False))
    ratings = rows.where(good).withColumn("ts", F.try_to_timestamp(F.col("timestamp"))).drop("_bad", "timestamp")
    return ratings, rows.where(~good).groupBy("rater").agg(F.count("*").alias("skipped"))


def read_answers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Answers whose item_id is there and unique; else an error."""
    rows = read_lines(spark, path, schema)
    bad = repeated(rows, "item_id").limit(1).collect()
    if bad:
        raise ValueError(f"item_id {bad[0]['item_id']!r} is missing or repeated in {path}")
    return rows


def write_manifest(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    rows.write.mode("overwrite").format(fmt).save(path)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose keys the table at path doesn't have yet, in one commit; returns how many."""
    spark = rows.sparkSession
    try:
        done = spark.read.schema(rows.schema).parquet(path)
        # As many parts as the rows need: what a task sorts doesn't grow with the table, and no table of keys is sent to all tasks.
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-max(rows.count(), done.count()) // ROWS_A_TASK))
        done = done.select(*keys).repartition(parts, *keys).hint("merge")
        rows = rows.repartition(parts, *keys).join(done, keys, "left_anti").select(*rows.columns)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows = rows.persist()
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    rows.unpersist()
    return n


def append_labels(labels: DataFrame, batch: DataFrame, path: str) -> int:
    """Appends a batch's labels to the table at path, unless one of them is wrong or already there: that is an error and nothing is written."""
    bad = [f"{r['item_id']}: {r['problem']}" for r in check_labels(labels, batch).limit(5).collect()]
    if bad:
        raise ValueError(f"labels refused: {bad}")
    n = labels.count()
    try:
        done = labels.sparkSession.read.schema(labels.schema).parquet(path).select("item_id")
        again = labels.join(done, "item_id", "left_semi").count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        again = 0
    if again:
        raise ValueError(f"{again} items have labels already")
    labels.write.mode("append").parquet(path)
    return n


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").partitionBy("position", "layer").parquet(path)


def scan_vectors(spark: SparkSession, path: str, position: str, layers: list[int] | None = None) -> DataFrame:
    """Vectors of one position and some layers, pruned by partition; an error if a part isn't there."""
    rows = spark.read.parquet(path).where(F.col("position") == position)
    have = {r["layer"] for r in rows.select("layer").distinct().collect()}  # one value for each folder
    if not have or (layers and set(layers) - have):
        raise ValueError(f"{path} has no {position!r} vectors of layers {sorted(set(layers or []) - have)}")
    return rows.where(F.col("layer").isin(*(layers or have)))


def write_bucketed(vectors: DataFrame, path: str, buckets: int = 64) -> None:
    """Vectors in a folder for each position and layer, within it in buckets by item_id, sorted: what is joined by item_id with a table that open_bucketed opens moves no vector.

    One file a bucket and folder; choose as many buckets as make files of some hundred MB.
    """
    spark, name = vectors.sparkSession, f"vectors_{uuid.uuid4().hex}"
    dealt = vectors.repartition(buckets, "item_id").sortWithinPartitions("position", "layer", "item_id")
    dealt.write.partitionBy("position", "layer").bucketBy(buckets, "item_id").sortBy("item_id").option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    layout = vectors.select([c for c in vectors.columns if c not in ("position", "layer")]).schema.json(), vectors.select("position", "layer").schema.json()
    spark.createDataFrame([(buckets, *layout)], "buckets int, columns string, folders string").coalesce(1).write.json(f"{path}/_layout")


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The vectors that write_bucketed has written to path, by any session."""
    layout = spark.read.schema("buckets int, columns string, folders string").json(f"{path}/_layout").first()
    columns, folders = (T.StructType.fromJson(json.loads(layout[k])) for k in ("columns", "folders"))
    name = f"vectors_{uuid.uuid4().hex}"
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*columns.fields, *folders.fields])
    spark.sql(f"CREATE TABLE {name} ({spec}) USING parquet PARTITIONED BY (position, layer) CLUSTERED BY (item_id) SORTED BY (item_id) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
    spark.catalog.recoverPartitions(name)
    return spark.table(name)


def merge_shards(shards: list[DataFrame], expected: DataFrame) -> DataFrame:
    """The union of vector shards; an error if an item is in two, or the items aren't the expected ones."""
    rows = shards[0]
    for s in shards[1:]:
        rows = rows.unionByName(s)
    again = rows.groupBy("item_id", "layer", "position").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if again:
        raise ValueError(f"item {again[0]['item_id']!r} is in two shards")
    cells = F.sort_array(F.collect_set(F.struct("layer", "position")))
    shapes = [s.agg(cells.alias("c")).first()["c"] for s in shards]  # one value for each folder of a vector table
    if any(x != shapes[0] for x in shapes):
        raise ValueError("the shards don't hold the same layers and positions")
    ids = rows.select("item_id").distinct()
    lost, extra = expected.join(ids, "item_id", "left_anti").count(), ids.join(expected, "item_id", "left_anti").count()
    if lost or extra:
        raise ValueError(f"{lost} expected items are in no shard, {extra} items weren't expected")
    return rows


def figure_items(figures: DataFrame, split: str) -> DataFrame:
    """One row for each question of the figures of a split; gold as a string, the question's other fields as they are."""
    names = [f.name for f in figures.schema["questions"].dataType.elementType.fields if f.name not in ("gold_answer", "question")]
    rows = figures.where(F.col("split") == split).select("figure_id", "split", "categories", F.posexplode("questions").alias("pos", "q"))
    return rows.select("figure_id", "split", "categories", "pos", F.col("q.question").alias("question"), F.col("q.gold_answer").cast("string").alias("gold"), *[F.col(f"q.{n}").alias(n) for n in names])


def annotation_items(rows: DataFrame) -> DataFrame:
    """item_id, image_path, question, gold_answer, model_answer of item rows, manifest rows or nested figures; nothing that names the model."""
    if "questions" in rows.columns:
        each = rows.select("figure_id", F.posexplode("questions").alias("n", "q"))
        return each.select(F.concat("figure_id", F.lit("_q"), F.col("n").cast("string")).alias("item_id"), F.col("figure_id").alias("image_path"), F.col("q.question").alias("question"), F.col("q.gold_answer").cast("string").alias("gold_answer"), F.lit("").alias("model_answer"))
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    some = lambda a, b: F.coalesce(F.nullif(has(a), F.lit("")), has(b), F.lit(""))
    key = F.coalesce(F.nullif(has("item_id"), F.lit("")), F.concat(has("figure_id"), F.lit("::"), has("question")))
    return rows.select(key.alias("item_id"), some("image_path", "figure_id").alias("image_path"), has("question").alias("question"), some("gold_answer", "gold").alias("gold_answer"), some("model_answer", "prediction").alias("model_answer"))


def tagged_union(runs: dict[str, DataFrame]) -> DataFrame:
    """Runs stacked with a pilot column, their figure ids kept apart by its name."""
    parts = [df.withColumn("pilot", F.lit(name)).withColumn("figure_id", F.concat(F.lit(f"{name}/"), "figure_id")) for name, df in runs.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows


VECTOR_SCHEMA = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("figure_id", T.StringType()), T.StructField("layer", T.IntegerType()), T.StructField("position", T.StringType()), T.StructField("vec", T.ArrayType(T.FloatType()))])
