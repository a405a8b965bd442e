"""Streams over the stand-in tables: written as files, read file by file, equal to the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.labels import last_labels
from evalspark.plans import standins as S
from evalspark.plans.registry import query
from evalspark.plans.score_queries import accuracy_by_day
from evalspark.plans.registry import ORACLE_SQL
from evalspark.sources.shared import shared_path
from evalspark.streaming.labels import current_labels, finished_windows, label_stream, running_accuracy, upsert_labels, windowed_accuracy


@query(f"WITH {S.LABELLED} SELECT item_id, label FROM labels_llm")
def stream_last_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last label of each item from a stream over an append-only log."""
    source, target, state = (shared_path(spark, f"label-{x}") for x in ("log", "table", "state"))
    log = S.labels(spark, sf_dir).select(F.lit("llm").alias("rater"), "item_id", "seq", "label")
    log.repartitionByRange(3, "seq").write.parquet(source)
    stream = label_stream(spark, source, "rater string, item_id string, seq long, label string")
    upsert_labels(stream, target, state, compact=2).awaitTermination()
    return current_labels(spark, target).select("item_id", "label")


@query(ORACLE_SQL[accuracy_by_day.__name__])
def stream_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and right answers by day and source from a stream, each window's last update."""
    source, target, state = (shared_path(spark, f"answers-{x}") for x in ("log", "windows", "state"))
    rows = S.items(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "source", "gold", "prediction")
    rows.repartitionByRange(3, "ts").write.parquet(source)
    stream = label_stream(spark, source, "ts timestamp, source string, gold string, prediction string")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    run = running_accuracy(stream, late="400 days").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    windows = spark.read.parquet(target).select("start", "source", F.col("batch").alias("seq"), "n", "n_correct")
    return last_labels(windows, ["start", "source"]).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "source", "n", "n_correct")


@query(f"""WITH {S.ANSWERS}, b AS (SELECT floor(epoch(ts))::bigint % 3 AS k, time_bucket(INTERVAL 1 day, ts) AS start, ts, source, correct::int AS ok FROM answers), m AS (SELECT k, max(max(ts)) OVER (ORDER BY k) - INTERVAL 10 days AS mark FROM b GROUP BY k),
  r AS (SELECT b.*, coalesce(start + INTERVAL 1 day <= m.mark, false) AS late FROM b LEFT JOIN m ON m.k = b.k - 1)
  SELECT strftime(start, '%Y-%m-%d') AS day, source, count(*) FILTER (NOT late) AS n, coalesce(sum(ok) FILTER (NOT late), 0)::bigint AS n_correct, count(*) FILTER (late) AS late
  FROM r WHERE start + INTERVAL 1 day <= (SELECT max(mark) FROM m) GROUP BY 1, 2""")
def stream_late_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of answers that the watermark has passed, from a stream whose three files each span all days: what came too late is counted beside."""
    source, target, state = (shared_path(spark, f"late-{x}") for x in ("log", "windows", "state"))
    rows = S.items(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "source", "gold", "prediction", (F.unix_timestamp(F.col("ts").cast("timestamp")) % 3).alias("k"))
    for k in range(3):
        rows.where(F.col("k") == k).drop("k").coalesce(1).write.mode("append").parquet(source)
    stream = label_stream(spark, source, "ts timestamp, source string, gold string, prediction string")
    windowed_accuracy(stream, target, state, late="10 days").awaitTermination()
    got = finished_windows(spark, target)
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "source", "n", "n_correct", "late")
