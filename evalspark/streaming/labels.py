"""Streams of labels and of answers, kept as tables that a restart finds as they were.

Each batch writes folders of its own number from those of the batch before it, so that a batch which is run again after a failure gives the same; what the
next batch no longer needs is deleted then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evalspark.functions.text import is_correct
from evalspark.operators.labels import last_labels

#: Batches after which the labels' table is written anew.
COMPACT = 16


def label_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system and path for a folder, wherever it is stored."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The batches that have a finished folder below path."""
    system, place = _folder(spark, path)
    if not system.exists(place):
        return []
    found = [x.getPath() for x in system.listStatus(place) if x.getPath().getName().startswith("batch=")]
    done = [x for x in found if system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted(int(x.getName().partition("=")[2]) for x in done)


def forget(spark: SparkSession, path: str, before: int) -> None:
    """Deletes the folders below path of batches before that number."""
    for n in numbers(spark, path):
        if n < before:
            system, place = _folder(spark, f"{path}/batch={n}")
            system.delete(place, True)


def upsert_labels(stream: DataFrame, target: str, checkpoint: str, order: Sequence[str] = ("seq",), compact: int = COMPACT) -> StreamingQuery:
    """Keeps the last record, in the order of columns, of each rater and item: a table of all batches up to one (target/base), and what came since (target/new).

    A batch writes its own rows only; every compact batches the table is written anew and the older folders go, so that neither the number of folders nor
    what current_labels reads grows with the stream's age.
    """
    columns = stream.columns

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last_labels(batch, ["rater", "item_id"], order).select(*columns).write.mode("overwrite").parquet(f"{target}/new/batch={number}")
        if (number + 1) % compact == 0:
            whole = current_labels(spark, target, order, number - 1 if number else None, f"{target}/new/batch={number}")
            whole.select(*columns).write.mode("overwrite").parquet(f"{target}/base/batch={number}")
        # The batch before this one is surely done: what its table holds is no longer needed.
        if done := [n for n in numbers(spark, f"{target}/base") if n < number]:
            forget(spark, f"{target}/new", done[-1] + 1)
            forget(spark, f"{target}/base", done[-1])

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_labels(spark: SparkSession, target: str, order: Sequence[str] = ("seq",), upto: int | None = None, *more: str) -> DataFrame:
    """The last record of each rater and item, of all batches or of those up to one, and of more folders."""
    base = [n for n in numbers(spark, f"{target}/base") if upto is None or n <= upto]
    since = [n for n in numbers(spark, f"{target}/new") if (not base or n > base[-1]) and (upto is None or n <= upto)]
    paths = [f"{target}/base/batch={n}" for n in base[-1:]] + [f"{target}/new/batch={n}" for n in since] + list(more)
    return last_labels(spark.read.parquet(*paths), ["rater", "item_id"], order)


def running_accuracy(answers: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, source, n, n_correct over tumbling windows of an answers stream (ts, source, gold, prediction), with a watermark."""
    right = is_correct(F.col("gold"), F.col("prediction")).cast("int")
    rows = answers.withColumn("_ok", right)
    if answers.isStreaming:
        rows = rows.withWatermark("ts", late)
    got = rows.groupBy(F.window("ts", width).alias("w"), "source").agg(F.count("*").alias("n"), F.sum("_ok").alias("n_correct"))
    return got.select(F.col("w.start").alias("start"), "source", "n", "n_correct")


def windowed_accuracy(answers: DataFrame, target: str, checkpoint: str, width: str = "1 day", late: str = "1 hour") -> StreamingQuery:
    """Windows of an answers stream (ts, source, gold, prediction) with the rows that came too late for them; finished_windows and open_windows read the result.

    A row is late if its window ended before the watermark: the greatest ts of all batches before, less late. It isn't counted in the window, whose counts
    are final by then, but beside it. A window is in the open table, which each batch writes anew, until the watermark passes it, and then
    in the closed one, which only grows. Rows without ts are in no window.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in numbers(spark, f"{target}/mark") if n < number]
        mark = spark.read.parquet(f"{target}/mark/batch={before[-1]}").first()["mark"] if before else None
        rows = batch.where("ts is not null").withColumn("_ok", is_correct(F.col("gold"), F.col("prediction")).cast("int")).withColumn("w", F.window("ts", width))
        rows = rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "source", "ts", "_ok")
        past = F.lit(False) if mark is None else F.col("end") <= F.lit(mark)
        counted = rows.groupBy("start", "end", "source", past.alias("_past")).agg(F.count("*").alias("n"), F.sum("_ok").alias("n_correct"), F.max("ts").alias("_ts"))
        counted = counted.persist()
        newest = counted.agg((F.max("_ts") - F.expr(f"INTERVAL {late}")).alias("mark")).first()["mark"]
        after = newest if mark is None else mark if newest is None else max(mark, newest)
        counted.where("_past").select("start", "source", F.col("n").alias("late")).write.mode("overwrite").parquet(f"{target}/late/batch={number}")
        now = counted.where("not _past").select("start", "end", "source", "n", "n_correct")
        if before:
            now = now.union(spark.read.parquet(f"{target}/open/batch={before[-1]}").select(*now.columns))
        whole = now.groupBy("start", "end", "source").agg(F.sum("n").alias("n"), F.sum("n_correct").alias("n_correct"))
        done = F.lit(False) if after is None else F.col("end") <= F.lit(after)
        whole.where(done).write.mode("overwrite").parquet(f"{target}/closed/batch={number}")
        whole.where(~done).write.mode("overwrite").parquet(f"{target}/open/batch={number}")
        spark.createDataFrame([(after,)], "mark timestamp").coalesce(1).write.mode("overwrite").parquet(f"{target}/mark/batch={number}")
        counted.unpersist()
        if before:  # the batch before this one may still be asked for, those before it not
            forget(spark, f"{target}/open", before[-1])
            forget(spark, f"{target}/mark", before[-1])

    return answers.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished_windows(spark: SparkSession, target: str) -> DataFrame:
    """start, source, n, n_correct, late of the windows that the watermark has passed; a window of late rows alone has 0 rows."""
    closed = [f"{target}/closed/batch={n}" for n in numbers(spark, f"{target}/closed")]
    late = [f"{target}/late/batch={n}" for n in numbers(spark, f"{target}/late")]
    counts = spark.read.parquet(*closed).select("start", "source", "n", "n_correct", F.lit(0).cast("long").alias("late"))
    none = spark.read.parquet(*late).select("start", "source", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_correct"), "late")
    return counts.union(none).groupBy("start", "source").agg(F.sum("n").alias("n"), F.sum("n_correct").alias("n_correct"), F.sum("late").alias("late"))


def open_windows(spark: SparkSession, target: str) -> DataFrame:
    """start, source, n, n_correct of the windows that may still grow."""
    last = numbers(spark, f"{target}/open")[-1]
    return spark.read.parquet(f"{target}/open/batch={last}").select("start", "source", "n", "n_correct")
