"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

Each text is normalised (A-Z lowered) and cut where its content says so: a chunk ends at the first
sentence or line end after MIN_CHUNK characters, at MAX_CHUNK otherwise, so equal texts have equal
chunks and an edit moves only the cuts close to it. A chunk's identifier is its 64-bit hash,
verified by its SHA-256: hashes shared by different chunks, if any, are found by counting digests
per hash after a map-side combine, and their chunks are told apart by the digest's rank. A text is
then its recipe, the ordered list of identifiers; equal texts are those with equal recipes. Texts
themselves are never shuffled, whatever their length; 40 bytes a chunk are.

Of equal texts the row with the largest doc_id stays (a NULL id only if all are NULL; of rows with
the same id all report that id, and each counts). Null text counts as empty; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import written

MIN_CHUNK, MAX_CHUNK = 1024, 8192
CHUNK_PATTERN = r"(?s).{%d,%d}?(?:[.!?\n](?=\s)|(?<=\n)|$)|.{1,%d}" % (MIN_CHUNK, MAX_CHUNK, MAX_CHUNK)


def normalised(text: Column) -> Column:
    """text with A-Z lowered and nothing else changed; NULL becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def chunks(text: Column) -> Column:
    """The content-defined chunks of a text, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK_PATTERN), F.lit(0))


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, recipe: arrays of chunk hashes and of their digests, in order."""
    text = docs.select("doc_id", normalised(F.col("text")).alias("_text"))
    cut = text.select("doc_id", F.sha2(F.encode("_text", "UTF-8"), 256).alias("text_sha256"), chunks(F.col("_text")).alias("_chunks"))
    return cut.select(
        "doc_id",
        "text_sha256",
        F.transform("_chunks", lambda c: F.xxhash64(c)).alias("hashes"),
        F.transform("_chunks", lambda c: F.unhex(F.sha2(F.encode(c, "UTF-8"), 256))).alias("digests"),
    )


def verified_recipes(coded: DataFrame) -> DataFrame:
    """coded with recipe: its identifiers, a chunk hash each, and for hashes of more than one chunk the digest's rank."""
    pairs = coded.select(F.explode(F.arrays_zip("hashes", "digests")).alias("c")).select("c.hashes", "c.digests").distinct()
    shared = pairs.groupBy("hashes").agg(F.count("*").alias("_n")).where("_n > 1").select("hashes")
    ranks = pairs.join(shared, "hashes").select("hashes", "digests", F.row_number().over(Window.partitionBy("hashes").orderBy("digests")).alias("_rank"))
    # Almost always there is no such hash; documents that have one get their ranks by a join of their own.
    clash = written(ranks, "dedup-clashes")
    flagged = coded.withColumn("_row", F.monotonically_increasing_id())
    hit = flagged.select("_row", F.posexplode("hashes").alias("_pos", "hashes"), "digests")
    hit = hit.withColumn("digests", F.element_at("digests", F.col("_pos") + 1)).join(clash, ["hashes", "digests"])
    marks = hit.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", "_rank"))).alias("_ranks"))
    joined = flagged.join(marks, "_row", "left") if not clash.isEmpty() else coded.withColumn("_ranks", F.lit(None).cast("array<struct<_pos:int,_rank:int>>"))
    return joined.select("doc_id", "text_sha256", "hashes", "_ranks")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text)."""
    coded = written(recipes(docs), "dedup-recipes")
    known = verified_recipes(coded)
    key = ["hashes", "_ranks"]
    groups = known.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Groups of one need no join: only recipes that occur again are looked up by their rows.
    groups = groups.select(F.col("hashes").alias("_h"), F.col("_ranks").alias("_r"), "keep_id", "group_size").where("group_size > 1")
    rows = known.join(groups, (F.col("hashes") == F.col("_h")) & F.col("_ranks").eqNullSafe(F.col("_r")), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
