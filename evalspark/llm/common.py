"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java and RE2 class of the characters that words are made of: everything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder in spark.checkpoint.dir, which all executors see.

    Where that setting is absent a folder of this machine is used if Spark runs on this machine only; else it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{tempfile.gettempdir()}/evalspark-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts its lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys up to this many pick their rows by a broadcast, more by a shuffle; either gives the same rows.
BROADCAST_KEYS = 1_000_000


def picked(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose columns on are in keys, a written table."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys, on, "left_semi")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; NULL ids fall into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def training_sample(rows: DataFrame, label: str, max_rows: int, max_bytes: int) -> DataFrame:
    """text and label of a bounded seeded sample of rows (doc_id, text, label), whole texts in the order of their ids' hashes.

    The first max_rows different rows take part, as far as their texts come to max_bytes together; a text of
    more than a sixteenth of that is left out. Rows that repeat id and text count once, with the largest label.
    """
    marked = rows.select("doc_id", "text", label, F.xxhash64("text").alias("_t"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    known = marked.where(size * 16 <= max_bytes).groupBy("doc_id", "_t").agg(F.max(size).alias("_n"))
    first = known.withColumn("_k", F.xxhash64("doc_id")).orderBy("_k", "doc_id", "_t").limit(max_rows)
    line = Window.orderBy("_k", "doc_id", "_t").rowsBetween(Window.unboundedPreceding, 0)
    keys = first.withColumn("_sum", F.sum("_n").over(line)).where(F.col("_sum") <= max_bytes).select("doc_id", "_t")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_s"))
    met = marked.join(F.broadcast(keys.select(F.col("doc_id").alias("_d"), F.col("_t").alias("_s"))), same, "left_semi")
    once = met.groupBy("doc_id", "_t").agg(F.min("text").alias("text"), F.max(label).alias(label))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id", "_t").select("text", label)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Within it, jobs send their rows to Python in batches of at most so many: for wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Longer texts are cut for numpy work arrays, at white space.
LONG_TEXT = 500_000
_BLANK = re.compile(r"[\x20\x09-\x0D]")


def cuts(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """The text in parts of about size characters that end at white space, so that no word is cut."""
    at = 0
    while len(text) - at > size and (end := _BLANK.search(text, at + size)):
        yield text[at : end.start()]
        at = end.start()
    yield text[at:]


def cut_texts(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The parts of all texts, and the number of the text that each is from."""
    parts = [list(cuts(t)) if len(t) > LONG_TEXT else [t] for t in texts]
    return [p for x in parts for p in x], np.repeat(np.arange(len(texts)), [len(x) for x in parts])


def pieces(texts: list[str | None], max_docs: int = 512, max_chars: int = LONG_TEXT) -> Iterator[tuple[int, list[str]]]:
    """Consecutive runs of texts, small enough for numpy work arrays: (offset, texts). None becomes empty."""
    at, run, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if run and (len(run) >= max_docs or size + len(text) > max_chars):
            yield at, run
            at, run, size = i, [], 0
        run.append(text)
        size += len(text)
    if run:
        yield at, run


def fresh(df: DataFrame, name: str) -> str:
    """name, or one with underscores after it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def plain_names(df: DataFrame) -> DataFrame:
    """df with columns c0, c1 ...: names that mapInArrow can look up, which it can't where one has a dot."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MULTIPLIER = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse modulo 2**64."""
    if not _powers or len(_powers["up"]) < size:
        room = 1 << max(16, (size - 1).bit_length())
        for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
            _powers[name] = np.cumprod(np.full(room, base, dtype=np.uint64))
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_places(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in UTF-8 with A-Z lowered, laid end to end; the start, end and 64-bit hash of each word; the words of each text."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    buffer = np.frombuffer(b" ".join(encoded) + b" ", dtype=np.uint8)
    lower = buffer + (((buffer >= 65) & (buffer <= 90)).astype(np.uint8) << 5)
    space = _SPACE[buffer]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power_tables(len(buffer) + 1)
    sums = np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up[: len(buffer)], dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    words = mixed((sums[ends - 1] - before) * down[starts] + (ends - starts).astype(np.uint64))
    limits = np.cumsum([len(e) + 1 for e in encoded])
    owner = np.searchsorted(limits, starts, side="right")
    return lower, starts, ends, words, np.bincount(owner, minlength=len(texts))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lowered) of the texts, and the number of words of each text."""
    parts, owner = cut_texts(texts)
    found = [word_places(run)[3:] for _, run in pieces(parts)]
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    hashes, counts = (np.concatenate(x) for x in zip(*found))
    return hashes, np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)


def shingle_sets(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct word-shingle hashes (54 bits) of each of at most 1,023 texts.

    Returns all hashes, text after text, and the set sizes. A text with fewer words than size has
    one shingle of all its words; a text without words has none.
    """
    assert len(texts) < 1024
    words, counts = word_hashes(texts)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    owner = np.repeat(np.arange(len(texts)), counts)
    total = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for k in range(size):
        total += words[k : len(words) - size + 1 + k] * mixed(np.uint64([k + 1]))
    inside = owner[: len(total)] == owner[size - 1 :]
    keys, owners = total[inside], owner[: len(total)][inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            whole[has] += words[first[short[has]] + k] * mixed(np.uint64([k + 1]))
        keys, owners = np.concatenate((keys, whole)), np.concatenate((owners, short))
    packed = np.sort((owners.astype(np.uint64) << np.uint64(54)) | (mixed(keys) >> np.uint64(10)))
    if len(packed):
        packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))]
    owners = (packed >> np.uint64(54)).astype(np.int64)
    return packed & np.uint64((1 << 54) - 1), np.bincount(owners, minlength=len(texts))
