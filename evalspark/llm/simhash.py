"""SimHash near-duplicates: fingerprints of word shingles that differ by two bits or fewer.

1. Each text has a fingerprint of 64 bits, of which one is set if it is set in over half of the hashes of the text's shingles.
   Rows of one fingerprint are one from here on, named by their smallest doc_id.
2. A fingerprint is cut into two segments of 32 bits, so that of two fingerprints within two bits one segment differs by one bit at most.
   The index has, for each fingerprint, both segments whole and the variants of the first with one bit wild (deleted, and its place told).
   That is all that is needed: if one segment is equal the other may differ by two bits; else both differ by one, and the first meets by a variant.
   Equal keys of the index meet (fingerprints of a key are sorted to one task) and are verified by their bits.
3. A key whose segment more than HOT fingerprints have is cut once more, by the variants of two segments of 16 bits of what is left. A key then fixes 46 bits at
   least, so no task gathers more than 2**17 fingerprints. The list of such segments is bounded by MAX_HOT; it changes the work, not the result.
4. In a key of many fingerprints no pairs are made: those that agree in all but two bits are neighbours after sorting with these bits wild, for each two
   bits that the key leaves open. A key gives as many links as make a forest of its groups; all links give components.

Rows with NULL doc_id have a fingerprint and no component. A null or empty text, or one of white space, has the fingerprint 0 and links like any other. Rows that
repeat a doc_id are one document with several texts: a link of any counts. An empty table gives no rows; extra columns are ignored. Long texts are
read whole, a part at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from evalspark.llm.common import arrow_rows, written
from evalspark.llm.ngram_join import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Segments of more fingerprints are cut again; at most so many segments are told to the tasks.
HOT, MAX_HOT = 4096, 1 << 20
#: Keys of up to DIRECT fingerprints compare each two; rows of text that Python gets at once; bytes of a text, and hashes, at a time.
DIRECT, TEXT_ROWS, PART, HASHES = 64, 2000, 1 << 20, 1 << 15
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_ONE, _HALF, _QUARTER = np.uint64(1), np.uint64(0xFFFFFFFF), np.uint64(0xFFFF)


def _runs(text: bytes) -> Iterator[list[bytes]]:
    """The words of the text (A-Z lowered), a part at a time; each run begins with the last words of the one before, for its first shingles."""
    at, last = 0, []
    while at < len(text):
        stop = _BLANK.search(text, at + PART) if len(text) - at > PART else None
        end = stop.start() if stop else len(text)
        run = last + text[at:end].lower().split()
        yield run
        at, last = end, run[max(0, len(run) - SHINGLE + 1) :]


def fingerprint(text: bytes | None) -> int:
    """The SimHash of the text's shingles, 0 if it has no word."""
    counts, n, words = np.zeros(64, dtype=np.int64), 0, []
    for words in _runs(text or b""):
        for at in range(0, len(words) - SHINGLE + 1, HASHES):
            part = words[at : at + HASHES + SHINGLE - 1]
            shingles = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE))))
            hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(part) - SHINGLE + 1)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(hashes)
    if not n:
        return xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (a long of the fingerprint's bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py()) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def hot_segments(heads: DataFrame, hot: int, most: int = MAX_HOT) -> tuple[np.ndarray, np.ndarray]:
    """The segments, first and second, of more than hot of the fingerprints, sorted; the most frequent at most."""
    segments = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("s")), F.struct(F.lit(1).alias("k"), F.shiftrightunsigned("fp", 32).alias("s"))))
    counted = heads.select(segments.alias("x")).groupBy("x.k", "x.s").count().where(F.col("count") > hot)
    top = counted.orderBy(F.col("count").desc(), "k", "s").limit(most).toPandas()
    return tuple(np.sort(top.loc[top["k"] == k, "s"].to_numpy(dtype=np.int64)).astype(np.uint64) for k in (0, 1))


def _key(tag: int, segment: np.ndarray) -> np.ndarray:
    return (np.uint64(tag << 53)) | (segment << np.uint64(21))


def index_keys(fps: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all variants: a tag of 6 bits (0 and 1: a whole segment; 2 + i: the first without bit i), 32 of the segment, then 21 of the second cut, 0 if none."""
    first, second = fps & _HALF, fps >> np.uint64(32)
    rows, keys = [], []

    def put(row: np.ndarray, key: np.ndarray) -> None:
        rows.append(row)
        keys.append(key)

    for tag in range(34):
        rest = first if tag == 1 else second
        if tag < 2:
            key, late = _key(tag, (first, second)[tag]), np.isin((first, second)[tag], hot[tag])
        else:
            bit = _ONE << np.uint64(tag - 2)
            key, late = _key(tag, first & ~bit), np.isin(first, hot[0]) | np.isin(first ^ bit, hot[0])
        put(np.flatnonzero(~late), key[~late])
        if late.any():
            at, key, low, high = np.flatnonzero(late), key[late], rest[late] & _QUARTER, rest[late] >> np.uint64(16)
            put(at, key | np.uint64(1 << 16) | low)
            put(at, key | np.uint64(2 << 16) | high)
            for p in range(16 if tag < 2 else 0):
                put(at, key | np.uint64((3 + p) << 16) | (low & ~np.uint64(1 << p)))
    return np.concatenate(rows), np.concatenate(keys)


@lru_cache(maxsize=None)
def open_pairs(kind: int) -> np.ndarray:
    """Masks of each two bits in which fingerprints of a key of this kind (its tag, and the tag of its second cut) may differ."""
    tag, cut = kind >> 5, kind & 31
    at = 0 if tag == 1 else 32
    free = {0: range(32), 1: range(16, 32), 2: range(16)}.get(cut, range(16, 32))
    free = [at + k for k in free]
    if tag >= 2:
        pairs = [(tag - 2, k) for k in free]
    elif cut >= 3:
        pairs = [(at + cut - 3, k) for k in free]
    else:
        pairs = list(combinations(free, 2))
    return np.array([1 << a | 1 << b for a, b in pairs], dtype=np.uint64)


def forest(fps: np.ndarray, kind: int) -> list[tuple[int, int]]:
    """Links (places of two fingerprints) that join what is linked among the different fingerprints of one key, one less than each group has."""

    def near() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(fps) <= DIRECT:
            yield np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= RADIUS, 1))
            return
        for mask in open_pairs(kind):
            seen = fps & ~mask
            order = np.argsort(seen, kind="stable")
            same = np.flatnonzero(seen[order][1:] == seen[order][:-1])
            yield order[same], order[same + 1]

    label, out = np.arange(len(fps)), []
    for a, b in near():
        apart = label[a] != label[b]
        if not apart.any():
            continue
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for i, j in zip(a[apart].tolist(), b[apart].tolist()):
            x, y = root(int(label[i])), root(int(label[j]))
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((i, j))
        table = np.arange(len(fps))
        for x in list(up):
            table[x] = root(x)
        label = table[label]
    return out


def links(heads: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): reps of the different fingerprints (fp, rep) that differ by RADIUS bits or fewer; of those of one key a forest, so the components are those of all links."""
    shared = heads.sparkSession.sparkContext.broadcast(hot_segments(heads, hot))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, key = index_keys(batch.column(0).to_numpy().view(np.uint64), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], names=["key", "fp", "rep"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, dtype=np.int64)] * 3
        for columns in _with_end(batches, tuple(np.array([x]) for x in (-1, 0, 0))):  # no key is negative
            key, fp, rep = (np.concatenate(x) for x in zip(kept, columns))
            edge = np.flatnonzero(np.diff(key)) + 1
            last = edge[-1] if len(edge) else 0
            kept = [x[last:] for x in (key, fp, rep)]
            starts = np.concatenate(([0], edge[:-1])) if len(edge) else edge
            out = []
            pairs = starts[(edge - starts) == 2]
            close = pairs[np.bitwise_count(fp[pairs].view(np.uint64) ^ fp[pairs + 1].view(np.uint64)) <= RADIUS]
            for a, b in zip(starts.tolist(), edge.tolist()):
                if b - a > 2:
                    value = int(key[a])
                    out += [(a + i, a + j) for i, j in forest(fp[a:b].view(np.uint64), (value >> 53) << 5 | (value >> 16) & 31)]
            i, j = np.array(out, dtype=np.int64).reshape(-1, 2).T
            i, j = np.concatenate((close, i)), np.concatenate((close + 1, j))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j]))], names=["a", "b"])

    keyed = heads.select("fp", "rep").mapInArrow(index, "key long, fp long, rep long")
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(meet, "a long, b long").distinct()


def _with_end(batches: Iterator[pa.RecordBatch], end: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        if batch.num_rows:
            yield tuple(x.to_numpy() for x in batch.columns)
    yield end


def near_copies(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    with arrow_rows(spark, TEXT_ROWS):
        rows = written(fingerprints(docs), "simhash-rows")
    named = rows.where("doc_id is not null")
    heads = written(named.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-heads")
    again = named.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    texts = named.join(again, "doc_id", "left_semi").join(heads, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    labels = components(written(links(heads, hot).union(texts), "simhash-links"))
    top = heads.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select("fp", F.coalesce("component_id", "rep").alias("_top"))
    found = rows.join(top, "fp", "left")
    return found.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("_top")).alias("component_id"))


def one_of_each(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The rows of docs with the smallest doc_id of their component (rows without one stay)."""
    lost = near_copies(docs, hot).where("component_id <> doc_id").select(F.col("doc_id").alias("_lost")).distinct()
    return docs.join(lost, docs["doc_id"] == lost["_lost"], "left_anti")
