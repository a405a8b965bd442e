"""Similarity self-join of word-shingle sets: 100 * intersection >= 75 * union, exactly.

1. Every text becomes a sorted array of 54-bit shingle hashes. Equal sets are one set from here on,
   named by their smallest doc_id, so a group of copies costs one comparison.
2. Two linked sets must share a shingle among the first n - ceil(3 n / 4) + 1 of each, in any one
   order of all shingles. The order is by hash, but the most frequent shingles (more than HOT sets
   have them among those first ones) come last, so that a passage many texts share opens no tile.
   The list of these is bounded by MAX_HOT; it changes the work only, not the result.
3. Shingles that two sets share among their first ones are tiles, split into bands of size: only
   within a band, and between it and the next, sizes are close enough for a link. Each band of a
   tile has a pivot, the set with the fewest shingles before the tile's own, and the sets that may be linked
   to it by their sizes and places meet it: as many pairs as members, not their square.
4. A pair's overlap is bounded from above by hashed bitmaps, as wide as the sizes ask for: what is set
   in one bitmap only is missing from the intersection. Pairs that pass are verified by intersecting
   their sorted arrays.
5. Verified links give components. Tiles whose sets are in one component are done. In the others,
   sets of different components meet, in small tiles by a join, in large ones block by block within
   tasks, and pass the same bounds and the same verification; the links found complete the components. A
   link left out by then joins two sets that are in one component already.

Rows with NULL doc_id have a set size and no component. A null or empty text, or one of white space,
has an empty set and links with nothing. Rows that repeat a doc_id are one document with several
texts: a link of any counts. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import arrow_rows, picked, pieces, shingle_sets, written

#: Links are at NUMERATOR / DENOMINATOR of the union or more.
NUMERATOR, DENOMINATOR = 3, 4
HOT, MAX_HOT = 12, 1 << 18
MIN_BITS, MAX_BITS, BITS_EACH = 256, 1 << 16, 4
#: Tiles up to SMALL_TILE sets meet by a join; larger ones in blocks of BLOCK sets, within a task.
SMALL_TILE, BLOCK, EARLY = 16, 1024, 8
#: Rows that Python gets at once: of texts, and of pairs of bitmaps or arrays.
TEXT_ROWS, PAIR_ROWS = 2000, 500
#: At most so many repeated sets, those with the most rows, are told to the tasks; first shingles to a bucket, and to a row of those known to be shared.
MAX_COPIED, BUCKET_SHINGLES, PACKED = 1 << 17, 1 << 20, 1 << 16


def first_ones(n: np.ndarray) -> np.ndarray:
    """How many shingles, in the common order, are sure to hold one that a linked set has among its own."""
    return np.where(n > 0, n - -(-NUMERATOR * n // DENOMINATOR) + 1, 0)


def bitmap(hashes: np.ndarray) -> bytes:
    """Hashed bitmap of a set: at least BITS_EACH times as many bits as members, a power of two within the bounds."""
    bits = min(MAX_BITS, max(MIN_BITS, 1 << int(BITS_EACH * len(hashes) - 1).bit_length())) if len(hashes) else MIN_BITS
    out = np.zeros(bits, dtype=bool)
    out[(hashes & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def overlap_bound(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """An upper bound of the intersection of two sets from their bitmaps; the wider one is folded."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if len(x) > len(y):
        x = np.bitwise_or.reduce(x.reshape(-1, len(y)), axis=0)
    elif len(y) > len(x):
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
    return min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))


def links(common: int, n_a: int, n_b: int) -> bool:
    return DENOMINATOR * common >= NUMERATOR * (n_a + n_b - common) and common > 0


def _sets(texts: pa.Array, each: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """The number and the set of each text, few texts at a time."""
    for first in range(0, len(texts), each):
        for at, run in pieces(texts.slice(first, each).to_pylist()):
            hashes, sizes = shingle_sets(run)
            ends = np.cumsum(sizes)
            for i, (a, b) in enumerate(zip(ends - sizes, ends)):
                yield first + at + i, hashes[a:b]


def described(docs: DataFrame, buckets: int) -> DataFrame:
    """Two kinds of rows: sets (doc_id, n, sig, bits) and, per batch and bucket, first shingles with counts (bucket, tokens, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            doc, n, sig, bits, firsts, seen = [], [], [], [], [], set()
            for i, hashes in _sets(batch.column(1)):
                doc.append(ids[i])
                n.append(len(hashes))
                digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
                sig.append(digest)
                bits.append(bitmap(hashes))
                if digest not in seen:
                    seen.add(digest)
                    firsts.append(hashes[: int(first_ones(np.int64(len(hashes))))].copy())
            none = lambda k, kind: pa.nulls(k, kind)
            k = len(doc)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(bits, pa.binary()), none(k, pa.int32()), none(k, pa.binary()), none(k, pa.binary())], names=names)
            tokens, counts = np.unique(np.concatenate(firsts) if firsts else np.zeros(0, np.uint64), return_counts=True)
            cuts = np.searchsorted(tokens, (np.arange(buckets + 1, dtype=np.float64) * (2.0**54 / buckets)).astype(np.uint64))
            full = np.flatnonzero(np.diff(cuts))
            k = len(full)
            yield pa.RecordBatch.from_arrays(
                [none(k, pa.int64()), none(k, pa.int64()), none(k, pa.binary()), none(k, pa.binary()), pa.array(full, pa.int32())]
                + [pa.array([x[cuts[j] : cuts[j + 1]].tobytes() for j in full], pa.binary()) for x in (tokens, counts.astype(np.int32))],
                names=names,
            )

    names = ["doc_id", "n", "sig", "bits", "bucket", "tokens", "counts"]
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig binary, bits binary, bucket int, tokens binary, counts binary")


def unpacked(rows: pa.Table, name: str, kind: type) -> np.ndarray:
    """The numbers of all rows of a packed column, end to end."""
    found = []
    for chunk in rows.column(name).chunks:
        ends = np.frombuffer(chunk.buffers()[1], dtype=np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        if len(chunk):
            found.append(np.frombuffer(chunk.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(kind))
    return np.concatenate(found) if found else np.zeros(0, dtype=kind)


def hot_shingles(counted: DataFrame, hot: int = HOT, max_hot: int = MAX_HOT) -> np.ndarray:
    """The shingles that more than hot sets have among their first ones, the max_hot most frequent of them at most."""

    def frequent(rows: pa.Table) -> pa.Table:
        tokens, counts = unpacked(rows, "tokens", np.uint64), unpacked(rows, "counts", np.int32)
        order = np.argsort(tokens, kind="stable")
        tokens, counts = tokens[order], counts[order]
        edge = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]) != 0)
        total = np.add.reduceat(counts, edge)
        often = total > hot
        return pa.table({"token": tokens[edge][often].astype(np.int64), "total": total[often].astype(np.int64)})

    found = counted.groupBy("bucket").applyInArrow(frequent, "token long, total long")
    top = found.orderBy(F.col("total").desc(), "token").limit(max_hot).select("token")
    return np.sort(top.toPandas()["token"].to_numpy(dtype=np.int64)).astype(np.uint64)


@dataclass
class Copied:
    """The sets that most rows repeat: the two halves of their digests, sorted, and the doc_id that stands for each."""

    high: np.ndarray
    low: np.ndarray
    rep: np.ndarray

    def of(self, digest: bytes) -> int | None:
        """The doc_id that stands for the set, None for one that isn't listed."""
        high, low = np.frombuffer(digest, dtype=np.uint64)
        at = int(np.searchsorted(self.high, high))
        return int(self.rep[at]) if at < len(self.high) and self.high[at] == high and self.low[at] == low else None


def copied_sets(owners: DataFrame, most: int) -> Copied:
    """The most sets (sig, rep, rows) with the most rows, of those that two rows or more have."""
    top = owners.where("rows > 1").orderBy(F.col("rows").desc(), "sig").limit(most).select("sig", "rep").toPandas()
    halves = np.frombuffer(b"".join(bytes(x) for x in top["sig"]), dtype=np.uint64).reshape(-1, 2)
    order = np.argsort(halves[:, 0], kind="stable")
    return Copied(halves[order, 0], halves[order, 1], top["rep"].to_numpy(dtype=np.int64)[order])


def bucket_count(docs: DataFrame, each: int = BUCKET_SHINGLES) -> int:
    """Buckets for at most about each first ones: a word has two characters with its space, a set a fourth of its words and one."""
    size = docs.agg((F.sum(F.octet_length("text")) / 8).alias("words"), F.count("*").alias("rows")).first()
    return max(64, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(((size["words"] or 0) + size["rows"]) // each))


#: The columns of packed entries.
KINDS = {"tokens": np.uint64, "docs": np.int64, "sizes": np.int32, "places": np.int32}


def packed(keys: np.ndarray | list[int], cuts: list[tuple[int, int]], columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32())] + [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in columns], names=["bucket", *KINDS])


def entries(docs: DataFrame, hot: np.ndarray, copied: Copied, buckets: int) -> DataFrame:
    """First shingles of the documents, packed by bucket.

    Of the rows of a set in copied only that of its doc_id takes part, of other equal sets in a batch the smallest
    doc_id. What a batch has twice is known to be shared: it goes to buckets below 0, in rows of up to PACKED
    entries, and leaves one entry without a place (-1), so that a bucket from 0 gathers one entry of
    a shingle from each batch at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast((hot, copied))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, copied = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            best: dict[bytes, tuple[int, int, np.ndarray]] = {}
            for i, hashes in _sets(batch.column(1)):
                if not len(hashes):
                    continue
                digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
                if (rep := copied.of(digest)) is not None and rep != ids[i] or digest in best and best[digest][0] <= ids[i]:
                    continue
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
                    late = hot[at] == hashes
                    hashes = np.concatenate((hashes[~late], hashes[late]))
                best[digest] = (ids[i], len(hashes), hashes[: int(first_ones(np.int64(len(hashes))))].copy())
            if not best:
                continue
            firsts = [x for _, _, x in best.values()]
            lengths = [len(x) for x in firsts]
            tokens = np.concatenate(firsts)
            doc = np.repeat(np.array([x for x, _, _ in best.values()], dtype=np.int64), lengths)
            size = np.repeat(np.array([x for _, x, _ in best.values()], dtype=np.int32), lengths)
            place = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
            order = np.argsort(tokens, kind="stable")
            tokens, doc, size, place = tokens[order], doc[order], size[order], place[order]
            again = np.concatenate(([False], tokens[1:] == tokens[:-1]))
            twice = again | np.concatenate((again[1:], [False]))
            known = tuple(x[twice] for x in (tokens, doc, size, place))
            for at in range(0, len(known[0]), PACKED):
                yield packed([-1 - ((int(known[0][at]) ^ int(known[1][at])) & 0x3FFFFFFF)], [(at, at + PACKED)], known)
            place[twice] = -1
            rest = tuple(x[~again] for x in (tokens, doc, size, place))
            cuts = np.searchsorted(rest[0], (np.arange(buckets + 1, dtype=np.float64) * (2.0**54 / buckets)).astype(np.uint64))
            full = np.flatnonzero(np.diff(cuts))
            yield packed(full, [(cuts[j], cuts[j + 1]) for j in full], rest)

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(emit, "bucket int, tokens binary, docs binary, sizes binary, places binary")


def tiles(docs: DataFrame, hot: np.ndarray, copied: Copied, buckets: int) -> DataFrame:
    """token, doc_id, n, pos (the shingle's place in the order) for shingles that two documents have among their first ones."""

    def meet(rows: pa.Table) -> pa.Table:
        tokens, doc, size, place = (unpacked(rows, name, kind) for name, kind in KINDS.items())
        if rows.column("bucket")[0].as_py() >= 0:
            order = np.argsort(tokens, kind="stable")
            tokens = tokens[order]
            same = np.concatenate(([False], tokens[1:] == tokens[:-1]))
            keep = same | np.concatenate((same[1:], [False]))
            keep[keep] = place[order[keep]] >= 0
            order = order[keep]
            tokens, doc, size, place = tokens[keep], doc[order], size[order], place[order]
        return pa.table({"token": tokens.astype(np.int64), "doc_id": doc, "n": size.astype(np.int64), "pos": place.astype(np.int64)})

    return entries(docs, hot, copied, buckets).groupBy("bucket").applyInArrow(meet, "token long, doc_id long, n long, pos long")


def compatible(n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Whether sets of n and m shingles can be linked if the first one in both has these places: what is left bounds the overlap."""
    return F.least(n - pos, m - at) * (NUMERATOR + DENOMINATOR) >= (n + m) * NUMERATOR


def bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow a link."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, bits_a, bits_b = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
            keep = pa.array([links(overlap_bound(x, y, p, q), p, q) for x, y, p, q in zip(bits_a, bits_b, n_a, n_b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(keep)

    return met.mapInArrow(run, "a long, b long").distinct()


def arrays(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, hashes (the sorted set, as bytes) of the documents named in ids."""
    chosen = picked(docs.select("doc_id", "text"), ids, ["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [hashes.tobytes() for _, hashes in _sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "hashes"])

    return chosen.mapInArrow(run, "doc_id long, hashes binary")


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, by intersecting their sorted arrays: a written table."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "join-ids")
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        sets = written(arrays(docs, ids), "join-arrays")
    met = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("right")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("left")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(left.as_py(), dtype=np.uint64), np.frombuffer(right.as_py(), dtype=np.uint64)
                keep.append(links(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with arrow_rows(docs.sparkSession, PAIR_ROWS):
        return written(met.select("a", "b", "left", "right").mapInArrow(run, "a long, b long").distinct(), "join-links")


def components(edges: DataFrame) -> DataFrame:
    """doc_id, component_id (the smallest id it is connected to) of every id in edges (a, b).

    Labels take the least label among their neighbours, then their label's label, until none changes;
    each round is a table in the shared folder.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "join-edges")
    now = both.groupBy("a").agg(F.least("a", F.min("b")).alias("label"))
    now = written(now, "join-labels")
    while True:
        near = both.join(now.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = now.join(near, "a").select("a", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("a").alias("label"), F.col("label").alias("up"))
        after = written(step.join(jump, "label", "left").select("a", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "join-labels")
        if after.where("label <> old").isEmpty():
            return after.select(F.col("a").alias("doc_id"), F.col("label").alias("component_id"))
        now = after.select("a", "label")


def crossing(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the tiles that aren't yet in one component, with their components: (of tiles up to SMALL_TILE, of larger ones)."""
    known = members.join(labels.withColumnRenamed("component_id", "c"), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
    mixed = known.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k")).where("lo <> hi and k > 2").select("token", "k")
    rows = written(known.join(mixed, "token"), "join-mixed")
    return rows.where(F.col("k") <= SMALL_TILE).drop("k"), rows.where(F.col("k") > SMALL_TILE)


def small_tile_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of compatible sets of different components in tiles of few sets."""
    rows = rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DENOMINATOR / NUMERATOR))))
    left = rows.withColumn("band", F.explode(F.array("band", F.col("band") + 1))).select("token", "band", F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), F.col("c").alias("c_a"))
    right = rows.select("token", "band", F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), F.col("c").alias("c_b"))
    # a is the smaller set, or of equal sets the smaller id: each pair meets once.
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    met = left.join(right, ["token", "band"]).where((F.col("c_a") != F.col("c_b")) & smaller & compatible(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b")))
    return met.select("a", "b").distinct()


def large_tile_pairs(rows: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different components in tiles of many sets whose sizes, places and bitmaps allow a link.

    A tile is cut into blocks of BLOCK sets; two blocks are a task's work, done on arrays in it, so
    that only pairs that pass leave it. A pair that meets in an earlier tile, told by the first EARLY shingles
    of both sets, is left to that tile.
    """
    docs = rows.select("doc_id").distinct()
    early = members.join(docs, "doc_id", "left_semi").groupBy("doc_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), 1, EARLY).alias("early"))
    told = early.join(sets.select("doc_id", "bits"), "doc_id")
    blocks = F.ceil(F.col("k") / BLOCK)
    block = F.pmod(F.xxhash64("doc_id"), blocks)
    placed = rows.withColumn("block", block).join(told, "doc_id")
    other = F.sequence(F.lit(0).cast("long"), blocks - 1)
    placed = placed.withColumn("other", F.explode(other)).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def meet(tile: pa.Table) -> pa.Table:
        n, pos, doc, c, block = (tile.column(x).to_numpy() for x in ("n", "pos", "doc_id", "c", "block"))
        order = np.lexsort((doc, n))
        n, pos, doc, c, block = n[order], pos[order], doc[order], c[order], block[order]
        bits = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in tile.column("bits")]
        early = tile.column("early").to_pylist()
        token, inside = tile.column("token")[0].as_py(), tile.column("i")[0].as_py() == tile.column("j")[0].as_py()
        before = np.arange(len(n) * EARLY, dtype=np.int64).reshape(len(n), EARLY) - (1 << 62)  # equal to nothing
        for k, o in enumerate(order):
            seen = early[o][: early[o].index(token)] if token in early[o] else early[o]
            before[k, : len(seen)] = seen
        widths = np.array([len(bits[o]) for o in order])
        maps = {w: np.stack([bits[o] for o in order[widths == w]]) for w in np.unique(widths)}
        place = np.zeros(len(n), dtype=np.int64)
        for w in maps:
            place[widths == w] = np.arange((widths == w).sum())
        halves = {w: np.bitwise_or.reduce(m.reshape(len(m), 2, w // 2), axis=1) for w, m in maps.items() if w > 1}
        last = np.searchsorted(n, n * DENOMINATOR // NUMERATOR, side="right")
        out_a, out_b = [], []
        for x in range(len(n) - 1):
            y = np.arange(x + 1, last[x])
            y = y[(c[y] != c[x]) & ((block[y] != block[x]) | inside)]
            y = y[np.minimum(n[x] - pos[x], n[y] - pos[y]) * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (n[x] + n[y])]
            if len(y):
                y = y[~(before[y][:, :, None] == before[x][None, None, :]).any(axis=(1, 2))]
            w = widths[x]
            for wide, table in ((w, maps), (2 * w, halves)):
                z = y[widths[y] == wide]
                if len(z):
                    one, many = maps[w][place[x]], table[wide][place[z]]
                    bound = np.minimum(n[x] - np.bitwise_count(one & ~many).sum(axis=1), n[z] - np.bitwise_count(many & ~one).sum(axis=1))
                    z = z[bound * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (n[x] + n[z])]
                    out_a.append(np.full(len(z), doc[x]))
                    out_b.append(doc[z])
        ends = [np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (out_a, out_b)]
        return pa.table({"a": pa.array(ends[0], pa.int64()), "b": pa.array(ends[1], pa.int64())})

    kept = placed.select("token", "i", "j", "doc_id", "n", "pos", "c", "block", "early", "bits")
    return kept.groupBy("token", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def join_near(docs: DataFrame, hot: int = HOT, max_hot: int = MAX_HOT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = bucket_count(docs)
    with arrow_rows(spark, TEXT_ROWS):
        told = written(described(docs, buckets), "join-sets")
    rows = told.where("bucket is null").select("doc_id", "n", "sig", "bits")
    frequent = hot_shingles(told.where("bucket is not null").select("bucket", "tokens", "counts"), hot, max_hot)

    named = rows.where("doc_id is not null and n > 0")
    owners = written(named.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "join-owners")
    heads = owners.select(F.col("rep").alias("doc_id")).distinct()
    copied, owners = copied_sets(owners, MAX_COPIED), owners.drop("rows")
    with arrow_rows(spark, TEXT_ROWS):
        members = written(tiles(docs, frequent, copied, buckets).join(heads, "doc_id", "left_semi"), "join-tiles")
    sets = rows.where("doc_id is not null").select("doc_id", "n", "bits", "sig").join(heads, "doc_id", "left_semi")
    sets = written(sets.dropDuplicates(["doc_id", "sig"]).drop("sig"), "join-heads")

    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DENOMINATOR / NUMERATOR)))
    banded = members.withColumn("band", band)
    # The set with the fewest shingles before the tile's own is nearest to all others: of near copies, the original.
    pivots = banded.groupBy("token", "band").agg(F.min(F.struct(F.col("pos") / F.col("n"), "doc_id", "n", "pos")).alias("p"))
    pivots = pivots.select("token", F.explode(F.array("band", F.col("band") + 1)).alias("band"), F.col("p.doc_id").alias("a"), F.col("p.n").alias("n_a"), F.col("p.pos").alias("pos_a"))
    stars = banded.join(pivots, ["token", "band"]).where((F.col("a") != F.col("doc_id")) & compatible(F.col("n"), F.col("pos"), F.col("n_a"), F.col("pos_a")))
    stars = stars.select("a", F.col("doc_id").alias("b")).distinct()
    with arrow_rows(spark, PAIR_ROWS):
        near = written(bounded(stars, sets), "join-stars")
    first = verified(docs, near)
    same = copies(named)
    labels = components(first.union(same))

    small, large = crossing(members, labels)
    with arrow_rows(spark, PAIR_ROWS):
        more = bounded(small_tile_pairs(small), sets).union(large_tile_pairs(large, members, sets))
        more = written(more.distinct(), "join-crossing")
    if not more.isEmpty():
        labels = components(first.union(same).union(verified(docs, more)))
    found = rows.join(owners, "sig", "left").join(labels.withColumnRenamed("doc_id", "_d"), F.coalesce("rep", "doc_id") == F.col("_d"), "left")
    top = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", F.when(F.col("n") > 0, F.col("rep")), "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), top.alias("component_id"))


def copies(named: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of rows that repeat a doc_id with other texts: few or none."""
    heads = named.groupBy("doc_id", "sig").count()
    again = heads.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    rows = named.join(again, "doc_id", "left_semi").select("sig", "doc_id")
    owner = named.groupBy("sig").agg(F.min("doc_id").alias("rep"))
    return rows.join(owner, "sig").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs with the smallest doc_id of their component (rows without one stay)."""
    lost = join_near(docs).where("component_id <> doc_id").select("doc_id").distinct()
    best = docs.join(lost, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    return best
