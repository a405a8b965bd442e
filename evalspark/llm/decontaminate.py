"""Benchmark decontamination by SimHash over windows, with DataFrame functions only.

1. Runs of a document's words, and of every benchmark item's, get SimHash fingerprints of BITS bits: bit b
   is set if most word hashes of the run have it set. A run is as long as the size of the item allows: a
   passage that is similar enough to an item of n words keeps least_run(n) words in a row of it, and the
   longest of SIZES that fits in there wherever it starts is the item's window size. Documents have windows of
   each size at every stride(size)-th word, items at every word, so that one document window lies on
   the run that is kept and has its item's fingerprint.
2. Fingerprints are cut into RADIUS + 1 blocks. A document window meets the item windows of its size that equal it
   in one block: by the pigeonhole principle these are at least all within RADIUS; what is farther is
   left out. No shingle is compared before this index.
3. A meeting says where in the document the item would begin. There the exact similarity is taken for
   item-sized windows, in each alignment that a shared shingle gives: the weight of the shingles in both over the
   weight of those in either. A shingle weighs the more the fewer items have it.

least_run supposes shingles of equal weight. Where a passage has lost its lighter shingles only, it may keep
a shorter run and still be similar; the radius finds most of those, and the README has the recall measured against all windows.

Words have A-Z lowered; shingles are of SHINGLE words, a text with fewer words is one shingle, so an item
with fewer words is found in documents that are as short. A document shorter than the item is one window. Null
texts have no words and match nothing, as do items without words. Of rows that repeat an item_id the smallest text counts. Repeated rows and rows that repeat a doc_id with
other texts are searched each; a document has its best window. Of equal windows the first counts. Rows with a NULL doc_id can't be
reported. Long texts are cut into segments of SEGMENT words for the windows. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import picked, written

SHINGLE, SIMILARITY = 5, 0.75
#: Fingerprints: LANES lanes of WIDTH bits count the votes of as many bits at once, in WIDTH longs; a lane counts to 15, enough for 16 words.
LANES, WIDTH = 15, 4
BITS, RADIUS = LANES * WIDTH, 3
_LANE = sum(1 << (WIDTH * i) for i in range(LANES))
_BLOCK_BITS = BITS // (RADIUS + 1)
#: Window sizes in words, beside whole texts of less than SHINGLE words. SEGMENT is a multiple of all their strides.
SIZES, SEGMENT = (4, 8, 12, 16), 4096
#: Items of up to this many words together are sent to all tasks, more are met by shuffles.
BROADCAST_WORDS = 1_000_000


def stride(size: int) -> int:
    return {4: 2, 16: 8}.get(size, 4)


def least_run(n: int) -> int:
    """Words in a row that a window keeps of an item of n words if their shingles' similarity is SIMILARITY or more.

    Of m shingles k breaks inside leave at least (3 m / 4 + 3 k) in k + 1 runs, and k is at most m / 28: a
    break takes four shingles of the item or more, and brings four others or more.
    """
    if n < SHINGLE:
        return n
    m = n - SHINGLE + 1
    k = m // 28
    return -(-(3 * m + 12 * k) // (4 * (k + 1))) + SHINGLE - 1


def window_size(n: int) -> int:
    """The largest of SIZES that has a window at a multiple of its stride within any least_run(n) words in a row; n below SHINGLE."""
    return n if n < SHINGLE else max(s for s in SIZES if s + stride(s) - 1 <= least_run(n))


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(words_: Column) -> Column:
    """The hashes of a text's shingles, in order."""
    last = F.greatest(F.lit(0), F.size(words_) - SHINGLE)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words_, i + k) for k in range(SHINGLE)]))


def hashes(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def votes(hash_: Column, k: int) -> Column:
    """The k-th of WIDTH longs: bit WIDTH * i + k of a word's hash as the lowest bit of lane i."""
    return F.shiftrightunsigned(hash_, k).bitwiseAND(F.lit(_LANE))


def fingerprint(sums: list[Column], size: Column) -> Column:
    """SimHash from the sums of the votes of size words: bit b is set if more than half of the word hashes have it set."""
    print_ = F.lit(0).cast("long")
    for k, total in enumerate(sums):
        majority = total + ((1 << (WIDTH - 1)) - 1 - F.floor(size / 2)) * F.lit(_LANE)
        print_ = print_.bitwiseOR(F.shiftleft(F.shiftrightunsigned(majority, WIDTH - 1).bitwiseAND(F.lit(_LANE)), k))
    return print_


def run_print(hashes_: Column) -> Column:
    """The fingerprint of all of a short list of hashes."""
    return fingerprint([F.aggregate(hashes_, F.lit(0).cast("long"), lambda acc, h: acc + votes(h, k)) for k in range(WIDTH)], F.size(hashes_))


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, size, start, print of the windows at each word of items (item_id, n, size, words)."""
    every = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("size")), lambda i: F.struct(i.alias("start"), run_print(F.slice("_hashes", i + 1, F.col("size"))).alias("print")))
    return items.withColumn("_hashes", hashes(F.col("words"))).select("item_id", "size", F.inline(every))


def windows(text: DataFrame, keep: list[str], sizes: list[int]) -> DataFrame:
    """keep, size, start, print of the windows of text (keep, words), each size at every stride(size)-th word; a text of less than SHINGLE words is one window."""
    parts = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.floor((F.size("words") - 1) / SEGMENT).cast("int")))
    cut = text.select(*keep, "words", F.explode(parts).alias("_part"))
    # Single entries are read, as a slice would copy the whole array.
    last = F.least(F.size("words"), (F.col("_part") + 1) * SEGMENT + max(SIZES)) - 1
    cut = cut.select(*keep, "_part", F.transform(F.sequence(F.col("_part") * SEGMENT, last), lambda i: F.xxhash64(F.get("words", i))).alias("_hashes"))
    # Votes are summed by as many words as all strides are multiples of, windows from these sums.
    unit = math.gcd(*map(stride, sizes)) or 1

    def summed(k: int) -> Callable[[Column], Column]:
        return lambda i: functools.reduce(lambda x, y: x + y, [votes(F.get("_hashes", unit * i + j), k) for j in range(unit)])

    units = F.when(F.size("_hashes") >= max(unit, SHINGLE), F.sequence(F.lit(0), F.floor(F.size("_hashes") / unit).cast("int") - 1))
    short = F.when((F.size("_hashes") < SHINGLE) & (F.col("_part") == 0), F.array(run_print(F.col("_hashes"))))
    cut = cut.select(*keep, "_part", F.size("_hashes").alias("_n"), short.alias("_short"), *[F.transform(units, summed(k)).alias(f"_sums{k}") for k in range(WIDTH)])

    def prints(size: int) -> Column:
        step = stride(size)
        starts = F.sequence(F.lit(0), F.floor((F.least(F.col("_n") - size, F.lit(SEGMENT - step))) / step).cast("int"))

        def one(i: Column) -> Column:
            return fingerprint([functools.reduce(lambda x, y: x + y, [F.get(f"_sums{k}", i * (step // unit) + j) for j in range(size // unit)]) for k in range(WIDTH)], F.lit(size))

        return F.struct(F.lit(size).alias("size"), F.lit(step).alias("_step"), F.when((F.col("_n") >= size) & (F.col("_n") >= SHINGLE), F.transform(starts, one)).alias("_prints"))

    kinds = F.array(F.struct(F.col("_n").alias("size"), F.lit(1).alias("_step"), F.col("_short").alias("_prints")), *map(prints, sizes))
    each = cut.select(*keep, "_part", F.inline(kinds)).select(*keep, "size", "_step", "_part", F.posexplode("_prints").alias("_at", "print"))
    return each.select(*keep, "size", (F.col("_part") * SEGMENT + F.col("_at") * F.col("_step")).alias("start"), "print")


def blocks(print_: Column) -> Column:
    mask = F.lit((1 << _BLOCK_BITS) - 1)
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(print_, i * _BLOCK_BITS).bitwiseAND(mask).alias("value")) for i in range(RADIUS + 1)])


def weighted(items: DataFrame) -> DataFrame:
    """item_id, n, _keys (its shingles), _weights (shingle to weight), _theirs (their sum), _places (shingle to its places), _unknown (the weight of others) of items (item_id, n, words)."""
    each = items.select("item_id", "n", F.posexplode(shingles(F.col("words"))).alias("pos", "shingle"))
    counts = each.groupBy("shingle").agg(F.countDistinct("item_id").alias("_df"))
    total = items.agg(F.count("*").cast("double").alias("_total"))
    once = each.groupBy("item_id", "n", "shingle").agg(F.sort_array(F.collect_list("pos")).alias("at")).join(counts, "shingle").crossJoin(total)
    weight = F.log(1 + (F.col("_total") + 1) / F.col("_df"))
    entries = lambda x: F.map_from_entries(F.collect_list(F.struct("shingle", x)))
    unknown = F.log(1 + F.max(F.col("_total") + 1))
    got = once.groupBy("item_id", "n").agg(entries(weight).alias("_weights"), entries(F.col("at")).alias("_places"), unknown.alias("_unknown"))
    theirs = F.aggregate(F.map_values("_weights"), F.lit(0.0), lambda acc, x: acc + x)
    return got.select("*", F.map_keys("_weights").alias("_keys"), theirs.alias("_theirs"))


def meetings(text: DataFrame, items: DataFrame, few: bool) -> DataFrame:
    """doc_id, _row, item_id, at: where by their fingerprints items (item_id, n, words) may begin in text (doc_id, _row, words). few: the items can be sent to all tasks."""
    lengths = [r["n"] for r in items.select("n").distinct().collect()]
    of = {n: window_size(n) for n in lengths}
    if not of:
        return text.select("doc_id", "_row", F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("at")).limit(0)
    size = F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), F.col("n"))
    index = item_windows(items.withColumn("size", size)).select("item_id", "size", F.col("start").alias("_at"), F.col("print").alias("_print"), F.inline(blocks(F.col("print"))))
    left = windows(text, ["doc_id", "_row"], sorted(set(of.values()) & set(SIZES)))
    left = left.select("*", F.inline(blocks(F.col("print"))))
    near = left.join(F.broadcast(index) if few else index, ["size", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("_print"))) <= RADIUS)
    return near.select("doc_id", "_row", "item_id", (F.col("start") - F.col("_at")).alias("at")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, start, end, similarity: the best window of every document for every item that it has.

    Words start to end - 1 of the document, counted from 0, are the window.
    """
    items = benchmark.where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text")).select("item_id", words(F.col("text")).alias("words"))
    items = written(items.where(F.size("words") > 0).withColumn("n", F.size("words")), "leak-items")
    few = (items.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_WORDS
    marked = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("_row"), "text")
    met = written(meetings(marked.select("doc_id", "_row", words(F.col("text")).alias("words")), items, few), "leak-meetings")

    some = picked(marked, met.select("doc_id", "_row").distinct(), ["doc_id", "_row"]).dropDuplicates(["doc_id", "_row"])
    weights = written(weighted(items), "leak-weights")
    # A document's meetings stay together until its words have been cut to what is near each.
    ends = met.join(items.select("item_id", "n"), "item_id").groupBy("doc_id", "_row").agg(F.collect_list(F.struct("item_id", "n", "at")).alias("_met"))
    pairs = ends.join(some.select("doc_id", "_row", words(F.col("text")).alias("words")), ["doc_id", "_row"])
    pairs = pairs.select("doc_id", F.size("words").alias("_size"), "words", F.inline("_met"))
    low = F.greatest(F.lit(0), F.col("at") - F.col("n"))
    near = F.transform(F.sequence(low, F.least(low + 3 * F.col("n"), F.col("_size")) - 1), lambda i: F.get("words", i))
    pairs = pairs.select("doc_id", "item_id", "n", "_size", low.alias("_low"), near.alias("_near"))
    pairs = pairs.select("doc_id", "item_id", "_size", "_low", F.size("_near").alias("_room"), shingles(F.col("_near")).alias("_own")).join(F.broadcast(weights) if few else weights, "item_id")

    summed = lambda of, default: F.aggregate(of, F.lit(0.0), lambda acc, s: acc + F.coalesce(F.element_at("_weights", s), default))
    # What is shared anywhere near bounds what a window shares.
    bound = summed(F.array_intersect("_keys", "_own"), F.lit(0.0)) >= (similarity - 1e-9) * F.col("_theirs")
    aligned = lambda g, p: F.transform(F.coalesce(F.element_at("_places", g), F.array().cast("array<int>")), lambda q: F.greatest(F.lit(0), F.least(p + F.col("_low") - q, F.col("_size") - F.col("n"))))
    inside = lambda at: (at >= F.col("_low")) & (at + F.least(F.col("n"), F.col("_size")) <= F.col("_low") + F.col("_room"))
    starts = F.filter(F.array_distinct(F.flatten(F.transform("_own", aligned))), inside)
    width = F.greatest(F.lit(1), F.least(F.col("n"), F.col("_size")) - (SHINGLE - 1))
    own = lambda at: F.array_distinct(F.slice("_own", at - F.col("_low") + 1, width))
    sums = F.transform(starts, lambda at: F.struct(at.alias("start"), summed(own(at), F.lit(0.0)).alias("both"), summed(own(at), F.col("_unknown")).alias("mine")))
    scored = pairs.select("doc_id", "item_id", F.least("n", "_size").alias("size"), "_theirs", F.inline(F.when(bound, sums)))
    scored = scored.withColumn("similarity", F.col("both") / (F.col("mine") + F.col("_theirs") - F.col("both"))).where(F.col("similarity") >= similarity - 1e-9)
    best = F.struct(F.round("similarity", 9).alias("rounded"), (-F.col("start")).alias("back"), "size", "similarity")
    top = scored.groupBy("doc_id", "item_id").agg(F.max(best).alias("b"))
    start = -F.col("b.back")
    return top.select("doc_id", "item_id", start.alias("start"), (start + F.col("b.size")).alias("end"), F.col("b.similarity").alias("similarity"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id has no benchmark item in it; rows with a NULL doc_id stay."""
    return docs.join(contaminated(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
