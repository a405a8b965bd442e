"""Merkle manifest of a dataset: a root digest, and for each row the witness that proves it.

Rows are leaves; those of a language, in the order of their ids, are a tree, and the trees' roots, in the order of languages, the leaves of
one more. A digest H is the sha256 of its inputs as text; of two nodes beside each other H of both is the node above, a node that is last and alone has H of itself above.

1. Leaves are digested by Spark and sorted into range partitions; counts by partition give each its place in its tree, so no window or task holds a tree.
2. A task appends the nodes that it reads to a stack of open subtrees. The node that completes a pair extends the witnesses of all
   nodes below both: those of the left by the right one's digest and the other way round. Subtrees that are HEIGHT higher than a node, or whose sibling is not in what
   the task reads, leave the stack: their rows go out with what they have of a witness, their root as a node for the next round.
3. The next round appends these nodes in the same way, over fewer tasks, until each tree is one node. What a round adds to a node's witness
   is then added to those of the nodes below it, round by round. A place says which siblings a node has, so appended rows need nothing but the order.

Rows with NULL lang are the first tree, NULL doc_ids come first in theirs; rows of one doc_id are ordered by their digests, so repeated rows, whose leaves are equal, can't
change anything. A row whose doc_id is NULL is not tampered with. Texts are digested whole, by Spark. A NULL value is `-` in a leaf and an empty one `0:`. An empty table has no rows and no root; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from evalspark.llm.common import written

#: Levels that a round adds at most while it has more than one task; nodes of a task in the rounds after the first.
HEIGHT, NODES = 10, 1 << 16
#: Witnesses of up to so many nodes (2 KB each at most), and places of so many runs, go to all tasks; more are joined by a shuffle.
BROADCAST_NODES, BROADCAST_RUNS = 1 << 14, 1 << 20
#: Rows of a batch that goes back to Spark.
BATCH = 4096


def digest(*parts: bytes) -> bytes:
    """H of digests: the sha256 of their hex texts."""
    return sha256(b"".join(parts).hex().encode()).digest()


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The leaf digest of a row, as bytes."""
    return F.unhex(F.sha2(F.concat(*map(encoded, (doc_id, source, lang, n_chars, text))), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (empty for a NULL lang, else "=" and lang), digest, tampered (the digest with n_chars one more, NULL where nothing is changed)."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = columns[:3] + [F.col("n_chars").cast("decimal(20,0)") + 1, columns[4]]
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    return docs.select("doc_id", tree.alias("tree"), leaf(*columns).alias("digest"), F.when(touched, leaf(*more)).alias("tampered"))


def numbered(rows: DataFrame, order: list[str], name: str, few: bool = False) -> DataFrame:
    """rows with level 0, idx (its place, from 0, among the rows of its tree in order) and n (how many these are), in that order within each task; few: in one task."""
    by = ["tree", *order]
    partition, over = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    dealt = rows.coalesce(1) if few else rows.repartitionByRange(*by)
    placed = written(dealt.sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("tree", "_part").agg(F.min("_at").alias("_from"), F.count("*").alias("_k"))
    starts = runs.select("tree", "_part", (F.coalesce(F.sum("_k").over(over), F.lit(0)) - F.col("_from")).alias("_shift"), F.sum("_k").over(partition).alias("n"))
    starts = written(starts, f"{name}-runs")
    sent = starts.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS
    joined = placed.join(F.broadcast(starts) if sent else starts, ["tree", "_part"])
    joined = joined.select(*rows.columns, F.lit(0).alias("level"), (F.col("_at") + F.col("_shift")).alias("idx"), "n")
    return joined if sent else joined.repartitionByRange("tree", "idx").sortWithinPartitions("tree", "idx")


class Appender:
    """A stack of open subtrees, each (level, idx, digest, nodes below, the lowest level of these); nodes below are [row, its witness so far]."""

    def __init__(self, height: int) -> None:
        self.height, self.stack, self.tree, self.n, self.next, self.rows, self.roots = height, [], None, 0, -1, [], []

    def append(self, tree: str, n: int, level: int, idx: int, node: bytes, row: tuple) -> None:
        if tree != self.tree or idx << level != self.next:
            self.close()
            self.tree, self.n = tree, n
        self.next = (idx + 1) << level
        below, low = [(row, [])], level
        while True:
            width = ((n - 1) >> level) + 1
            if width == 1:
                break
            if idx & 1:
                if not self.stack or self.stack[-1][:2] != (level, idx - 1):
                    break
                _, _, other, before, least = self.stack.pop()
                for _, witness in before:
                    witness.append(node)
                for _, witness in below:
                    witness.append(other)
                below, low, node = before + below, min(low, least), digest(other, node)
            elif idx + 1 == width:
                node = digest(node)
            else:
                break
            level, idx = level + 1, idx >> 1
            if level - low >= self.height:
                self.put(level, idx, node, below)
                return
        self.stack.append((level, idx, node, below, low))

    def put(self, level: int, idx: int, node: bytes, below: list) -> None:
        self.roots.append((self.tree, self.n, level, idx, node))
        self.rows += [(*row, b"".join(witness), level, idx) for row, witness in below]

    def close(self) -> None:
        for x in self.stack:
            self.put(*x[:4])
        self.stack = []


def appended(nodes: DataFrame, extra: list[str], height: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows, roots) after one round over nodes (tree, n, level, idx, digest, and extra columns).

    rows are nodes without their digest, with witness (what this round adds) and the subtree that the node is now below (top_level, top_idx); roots are these subtrees, as nodes.
    """
    kept = ["tree", "n", "level", "idx", *extra]
    told_as = [("witness", BinaryType()), ("top_level", IntegerType()), ("top_idx", LongType()), ("digest", BinaryType())]
    out_type = StructType([*nodes.select(*kept).schema.fields, *(StructField(*x) for x in told_as)])
    nodes = nodes.select(*kept, "digest")
    empty = (None,) * len(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, stack = to_arrow_schema(out_type), Appender(height)

        def full() -> pa.RecordBatch:
            out = [(*x, None) for x in stack.rows] + [(tree, n, level, idx, *empty, None, None, None, node) for tree, n, level, idx, node in stack.roots]
            stack.rows, stack.roots = [], []
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), schema.types)], names=schema.names)

        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns)):
                stack.append(row[0], row[1], row[2], row[3], row[-1], row[:-1])
                if len(stack.rows) >= BATCH:
                    yield full()
        stack.close()
        if stack.rows:
            yield full()

    told = written(nodes.mapInArrow(run, out_type), name)
    return told.where("digest is null").drop("digest"), told.where("digest is not null").select("tree", "n", "level", "idx", "digest")


def witnesses(nodes: DataFrame, extra: list[str], name: str, above: Callable[[DataFrame], DataFrame], height: int, each: int) -> DataFrame:
    """tree, n, idx, extra and more columns, witness (the siblings from below to above) of all nodes, which are leaves of their trees.

    above takes the trees (tree, subroot) to (tree, more columns, _above), how the witness goes on from a tree's root.
    """
    rounds, level_zero, tasks = [], extra, None
    while True:
        rows, roots = appended(nodes, level_zero, height, f"{name}-{len(rounds)}")
        rounds.append(rows)
        if roots.where("shiftright(n - 1, level) > 0").isEmpty():
            break
        wanted = -(-roots.count() // each)
        tasks = wanted if tasks is None else max(1, min(wanted, tasks // 2))  # fewer each time, so that it ends however nodes fall to tasks
        height = height if tasks > 1 else 64
        at = F.expr("shiftleft(idx, level)")
        dealt = roots.repartitionByRange(tasks, "tree", at) if tasks > 1 else roots.coalesce(1)
        nodes, level_zero = dealt.sortWithinPartitions("tree", at), []
    chain = above(roots.select("tree", F.col("digest").alias("subroot")))
    more = [c for c in chain.columns if c not in ("tree", "_above")]
    chain = roots.select("tree", F.col("level").alias("top_level"), F.col("idx").alias("top_idx")).join(chain, "tree")
    for rows in reversed(rounds):
        few = chain.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
        met = rows.join(F.broadcast(chain) if few else chain, ["tree", "top_level", "top_idx"])
        own = [c for c in rows.columns if c not in ("witness", "top_level", "top_idx")]
        chain = met.select(*own, *more, F.concat("witness", "_above").alias("_above"))
        if rows is not rounds[0]:
            chain = written(chain.drop("n").withColumnsRenamed({"level": "top_level", "idx": "top_idx"}), f"{name}-chain")
    return chain.drop("level").withColumnRenamed("_above", "witness")


def folded(node: bytes, witness: bytes, places: tuple[tuple[int, int], ...]) -> bytes:
    """The root that a node and its witness give; places: its place and the number of leaves in its tree, then those of its tree."""
    at = 0
    for idx, n in places:
        while n > 1:
            if idx & 1 or idx + 1 < n:
                other = witness[at : at + 32]
                at += 32
                node = digest(other, node) if idx & 1 else digest(node, other)
            else:
                node = digest(node)
            idx, n = idx >> 1, (n + 1) >> 1
    return node


def manifest(docs: DataFrame, height: int = HEIGHT, each: int = NODES) -> DataFrame:
    """doc_id, tree, digest, tampered, idx, n (place and leaves in its tree), tree_idx, trees (the tree's own), witness, subroot, root of every row of docs."""
    flat = written(leaves(docs), "merkle-leaves")
    nodes = numbered(flat, ["doc_id", "digest"], "merkle-sorted").withColumn("leaf", F.col("digest"))

    def above(subroots: DataFrame) -> DataFrame:
        trees = subroots.withColumnsRenamed({"tree": "lang_tree", "subroot": "digest"}).withColumn("tree", F.lit(""))
        trees = numbered(trees, ["lang_tree"], "merkle-trees", trees.limit(each + 1).count() <= each).withColumn("subroot", F.col("digest"))
        found = witnesses(trees, ["lang_tree", "subroot"], "merkle-top", lambda roots: roots.select("tree", F.col("subroot").alias("root"), F.lit(b"").alias("_above")), height, each)
        return found.select(F.col("lang_tree").alias("tree"), "subroot", "root", F.col("idx").alias("tree_idx"), F.col("n").alias("trees"), F.col("witness").alias("_above"))

    return witnesses(nodes, ["doc_id", "leaf", "tampered"], "merkle", above, height, each).withColumnRenamed("leaf", "digest")


def checked(entries: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of a manifest's rows, folding each tampered leaf, or else the leaf, along its witness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, leaf, tampered, witness, idx, n, tree_idx, trees, subroot, root = (x.to_pylist() for x in batch.columns)
            found = [folded(t or d, w, ((i, k), (j, m))) for d, t, w, i, k, j, m in zip(leaf, tampered, witness, idx, n, tree_idx, trees)]
            text = lambda x: pa.array([v.hex() for v in x], pa.string())
            proof = [sha256(w.hex().encode()).digest() for w in witness]
            same = pa.array([x == y for x, y in zip(found, root)], pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), *map(text, (leaf, subroot, root, proof, found)), same], names=names)

    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kinds = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return entries.select(F.col("doc_id").cast("long").alias("doc_id"), "digest", "tampered", "witness", "idx", "n", "tree_idx", "trees", "subroot", "root").mapInArrow(run, kinds)
