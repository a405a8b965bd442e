"""Cluster bootstrap by weights that are made where the groups are.

A replicate draws as many groups as there are, with replacement. Groups are dealt to ranges by their hash; how often a range is
drawn comes from a splitting tree over the counts of all ranges (RANGES rows at most), which all tasks get, and how often a group of it from the tree below
the range. So a task has the weights of its groups for all replicates at once, no draw is a row, and what leaves a task is one total a key and
replicate. A replicate can be repeated by any other engine. A NULL group is a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from evalspark.operators.multinomial import Tree, multinomial
from evalspark.sources.shared import written

#: Ranges of groups at most, and groups that a range has on average until then.
RANGES, RANGE_GROUPS = 4096, 16
#: Replicates of a row that tasks send each other; numbers that a task sums up before it sends them; rows whose weights are laid side by side.
BLOCK, HELD, STEP = 250, 4_000_000, 256


def group_places(rows: DataFrame, group: str) -> DataFrame:
    """group, place: its place from 0 in hash order, counted in 4,096 hash ranges so no window holds all groups."""
    groups = rows.select(group).distinct().withColumn("_h", F.sha1(F.col(group).cast("string").cast("binary"))).withColumn("_r", F.substring("_h", 1, 3))
    before = groups.groupBy("_r").count().select("_r", (F.sum("count").over(Window.orderBy("_r")) - F.col("count")).alias("_b"))
    place = F.col("_b") + F.row_number().over(Window.partitionBy("_r").orderBy("_h")) - 1
    return groups.join(before, "_r").select(group, place.cast("long").alias("place"))


def _hash(group: str) -> Column:
    return F.sha1(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).cast("binary"))


def tree_of(groups: DataFrame, draws: int, seed: int) -> Tree:
    """The tree over groups (_h, the hash of each, repeated or not)."""
    fine = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    counted = groups.groupBy(fine.alias("r")).agg(F.countDistinct("_h").alias("m")).toPandas()
    counts = np.zeros(RANGES, dtype=np.int64)
    counts[counted["r"].to_numpy(dtype=np.int64)] = counted["m"].to_numpy(dtype=np.int64)
    ranges = min(RANGES, 1 << max(0, int(counts.sum() // RANGE_GROUPS)).bit_length())
    return Tree(counts.reshape(ranges, -1).sum(axis=1), draws, seed)


def _range(tree: Tree) -> Column:
    return F.floor(F.conv(F.substring("_h", 1, 3), 16, 10).cast("int") / F.lit(RANGES // len(tree.counts))).cast("int")


def _coded(batch: pa.RecordBatch, names: list[str], codes: dict) -> np.ndarray:
    """A number for the keys of each row, from codes, which grows."""
    if not names:
        codes.setdefault((), 0)
        return np.zeros(batch.num_rows, dtype=np.int64)
    return np.array([codes.setdefault(k, len(codes)) for k in zip(*(batch.column(n).to_pylist() for n in names))], dtype=np.int64)


def _blocks(codes: dict, totals: dict[int, np.ndarray], schema: pa.Schema, extra: list | None = None) -> pa.RecordBatch:
    """The totals (sums x replicates) of each key as rows (keys, extra, block, sums in bytes)."""
    rows = []
    for key, code in codes.items():
        if code in totals:
            for at in range(0, totals[code].shape[1], BLOCK):
                rows.append((*key, *(extra or []), at // BLOCK, np.ascontiguousarray(totals[code][:, at : at + BLOCK]).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], names=schema.names)


def _spread(blocks: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """keys, b, sums from blocks (keys, block, sums in bytes), added up."""
    kinds = blocks.select(*keys).schema
    out = kinds.add("b", "long")
    for s in sums:
        out = out.add(s, "double")
    schema = to_arrow_schema(out)

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), dtype=float).reshape(len(sums), -1) for x in rows.column("sums"))
        size, first = total.shape[1], rows.column("block")[0].as_py() * BLOCK
        same = [pa.array([rows.column(k)[0].as_py()] * size, schema.field(k).type) for k in keys]
        return pa.Table.from_arrays([*same, pa.array(np.arange(first, first + size)), *map(pa.array, total)], schema=schema)

    return blocks.groupBy(*keys, "block").applyInArrow(add, out)


def replicates(rows: DataFrame, group: str, sums: list[str], draws: int, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """keys, b, sums (as doubles): the totals of columns over rows with the weights of their groups, for each of draws replicates b."""
    keys = keys or []
    cells = rows.groupBy(_hash(group).alias("_h"), *keys).agg(*[F.sum(F.col(s).cast("double")).alias(s) for s in sums])
    cells = written(cells, "boot-cells")
    tree = tree_of(cells, draws, seed)
    shared = rows.sparkSession.sparkContext.broadcast(tree)
    told = rows.select(*keys).schema.add("block", "integer").add("sums", "binary")
    schema = to_arrow_schema(told)
    held = max(1, HELD // (len(sums) * draws))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, codes, totals, last, place = shared.value, {}, {}, None, 0
        for batch in batches:
            code, values = _coded(batch, keys, codes), np.stack([batch.column(s).fill_null(0.0).to_numpy() for s in sums], axis=1)
            ranges, hashes = batch.column("_r").to_numpy(), batch.column("_h").to_pylist()
            places = np.empty(len(hashes), dtype=np.int64)
            for i, h in enumerate(hashes):
                if last is None or h != last[1]:
                    place = 0 if last is None or ranges[i] != last[0] else place + 1
                    last = ranges[i], h
                places[i] = place
            at = 0
            while at < len(places):
                first, weights = tree.leaf(int(ranges[at]), int(places[at]))
                end = at + int(np.argmin(np.append((ranges[at:] == ranges[at]) & (places[at:] < first + len(weights)), False)))
                here, inverse = np.unique(code[at:end], return_inverse=True)
                sparse = np.zeros((len(here), len(sums), len(weights)))
                for s in range(len(sums)):
                    np.add.at(sparse[:, s], (inverse, places[at:end] - first), values[at:end, s])
                made = (sparse.reshape(-1, len(weights)) @ weights).reshape(len(here), len(sums), -1)
                for k, c in enumerate(here.tolist()):
                    totals[c] = totals[c] + made[k] if c in totals else made[k]
                at = end
            if len(totals) > held:
                yield _blocks(codes, totals, schema)
                codes, totals = {}, {}
        yield _blocks(codes, totals, schema)

    dealt = cells.select("*", _range(tree).alias("_r")).repartition("_r").sortWithinPartitions("_r", "_h")
    return _spread(dealt.mapInArrow(run, told), keys, sums)


def placed(rows: DataFrame, group: str, draws: int, seed: int) -> tuple[Tree, DataFrame]:
    """The tree of rows' groups, and rows with _r and _place, where the tree has the weights of their groups."""
    groups = written(rows.select(_hash(group).alias("_h")).distinct(), "boot-groups")
    tree = tree_of(groups, draws, seed)
    groups = groups.withColumn("_r", _range(tree))
    groups = groups.withColumn("_place", (F.row_number().over(Window.partitionBy("_r").orderBy("_h")) - 1).cast("long"))
    return tree, rows.withColumn("_h", _hash(group)).join(groups, "_h").drop("_h")


def weights(rows: DataFrame, group: str, draws: int, seed: int = 42) -> DataFrame:
    """group, b, w (from 1) for draws replicates: the weights as rows, for statistics that need them so."""
    tree, groups = placed(rows.select(group).distinct(), group, draws, seed)
    shared, out = rows.sparkSession.sparkContext.broadcast(tree), rows.select(group).schema.add("b", "long").add("w", "long")
    kind = to_arrow_schema(out).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value, r, place in zip(*(x.to_pylist() for x in batch.columns)):
                first, found = shared.value.leaf(r, place)
                b = np.flatnonzero(found[place - first])
                yield pa.RecordBatch.from_arrays([pa.array([value] * len(b), kind), pa.array(b), pa.array(found[place - first][b].astype(np.int64))], names=[group, "b", "w"])

    return groups.select(group, "_r", "_place").mapInArrow(run, out)


def bootstrap(rows: DataFrame, group: str, statistic: Column, draws: int, seed: int = 42) -> DataFrame:
    """b, value of an aggregate over rows with the weight w, for each replicate."""
    drawn = weights(rows, group, draws, seed).withColumnRenamed(group, "_g")
    return rows.join(drawn, F.col(group).eqNullSafe(F.col("_g"))).groupBy("b").agg(statistic.alias("value"))


def cell_replicates(cells: DataFrame, keys: list[str], n: str, draws: int, seed: int = 42) -> DataFrame:
    """keys, b, n: cells (keys, n) of counted rows, each replicate drawing as many rows as there are: multinomial over the cells, in the order of their keys.

    That is what drawing the rows themselves comes to, at a cost that doesn't depend on their number; cells are collected, so let them be those of a report.
    """
    told = cells.select(*keys, F.col(n).cast("long").alias("n")).orderBy(*keys).toPandas()
    out = cells.select(*keys).schema.add("b", "long").add("n", "long")
    names, schema = told[keys].values.tolist(), to_arrow_schema(out)
    spark = cells.sparkSession
    shared = spark.sparkContext.broadcast(multinomial(told["n"].to_numpy(dtype=np.int64), draws, seed) if names else np.zeros((0, draws), dtype=np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                same = [pa.array(x, t) for x, t in zip(zip(*names), schema.types)]
                yield pa.RecordBatch.from_arrays([*same, pa.array([b] * len(names)), pa.array(shared.value[:, b].astype(np.int64))], names=schema.names)

    return spark.range(draws if names else 0).mapInArrow(run, out)


def interval(values: DataFrame, value: str, keys: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """keys, lo, hi: percentiles of the values that are not NULL, interpolated."""
    cut = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("_p")
    return values.where(F.col(value).isNotNull()).groupBy(*(keys or [])).agg(cut).select(*(keys or []), F.col("_p")[0].alias("lo"), F.col("_p")[1].alias("hi"))


def order_statistics(values: DataFrame, value: str, keys: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """keys, lo, hi: of the sorted values those at int(alpha / 2 * n) and int((1 - alpha / 2) * n) - 1."""
    got = values.where(F.col(value).isNotNull()).groupBy(*(keys or [])).agg(F.sort_array(F.collect_list(value)).alias("_v"))
    n = F.size("_v")
    at = lambda i: F.element_at("_v", F.greatest(F.lit(1), i).cast("int"))
    return got.select(*(keys or []), at(F.floor(n * (alpha / 2)) + 1).alias("lo"), at(F.floor(n * (1 - alpha / 2))).alias("hi"))


#: A term of a tie: from the totals of two columns before it, and its own.
Term = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def ordered_replicates(rows: DataFrame, group: str, keys: list[str], order: str, sums: tuple[str, str], term: Term, draws: int, seed: int = 42, descending: bool = False) -> DataFrame:
    """keys, b, area, sums: of each replicate the sum of a term over the ties of order, and the totals of two columns.

    Rows (group, keys, order, sums), one of each group, key and order value, are cut into ranges of (keys, order) once, before
    they are drawn, so that a range holds what a task can read whatever the spread of a key's values. A first pass has the totals of each range and
    replicate; what comes before a range is the running sum of these; the second pass adds up the terms.
    """
    tree, cells = placed(rows, group, draws, seed)
    shared = rows.sparkSession.sparkContext.broadcast(tree)
    by = [F.col(k) for k in keys] + [F.col(order).desc() if descending else F.col(order).asc()]
    cells = cells.select(*keys, order, *[F.col(s).cast("double").alias(s) for s in sums], "_r", "_place")
    cells = written(cells.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()), "boot-ordered")
    told = cells.select(*keys).schema.add("_part", "integer").add("block", "integer").add("sums", "binary")
    schema = to_arrow_schema(told)

    def tied(batch: pa.RecordBatch, code: np.ndarray) -> Iterator[tuple[int, int, object, np.ndarray]]:
        """(code, part, order value, weighted sums) of each run of equal ones, STEP rows at a time: a tie may come in several runs."""
        part, value = batch.column("_part").to_numpy(), batch.column(order).to_numpy(zero_copy_only=False)
        r, place = batch.column("_r").to_pylist(), batch.column("_place").to_pylist()
        xy = [batch.column(s).to_numpy() for s in sums]
        for at in range(0, len(part), STEP):
            here = slice(at, at + STEP)
            found = np.empty((len(part[here]), draws))
            for i, (a, b) in enumerate(zip(r[here], place[here])):
                first, made = shared.value.leaf(a, b)
                found[i] = made[b - first]
            p, c, v = part[here], code[here], value[here]
            starts = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (c[1:] != c[:-1]) | (v[1:] != v[:-1]))))
            both = np.stack([np.add.reduceat(found * s[here, None], starts, axis=0) for s in xy], axis=1)
            for i, k in enumerate(starts.tolist()):
                yield int(c[k]), int(p[k]), v[k], both[i]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: dict = {}
            code = _coded(batch, [*keys, "_part"], codes)
            totals: dict[int, np.ndarray] = {}
            for c, _, _, both in tied(batch, code):
                totals[c] = totals[c] + both if c in totals else both
            yield _blocks(codes, totals, schema)

    def running(rows: pa.Table) -> pa.Table:
        parts = rows.column("_part").to_pylist()
        each: dict[int, np.ndarray] = {}
        for p, x in zip(parts, rows.column("sums")):
            each[p] = each.get(p, 0) + np.frombuffer(x.as_py(), dtype=float)
        out, before = [], 0
        for p in sorted(each):
            out.append((np.zeros_like(each[p]) + before).tobytes())
            before = before + each[p]
        same = [pa.array([rows.column(k)[0].as_py()] * len(out), schema.field(k).type) for k in keys]
        return pa.Table.from_arrays([*same, pa.array(sorted(each), pa.int32()), pa.array([rows.column("block")[0].as_py()] * len(out), pa.int32()), pa.array(out, pa.binary())], schema=schema)

    before = written(written(cells.mapInArrow(total, told), "boot-totals").groupBy(*keys, "block").applyInArrow(running, told), "boot-before")
    done = to_arrow_schema(out := cells.select(*keys).schema.add("block", "integer").add("sums", "binary"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict = {}
        now, tie, state, area = None, None, None, None  # (code, part), its open tie (value, sums), sums before, (area and sums)

        def closed() -> None:
            area[0] += term(*state, *tie[1])
            area[1:] += tie[1]
            state[:] += tie[1]

        def ended() -> pa.RecordBatch:
            if tie is not None:
                closed()
            return _blocks(codes, {now[0]: area}, done)

        for batch in batches:
            code, head = _coded(batch, keys, codes), batch.column("sums")
            block, part = batch.column("block").to_pylist(), batch.column("_part").to_pylist()
            at = 0
            while at < len(part):
                if block[at] >= 0:  # what comes before a range stands before its rows
                    if now != (int(code[at]), part[at]):
                        if now is not None:
                            yield ended()
                        now, tie, state, area = (int(code[at]), part[at]), None, np.zeros((2, draws)), np.zeros((3, draws))
                    x = np.frombuffer(head[at].as_py(), dtype=float).reshape(2, -1)
                    state[:, block[at] * BLOCK : block[at] * BLOCK + x.shape[1]] = x
                    at += 1
                    continue
                end = at
                while end < len(part) and block[end] < 0:
                    end += 1
                for _, _, value, both in tied(batch.slice(at, end - at), code[at:end]):
                    if tie is not None and tie[0] == value:
                        tie = value, tie[1] + both
                    else:
                        if tie is not None:
                            closed()
                        tie = value, both
                at = end
        if now is not None:
            yield ended()

    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    kind = cells.schema[order].dataType
    heads = before.select(*keys, none(order, kind), *[F.lit(0.0).alias(s) for s in sums], F.lit(0).alias("_r"), F.lit(0).cast("long").alias("_place"), "_part", "block", F.col("sums").alias("sums"))
    body = cells.select(*keys, order, *sums, "_r", "_place", "_part", F.lit(-1).alias("block"), none("sums", "binary"))
    both = heads.union(body).repartition("_part").sortWithinPartitions("_part", *by[:-1], F.col("block") < 0, by[-1])
    return _spread(both.mapInArrow(add, out), keys, ["area", *sums])


def concordance(before_pos: np.ndarray, before_neg: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """Twice the pairs that a tie adds to the area under the ROC curve."""
    return pos * (2 * before_neg + neg)


def weighted_auroc(rows: DataFrame, group: str, score: str, label: Column, draws: int, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """b, keys, value: the AUROC of each replicate from counts per group and score, the same draws for all keys."""
    keys, y = keys or [], label.cast("int")
    cells = rows.where(y.isNotNull() & F.col(score).isNotNull()).groupBy(group, *keys, score).agg(F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg"))
    got = ordered_replicates(cells, group, keys, score, ("_pos", "_neg"), concordance, draws, seed)
    return got.select("b", *keys, (F.col("area") / F.nullif(2.0 * F.col("_pos") * F.col("_neg"), F.lit(0.0))).alias("value"))


def auroc_interval(rows: DataFrame, group: str, score: str, label: Column, draws: int, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """keys, n_pos, n_neg, auroc and its interval lo, hi over draws of groups."""
    from evalspark.operators.metrics import auroc

    keys = keys or []
    span = interval(weighted_auroc(rows, group, score, label, draws, seed, keys), "value", keys)
    whole = auroc(rows, score, label, keys)
    return whole.join(span, keys, "left") if keys else whole.crossJoin(span)


_HARMONIC = np.concatenate(([0.0], np.cumsum(1.0 / np.arange(1, 65))))


def _harmonic_rest(n: np.ndarray) -> np.ndarray:
    return 1 / (2 * n) - 1 / (12 * n * n) + 1 / (120 * n**4)


def tied_risks(before_g: np.ndarray, before_e: np.ndarray, g: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The sum of the risks of a tie of g rows with e errors after before_g rows with before_e errors; 0 for no rows."""
    low, high = before_g, before_g + g
    few = low < len(_HARMONIC)
    a, b = np.maximum(low, 1), np.maximum(high, 1)
    whole = np.where(high < len(_HARMONIC), _HARMONIC[np.minimum(high, 64).astype(int)], np.log(b) + np.euler_gamma + _harmonic_rest(b))
    steps = np.where(few, whole - _HARMONIC[np.minimum(low, 64).astype(int)], np.log1p(g / a) + _harmonic_rest(b) - _harmonic_rest(a))
    return np.where(g > 0, e + (before_e - before_g * e / np.maximum(g, 1)) * steps, 0.0)


def weighted_aurc(rows: DataFrame, group: str, ok: str, conf: str, draws: int, keys: list[str] | None = None, seed: int = 42) -> DataFrame:
    """b, keys, value: the AURC of each replicate, a tied group's risks summed at once from its counts."""
    keys = keys or []
    cells = rows.groupBy(group, *keys, conf).agg(F.count("*").alias("_g"), F.count_if(~F.col(ok)).alias("_e"))
    got = ordered_replicates(cells, group, keys, conf, ("_g", "_e"), tied_risks, draws, seed, descending=True)
    return got.select("b", *keys, (F.col("area") / F.nullif(F.col("_g"), F.lit(0.0))).alias("value"))


def cell_rates(outcomes: DataFrame, group: str, draws: int, seed: int = 42) -> DataFrame:
    """b, failure_type, intervention, recovered (a rate), w: a row for each replicate and cell of outcomes, standing for w rows."""
    counted = outcomes.select(group, "failure_type", "intervention", F.col("recovered").cast("int").alias("_n"), F.when(F.col("recovered").isNotNull(), 1).alias("w"))
    got = replicates(counted, group, ["_n", "w"], draws, seed, ["failure_type", "intervention"])
    return got.select("b", "failure_type", "intervention", (F.col("_n") / F.nullif(F.col("w"), F.lit(0.0))).alias("recovered"), "w")


def flip_stability(outcomes: DataFrame, group: str, draws: int, seed: int = 42) -> DataFrame:
    """One row: the share of replicates whose two failure types have different best repairs."""
    from evalspark.operators.outcomes import best_repairs

    best = best_repairs(cell_rates(outcomes, group, draws, seed), ["b"]).groupBy("b").agg(F.count("*").alias("k"), F.min("best").alias("lo"), F.max("best").alias("hi"))
    return best.agg((F.count_if((F.col("k") == 2) & (F.col("lo") != F.col("hi"))) / F.lit(float(draws))).alias("stability"))
