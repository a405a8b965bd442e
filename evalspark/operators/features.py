"""Feature tables: surface, metadata and grid features, pooling, standardising, residualising, question building."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StringType, StructField, StructType

from evalspark.functions import text as X
from evalspark.operators.bootstrap import group_places
from evalspark.operators.metrics import prefix_sums
from evalspark.sources.shared import written

# Gridlines of the three tick densities.
TICK_COUNTS = {"sparse": 6, "medium": 11, "dense": 21}
GRID_FEATURES = ("grid_offset", "ten_offset", "rel_grid_offset", "rel_ten_offset")


def surface_columns() -> list[Column]:
    """Four features that need no activations."""
    return [
        F.coalesce(F.col("source") == "human", F.lit(False)).cast("double").alias("is_human"),
        F.length("question").cast("double").alias("question_length"),
        F.coalesce("n_vision_tokens", F.lit(0)).cast("double").alias("vision_tokens"),
        X.is_digits(F.col("gold")).cast("double").alias("numeric_gold"),
    ]


def one_hot(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """key, feature ("column=value"), place of each row's categories; places number the sorted features from 0."""
    each = rows.select(key, F.explode(F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])).alias("feature"))
    names = prefix_sums(each.select("feature").distinct().withColumn("_one", F.lit(1)), [], "feature", ["_one"])
    return each.join(names.select("feature", F.col("before__one").cast("int").alias("place")), "feature").select(key, "feature", "place")


def dense_one_hot(hot: DataFrame, key: str) -> DataFrame:
    """key, vec: 1.0 at the places of a row's features, as wide as there are features."""
    width = hot.agg((F.max("place") + 1).alias("_w"))
    rows = hot.groupBy(key).agg(F.collect_set("place").alias("_p")).crossJoin(width)
    vec = F.transform(F.sequence(F.lit(0), F.col("_w") - 1), lambda i: F.array_contains("_p", i).cast("double"))
    return rows.select(key, vec.alias("vec"))


def surface_items(items: DataFrame) -> DataFrame:
    """items with answer_in_figure, answer_length (standardised by the population), answer_type."""
    length = F.length("answer").cast("double")
    stats = items.agg(F.avg(length).alias("_m"), F.stddev_pop(length).alias("_s"))
    z = F.when(F.col("_s") > 0, (length - F.col("_m")) / F.col("_s")).otherwise(length)
    got = items.crossJoin(stats).withColumn("answer_in_figure", X.answer_in_figure(F.col("answer"), F.col("texts")))
    return got.withColumn("answer_length", z).withColumn("answer_type", X.answer_type(F.col("answer"))).drop("_m", "_s")


def grid_features(items: DataFrame) -> DataFrame:
    """items (asks_about, categories, values, axis_min, axis_max, tick_density) with four offsets, 0 for what isn't shown."""
    ticks = F.element_at(F.create_map(*[F.lit(x) for p in TICK_COUNTS.items() for x in p]), F.col("tick_density"))
    place = F.array_position("categories", F.col("asks_about"))
    v = F.when(place > 0, F.get("values", (place - 1).cast("int"))).cast("double")
    step = (F.col("axis_max") - F.col("axis_min")) / (ticks - 1)
    r = (v - F.col("axis_min")) / F.nullif(step, F.lit(0.0))
    grid, ten = F.abs(r - F.rint(r)) * step, F.abs(v - 10 * F.rint(v / 10))
    values = (grid / F.nullif(step, F.lit(0.0)), ten / 10, grid / F.greatest(v, F.lit(1.0)), ten / F.greatest(v, F.lit(1.0)))
    return items.select("*", *[F.coalesce(x, F.lit(0.0)).alias(n) for n, x in zip(GRID_FEATURES, values)])


def extrapolated(points: DataFrame, year: int) -> DataFrame:
    """figure_id, extrapolated: the least-squares line through (year, value) at a year, to one decimal."""
    got = points.groupBy("figure_id").agg(F.regr_slope("value", "year").alias("a"), F.regr_intercept("value", "year").alias("b"))
    return got.select("figure_id", F.round(F.col("a") * year + F.col("b"), 1).alias("extrapolated"))


def min_gap(points: DataFrame) -> DataFrame:
    """figure_id, min_gap between any two values of a figure."""
    order = Window.partitionBy("figure_id").orderBy("value")
    return points.withColumn("_d", F.col("value") - F.lag("value").over(order)).groupBy("figure_id").agg(F.min("_d").alias("min_gap"))


def closest_pairs(points: DataFrame) -> DataFrame:
    """figure_id, low, high: the categories whose values are closest; of equal gaps the lower pair."""
    order = Window.partitionBy("figure_id").orderBy("value", "category")
    near = points.select("figure_id", "value", F.col("category").alias("high"), F.lag("category").over(order).alias("low"), (F.col("value") - F.lag("value").over(order)).alias("gap"))
    best = near.where("low is not null").groupBy("figure_id").agg(F.min_by(F.struct("low", "high"), F.struct("gap", "value", "low", "high")).alias("p"))
    return best.select("figure_id", "p.low", "p.high")


def neighbours(points: DataFrame) -> DataFrame:
    """figure_id, category, right: what stands next to each category by place."""
    return points.select("figure_id", "category", F.lead("category").over(Window.partitionBy("figure_id").orderBy("place")).alias("right"))


def absent_names(points: DataFrame, names: DataFrame, seed: int = 42) -> DataFrame:
    """figure_id, absent: a name of the vocabulary that the figure doesn't show.

    The names stand in a circle in hash order. A figure starts at a place that its own hash gives and takes the
    first name that it doesn't show; that is among as many as it shows and one, so only these are looked up. A figure
    that shows all names has none and is left out.
    """
    places = group_places(names.select("name"), "name")
    size = places.count()
    if not size:
        return points.select("figure_id", F.lit(None).cast("string").alias("absent")).limit(0)
    shown = points.groupBy("figure_id").agg(F.countDistinct("category").alias("_k"))
    first = F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}/"), F.col("figure_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    tried = shown.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.least("_k", F.lit(size - 1)))))
    tried = tried.select("figure_id", "_i", ((first + F.col("_i")) % size).alias("place")).join(places, "place")
    free = tried.join(points.select("figure_id", F.col("category").alias("name")).distinct(), ["figure_id", "name"], "left_anti")
    return free.groupBy("figure_id").agg(F.min_by("name", "_i").alias("absent"))


def lookalikes(points: DataFrame, names: DataFrame, seed: int = 42) -> DataFrame:
    """figure_id, lookalike_of, absent: a name (name, like) that the figure doesn't show, but shows the one that it looks like; the first pair by hash."""
    near = points.select("figure_id", F.col("category").alias("lookalike_of")).join(names.select(F.col("like").alias("lookalike_of"), "name"), "lookalike_of")
    free = near.join(points.select("figure_id", F.col("category").alias("name")), ["figure_id", "name"], "left_anti")
    h = F.sha1(F.concat_ws("/", F.lit(str(seed)), F.col("figure_id").cast("string"), "lookalike_of", "name").cast("binary"))
    best = free.groupBy("figure_id").agg(F.min(F.struct(h.alias("h"), "lookalike_of", "name")).alias("b"))
    return best.select("figure_id", "b.lookalike_of", F.col("b.name").alias("absent"))


def path_questions(graphs: DataFrame) -> DataFrame:
    """figure_id, template, question, gold of node-link figures (path_nodes, edges): the steps of the path, what follows its first node, a node that isn't there."""
    nodes = F.array_distinct(F.flatten("edges"))
    letters = F.array(*[F.lit(chr(65 + i)) for i in range(26)])
    absent = F.get(F.array_except(letters, F.array_union(nodes, F.col("path_nodes"))), F.lit(0))
    first, second, last = F.get("path_nodes", F.lit(0)), F.get("path_nodes", F.lit(1)), F.element_at("path_nodes", -1)
    made = [
        ("path_length", F.concat(F.lit("How many steps lead from "), first, F.lit(" to "), last, F.lit("?")), (F.size("path_nodes") - 1).cast("string")),
        ("successor", F.concat(F.lit("Which node follows "), first, F.lit("?")), second),
        ("absent_node", F.concat(F.lit("Which node follows "), absent, F.lit("?")), F.lit("not shown")),
    ]
    cells = F.array(*[F.struct(F.lit(t).alias("template"), q.alias("question"), g.alias("gold")) for t, q, g in made])
    return graphs.where(F.size("path_nodes") > 1).select("figure_id", F.inline(cells)).where("question is not null and gold is not null")


class Pool:
    """What pooling needs of some tokens of an item: counts, sums and greatest values of the image tokens, counts and sums of the text tokens, and the last token."""

    def __init__(self, width: int) -> None:
        self.image, self.text = np.zeros((2, width)), np.zeros((2, width))
        self.most, self.last = np.full(width, -np.inf), (None, None)

    def add(self, pos: int | None, kind: str, x: np.ndarray, known: np.ndarray) -> None:
        if kind == "image":
            self.image += known, np.where(known, x, 0.0)
            self.most = np.where(known, np.maximum(self.most, x), self.most)
        elif kind == "text":
            self.text += known, np.where(known, x, 0.0)
        if pos is not None:
            self.later(pos, [v if k else None for v, k in zip(x.tolist(), known.tolist())])

    def later(self, pos: int, vec: list) -> None:
        rank = lambda p, v: (p, [(x is not None, x or 0.0) for x in v])
        if self.last[0] is None or rank(pos, vec) > rank(*self.last):
            self.last = pos, vec

    def merge(self, other: Pool) -> None:
        self.image, self.text, self.most = self.image + other.image, self.text + other.text, np.maximum(self.most, other.most)
        if other.last[0] is not None:
            self.later(*other.last)

    def vectors(self) -> dict[str, list]:
        mean = lambda x: [s / n if n else None for n, s in x.T.tolist()]
        most = [v if n else None for n, v in zip(self.image[0], self.most.tolist())]
        return {"vision_mean": mean(self.image), "vision_max": most, "query_last": self.last[1] or [None] * len(self.most), "query_mean": mean(self.text)}


#: Items of which a task keeps pools at once.
POOLS = 256


def pooled(tokens: DataFrame) -> DataFrame:
    """item_id, layer, position, vec from tokens (item_id, layer, pos, kind, vec): mean and max over image tokens,
    the last token, the mean over text tokens. NULL entries are left out; what no token tells is NULL.

    Vectors stay whole: a task adds its tokens of an item up, and what it sends is one row an item and layer.
    """
    kinds = tokens.select("item_id", "layer").schema
    part, out = StructType([*kinds.fields, StructField("pool", BinaryType())]), StructType([*kinds.fields, StructField("position", StringType()), StructField("vec", ArrayType(DoubleType()))])
    schema, made = to_arrow_schema(part), to_arrow_schema(out)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pools: dict[tuple, Pool] = {}

        def full() -> pa.RecordBatch:
            keys = list(zip(*pools)) or [[], []]
            rows = pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(keys, schema.types)), pa.array([pickle.dumps(p) for p in pools.values()], pa.binary())], names=schema.names)
            pools.clear()
            return rows

        for batch in batches:
            item, layer, pos, kind = (batch.column(i).to_pylist() for i in range(4))
            for i, vec in enumerate(batch.column(4)):
                values = vec.values
                known = values.is_valid().to_numpy(zero_copy_only=False)
                if (item[i], layer[i]) not in pools and len(pools) >= POOLS:
                    yield full()
                pools.setdefault((item[i], layer[i]), Pool(len(known))).add(pos[i], kind[i], values.to_numpy(zero_copy_only=False).astype(float), known)
        yield full()

    def merge(rows: pa.Table) -> pa.Table:
        whole = None
        for x in rows.column("pool"):
            one = pickle.loads(x.as_py())
            whole = one if whole is None else whole
            if one is not whole:
                whole.merge(one)
        vectors = whole.vectors()
        keys = [pa.array([rows.column(c)[0].as_py()] * len(vectors), t) for c, t in zip(("item_id", "layer"), made.types)]
        return pa.Table.from_arrays([*keys, pa.array(list(vectors)), pa.array(list(vectors.values()), made.types[3])], names=made.names)

    whole = tokens.where("vec is not null").select("item_id", "layer", "pos", "kind", "vec").mapInArrow(add, part)
    return whole.groupBy("item_id", "layer").applyInArrow(merge, out)


def questions(figures: DataFrame) -> DataFrame:
    """figure_id, template, question, gold built from bar figures (categories, values): a read, a comparison, a difference, an absent letter."""
    c, v = (lambda i: F.get("categories", F.lit(i))), (lambda i: F.get("values", F.lit(i)))
    letters = F.array(*[F.lit(chr(65 + i)) for i in range(26)])
    absent = F.get(F.array_except(letters, F.col("categories")), F.lit(0))
    made = [
        ("read_value", F.concat(F.lit("What is the value of "), c(0), F.lit("?")), v(0).cast("string")),
        ("compare_bars", F.concat(F.lit("Which is larger, "), c(0), F.lit(" or "), c(1), F.lit("?")), F.when(v(0) >= v(1), c(0)).otherwise(c(1))),
        ("bar_difference", F.concat(F.lit("What is the difference between "), c(0), F.lit(" and "), c(1), F.lit("?")), F.abs(v(0) - v(1)).cast("string")),
        ("absent_category", F.concat(F.lit("What is the value of "), absent, F.lit("?")), F.lit("not shown")),
    ]
    cells = F.array(*[F.struct(F.lit(t).alias("template"), q.alias("question"), g.alias("gold")) for t, q, g in made])
    return figures.select("figure_id", F.inline(cells)).where("question is not null and gold is not null")


def standardised(rows: DataFrame, columns: list[str], fit: Column, keys: list[str] | None = None) -> DataFrame:
    """rows with columns as z-scores by the mean and population deviation of the rows where fit; a deviation under 1e-6 counts as 1."""
    keys = keys or []
    stats = rows.groupBy(*keys).agg(*[e for c in columns for e in (F.avg(F.when(fit, F.col(c))).alias(f"_m_{c}"), F.stddev_pop(F.when(fit, F.col(c))).alias(f"_s_{c}"))])
    joined = rows.join(stats, keys) if keys else rows.crossJoin(stats)
    z = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-6, 1.0).otherwise(F.col(f"_s_{c}"))
    return joined.select(*[z(c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def residualised(rows: DataFrame, vec: str, surface: list[str], fit: Column, keys: list[str] | None = None) -> DataFrame:
    """rows with vec less its least-squares prediction from the surface columns, fitted where fit, for each of keys; NULL where nothing was fitted.

    The planes come from sums that each task takes over whole vectors: products of the surface columns with each other and with vec.
    Rows with a NULL surface column take no part in a fit.
    """
    from evalspark.operators.descent import planes, same

    keys = keys or []
    known = rows.where(fit)
    for c in surface:
        known = known.where(F.col(c).isNotNull())
    names = written(known.select(*keys).distinct().withColumn("_code", F.monotonically_increasing_id()), "planes-keys") if keys else None
    with_surface = F.concat(F.transform(vec, lambda x: x.cast("double")), F.array(*[F.col(c).cast("double") for c in surface])).alias("vec")
    if names is None:
        data = known.select(F.lit(0).cast("long").alias("code"), F.lit(0.0).alias("y"), with_surface)
    else:
        renamed = names.withColumnsRenamed({k: f"_{k}" for k in keys})
        data = known.join(renamed, same(keys)).select(F.col("_code").alias("code"), F.lit(0.0).alias("y"), with_surface)
    found = written(planes(data, len(surface)), "planes")
    if names is None:
        joined = rows.join(F.broadcast(found.select(F.col("planes").alias("_planes"))), F.lit(True), "left")
    else:
        told = renamed.join(found.select(F.col("code").alias("_code"), F.col("planes").alias("_planes")), "_code").drop("_code")
        joined = rows.join(told, same(keys), "left")
    left = F.zip_with(F.col(vec), F.col("_planes")[0], lambda a, b: a.cast("double") - b)
    for i, c in enumerate(surface):
        left = _less(left, F.col("_planes")[i + 1], F.col(c).cast("double"))
    return joined.select(*[left.alias(vec) if c == vec else F.col(c) for c in rows.columns])


def _less(left: Column, plane: Column, by: Column) -> Column:
    return F.zip_with(left, plane, lambda a, b: a - b * by)
