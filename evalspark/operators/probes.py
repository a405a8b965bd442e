"""Linear probes: L2 logistic fits over grids of layers, positions, penalties and folds.

The rows that a cell of a grid is fitted on are a group of a grouped map, all penalties and inner folds in one pass
over it, whose rows stay as they came; the fit is Newton's method in numpy, some rows at a time, in the space that the rows span where they are fewer than the
dimensions. Cells of more than MAX_CELL numbers (rows times dimensions and ROW more) are fitted together by a descent over
their distributed rows instead, to the same weights. Where vectors repeat, equal rows of a cell are one with a weight. Fits are tables of weights; rows are scored by joining them, so whatever is
only scored never passes through a group. Roles are explicit: selection sees what it is given and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evalspark.operators.bootstrap import auroc_interval
from evalspark.operators.descent import large_fits
from evalspark.operators.features import residualised
from evalspark.operators.metrics import auroc
from evalspark.operators.quality import require_no_leaks
from evalspark.sources.shared import written

MAX_CELL = 20_000_000
#: Numbers that a fit holds for a row besides its vector: label, weight, margin, probability and the like.
ROW = 8
#: Numbers that a pass makes of a cell's rows at once, so that no second copy of them is made.
STEP = 131_072
MIN_TRAIN, MIN_REPORT = 20, 5
#: Wider systems are solved by conjugate gradients.
DENSE = 256


def spanned(x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The rows in coordinates of the space that they span, and the matrix that takes weights back; x itself if it has more rows than columns."""
    if len(x) >= x.shape[1]:
        return x, None
    values, vectors = np.linalg.eigh(x @ x.T)
    keep = values > 1e-12 * max(values.max(), 1e-300)
    root = np.sqrt(values[keep])
    return vectors[:, keep] * root, x.T @ (vectors[:, keep] / root)


Parts = Callable[[], Iterator[tuple[slice, np.ndarray]]]


def _slices(rows: int, width: int) -> Iterator[slice]:
    """Places of rows of so many numbers, STEP numbers at a time."""
    step = max(1, STEP // width)
    return (slice(at, at + step) for at in range(0, rows, step))


def _conjugate(parts: Parts, curvature: np.ndarray, penalty: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """Newton's step by conjugate gradients, scaled by the diagonal."""
    scale = 1.0 / (sum(np.einsum("i,ij,ij->j", curvature[at], part, part) for at, part in parts()) + penalty + 1e-10)
    step, left = np.zeros_like(gradient), gradient.copy()
    ahead = scale * left
    size = left @ ahead
    for _ in range(4 * 50):
        image = sum(part.T @ (curvature[at] * (part @ ahead)) for at, part in parts()) + (penalty + 1e-10) * ahead
        length = size / (ahead @ image)
        step, left = step + length * ahead, left - length * image
        again = left @ (scale * left)
        if again < 1e-18 * (gradient @ (scale * gradient)) or again < 1e-30:
            break
        ahead, size = scale * left + again / size * ahead, again
    return step


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Minimum of the summed logistic loss plus l2 / 2 times the squared weights; the intercept is free."""
    design = np.column_stack((x, np.ones(len(x))))
    return _fitted(lambda: ((at, design[at]) for at in _slices(*design.shape)), design.shape[1], y, np.ones(len(y)), l2, rounds)


def _fitted(parts: Parts, width: int, y: np.ndarray, n: np.ndarray, l2: float, rounds: int = 60) -> tuple[np.ndarray, float]:
    """fit_logistic of rows of width numbers that end in a 1 and count n times; each pass over them takes them from parts, some at a time."""
    penalty, dense = np.append(np.full(width - 1, float(l2)), 0.0), width <= DENSE

    def told(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and curvature: a matrix, of wide rows what each of them has."""
        loss, gradient = 0.5 * float((penalty * w * w).sum()), penalty * w
        curvature = np.diag(penalty + 1e-10) if dense else np.empty(len(y))
        for at, part in parts():
            z = part @ w
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
            curve = n[at] * p * (1 - p)
            loss += float(n[at] @ np.logaddexp(0.0, np.where(y[at] > 0, -z, z)))
            gradient = gradient + part.T @ (n[at] * (p - y[at]))
            if dense:
                curvature += (part * curve[:, None]).T @ part
            else:
                curvature[at] = curve
        return loss, gradient, curvature

    w = np.zeros(width)
    now, gradient, curvature = told(w)
    for _ in range(rounds):
        step, scale = np.linalg.solve(curvature, gradient) if dense else _conjugate(parts, curvature, penalty, gradient), 1.0
        # What a sum over many rows can't tell from 0 is none.
        while (after := told(w - scale * step))[0] > now + 1e-12 * max(1.0, now) and scale > 1e-8:
            scale /= 2
        w, change, (now, gradient, curvature) = w - scale * step, now - after[0], after
        if change < max(1e-10, 1e-13 * now):
            break
    return w[:-1], float(w[-1])


def _plane(x: np.ndarray, surface: int, n: np.ndarray) -> np.ndarray:
    """Intercept and slopes by which the last surface columns of x, whose rows count n times, predict the others."""
    inner, crossed = np.zeros((surface + 1, surface + 1)), np.zeros((surface + 1, x.shape[1] - surface))
    for at in _slices(*x.shape):
        base = np.column_stack((np.ones(len(x[at])), x[at, -surface:]))
        weighed = (base * n[at, None]).T
        inner += weighed @ base
        crossed += weighed @ x[at, :-surface]
    return np.linalg.pinv(inner) @ crossed


class Cell:
    """The fit rows of a cell, which count n times (0: not at all), ready to be fitted at any penalty as standardised rows, after what the last surface columns explain is taken out.

    beta: the plane by which these explain the others, if not that of the rows. The rows stay as they came, in the type that they have; a
    pass standardises STEP numbers at a time. Only of wide rows, which are passed over often, a standardised copy is held.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, surface: int = 0, n: np.ndarray | None = None, beta: np.ndarray | None = None):
        n, width = np.ones(len(y)) if n is None else n, x.shape[1] - surface
        wide = np.count_nonzero(n) < width or width >= DENSE
        if wide and not n.all():
            x, y, n = x[n > 0], y[n > 0], n[n > 0]
        self.x, self.y, self.n, self.surface, self.design, self.back = x, y, n, surface, None, None
        self.beta = _plane(x, surface, n) if surface and beta is None else beta
        self.mean, self.sd = np.zeros(width), np.ones(width)
        self.mean = sum(n[at] @ part[:, :-1] for at, part in self._parts()) / n.sum()
        sd = np.sqrt(sum(np.einsum("i,ij,ij->j", n[at], part[:, :-1], part[:, :-1]) for at, part in self._parts()) / n.sum())
        self.sd = np.where(sd < 1e-6, 1.0, sd)
        if wide:
            design = np.empty((len(x), width + 1))
            for at, part in self._parts():
                design[at] = part
            rows, self.back = spanned(design[:, :-1])
            self.design = design if self.back is None else np.column_stack((rows, np.ones(len(rows))))

    def _parts(self) -> Iterator[tuple[slice, np.ndarray]]:
        """Places and standardised rows, which end in a 1."""
        if self.design is not None:
            yield from ((at, self.design[at]) for at in _slices(*self.design.shape))
            return
        width = len(self.sd)
        for at in _slices(len(self.x), self.x.shape[1] + 1):
            x = self.x[at]
            part = np.ones((len(x), width + 1))
            z = part[:, :-1]
            z[:] = x[:, :width]
            if self.surface:
                z -= np.column_stack((np.ones(len(x)), x[:, width:])) @ self.beta
            z -= self.mean
            z /= self.sd
            yield at, part

    def fit(self, l2: float) -> tuple[np.ndarray, float] | None:
        """Weights and intercept for the rows as they came; None with one class only."""
        if not 0 < self.n @ (self.y > 0) < self.n.sum():
            return None
        w, b = _fitted(self._parts, len(self.sd) + 1 if self.design is None else self.design.shape[1], self.y, self.n, l2)
        w = (w if self.back is None else self.back @ w) / self.sd
        b -= float(self.mean @ w)
        if self.surface:
            b -= float(self.beta[0] @ w)
            w = np.concatenate((w, -self.beta[1:] @ w))
        return w, b


def area(y: np.ndarray, s: np.ndarray, n: np.ndarray | None = None) -> float | None:
    """AUROC of scores in memory, of rows that count n times, ties counted half; None with one class."""
    if len(np.unique(y)) < 2:
        return None
    n = np.ones(len(y)) if n is None else n
    _, place = np.unique(s, return_inverse=True)
    pos, neg = np.bincount(place, n * (y > 0)), np.bincount(place, n * (y <= 0))
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum()))


def _best(x: np.ndarray, y: np.ndarray, n: np.ndarray, fold: np.ndarray, l2: tuple[float, ...], surface: int) -> tuple[float, float | None, tuple[np.ndarray, float] | None]:
    """The penalty with the best mean AUROC over the inner folds, that mean, and the fit of all rows at it; a fold that is held out counts 0 times, so that no rows are copied to leave it out."""
    beta = _plane(x, surface, n) if surface else None
    areas: dict[float, list[float]] = {p: [] for p in l2}
    for inner in np.unique(fold):
        out = fold == inner
        held, seen = Cell(x, y, surface, np.where(out, 0.0, n), beta), x[out]
        for p in l2:
            if (f := held.fit(p)) and (value := area(y[out], np.concatenate([seen[at] @ f[0] + f[1] for at in _slices(*seen.shape)]), n[out])) is not None:
                areas[p].append(value)
    mean = {p: float(np.mean(v)) if v else None for p, v in areas.items()}
    best = min(l2, key=lambda p: (mean[p] is None, -(mean[p] or 0.0), p))
    return best, mean[best], Cell(x, y, surface, n, beta).fit(best)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).cast(pa.float64()).to_numpy()


def _matrix(table: pa.Table) -> np.ndarray:
    """The vectors of a table of them, one row each, in the type that they have."""
    column = table.column("vec").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _told(table: pa.Table, cell: list[str], found: list[tuple[float, tuple[np.ndarray, float] | None]], schema: pa.Schema, **more: float | None) -> pa.Table:
    """One row: the table's cell, more, and the fits found for penalties."""
    row = {c: table.column(c)[0].as_py() for c in cell} | more
    return pa.Table.from_pylist([row | {"fits": [{"l2": x, "w": f[0].tolist() if f else None, "b": f[1] if f else None} for x, f in found]}], schema=schema)


def _split(rows: DataFrame, cell: list[str], each: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of cells that fit into a task, those of the others, None if there are none); the others' from each, the rows that rows weigh, if it is given."""
    large = rows.groupBy(*cell).agg(F.sum(F.size("vec").cast("long") + ROW).alias("_size")).where(F.col("_size") > MAX_CELL).drop("_size")
    large = written(large, "probe-large")
    if large.isEmpty():
        return rows, None
    return rows.join(F.broadcast(large), cell, "left_anti"), (rows if each is None else each).join(F.broadcast(large), cell, "left_semi")


def _weighed(rows: DataFrame, columns: list[str], repeats: bool) -> DataFrame:
    """columns, y, vec, n: with repeats one row for all that are equal in these, which counts n times; else the rows as they are."""
    if not repeats:
        return rows.select(*columns, "y", "vec", F.lit(1.0).alias("n"))
    return written(rows.groupBy(*columns, "y", "vec").agg(F.count("*").cast("double").alias("n")), "probe-weighed")


def _kinds(rows: DataFrame, cell: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ", ".join(f"`{c}` {kinds[c]}" for c in cell)


_FITS = "fits array<struct<l2: double, w: array<double>, b: double>>"


def fits(rows: DataFrame, cell: list[str], l2: tuple[float, ...], surface: int = 0, repeats: bool = False) -> DataFrame:
    """cell, fits (l2, w, b): a cell's probe for each penalty, from its rows (cell, y, vec), written to the shared folder.

    The last surface entries of vec are features whose least-squares prediction of the others is taken out first. A cell
    with one class has no w. repeats: vectors are few and come often, so that a task gets each of a cell's once.
    """
    small, large = _split(_weighed(rows, cell, repeats), cell, rows)
    kinds = f"{_kinds(rows, cell)}, {_FITS}"
    schema = to_arrow_schema(StructType.fromDDL(kinds))

    def fit(table: pa.Table) -> pa.Table:
        known = Cell(_matrix(table), _numbers(table, "y"), surface, _numbers(table, "n"))
        return _told(table, cell, [(x, known.fit(x)) for x in l2], schema)

    got = small.groupBy(*cell).applyInArrow(fit, kinds)
    if large is not None:
        got = got.unionByName(large_fits(large.select(*cell, "y", "vec"), cell, l2, surface))
    return written(got, "probe-fits")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)


def scored(rows: DataFrame, fitted: DataFrame, cell: list[str], keep: list[str]) -> DataFrame:
    """cell, l2, keep, score of rows under each fit of their cell: a join with the weights, no group."""
    each = F.transform("fits", lambda f: F.struct(f["l2"].alias("l2"), (dot(F.col("vec"), f["w"]) + f["b"]).alias("score")))
    return rows.join(fitted, cell).select(*cell, *keep, F.inline(each))


def layer_sweep(rows: DataFrame, l2: tuple[float, ...], keys: list[str] | None = None, surface: int = 0, repeats: bool = False) -> DataFrame:
    """keys, position, layer, l2, auroc on validation rows. rows: split (train or val), position, layer, y, vec. Test rows can't take part."""
    cell = [*(keys or []), "position", "layer"]
    fitted = fits(rows.where("split = 'train'"), cell, l2, surface, repeats)
    return auroc(scored(rows.where("split = 'val'"), fitted, cell, ["y"]), "score", F.col("y") == 1, [*cell, "l2"])


def selected(curve: DataFrame, keys: list[str] | None = None, value: str = "auroc") -> DataFrame:
    """The best cell: highest value; ties to the smaller position, penalty, then the shallowest layer."""
    w = Window.partitionBy(*(keys or []))
    ranked = curve.withColumn("_r", F.row_number().over(w.orderBy(F.col(value).desc_nulls_last(), "position", "l2", "layer")))
    return ranked.where("_r = 1").drop("_r")


def test_scores(rows: DataFrame, choice: DataFrame, keys: list[str] | None = None, surface: int = 0, split: str = "test", repeats: bool = False) -> DataFrame:
    """keys, position, layer, l2, item_id, figure_id, y, score of the test rows under the chosen configuration of each of keys, fitted on train only."""
    cell = [*(keys or []), "position", "layer"]
    one = rows.join(choice.select(*cell, "l2"), cell)
    penalties = tuple(sorted(r["l2"] for r in choice.select("l2").distinct().collect()))
    fitted = fits(one.where("split = 'train'"), cell, penalties, surface, repeats)
    return scored(one.where(F.col("split") == split).withColumnRenamed("l2", "_l2"), fitted, cell, ["_l2", "item_id", "figure_id", "y"]).where("l2 = _l2").drop("_l2")


def one_vs_rest(rows: DataFrame, classes: tuple[str, ...], l2: float, keys: tuple[str, ...] = ("position", "layer")) -> DataFrame:
    """keys, trained_on, tested_on, auroc, degenerate: the probe of each class scored against each class on validation rows.

    degenerate: the rows have two classes at most, so that the probes are one with its sign turned and what one says of the other's class is 1 less its own area by construction.
    """
    each = rows.withColumn("trained_on", F.explode(F.array(*map(F.lit, classes)))).withColumn("y", (F.col("cls") == F.col("trained_on")).cast("int"))
    cell = [*keys, "trained_on"]
    got = scored(each.where("split = 'val'"), fits(each.where("split = 'train'"), cell, (l2,)), cell, ["cls"])
    crossed = got.withColumn("tested_on", F.explode(F.array(*map(F.lit, classes))))
    found = rows.where("split in ('train', 'val')").groupBy(*keys).agg((F.countDistinct("cls") <= 2).alias("degenerate"))
    return auroc(crossed, "score", F.col("cls") == F.col("tested_on"), [*cell, "tested_on"]).join(found, list(keys))


def nested_cv(rows: DataFrame, l2: tuple[float, ...], folds: int = 5, keys: list[str] | None = None, surface: int = 0, repeats: bool = False) -> DataFrame:
    """keys, layer, outer, item_id, figure_id, cls, y, l2, inner_auroc, score: out-of-fold scores.

    For each outer fold the penalty with the best mean inner AUROC (inner folds of one class left
    out, ties to the smaller penalty) is fitted on all other folds; what the last surface entries of vec explain
    of the rest is taken out by a projection fitted on these folds alone. rows: keys, layer, fold, y (NULL: only
    scored), vec. An outer fold's rows never reach the group that is fitted for it. repeats: vectors are few and come often, so that a
    task gets each of a fold's once.
    """
    cell = [*(keys or []), "layer", "outer"]
    known = rows.where("y is not null")
    dealt = lambda rows: rows.withColumn("outer", F.explode(F.array(*map(F.lit, range(folds))))).where("fold <> outer")
    small, large = _split(dealt(_weighed(known, [*cell[:-1], "fold"], repeats)), cell, dealt(known))
    kinds = f"{_kinds(small, cell)}, inner_auroc double, {_FITS}"
    schema = to_arrow_schema(StructType.fromDDL(kinds))

    def fit(table: pa.Table) -> pa.Table:
        best, mean, found = _best(_matrix(table), _numbers(table, "y"), _numbers(table, "n"), _numbers(table, "fold"), l2, surface)
        return _told(table, cell, [(best, found)], schema, inner_auroc=mean)

    got = small.select(*cell, "fold", "y", "vec", "n").groupBy(*cell).applyInArrow(fit, kinds)
    if large is not None:
        got = got.unionByName(_large_nested(large.select(*cell, "fold", "y", "vec"), cell, l2, folds, surface))
    fitted = written(got, "probe-fits")
    return scored(rows.withColumn("outer", F.col("fold")), fitted, cell, ["inner_auroc", "item_id", "figure_id", "cls", "y"])


def _large_nested(rows: DataFrame, cell: list[str], l2: tuple[float, ...], folds: int, surface: int) -> DataFrame:
    """cell, inner_auroc, fits (the chosen penalty's) of cells (cell, fold, y, vec) too large for a task: all inner folds of all cells are one descent, all cells another."""
    inner_rows = rows
    if surface:
        names = [f"_s{i}" for i in range(surface)]
        parts = rows.select("*", *[F.element_at("vec", i - surface).alias(n) for i, n in enumerate(names)]).withColumn("vec", F.slice("vec", 1, F.size("vec") - surface))
        inner_rows = residualised(parts, "vec", names, F.lit(True), cell).drop(*names)
    inner = [*cell, "inner"]
    each = inner_rows.withColumn("inner", F.explode(F.array(*map(F.lit, range(folds))))).where("inner <> outer and fold <> inner")
    fitted = written(large_fits(each.select(*inner, "y", "vec"), inner, l2), "probe-inner")
    held = auroc(scored(inner_rows.withColumn("inner", F.col("fold")), fitted, inner, ["y"]), "score", F.col("y") == 1, [*inner, "l2"])
    means = held.groupBy(*cell, "l2").agg(F.avg("auroc").alias("inner_auroc"))
    best = Window.partitionBy(*cell).orderBy(F.round("inner_auroc", 12).desc_nulls_last(), "l2")
    choice = means.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*cell, F.col("l2").alias("_l2"), "inner_auroc")
    whole = large_fits(rows.select(*cell, "y", "vec"), cell, l2, surface).join(choice, cell)
    return whole.select(*cell, "inner_auroc", F.filter("fits", lambda f: f["l2"] == F.col("_l2")).alias("fits"))


def assembled(oof: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Out-of-fold scores of one layer for each of keys and outer fold: that with the best inner AUROC, ties to the shallowest."""
    keys = keys or []
    best = oof.groupBy(*keys, "layer", "outer").agg(F.max("inner_auroc").alias("_a"))
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "outer").orderBy(F.col("_a").desc_nulls_last(), "layer"))).where("_r = 1")
    return oof.join(best.select(*keys, "layer", "outer"), [*keys, "layer", "outer"])


def type_matrix(scores: DataFrame, targets: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], keys: list[str] | None = None, draws: int = 0) -> DataFrame:
    """keys, target, n_pos, n_neg, auroc of scores (cls, score) on contrasts of class sets; with draws also its interval lo, hi over draws of figures."""
    cells = [F.when(F.col("cls").isin(*pos, *neg), F.struct(F.lit(name).alias("target"), F.col("cls").isin(*pos).cast("int").alias("t"))) for name, (pos, neg) in targets.items()]
    each = scores.withColumn("_t", F.explode(F.array_compact(F.array(*cells)))).withColumn("target", F.col("_t.target")).withColumn("t", F.col("_t.t"))
    names = [*(keys or []), "target"]
    return auroc_interval(each, "figure_id", "score", F.col("t") == 1, draws, keys=names) if draws else auroc(each, "score", F.col("t") == 1, names)


def usable(rows: DataFrame, keys: list[str], y: str = "y", least: int = MIN_REPORT, splits: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """keys of groups with at least so many rows of either class in each of the splits."""
    counts = rows.where(F.col("split").isin(*splits)).groupBy(*keys, "split").agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("q"))
    good = counts.where((F.col("p") >= least) & (F.col("q") >= least))
    return good.groupBy(*keys).agg(F.count("*").alias("k")).where(F.col("k") == len(splits)).select(*keys)


def population(answers: DataFrame, labels: DataFrame, task: str, rest: str = "errors") -> DataFrame:
    """answers with split and y for a task: binary (all rows, y: wrong), structural or fabrication (errors by label,
    others of them negatives; rest "correct" adds the right answers as negatives). Errors without a label drop out."""
    from evalspark.functions.ids import figure_split

    rows = answers.join(labels.select("item_id", "label"), "item_id", "left").withColumn("split", figure_split(F.col("figure_id")))
    if task == "binary":
        return rows.withColumn("y", (~F.col("correct")).cast("int"))
    kept = (~F.col("correct") & F.col("label").isNotNull()) | (F.lit(rest == "correct") & F.col("correct"))
    return rows.where(kept).withColumn("y", F.coalesce((~F.col("correct") & (F.col("label") == task)).cast("int"), F.lit(0)))


def platt(rows: DataFrame, score: str, y: str) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of y on one score, from sums over the rows: Newton on two numbers."""
    a = b = 0.0
    for _ in range(60):
        p = 1 / (1 + F.exp(-(F.lit(a) * F.col(score) + F.lit(b))))
        v, s = p * (1 - p), F.col(score)
        g = rows.agg(F.sum((p - F.col(y)) * s), F.sum(p - F.col(y)), F.sum(v * s * s), F.sum(v * s), F.sum(v)).first()
        if g[0] is None:
            return a, b
        step = np.linalg.solve(np.array([[g[2] + 1e-6, g[3]], [g[3], g[4] + 1e-12]]), np.array([g[0] + 1e-6 * a, g[1]]))
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-9:
            break
    return a, b


def sanity_gate(curve: DataFrame, least: float = 0.9) -> DataFrame:
    return curve.agg(F.max("auroc").alias("best"), (F.max("auroc") >= least).alias("passes"))


def disjoint(one: DataFrame, other: DataFrame, key: str = "figure_id") -> Column:
    """Number of keys that both have, as a one-row frame's only column."""
    return one.select(key).distinct().join(other.select(key), key, "left_semi").agg(F.count("*").alias("shared"))


def transfer(source: DataFrame, target: DataFrame, l2: tuple[float, ...], folds: int = 5) -> DataFrame:
    """item_id, figure_id, cls, score of target under a probe that never saw it.

    Layer and penalty are those with the best AUROC of the source's pooled out-of-fold scores (ties: smaller
    penalty, then shallower layer); the probe is then fitted on all source rows with a y.
    """
    known = source.where("y is not null")
    outer = known.withColumn("outer", F.explode(F.array(*map(F.lit, range(folds))))).where("fold <> outer")
    fitted = fits(outer, ["layer", "outer"], l2)
    pooled = auroc(scored(known.withColumn("outer", F.col("fold")), fitted, ["layer", "outer"], ["y"]), "score", F.col("y") == 1, ["layer", "l2"])
    best = pooled.orderBy(F.col("auroc").desc_nulls_last(), "l2", "layer").limit(1).first()
    whole = fits(known.where(F.col("layer") == best["layer"]), ["layer"], (best["l2"],))
    return scored(target, whole, ["layer"], ["item_id", "figure_id", "cls"])


def frozen_scores(rows: DataFrame, extra: DataFrame, choice: DataFrame) -> DataFrame:
    """item_id, figure_id, y, score of extra's rows under the chosen probe, fitted on the train rows of rows; an error if they share a figure."""
    if shared := disjoint(rows, extra).first()["shared"]:
        raise ValueError(f"{shared} figures are in both tables")
    both = rows.where("split = 'train'").select("item_id", "figure_id", "split", "position", "layer", "y", "vec")
    return test_scores(both.unionByName(extra.withColumn("split", F.lit("extra")).select(*both.columns)), choice, split="extra")


def contrast_sweep(rows: DataFrame, l2: tuple[float, ...]) -> DataFrame:
    """contrast, position, layer, l2, auroc on validation rows, for contrasts with enough rows of either class."""
    seen = rows.join(usable(rows, ["contrast"], splits=("train", "val")), "contrast", "left_semi")
    return layer_sweep(seen, l2, ["contrast"])


def join_vectors(vectors: DataFrame, answers: DataFrame) -> DataFrame:
    """vectors with the columns of answers, by item_id: vectors without an answer drop out. A figure_id that differs is an error."""
    more = [c for c in answers.columns if c not in vectors.columns or c == "item_id"]
    right = answers.select(*more, F.col("figure_id").alias("_figure")) if "figure_id" in answers.columns and "figure_id" in vectors.columns else answers.select(*more, F.lit(None).cast("string").alias("_figure"))
    joined = vectors.join(right, "item_id")
    differs = F.raise_error(F.concat(F.lit("the figures differ of item "), F.col("item_id").cast("string")))
    same = F.when(F.col("_figure").isNull() | (F.col("_figure") == F.col("figure_id")), F.col("figure_id")).otherwise(differs.cast("string")) if "figure_id" in vectors.columns else None
    return (joined if same is None else joined.withColumn("figure_id", same)).drop("_figure")


def dataset(vectors: DataFrame, answers: DataFrame, labels: DataFrame, task: str, rest: str = "errors") -> DataFrame:
    """The rows that probes of a task are fitted on: vectors joined with the task's population by item_id; an error if a figure is in two splits."""
    chosen = population(answers, labels, task, rest).select("item_id", "figure_id", "split", "y")
    return require_no_leaks(join_vectors(vectors.drop("split", "y"), chosen))
