"""Logistic fits of cells too large for a task: one descent for all cells and penalties at once.

Each pass reads the rows once. A task adds up, for each cell of its rows, the losses and gradients of all its penalties that are not yet done (one product
of a matrix of rows with a matrix of weights); what tasks send each other is one vector a cell and penalty. The sums meet the descent's state, a row of
a written table for each cell and penalty, and take it a step further (L-BFGS with a search that halves steps). Weights, of cells x
penalties x dimensions numbers, go back to all tasks. Cells whose penalties are all done drop out of the pass. Rows stay as they are: means, deviations and what surface
features explain are taken into the weights.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.sources.shared import written

#: Steps and gradients that a descent remembers; passes at most; how small a gradient must be beside the first one.
MEMORY, PASSES, SMALL = 10, 300, 1e-8
#: Rows of a product.
STEP = 1024


class Moments:
    """Sums over the rows of a cell, and what they say of its scale: vec ends in surface features."""

    def __init__(self, n: float, positives: float, crossed: np.ndarray, squares: np.ndarray) -> None:
        """crossed: base.T @ vec of the base columns 1 and the surface features."""
        surface = len(crossed) - 1
        width = crossed.shape[1] - surface
        self.n, self.positives, self.surface = n, positives, surface
        # Normal equations of centred and scaled surface features; the intercept follows from the means.
        mean, middle = crossed[0, :width] / n, crossed[0, width:] / n
        inner = crossed[1:, width:] - n * np.outer(middle, middle)
        scale = np.sqrt(np.maximum(np.diag(inner), 1e-300))
        slopes = np.linalg.pinv(inner / np.outer(scale, scale)) @ ((crossed[1:, :width] - n * np.outer(middle, mean)) / scale[:, None]) / scale[:, None]
        self.beta = np.vstack((mean - middle @ slopes, slopes))
        sd = np.sqrt(np.maximum(squares[:width] - (self.beta * crossed[:, :width]).sum(axis=0), 0.0) / n)
        self.sd = np.where(sd < 1e-6, 1.0, sd)

    def raw(self, w: np.ndarray) -> np.ndarray:
        """Weights and intercept (last) for rows as they are, from those for standardised rows."""
        v = w[:-1] / self.sd
        return np.concatenate((v, -self.beta[1:] @ v, [w[-1] - self.beta[0] @ v]))

    def standard(self, gradient: np.ndarray) -> np.ndarray:
        """The gradient in the weights of standardised rows, from that in those of rows as they are (the intercept last)."""
        width = len(self.sd)
        base = np.concatenate((gradient[-1:], gradient[width:-1]))
        return np.append((gradient[:width] - base @ self.beta) / self.sd, gradient[-1])


class Descent:
    """One cell and penalty: the point that waits for its loss and gradient, and what led there."""

    def __init__(self, moments: Moments, l2: float) -> None:
        self.moments, self.l2, self.done = moments, l2, False
        self.at = self.trial = np.zeros(len(moments.sd) + 1)
        self.loss = self.gradient = self.direction = self.first = None
        self.length, self.steps = 1.0, []

    def told(self, loss: float, gradient: np.ndarray) -> None:
        """The summed loss at trial and its gradient in raw weights."""
        penalty = np.append(np.full(len(self.trial) - 1, self.l2), 0.0)
        loss = loss + 0.5 * float(penalty @ (self.trial * self.trial))
        gradient = self.moments.standard(gradient) + penalty * self.trial
        if self.loss is not None:
            if loss > self.loss + 1e-4 * self.length * float(self.gradient @ self.direction):
                self.length /= 2
                self.trial = self.at + self.length * self.direction
                self.done = self.length < 1e-9
                return
            s, y = self.trial - self.at, gradient - self.gradient
            if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
                self.steps = [*self.steps[1 - MEMORY :], (s, y)]
        flat = self.loss is not None and self.loss - loss <= 1e-14 * abs(loss)
        self.at, self.loss, self.gradient = self.trial, loss, gradient
        size = float(np.linalg.norm(gradient))
        self.first = size if self.first is None else self.first
        self.done = flat or size <= SMALL * max(self.first, 1.0)
        self.direction, self.length = -self._scaled(gradient), 1.0
        self.trial = self.at + self.direction

    def _scaled(self, g: np.ndarray) -> np.ndarray:
        """The inverse curvature, as the last steps tell it, times g; at first as if all margins were 0."""
        g, parts = g.copy(), []
        for s, y in reversed(self.steps):
            a = (s @ g) / (s @ y)
            g -= a * y
            parts.append((a, s, y))
        scale = self.moments.n / 4 + np.append(np.full(len(g) - 1, self.l2), 0.0)
        if self.steps:
            s, y = self.steps[-1]
            scale = scale * ((y @ (y / scale)) / (s @ y))
        g /= scale
        for a, s, y in reversed(parts):
            g += s * (a - (y @ g) / (s @ y))
        return g

    def weights(self) -> np.ndarray:
        """Of the point that waits, or where it's done of the last one."""
        return self.moments.raw(self.at if self.done else self.trial)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(code, y, rows) of batches (code, y, vec), a cell's rows STEP at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            code, y, x = part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2))
            for c in np.unique(code):
                yield int(c), y[code == c], x[code == c]


def moments(data: DataFrame, surface: int) -> DataFrame:
    """code, moments (pickled) of data (code, y, vec)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for code, y, x in _by_cell(batches):
            base = np.column_stack((np.ones(len(x)), x[:, x.shape[1] - surface :]))
            new = [float(len(y)), float(y.sum()), base.T @ x, (x * x).sum(axis=0)]
            sums[code] = [a + b for a, b in zip(sums[code], new)] if code in sums else new
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([pickle.dumps(x) for x in sums.values()], pa.binary())], names=["code", "sums"])

    def merge(rows: pa.Table) -> pa.Table:
        total = None
        for x in rows.column("sums"):
            new = pickle.loads(x.as_py())
            total = new if total is None else [a + b for a, b in zip(total, new)]
        return pa.table({"code": rows.column("code")[:1], "moments": pa.array([pickle.dumps(Moments(*total))], pa.binary())})

    return data.mapInArrow(add, "code long, sums binary").groupBy("code").applyInArrow(merge, "code long, moments binary")


def planes(data: DataFrame, surface: int) -> DataFrame:
    """code, planes (intercept first) that predict vec, but for its last surface entries, from these by least squares."""

    def told(rows: pa.Table) -> pa.Table:
        beta = pickle.loads(rows.column("moments")[0].as_py()).beta
        return pa.table({"code": rows.column("code")[:1], "planes": pa.array([beta.tolist()], pa.list_(pa.list_(pa.float64())))})

    return moments(data, surface).groupBy("code").applyInArrow(told, "code long, planes array<array<double>>")


def gradients(data: DataFrame, weights: dict[int, tuple[list[int], np.ndarray]]) -> DataFrame:
    """code, p, sums (loss, gradient in raw weights) a task, for the penalties (numbers p, and a column of weights each) of each code."""
    shared = data.sparkSession.sparkContext.broadcast(weights)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for code, y, x in _by_cell(batches):
            w = shared.value[code][1]
            z = x @ w[:-1] + w[-1]
            rest = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[:, None]
            new = np.vstack((np.logaddexp(0.0, np.where(y[:, None] > 0, -z, z)).sum(axis=0), x.T @ rest, rest.sum(axis=0)))
            sums[code] = sums[code] + new if code in sums else new
        rows = [(c, p, np.ascontiguousarray(sums[c][:, k]).tobytes()) for c in sums for k, p in enumerate(shared.value[c][0])]
        code, p, told = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(p, pa.int32()), pa.array(told, pa.binary())], names=["code", "p", "sums"])

    return data.where(F.col("code").isin(*weights)).mapInArrow(add, "code long, p int, sums binary")


_STATE = "code long, p int, done boolean, weights binary, state binary"


def _told(code: int, p: int, now: Descent) -> pa.Table:
    row = [pa.array([code], pa.int64()), pa.array([p], pa.int32()), pa.array([now.done]), pa.array([now.weights().tobytes()], pa.binary()), pa.array([pickle.dumps(now)], pa.binary())]
    return pa.Table.from_arrays(row, names=["code", "p", "done", "weights", "state"])


def large_fits(rows: DataFrame, cell: list[str], l2: tuple[float, ...], surface: int = 0) -> DataFrame:
    """cell, fits (an array of l2, w, b) of all cells in rows (cell, y, vec), each fitted over all tasks; a cell with one class has no w."""
    # One row a cell, each of more than MAX_CELL numbers.
    names = written(rows.groupBy(*cell).agg(F.min("y").alias("_lo"), F.max("y").alias("_hi")).withColumn("code", F.monotonically_increasing_id()), "descent-cells")
    joined = rows.join(F.broadcast(names.withColumnsRenamed({c: f"_{c}" for c in cell})), same(cell))
    data = written(joined.where("_lo < _hi").select("code", F.col("y").cast("double").alias("y"), "vec"), "descent-rows")

    def begun(table: pa.Table) -> pa.Table:
        found, code = pickle.loads(table.column("moments")[0].as_py()), table.column("code")[0].as_py()
        return pa.concat_tables([_told(code, p, Descent(found, float(x))) for p, x in enumerate(l2)])

    def stepped(table: pa.Table) -> pa.Table:
        state, total = None, 0.0
        for told, sums in zip(table.column("state"), table.column("sums")):
            if told.is_valid:
                state = pickle.loads(told.as_py())
            else:
                total = total + np.frombuffer(sums.as_py(), dtype=float)
        state.told(float(total[0]), total[1:])
        return _told(table.column("code")[0].as_py(), table.column("p")[0].as_py(), state)

    states = written(moments(data, surface).groupBy("code").applyInArrow(begun, _STATE), "descent-state")
    for _ in range(PASSES):
        ahead = states.where("not done").select("code", "p", "weights").toPandas()
        if ahead.empty:
            break
        weights = {int(c): (g["p"].tolist(), np.stack([np.frombuffer(x) for x in g["weights"]], axis=1)) for c, g in ahead.groupby("code")}
        sums = gradients(data, weights).withColumn("state", F.lit(None).cast("binary"))
        both = sums.unionByName(states.where("not done").select("code", "p", F.lit(None).cast("binary").alias("sums"), "state"))
        states = written(both.groupBy("code", "p").applyInArrow(stepped, _STATE).unionByName(states.where("done")), "descent-state")

    def fits(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("p")
        each = [np.frombuffer(x) for x in table["weights"]]
        return pd.DataFrame({"code": table["code"].iloc[:1], "fits": [[{"l2": float(l2[p]), "w": w[:-1].tolist(), "b": float(w[-1])} for p, w in zip(table["p"], each)]]})

    kind = "array<struct<l2: double, w: array<double>, b: double>>"
    found = states.select("code", "p", "weights").groupBy("code").applyInPandas(fits, f"code long, fits {kind}")
    none = F.array(*[F.struct(F.lit(float(x)).alias("l2"), F.lit(None).cast("array<double>").alias("w"), F.lit(None).cast("double").alias("b")) for x in l2])
    return names.join(found, "code", "left").select(*cell, F.coalesce("fits", none).alias("fits"))


def same(cell: list[str]) -> Column:
    """The columns of cell equal those with an underscore before their names, NULLs too."""
    on = F.lit(True)
    for c in cell:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return on
