import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators import answers as A
from evalspark.operators import bootstrap, features, metrics, outcomes, policy, probes, quality
from evalspark.operators import labels as L
from evalspark.sources import tables


def one(df):
    return df.first().asDict()


def test_error_report(spark):
    answers = spark.createDataFrame([("a", "human", "43", "0.43", False), ("b", "human", "x", "y", False), ("c", "augmented", "1", "2", False), ("d", "augmented", "1", "1", True)], "item_id string, source string, gold string, prediction string, correct boolean")
    labels = spark.createDataFrame([("a", "not_an_error", "valid_reading", 1), ("b", "ambiguous", "gold_error", 2), ("c", "structural", None, 3)], "item_id string, label string, reason string, seq long")
    got = {r["source"]: r.asDict() for r in A.error_report(answers, labels).collect()}
    assert (got["human"]["errors"], got["augmented"]["real_errors"], got["human"]["gold_wrong"], got["human"]["rescaled"]) == (2, 1, 1, 1)
    assert one(A.accuracies(answers, labels)) == {"relaxed": 0.25, "rescaled_right": 0.5, "not_an_error_right": 0.5}


def test_last_label_wins(spark):
    rows = spark.createDataFrame([("a", "structural", 1), ("a", "not_an_error", 2), ("b", "computation", 1)], "item_id string, label string, seq long")
    assert {tuple(r)[:2] for r in L.last_labels(rows, ["item_id"]).select("item_id", "label").collect()} == {("a", "not_an_error"), ("b", "computation")}


def ratings(spark, votes):
    return spark.createDataFrame([(f"r{k}", i, {"S": "structural", "F": "fabrication"}[v]) for i, vs in enumerate(votes) for k, v in enumerate(vs)], "rater string, item_id int, label string")


@pytest.mark.parametrize("votes, expected", [(["SSS", "SSF", "FF", "SF"], 19 / 144), (["SSS", "FFF"], 1.0), (["FF"] * 4, None), (["F", "S"], None)])
def test_fleiss(spark, votes, expected):
    got = one(L.fleiss_kappa(ratings(spark, votes)))["kappa"]
    assert got is None if expected is None else got == pytest.approx(expected)


def test_majority(spark):
    got = {r["item_id"]: (r["label"], r["tie"]) for r in L.majority(ratings(spark, ["SSF", "SF"])).collect()}
    assert got == {0: ("structural", False), 1: ("ambiguous", True)}


def test_kappa_of_identical_and_empty(spark):
    same = spark.createDataFrame([("S", "S", 90), ("F", "F", 10)], "a string, b string, n long")
    assert one(L.kappa_of_cells(same, [], "a", "b"))["kappa"] == 1.0
    assert spark.range(1).select(L.kappa(F.lit(0), F.lit(0), F.lit(0)).alias("k")).first()["k"] == 1.0


def test_allocation(spark):
    def take(counts, n, floor):
        rows = spark.createDataFrame([(str(i), k) for i, k in enumerate(counts)], "label string, k long")
        return [r["take"] for r in L.allocate(rows, n, floor).orderBy("label").collect()]

    got = take([80, 60, 33, 2], 50, 4)
    assert sum(got) == 50 and got[3] == 2
    assert take([495, 5], 50, 3)[1] == 3
    with pytest.raises(Exception, match="can't draw"):
        take([3, 4], 10, 1)


def test_water_fill():
    assert L.water_fill({"x": 4, "y": 1, "z": 1}, 6) == {"x": 0, "y": 3, "z": 3}
    assert L.water_fill({"p": 2, "q": 2}, 3) == {"p": 2, "q": 1}


@pytest.mark.parametrize("y, s, expected", [([0, 0, 1, 1], [1, 2, 3, 4], 1.0), ([1, 1, 0, 0], [1, 2, 3, 4], 0.0), ([0, 1, 0, 1], [5, 5, 5, 5], 0.5), ([1, 1], [1, 2], None)])
def test_auroc(spark, y, s, expected):
    rows = spark.createDataFrame(list(zip(y, s)), "y int, s int")
    assert one(metrics.auroc(rows, "s", F.col("y") == 1))["auroc"] == expected


def test_auroc_by_pairs(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 400), rng.integers(0, 30, 400)
    pairs = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
    for parts in (1, 7):
        rows = spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "y int, s int").repartition(parts)
        assert one(metrics.auroc(rows, "s", F.col("y") == 1))["auroc"] == pytest.approx(pairs)


def test_auroc_of_a_key_with_a_narrow_span(spark):
    """A million scores of one key between two neighbouring scores of another, and a NULL key: ranges are cut within the key."""
    i = F.col("id")
    narrow = spark.range(1_000_000).select(F.lit("narrow").alias("k"), (1 + (i * 7919 % 1_000_003) / 1e9).alias("s"), (i % 3 == 0).alias("y"))
    wide = spark.range(1000).select(F.when(i % 2 == 0, "wide").alias("k"), (i / 2).cast("double").alias("s"), (i % 5 < 2).alias("y"))
    rows = narrow.union(wide)
    cut, _ = metrics.ranged(rows.groupBy("k", "s").count().repartition(8), ["k"], "s")
    sizes = [r["count"] for r in cut.groupBy("_part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 600_000
    got = {r["k"]: r["auroc"] for r in metrics.auroc(rows, "s", F.col("y"), ["k"]).collect()}
    for key in ("narrow", "wide", None):
        frame = rows.where(F.col("k").eqNullSafe(F.lit(key))).toPandas()
        assert got[key] == pytest.approx(probes.area(frame["y"].to_numpy().astype(int), frame["s"].to_numpy()))


def test_risk_coverage(spark):
    rows = lambda conf: spark.createDataFrame(list(zip([True, True, True, False], conf)), "ok boolean, conf int")
    curve = lambda conf: [r["risk"] for r in metrics.risk_coverage(rows(conf), "ok", "conf").orderBy("k").collect()]
    assert curve([7, 7, 7, 7]) == [0.25] * 4
    assert curve([3, 3, 1, 1]) == pytest.approx([0, 0, 1 / 6, 1 / 4])
    got = one(metrics.aurc(metrics.stretches(rows([3, 3, 1, 1]), "ok", "conf")))
    assert (got["aurc"], got["risk_50"], got["risk_100"]) == (pytest.approx(5 / 48), 0.0, 0.25)


def test_a_tie_of_a_million_rows(spark):
    rows = spark.range(1_000_000).select((F.col("id") % 8 != 0).alias("ok"), F.when(F.col("id") < 100, 1).otherwise(0).alias("conf"))
    got = one(metrics.aurc(metrics.stretches(rows, "ok", "conf")))
    k = np.arange(1, 1_000_001)
    risk = np.where(k <= 100, 0.13, (13 + (k - 100) * (125_000 - 13) / 999_900) / k)
    assert got["aurc"] == pytest.approx(risk.mean(), rel=1e-9) and got["risk_50"] == pytest.approx(risk[499_999])
    assert metrics.risk_coverage(rows, "ok", "conf").count() == 1_000_000


@pytest.mark.parametrize("low, g", [(0, 1), (0, 5), (3, 100), (63, 2), (64, 1), (65, 1), (500, 20_000), (10**9, 3)])
def test_harmonic_differences(spark, low, g):
    got = spark.range(1).select(metrics.harmonic_difference(F.lit(low).cast("long"), F.lit(g).cast("long"))).first()[0]
    assert got == pytest.approx(sum(1.0 / i for i in range(low + 1, low + g + 1)), rel=1e-11)


def test_absent_names_of_a_large_vocabulary(spark):
    """Each name may be the one: those shown are passed over, however many names there are."""
    import hashlib

    names = [f"n{i}" for i in range(20_000)]
    circle = sorted(names, key=lambda n: hashlib.sha1(n.encode()).hexdigest())
    place = {n: k for k, n in enumerate(circle)}
    points, expected = [], {}
    for f in range(30):
        start = int(hashlib.sha1(f"42/f{f}".encode()).hexdigest()[:8], 16) % len(circle)
        points += [(f"f{f}", circle[(start + k) % len(circle)]) for k in range(f)] + [(f"f{f}", "another"), (f"f{f}", circle[(start + 500) % len(circle)])]
        expected[f"f{f}"] = circle[(start + f) % len(circle)]
    got = features.absent_names(spark.createDataFrame(points, "figure_id string, category string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert {r["figure_id"]: r["absent"] for r in got.collect()} == expected and len(place) == 20_000
    every = spark.createDataFrame([("f", "a"), ("f", "b")], "figure_id string, category string")
    assert features.absent_names(every, spark.createDataFrame([("a",), ("b",)], "name string")).count() == 0


def outcome_rows(spark, rows):
    return spark.createDataFrame(rows, "failure_type string, intervention string, recovered boolean")


def test_recovery_and_contrast(spark):
    rows = [("structural", "I_0", k < 1) for k in range(5)] + [("structural", "I_crop", k < 3) for k in range(5)] + [("fabrication", "I_0", k < 1) for k in range(10)] + [("fabrication", "I_crop", k < 2) for k in range(10)]
    assert one(outcomes.difference_in_differences(outcome_rows(spark, rows), "I_crop"))["delta"] == pytest.approx(0.3)
    with pytest.raises(ValueError):
        outcomes.difference_in_differences(outcome_rows(spark, rows), "I_abstain")
    best = {r["failure_type"]: r["best"] for r in outcomes.best_repairs(outcome_rows(spark, rows)).collect()}
    assert best == {"structural": "I_crop", "fabrication": "I_crop"}


def test_universe_refuses_missing_outcomes(spark):
    rows = spark.createDataFrame([("a", i, True, True) for i in ("I_0", "I_reask", "I_upsample", "I_crop")], "item_id string, intervention string, recovered boolean, applicable boolean")
    with pytest.raises(Exception, match="missing"):
        outcomes.universe(spark.createDataFrame([("a",)], "item_id string"), rows).collect()


def test_grid_features(spark):
    rows = [(c, ["D", "E", "F"], [12, 40, 71], 0, 100, "sparse") for c in ("D", "E", "F", "Y")]
    got = features.grid_features(spark.createDataFrame(rows, "asks_about string, categories array<string>, values array<int>, axis_min int, axis_max int, tick_density string"))
    table = [[r[n] for n in features.GRID_FEATURES] for r in got.orderBy("asks_about").collect()]
    assert np.allclose(table, [[0.4, 0.2, 8 / 12, 2 / 12], [0, 0, 0, 0], [0.45, 0.1, 9 / 71, 1 / 71], [0, 0, 0, 0]])


def vectors(spark, layers=(0, 3, 7), signal=7, n=240, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(rng.integers(0, 2))
        split = ("train", "train", "val", "test")[i % 4]
        for layer in layers:
            v = rng.normal(size=6)
            if layer == signal:
                v[0] += 2.5 * y
            rows.append((f"i{i}", f"f{i // 2}", split, i % 5, "C" if y else "S", y, layer, "query_last", v.tolist()))
    return spark.createDataFrame(rows, "item_id string, figure_id string, split string, fold int, cls string, y int, layer int, position string, vec array<double>")


def test_planted_layer_is_found(spark):
    rows = vectors(spark)
    curve = probes.layer_sweep(rows, (1.0, 10.0))
    choice = probes.selected(curve)
    assert choice.first()["layer"] == 7
    assert one(metrics.auroc(probes.test_scores(rows, choice), "score", F.col("y") == 1))["auroc"] > 0.85
    poisoned = rows.withColumn("vec", F.when(F.col("split") == "test", F.transform("vec", lambda x: x * 1e6)).otherwise(F.col("vec")))
    assert sorted(map(tuple, probes.layer_sweep(poisoned, (1.0, 10.0)).collect())) == sorted(map(tuple, curve.collect()))


def test_fits_in_tasks_and_over_tasks_agree(spark, monkeypatch):
    rows = vectors(spark, layers=(7,))
    oof = probes.assembled(probes.nested_cv(rows, (1.0,)))
    assert oof.count() == 240 and one(metrics.auroc(oof, "score", F.col("y") == 1))["auroc"] > 0.85
    train, rest = rows.where("split = 'train'"), rows.where("split <> 'train'")
    for surface in (0, 2):
        small = {(r["item_id"], r["l2"]): r["score"] for r in probes.scored(rest, probes.fits(train, ["layer"], (1.0, 10.0), surface), ["layer"], ["item_id"]).collect()}
        monkeypatch.setattr(probes, "MAX_CELL", 10)
        large = {(r["item_id"], r["l2"]): r["score"] for r in probes.scored(rest, probes.fits(train, ["layer"], (1.0, 10.0), surface), ["layer"], ["item_id"]).collect()}
        again = {r["item_id"]: r["score"] for r in probes.nested_cv(rows, (1.0,), folds=2, surface=surface).collect()} if surface else None
        monkeypatch.undo()
        assert max(abs(small[k] - large[k]) for k in small) < 1e-4 and small.keys() == large.keys()
        if again:
            grouped = {r["item_id"]: r["score"] for r in probes.nested_cv(rows, (1.0,), folds=2, surface=surface).collect()}
            assert max(abs(again[k] - grouped[k]) for k in grouped) < 1e-4


@pytest.mark.parametrize("surface", [0, 2])
def test_a_descent_reaches_the_fit_of_a_task(surface):
    """Penalties from 1 to 10,000 on badly scaled columns: the weights of Newton's method, in fewer passes than PASSES."""
    from evalspark.operators import descent

    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 12)) * 10.0 ** np.append(rng.integers(-3, 4, 10), [0, 1]) + rng.normal(size=12) * np.append(np.full(10, 50), [3, 3])
    y = (x[:, 0] / x[:, 0].std() + rng.normal(size=400) > x[:, 0].mean() / x[:, 0].std()).astype(float)
    base = np.column_stack((np.ones(400), x[:, 12 - surface :]))
    for l2 in (1.0, 100.0, 10_000.0):
        now = descent.Descent(descent.Moments(400.0, y.sum(), base.T @ x, (x * x).sum(axis=0)), l2)
        for passes in range(descent.PASSES):
            if now.done:
                break
            w = now.weights()
            z = x @ w[:-1] + w[-1]
            rest = 1 / (1 + np.exp(-z)) - y
            now.told(float(np.logaddexp(0, np.where(y > 0, -z, z)).sum()), np.append(x.T @ rest, rest.sum()))
        w, b = probes.Cell(x, y, surface).fit(l2)
        assert passes < 120 and np.abs(x @ (now.weights()[:-1] - w) + now.weights()[-1] - b).max() < 1e-5


@pytest.mark.parametrize("surface", [0, 2])
def test_a_row_that_counts_n_times_is_n_rows(surface):
    rng = np.random.default_rng(9)
    x, y, n = rng.integers(0, 4, (60, 6)).astype("float32"), rng.integers(0, 2, 60).astype(float), rng.integers(1, 9, 60)
    w, b = probes.Cell(x, y, surface, n.astype(float)).fit(2.0)
    each = np.repeat(np.arange(60), n)
    v, c = probes.Cell(x[each], y[each], surface).fit(2.0)
    assert np.abs(w - v).max() < 1e-6 and abs(b - c) < 1e-6
    s = np.round(x @ w, 2)
    assert probes.area(y, s, n.astype(float)) == pytest.approx(probes.area(y[each], s[each]), abs=1e-12)


def test_tasks_get_equal_rows_once(spark, monkeypatch):
    """Cells of few vectors that come often never are too large for a task, and their fits are those of all rows."""
    rows = spark.range(2000).select(F.col("id").alias("item_id"), F.lit("f").alias("figure_id"), F.lit("-").alias("cls"), F.lit(0).alias("layer"), (F.col("id") % 5).alias("fold"), ((F.col("id") * 7919 % 11) < F.col("id") % 4 * 2 + 2).cast("int").alias("y"), F.array((F.col("id") % 4).cast("double"), (F.col("id") % 3).cast("double")).alias("vec"))
    told = lambda df: {r["item_id"]: (r["l2"], r["score"]) for r in df.collect()}
    want = told(probes.nested_cv(rows, (1.0, 100.0))), told(probes.scored(rows, probes.fits(rows, ["layer"], (1.0,)), ["layer"], ["item_id"]))

    def refused(*_):
        raise AssertionError("a cell went over tasks")

    monkeypatch.setattr(probes, "large_fits", refused)
    monkeypatch.setattr(probes, "MAX_CELL", 2000)
    got = told(probes.nested_cv(rows, (1.0, 100.0), repeats=True)), told(probes.scored(rows, probes.fits(rows, ["layer"], (1.0,), repeats=True), ["layer"], ["item_id"]))
    for g, w in zip(got, want):
        assert len(w) == 2000 and all(g[k][0] == w[k][0] and abs(g[k][1] - w[k][1]) < 1e-6 for k in w)


def test_a_fit_holds_one_copy_of_its_rows():
    import tracemalloc

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(300_000, 16)), rng.integers(0, 2, 300_000).astype(float)
    tracemalloc.start()
    probes.Cell(x, y).fit(1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak / len(x) < 8 * 17 + 8 * 20


@pytest.mark.parametrize("surface", [0, 2])
def test_a_fit_copies_no_rows(surface):
    """What a fit and a choice over inner folds hold besides the rows is a few numbers a row, however wide these are."""
    import tracemalloc

    rng = np.random.default_rng(4)
    x, fold = rng.normal(size=(300_000, 18)).astype("float32"), rng.integers(0, 4, 300_000)
    y, n = (x[:, 0] + rng.normal(size=300_000) > 0).astype(float), np.ones(300_000)
    for what, numbers in ((lambda: probes.Cell(x, y, surface, n).fit(1.0), 4), (lambda: probes._best(x, y, n, fold, (1.0,), surface), 8)):
        tracemalloc.start()
        what()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak / len(x) < 8 * numbers


def test_a_fold_that_counts_no_times_is_left_out():
    """Narrow and wide rows, with a plane of all of them: the fits are those of the other folds' rows alone."""
    rng = np.random.default_rng(5)
    for size, width in ((90, 6), (30, 40)):
        x, y, out = rng.normal(size=(size, width)), rng.integers(0, 2, size).astype(float), np.arange(size) % 3 == 0
        beta = probes._plane(x, 2, np.ones(size))
        w, b = probes.Cell(x, y, 2, np.where(out, 0.0, 1.0), beta).fit(2.0)
        left = x[:, :-2] - np.column_stack((np.ones(size), x[:, -2:])) @ beta
        v, c = probes.Cell(left[~out], y[~out]).fit(2.0)
        assert np.abs(x @ w + b - left @ v - c).max() < 1e-8
        assert probes.Cell(x, out.astype(float), 2, np.where(out, 0.0, 1.0), beta).fit(2.0) is None


def test_fits_of_wide_cells_are_the_same_in_the_space_of_their_rows():
    rng = np.random.default_rng(6)
    for n, d in ((40, 300), (300, 40), (400, 700)):
        x, y = rng.normal(size=(n, d)), rng.integers(0, 2, n).astype(float)
        cell = probes.Cell(x, y)
        w, b = cell.fit(5.0)
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        design, v = np.column_stack((z, np.ones(n))), np.append(w * x.std(axis=0), b + x.mean(axis=0) @ w)
        p = 1 / (1 + np.exp(-design @ v))
        gradient = design.T @ (p - y) + np.append(5.0 * v[:-1], 0.0)
        assert np.abs(gradient).max() < 1e-4


def test_joins_refuse_other_figures_and_datasets_refuse_leaks(spark):
    v = spark.createDataFrame([("a", "f1", 0, [1.0]), ("b", "f2", 0, [2.0])], "item_id string, figure_id string, layer int, vec array<double>")
    good = spark.createDataFrame([("a", "f1", 1), ("c", "f9", 0)], "item_id string, figure_id string, y int")
    assert [(r["item_id"], r["y"]) for r in probes.join_vectors(v, good).collect()] == [("a", 1)]
    with pytest.raises(Exception, match="figures differ"):
        probes.join_vectors(v, good.withColumn("figure_id", F.lit("x"))).collect()
    leaky = spark.createDataFrame([("f1", "train"), ("f1", "test"), ("f2", "val")], "figure_id string, split string")
    with pytest.raises(ValueError, match="f1"):
        quality.require_no_leaks(leaky)
    assert quality.require_no_leaks(leaky.where("split <> 'test'")).count() == 2
    with pytest.raises(ValueError, match="figures are in both"):
        probes.frozen_scores(vectors(spark), vectors(spark), probes.selected(probes.layer_sweep(vectors(spark), (1.0,))))


def test_labels_are_appended_whole_or_not_at_all(spark, tmp_path):
    batch = spark.createDataFrame([("a",), ("b",)], "item_id string")
    labels = spark.createDataFrame([("a", "structural", None, "r"), ("b", "computation", None, "r")], "item_id string, label string, reason string, rationale string")
    path = str(tmp_path / "labels")
    with pytest.raises(ValueError, match="refused"):
        tables.append_labels(labels.where("item_id = 'a'"), batch, path)
    assert tables.append_labels(labels, batch, path) == 2
    with pytest.raises(ValueError, match="already"):
        tables.append_labels(labels, batch, path)
    assert spark.read.parquet(path).count() == 2


def test_kappa_refuses_labels_outside_the_categories(spark):
    cells = spark.createDataFrame([("S", "S", 5), ("S", "odd", 1)], "a string, b string, n long")
    assert one(L.kappa_of_cells(cells, [], "a", "b"))["n"] == 6
    with pytest.raises(Exception, match="none of the categories"):
        L.kappa_of_cells(cells, [], "a", "b", labels=("S", "F")).collect()


def test_residualising_removes_a_surface_signal(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(s := rng.normal()), [2 * s + 1, 0.1 * float(rng.normal())]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, s double, vec array<double>")
    got = features.residualised(df, "vec", ["s"], F.col("i") % 2 == 0)
    assert max(abs(r["vec"][0]) for r in got.collect()) < 1e-8


def test_residualising_by_key(spark):
    """Each key has planes of its own, fitted where told; NULL is a key; a key without fitted rows has none."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        k, s, t = ("a", "b", None)[i % 3], float(rng.normal()), float(rng.normal())
        slope = {"a": 2.0, "b": -1.0, None: 5.0}[k]
        rows.append((i, k, s, t, [slope * s + 1, 3.0 - t * slope, float(rng.normal())]))
    df = spark.createDataFrame(rows + [(999, "c", 1.0, 1.0, [1.0, 2.0, 3.0])], "i int, k string, s double, t double, vec array<double>")
    got = features.residualised(df, "vec", ["s", "t"], F.col("i") < 200, ["k"])
    assert got.columns == df.columns
    left = {r["i"]: r["vec"] for r in got.collect()}
    assert left.keys() == {r[0] for r in rows} | {999} and left[999] is None
    assert max(abs(x) for i, v in left.items() if i != 999 for x in v[:2]) < 1e-9
    plan = got._jdf.queryExecution().toString()
    assert "explode" not in plan


def test_pooling_keeps_vectors_whole(spark):
    """Tokens of an item in many tasks, NULL entries, an item without image tokens; no row for a number."""
    rng = np.random.default_rng(5)
    rows = [(f"i{k % 7}", k % 2, k, "text" if k % 7 == 3 or k % 5 == 0 else "image", [None if k % 11 == 0 and d == 2 else float(x) for d, x in enumerate(rng.normal(size=6))]) for k in range(700)]
    df = spark.createDataFrame(rows, "item_id string, layer int, pos int, kind string, vec array<double>").repartition(6)
    got = features.pooled(df)
    assert "explode" not in got._jdf.queryExecution().toString()
    found = {(r["item_id"], r["layer"], r["position"]): r["vec"] for r in got.collect()}
    assert len(found) == 7 * 2 * 4
    for item in {r[0] for r in rows}:
        for layer in (0, 1):
            mine = [r for r in rows if r[:2] == (item, layer)]
            of = {kind: np.array([r[4] for r in mine if r[3] == kind], dtype=float) for kind in ("image", "text")}
            want = {"query_last": mine[-1][4], "vision_mean": None, "vision_max": None, "query_mean": None}
            if len(of["image"]):
                want |= {"vision_mean": np.nanmean(of["image"], axis=0), "vision_max": np.nanmax(of["image"], axis=0)}
            if len(of["text"]):
                want["query_mean"] = np.nanmean(of["text"], axis=0)
            for position, vec in want.items():
                mine = found[item, layer, position]
                assert mine == [None] * 6 if vec is None else mine == pytest.approx([None if x is None or np.isnan(x) else x for x in vec])


def test_crossings_of_a_large_figure(spark):
    """20,000 short edges and some long ones in one figure: as a plain count says, from pairs that are near each other only."""
    rng = np.random.default_rng(2)
    k = 20_000
    start = rng.uniform(0, 1000, (k, 2)).round(3)
    end = start + rng.normal(0, 3, (k, 2)).round(3)
    end[:20] = rng.uniform(0, 1000, (20, 2))
    end[20:24] = start[20:24]
    rows = [(f, int(e), 2 * int(e), 2 * int(e) + 1, *map(float, (*start[e], *end[e]))) for f, n in (("large", k), ("small", 40), ("one", 1)) for e in range(n)]
    edges = spark.createDataFrame(rows, "figure_id string, eid int, a int, b int, ax double, ay double, bx double, by double").repartition(5)
    got = outcomes.edge_crossings(edges)
    found = {r["figure_id"]: r["crossings"] for r in got.collect()}

    def plain(n):
        p, q, total = start[:n], end[:n], 0
        side = lambda a, b, c: np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))
        for i in range(n - 1):
            c, d = p[i + 1 : n], q[i + 1 : n]
            a, b = np.broadcast_to(p[i], c.shape), np.broadcast_to(q[i], c.shape)
            total += int(((side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)).sum())
        return total

    assert found == {"large": plain(k), "small": plain(40)}


def test_crossings_of_figures_at_one_place(spark):
    """Figures whose nodes are all at one place, or have none, cross nowhere; that is no division by their size."""
    at = lambda x, y, k: (2 * k, 2 * k + 1, x, y, x, y)
    rows = [("point", e, *at(3, 4, e)) for e in range(9)] + [("nowhere", e, *at(None, None, e)) for e in range(9)]
    rows += [("point and line", 1, 0, 1, 5, 5, 5, 5), ("point and line", 2, 2, 3, 0, 5, 9, 5), ("cross", 1, 0, 1, 0, 0, 2, 2), ("cross", 2, 2, 3, 0, 2, 2, 0)]
    edges = spark.createDataFrame(rows, "figure_id string, eid int, a long, b long, ax long, ay long, bx long, by long")
    found = {r["figure_id"]: r["crossings"] for r in outcomes.edge_crossings(edges).collect()}
    assert found == {"point": 0, "nowhere": 0, "point and line": 0, "cross": 1}


@pytest.mark.parametrize("shares", [[0.0, 0.5, 1.0], [0.5 + 0.01 * i for i in range(51)]])
def test_quantiles_by_selection(spark, shares):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("k"), (F.col("id") * 7919 % 97 / 8).alias("v"))
    counted = rows.groupBy("k", "v").agg(F.count("*").alias("c"))
    got = metrics.quantile_rows(metrics.prefix_sums(counted, ["k"], "v", ["c"]), ["k"], "v", "c", shares, [])
    frame = rows.toPandas()
    want = {(k, i): np.quantile(frame["v"][frame["k"].isna() if k is None else frame["k"] == k], s) for k in ("a", "b", None) for i, s in enumerate(shares)}
    found = {(r["k"], r["place"]): r["cut"] for r in got.collect()}
    assert found.keys() == want.keys() and all(found[x] == pytest.approx(want[x]) for x in want)


def test_bucketed_vectors_stay_where_they_are(spark, tmp_path):
    """A join by item_id, and one of two such tables, move the other side alone; a position and layer are a folder."""
    rows = spark.range(2000).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("item_id"), F.lit("f").alias("figure_id"), F.lit("query_last").alias("position"), (F.col("id") % 4).cast("int").alias("layer"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
    path = str(tmp_path / "v")
    tables.write_bucketed(rows, path, 4)
    vectors = tables.open_bucketed(spark, path)
    assert sorted(map(str, vectors.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))
    answers = spark.range(0, 4000, 2).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("item_id"), (F.col("id") % 2).alias("y"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = probes.join_vectors(vectors, answers)._jdf.queryExecution().executedPlan().toString()
        twice = vectors.join(tables.open_bucketed(spark, path).select("item_id", F.col("vec").alias("w")), "item_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and "Range" in plan.split("Exchange")[1] and "Exchange" not in twice
    pruned = vectors.where("layer = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(layer" in pruned and vectors.where("layer = 2").count() == 500


def test_bootstrap_interval(spark):
    rows = spark.createDataFrame([(f"g{i}", float(i % 7)) for i in range(60)], "g string, x double")
    mean = F.sum(F.col("x") * F.col("w")) / F.sum("w")
    got = bootstrap.bootstrap(rows, "g", mean, 60)
    assert got.count() == 60
    span = one(bootstrap.interval(got, "value"))
    assert span["lo"] < 2.9 < span["hi"]
    again = bootstrap.bootstrap(rows.repartition(7), "g", mean, 60)
    assert sorted(round(r["value"], 9) for r in got.collect()) == sorted(round(r["value"], 9) for r in again.collect())


def controller_items(spark, n=200):
    rows = []
    for i in range(n):
        cls = "S" if i % 14 == 0 else "F" if i % 3 == 0 else "C"
        right = cls == "C"
        rows.append((f"i{i}", f"f{i}", cls, i % 5, 0.9 if not right else 0.1, 0.9 if cls == "F" else 0.1, 0.95 if cls == "S" else 0.05 + (i % 10) / 1000, right, right, right, right or cls == "S", right))
    return spark.createDataFrame(rows, "item_id string, figure_id string, cls string, fold int, binary double, missing double, misread double, I_0 boolean, I_reask boolean, I_upsample boolean, I_crop boolean, I_verify boolean")


def test_controller_policies(spark):
    items = controller_items(spark)
    rules = policy.relook_rules(items).collect()
    assert {r["repair"] for r in rules} == {"I_crop"} and len(rules) == 5
    final = policy.relooked(items, policy.relook_rules(items))
    assert final.where("cls = 'S' and not final").count() == 0
    area = {r["policy"]: r["aurc"] for r in policy.evaluate(items).collect()}
    assert area["oracle"] <= area["controller"] <= area["plain"] and area["controller"] < area["missing"]


def test_quality_checks(spark):
    figs = spark.createDataFrame([("p1", "easy", "train"), ("p1", "hard", "train"), ("p2", "easy", "train"), ("p2", "easy", "train"), ("p3", "easy", "train"), ("p3", "hard", "val")], "pair_id string, pair_variant string, split string")
    assert {r["pair_id"] for r in quality.check_pairs(figs).collect()} == {"p2", "p3"}
    batch = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    labels = spark.createDataFrame([("a", "structural", None, "r"), ("a", "odd", None, " "), ("b", "ambiguous", None, "r"), ("z", "structural", "other", "r")], "item_id string, label string, reason string, rationale string")
    got = sorted(map(tuple, quality.check_labels(labels, batch).collect()))
    assert got == sorted([("a", "unknown label"), ("a", "empty rationale"), ("b", "needs a reason"), ("z", "takes no reason"), ("c", "missing"), ("z", "unexpected"), ("a", "repeated")])


def test_sources(spark, tmp_path):
    (tmp_path / "test").mkdir()
    (tmp_path / "test" / "test_human.json").write_text('[{"imgname": "a.png", "query": "q", "label": 3}, {"imgname": "b.png", "query": "q", "label": "x"}]')
    got = tables.read_items(spark, str(tmp_path), ["test", "val"], ["human", "augmented"]).collect()
    assert [(r["figure_id"], r["gold"], r["split"], r["source"]) for r in got] == [("a.png", "3", "test", "human"), ("b.png", "x", "test", "human")]
    (tmp_path / "ann.jsonl").write_text('{"item_id": "1", "label": "structural"}\n\nbroken\n{"item_id": "2", "label": "other"}\n')
    ratings_, skipped = tables.read_ratings(spark, str(tmp_path))
    assert [(r["rater"], r["item_id"]) for r in ratings_.collect()] == [("ann", "1")] and skipped.first()["skipped"] == 2
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    target = str(tmp_path / "out")
    assert (tables.append_new(rows, target, ["k"]), tables.append_new(rows.union(rows.selectExpr("k + 1", "v")), target, ["k"])) == (2, 1)


def test_appending_to_a_large_table_takes_more_tasks(spark, tmp_path, monkeypatch):
    """No task sorts more rows, or about so many, than ROWS_A_TASK: the parts grow with the table."""
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100, raising=False)
    rows = spark.range(4000).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    target = str(tmp_path / "out")
    assert tables.append_new(rows.where("k % 4 = 0"), target, ["k"]) == 1000
    before = {r["f"] for r in spark.read.parquet(target).select(F.input_file_name().alias("f")).distinct().collect()}
    assert tables.append_new(rows, target, ["k"]) == 3000 and tables.append_new(rows, target, ["k"]) == 0
    added = spark.read.parquet(target).groupBy(F.input_file_name().alias("f")).count().collect()
    assert max(r["count"] for r in added if r["f"] not in before) <= 200
    assert sorted(r["k"] for r in spark.read.parquet(target).collect()) == list(range(4000))


def test_vector_table(spark, tmp_path):
    rows = spark.createDataFrame([("a", "f", 0, "query_last", [1.0]), ("a", "f", 1, "query_last", [2.0])], tables.VECTOR_SCHEMA)
    tables.write_vectors(rows, str(tmp_path / "v"))
    assert tables.scan_vectors(spark, str(tmp_path / "v"), "query_last", [1]).count() == 1
    with pytest.raises(ValueError):
        tables.scan_vectors(spark, str(tmp_path / "v"), "query_last", [5])
    with pytest.raises(ValueError):
        tables.merge_shards([rows, rows], rows.select("item_id").distinct())


def test_changed_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"one")
    (tmp_path / "b.bin").write_bytes(b"two")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.bin")).select(F.regexp_extract("path", "[^/]+$", 0).alias("path"), "content")
    manifest = spark.createDataFrame([("a.bin", hashlib.sha256(b"one").hexdigest()), ("b.bin", hashlib.sha256(b"2").hexdigest()), ("c.bin", "x")], "path string, sha256 string")
    assert {tuple(r) for r in quality.changed_files(files, manifest).collect()} == {("b.bin", "changed"), ("c.bin", "missing")}


def test_ablation_differences_has_three_pairs_and_their_differences(spark):
    from evalspark.operators import policy
    import __spark_entry__  # noqa: F401
    from evalspark.plans import score_queries, standins

    sf = "/root/testdata/sf0.001"
    aurc = {r["policy"]: r["aurc"] for r in policy.evaluate(standins.controller_items(spark, sf)).collect()}
    got = {(r["one"], r["other"]): r for r in score_queries.ablation_differences(spark, sf).collect()}
    assert set(got) == {("controller", "missing"), ("controller", "binary"), ("relook_binary", "binary")}
    assert all(abs(r["difference"] - (aurc[a] - aurc[b])) < 1e-12 and r["lo"] <= r["hi"] for (a, b), r in got.items())
