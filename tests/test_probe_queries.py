"""The queries that have no SQL, held against plain numpy over the collected stand-in tables."""

import hashlib
from itertools import groupby, product

import numpy as np
import pytest

from evalspark.plans import model_queries as M
from evalspark.plans import registry
from evalspark.plans import standins as S
from tests import oracle

CLASS_SETS = M.TARGETS


def area(y, s):
    y, s = np.asarray(y) > 0, np.asarray(s, dtype=float)
    if y.all() or not y.any():
        return None
    return float((s[y][:, None] > s[~y]).mean() + 0.5 * (s[y][:, None] == s[~y]).mean())


def fitted(x, y, l2):
    """Newton steps on the whole system, with intercept."""
    d = np.column_stack((x, np.ones(len(x))))
    penalty = np.append(np.full(x.shape[1], l2), 0.0)
    w = np.zeros(d.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -60, 60)))
        step = np.linalg.lstsq((d * (p * (1 - p))[:, None]).T @ d + np.diag(penalty + 1e-10), d.T @ (p - y) + penalty * w, rcond=None)[0]
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-11:
            break
    return w


def scores(train, test, l2, surface=0):
    """Scores of test rows under a probe fitted on train rows; both lists of dicts with x and y."""
    a, b = (np.array([r["x"] for r in rows], dtype=float) for rows in (train, test))
    y = np.array([r["y"] for r in train], dtype=float)
    if len(set(y)) < 2 or not len(test):
        return None
    if surface:
        s, t = (np.column_stack((np.ones(len(m)), m[:, -surface:])) for m in (a, b))
        beta = np.linalg.lstsq(s, a[:, :-surface], rcond=None)[0]
        a, b = a[:, :-surface] - s @ beta, b[:, :-surface] - t @ beta
    mean, sd = a.mean(axis=0), a.std(axis=0)
    sd = np.where(sd < 1e-6, 1.0, sd)
    w = fitted((a - mean) / sd, y, l2)
    return (b - mean) / sd @ w[:-1] + w[-1]


def of(rows, **wanted):
    return [r for r in rows if all(r[k] == v for k, v in wanted.items())]


def collected(df, *columns):
    return [{"x": [float(v) for v in r["vec"]], **{c: r[c] for c in columns}} for r in df.select(*columns, "vec").orderBy(*[c for c in columns if c != "y"]).collect()]


VECTOR_COLUMNS = ("item_id", "figure_id", "cls", "split", "fold", "position", "layer", "y")


@pytest.fixture(scope="module")
def vectors(spark):
    return collected(S.vectors(spark, oracle.SF), *VECTOR_COLUMNS)


def run(spark, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, oracle.SF).collect()]


def sweep(rows, surface=0, fit="train", on="val"):
    """(position, layer, l2) -> AUROC."""
    found = {}
    for position, layer in sorted({(r["position"], r["layer"]) for r in rows}):
        cell = of(rows, position=position, layer=layer)
        test = of(cell, split=on)
        for l2 in M.L2:
            s = scores(of(cell, split=fit), test, l2, surface)
            found[position, layer, l2] = None if s is None else area([r["y"] for r in test], s)
    return found


def best(curve):
    return min(curve, key=lambda k: (curve[k] is None, -(round(curve[k], 12) if curve[k] is not None else 0), k[0], k[2], k[1]))


def chosen_scores(rows, surface=0, on="test"):
    position, layer, l2 = best(sweep(rows, surface))
    cell = of(rows, position=position, layer=layer)
    test = of(cell, split=on)
    return test, scores(of(cell, split="train"), test, l2, surface)


def nested(rows, surface=0):
    """Scores of rows (of one position) by layer and outer fold: [(row, score, inner, layer)]."""
    found = []
    for layer, outer in product(sorted({r["layer"] for r in rows}), range(5)):
        cell = of(rows, layer=layer)
        known = [r for r in cell if r["y"] is not None and r["fold"] != outer]
        base = known
        if surface:
            x = np.array([r["x"] for r in known])
            s = np.column_stack((np.ones(len(x)), x[:, -surface:]))
            left = x[:, :-surface] - s @ np.linalg.lstsq(s, x[:, :-surface], rcond=None)[0]
            base = [dict(r, x=list(v)) for r, v in zip(known, left)]
        means = {}
        for l2 in M.L2:
            values = []
            for inner in sorted({r["fold"] for r in base}):
                test = [r for r in base if r["fold"] == inner]
                s = scores([r for r in base if r["fold"] != inner], test, l2)
                value = None if s is None else area([r["y"] for r in test], s)
                values += [] if value is None else [value]
            means[l2] = np.mean(values) if values else None
        l2 = min(M.L2, key=lambda p: (means[p] is None, -(round(means[p], 12) if means[p] is not None else 0), p))
        test = of(cell, fold=outer)
        s = scores(known, test, l2, surface)
        found += [(r, v, means[l2], layer) for r, v in zip(test, s if s is not None else [])]
    return found


def assembled(oof):
    layers = {}
    for r, _, inner, layer in oof:
        layers.setdefault(r["fold"], {})[layer] = inner
    top = {f: min(m, key=lambda k: (-round(m[k], 12), k)) for f, m in layers.items()}
    return [(r, v) for r, v, _, layer in oof if top[r["fold"]] == layer]


def labelled(rows, pos, neg):
    return [dict(r, y=1 if r["cls"] in pos else 0 if r["cls"] in neg else None) for r in rows]


def contrast(pairs, pos, neg):
    kept = [(r, v) for r, v in pairs if r["cls"] in (*pos, *neg)]
    return area([r["cls"] in pos for r, _ in kept], [v for _, v in kept])


def close(a, b):
    return (a is None) == (b is None) and (a is None or abs(a - b) < 2e-4)


def with_surface(rows):
    return [dict(r, x=r["x"] + [float(r["item_id"] % 7), float(r["item_id"] % 3)]) for r in rows]


@pytest.mark.parametrize("name, surface", [("layer_sweep", 0), ("residualised_sweep", 2)])
def test_sweeps(spark, vectors, name, surface):
    expected = sweep(with_surface(vectors) if surface else vectors, surface)
    got = {(r["position"], r["layer"], r["l2"]): r["auroc"] for r in run(spark, name)}
    assert got.keys() == expected.keys() and all(close(got[k], expected[k]) for k in got)


def test_selected_probe_on_test(spark, vectors):
    test, s = chosen_scores(vectors)
    (got,) = run(spark, "selected_probe_on_test")
    assert close(got["auroc"], area([r["y"] for r in test], s)) and got["lo"] <= got["auroc"] <= got["hi"] and got["n_pos"] + got["n_neg"] == len(test)


def test_target_sweeps(spark):
    rows = collected(S.target_vectors(spark, oracle.SF), *VECTOR_COLUMNS, "target")
    for got in run(spark, "target_sweeps"):
        one = of(rows, target=got["target"])
        curve = sweep(one)
        test, s = chosen_scores(one)
        assert (got["position"], got["layer"], got["l2"]) == best(curve) and close(got["val_auroc"], curve[best(curve)]) and close(got["test_auroc"], area([r["y"] for r in test], s))


def test_sanity_gate(spark, vectors):
    rows = [dict(r, y=int(r["x"][0] > (0.0 if r["position"] == "query_last" else 0.1))) for r in vectors]
    (got,) = run(spark, "sanity_gate")
    top = max(v for v in sweep(rows).values() if v is not None)
    assert close(got["best"], top) and got["passes"] == (top >= 0.9)


def test_cross_transfer(spark, vectors):
    got = run(spark, "cross_transfer")
    assert len(got) == 2 * 4 * 9
    for r in got:
        cell = [dict(x, y=int(x["cls"] == r["trained_on"])) for x in of(vectors, position=r["position"], layer=r["layer"])]
        test = of(cell, split="val")
        assert close(r["auroc"], area([x["cls"] == r["tested_on"] for x in test], scores(of(cell, split="train"), test, 10.0))) and not r["degenerate"]
    few = {(r["position"], r["layer"], r["trained_on"], r["tested_on"]): r for r in run(spark, "cross_transfer_of_errors")}
    assert len(few) == 2 * 4 * 4 and all(r["degenerate"] for r in few.values())
    for (position, layer, trained, tested), r in few.items():
        assert close(r["auroc"], few[position, layer, trained, trained]["auroc"] if trained == tested else 1 - few[position, layer, trained, trained]["auroc"])


def test_nested_probes(spark, vectors):
    oof = {p: nested(labelled(of(vectors, position=p), "S", "C")) for p in M.POSITIONS}
    for r in run(spark, "nested_type_probe"):
        assert close(r["auroc"], contrast(assembled(oof[r["position"]]), *CLASS_SETS[r["target"]])) and r["lo"] <= r["hi"]
    for r in run(spark, "auroc_by_layer"):
        kept = [(x["y"], v) for x, v, _, layer in oof[r["position"]] if layer == r["layer"] and x["y"] is not None]
        assert close(r["auroc"], area(*zip(*kept)))


def test_residualised_nested(spark, vectors):
    for r in run(spark, "residualised_nested"):
        oof = assembled(nested(with_surface(labelled(of(vectors, position=r["position"]), "S", "C")), 2))
        kept = [(x["y"], v) for x, v in oof if x["y"] is not None]
        assert close(r["auroc"], area(*zip(*kept)))


def test_controller_scores(spark, vectors):
    rows = of(vectors, position="query_last")
    sets = {"binary": ("SFZ", "CR"), "missing": ("FZR", "CS"), "misread": ("S", "C")}
    expected = {name: {r["item_id"]: v for r, v in assembled(nested(labelled(rows, *k)))} for name, k in sets.items()}
    got = run(spark, "controller_scores")
    assert len(got) == len({r["item_id"] for r in rows})
    assert all(abs(r[n] - expected[n][r["item_id"]]) < 1e-3 for r in got for n in sets)


def test_transfer_matrix(spark, vectors):
    import zlib

    half = lambda r: zlib.crc32(r["figure_id"].encode()) % 2
    for position, found in groupby(sorted(run(spark, "transfer_matrix"), key=lambda r: r["position"]), lambda r: r["position"]):
        rows = labelled(of(vectors, position=position), "S", "C")
        source, target = [r for r in rows if half(r) == 0 and r["y"] is not None], [r for r in rows if half(r) == 1]
        pooled = {}
        for layer, l2 in product(range(4), M.L2):
            cell, y, s = of(source, layer=layer), [], []
            for outer in range(5):
                test = of(cell, fold=outer)
                if (v := scores([r for r in cell if r["fold"] != outer], test, l2)) is not None:
                    y += [r["y"] for r in test]
                    s += list(v)
            pooled[l2, layer] = area(y, s)
        l2, layer = min(pooled, key=lambda k: (-round(pooled[k], 12), *k))
        test = of(target, layer=layer)
        pairs = list(zip(test, scores(of(source, layer=layer), test, l2)))
        assert all(close(r["auroc"], contrast(pairs, *CLASS_SETS[r["target"]])) for r in found)


def test_contrast_probes(spark, vectors):
    got = run(spark, "contrast_probes")
    assert got
    curves = {}
    for r in got:
        pos, neg = CLASS_SETS[r["contrast"]]
        if r["contrast"] not in curves:
            curves[r["contrast"]] = sweep([x for x in labelled(vectors, pos, neg) if x["y"] is not None])
        assert close(r["auroc"], curves[r["contrast"]][r["position"], r["layer"], r["l2"]])
    for r in run(spark, "vision_only_probes"):
        pos, neg = CLASS_SETS[r["contrast"]]
        test, s = chosen_scores([x for x in labelled(of(vectors, position="vision_mean"), pos, neg) if x["y"] is not None])
        assert close(r["auroc"], area([x["y"] for x in test], s))


def test_frozen_probe_elsewhere(spark, vectors):
    import zlib

    other = lambda r: zlib.crc32(r["figure_id"].encode()) % 4 == 0
    seen, extra = [r for r in vectors if not other(r)], [dict(r, split="extra") for r in vectors if other(r)]
    position, layer, l2 = best(sweep(seen))
    test = of(extra, position=position, layer=layer)
    s = scores(of(seen, position=position, layer=layer, split="train"), test, l2)
    (got,) = run(spark, "frozen_probe_elsewhere")
    assert close(got["auroc"], area([r["y"] for r in test], s))


def test_metadata_and_text_baselines(spark):
    for name, columns in (("metadata_baseline", S.METADATA), ("text_baseline", S.QUESTION_TEXT)):
        rows = collected(M._metadata_rows(spark, oracle.SF, list(columns)).withColumnRenamed("grid_offset", "g0").withColumnRenamed("ten_offset", "g1").withColumnRenamed("rel_grid_offset", "g2").withColumnRenamed("rel_ten_offset", "g3"), "item_id", "figure_id", "fold", "layer", "y", "g0", "g1", "g2", "g3")
        for r in run(spark, name):
            one = [dict(x, x=x["x"] + [x["g0"], x["g1"], x["g2"], x["g3"]]) for x in rows] if r.get("kind") == "metadata_and_grid" else rows
            oof = nested(one)
            # Rows with the same features tie; sums that differ in their last bits may part them.
            assert abs(r["auroc"] - area([x["y"] for x, *_ in oof], [round(v, 9) for _, v, *_ in oof])) < 2e-3


def test_calibrated_probe(spark, vectors):
    val, s = chosen_scores(vectors, on="val")
    w = fitted(np.array(s)[:, None], np.array([r["y"] for r in val], dtype=float), 1e-6)
    test, t = chosen_scores(vectors)
    p, y = 1 / (1 + np.exp(-(w[0] * np.array(t) + w[1]))), np.array([r["y"] for r in test])
    (got,) = run(spark, "platt_calibration")
    bins = np.minimum((p * 10).astype(int), 9)
    ece = sum(abs(p[bins == k].sum() - y[bins == k].sum()) for k in range(10)) / len(p)
    assert close(got["brier"], ((p - y) ** 2).mean()) and close(got["mean_p"], p.mean()) and close(got["base_rate"], y.mean()) and close(got["ece"], ece)


def test_seeds_summary(spark, vectors):
    def split(figure, seed):
        share = int(hashlib.sha1(f"{seed}\x1f{figure}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
        return "test" if share < 0.2 else "val" if share < 0.4 else "train"

    got = {r["variant"]: r for r in run(spark, "seeds_summary")}
    main = of(vectors, position="query_last")
    for variant, surface in (("plain", 0), ("residualised", 2), ("extra_training", 0)):
        values = []
        for seed in M.SEEDS:
            rows = [dict(r, split=split(r["figure_id"], seed)) for r in (with_surface(main) if surface else main)]
            if variant == "extra_training":
                rows += [dict(r, position="query_last", split="train") for r in of(vectors, position="vision_mean") if split(r["figure_id"], seed) == "train"]
            test, s = chosen_scores(rows, surface)
            values.append(area([r["y"] for r in test], s))
        assert close(got[variant]["mean"], np.mean(values)) and close(got[variant]["sd"], np.std(values, ddof=1)) and close(got[variant]["min"], min(values)) and close(got[variant]["max"], max(values))


def test_surface_baseline(spark):
    from pyspark.sql import functions as F

    from evalspark.functions.ids import figure_split
    from evalspark.operators import features

    rows = S.answers(spark, oracle.SF).select("item_id", "figure_id", (~F.col("correct")).cast("int").alias("y"), *features.surface_columns())
    rows = rows.withColumn("split", figure_split(F.col("figure_id"))).withColumn("position", F.lit("surface")).withColumn("layer", F.lit(0)).withColumn("vec", F.array("is_human", "question_length", "vision_tokens", "numeric_gold"))
    test, s = chosen_scores(collected(rows, "item_id", "figure_id", "split", "position", "layer", "y"))
    (got,) = run(spark, "surface_baseline")
    assert close(got["auroc"], area([r["y"] for r in test], np.round(s, 9)))


def test_policy_report(spark):
    """Risks and areas of the policies against the curve laid out row by row; the intervals hold the areas."""
    from evalspark.operators import policy

    rows = policy.policies(S.controller_items(spark, oracle.SF)).collect()
    areas = {}
    for r in run(spark, "policy_report"):
        mine = sorted(((x["conf"], x["ok"]) for x in rows if x["policy"] == r["policy"]), reverse=True)
        risks, before, wrong = [], 0, 0
        for _, tie in groupby(mine, lambda x: x[0]):
            tie = list(tie)
            e = sum(not ok for _, ok in tie)
            risks += [(wrong + i * e / len(tie)) / (before + i) for i in range(1, len(tie) + 1)]
            before, wrong = before + len(tie), wrong + e
        areas[r["policy"]] = np.mean(risks)
        assert r["aurc"] == pytest.approx(np.mean(risks), abs=6e-4) and r["lo"] - 1e-3 <= r["aurc"] <= r["hi"] + 1e-3
        assert all(r[f"risk_{c}"] == pytest.approx(risks[max(1, round(c / 100 * len(risks))) - 1], abs=6e-4) for c in (100, 80, 50))
    for r in run(spark, "ablation_differences"):
        assert r["difference"] == pytest.approx(areas[r["one"]] - areas[r["other"]], abs=1e-6) and r["lo"] <= r["hi"]
