"""Draws by the splitting tree: against exact distributions, a plain replay, and the weights as rows."""

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators import bootstrap, multinomial


def plain_scrambled(x):
    for _ in range(2):
        x = ((x >> 16) ^ x) * 0x45D9F3B % 2**32
    return (x >> 16) ^ x


def plain_multinomial(counts, b, seed):
    """Replicate b's counts, one uniform number and one sum of exact probabilities after the other."""
    ranges = 1
    while ranges < len(counts):
        ranges *= 2
    counts = counts + [0] * (ranges - len(counts))

    def split(node, low, high, n):
        if high - low == 1:
            return [n]
        mid = (low + high) // 2
        left, total = sum(counts[low:mid]), sum(counts[low:high])
        if not total or left in (0, total):
            k = n if total and left == total else 0
        else:
            p, k, rest, told = Fraction(left, total), 0, n, 0
            stream = plain_scrambled(plain_scrambled(plain_scrambled(seed) ^ node) ^ b)
            while rest:
                size = next((s for s in (1 << 12, 64) if s <= rest), rest)
                u, below, i = plain_scrambled(stream ^ told), Fraction(0), 0
                while True:
                    below += math.comb(size, i) * p**i * (1 - p) ** (size - i)
                    if u < math.floor(below * 2**32) or i == size:
                        break
                    i += 1
                k, rest, told = k + i, rest - size, told + 1
        return split(2 * node, low, mid, k) + split(2 * node + 1, mid, high, n - k)

    return split(1, 0, ranges, sum(counts))


@pytest.mark.parametrize("counts", [[3, 0, 5, 100, 7], [1], [0, 0, 4], [40, 41], [1] * 33])
def test_multinomial_is_replayed(counts):
    got = multinomial.multinomial(np.array(counts), 12, 42)
    for b in range(12):
        assert got[:, b].tolist() == plain_multinomial(counts, b, 42)[: len(counts)]


def test_large_sizes():
    """Sizes of 4,096 and more: moments, and the replay of one."""
    key = multinomial.node_key(7, 3)
    got = multinomial.binomial(np.full(4000, 10**7 + 123), 0.3, key)
    assert abs(got.mean() - 0.3 * (10**7 + 123)) < 5 * math.sqrt(2.1e6 / 4000) and abs(got.std() / math.sqrt(2.1e6) - 1) < 0.05
    assert multinomial.multinomial(np.array([3000, 2000]), 2, 5)[:, 1].tolist() == plain_multinomial([3000, 2000], 1, 5)


def test_binomials_have_their_distribution():
    got = np.bincount(multinomial.binomial(np.full(200_000, 9), 0.3, multinomial.node_key(1, 1)), minlength=10)
    want = np.array([math.comb(9, k) * 0.3**k * 0.7 ** (9 - k) for k in range(10)]) * 200_000
    assert (((got - want) ** 2 / want)[want > 5]).sum() < 30
    counts = np.array([5, 1, 4, 10])
    drawn = multinomial.multinomial(counts, 50_000, 3)
    share = counts / 20
    assert np.allclose(np.cov(drawn), 20 * (np.diag(share) - np.outer(share, share)), atol=0.15) and (drawn.sum(axis=0) == 20).all()


def test_a_large_range_is_split_down_to_its_places():
    tree = multinomial.Tree(np.array([1000, 30]), 300, 9)
    found, at = [], 0
    while at < 1000:
        first, w = tree.leaf(0, at)
        assert first == at and len(w) <= multinomial.LEAF
        found.append(w)
        at += len(w)
    whole = np.concatenate(found)
    assert (whole.sum(axis=0) == tree.totals[0]).all() and abs(whole.var() - 1) < 0.02
    assert (tree.leaf(0, 500)[1] == multinomial.Tree(np.array([1000, 30]), 300, 9).leaf(0, 500)[1]).all()


@pytest.fixture(scope="module")
def rows(spark):
    """Two hundred groups and a NULL one, two keys and a NULL one, ties; the scores of one key lie in a span that the others skip."""
    data = []
    for i in range(1500):
        key = ("wide", "narrow", None)[i % 3]
        score = float(i * 7 % 50) if key != "narrow" else 10 + (i * 7 % 400) / 1000
        data.append((None if i % 97 == 0 else f"g{i * 13 % 200}", key, score, (i * i // 7) % 3 == 0, float(i % 11)))
    return spark.createDataFrame(data, "g string, key string, s double, y boolean, x double")


def by_replicate(rows, draws):
    """b -> rows with weights, from the weights as rows."""
    weight = {(r["g"], r["b"]): r["w"] for r in bootstrap.weights(rows, "g", draws).collect()}
    assert len({g for g, _ in weight}) == 201
    kept = rows.collect()
    for b in range(draws):
        assert sum(weight.get((g, b), 0) for g in {r["g"] for r in kept}) == 201
        yield b, [(r, weight.get((r["g"], b), 0)) for r in kept]


def test_replicates(spark, rows):
    draws = 30
    got = {(r["key"], r["b"]): (r["x"], r["one"]) for r in bootstrap.replicates(rows.withColumn("one", F.lit(1)), "g", ["x", "one"], draws, keys=["key"]).collect()}
    for b, each in by_replicate(rows, draws):
        for key in ("wide", "narrow", None):
            mine = [(r["x"] * w, w) for r, w in each if r["key"] == key]
            assert got[key, b] == pytest.approx((sum(v for v, _ in mine), sum(w for _, w in mine)))
    whole = bootstrap.replicates(rows.repartition(7), "g", ["x"], draws).collect()
    assert sorted(r["b"] for r in whole) == list(range(draws))


def test_weighted_areas(spark, rows, monkeypatch):
    draws = 12
    area = {(r["key"], r["b"]): r["value"] for r in bootstrap.weighted_auroc(rows, "g", "s", F.col("y"), draws, keys=["key"]).collect()}
    risk = {(r["key"], r["b"]): r["value"] for r in bootstrap.weighted_aurc(rows, "g", "y", "s", draws, keys=["key"]).collect()}
    for b, each in by_replicate(rows, draws):
        for key in ("wide", "narrow", None):
            ties = defaultdict(lambda: [0, 0])
            for r, w in each:
                if r["key"] == key:
                    ties[r["s"]][not r["y"]] += w
            pairs, neg, pos = 0.0, 0, 0
            for s in sorted(ties):
                pairs += ties[s][0] * (neg + ties[s][1] / 2)
                neg, pos = neg + ties[s][1], pos + ties[s][0]
            assert area[key, b] == pytest.approx(pairs / (pos * neg))
            total, before, wrong = 0.0, 0, 0
            for s in sorted(ties, reverse=True):
                g, e = sum(ties[s]), ties[s][1]
                total += sum((wrong + i * e / g) / (before + i) for i in range(1, g + 1))
                before, wrong = before + g, wrong + e
            assert risk[key, b] == pytest.approx(total / before)


def test_no_rows(spark, rows):
    none = rows.limit(0)
    assert bootstrap.replicates(none, "g", ["x"], 5, keys=["key"]).count() == 0
    assert bootstrap.weighted_auroc(none, "g", "s", F.col("y"), 5, keys=["key"]).count() == 0
    assert bootstrap.cell_replicates(none.groupBy("key").count(), ["key"], "count", 5).count() == 0


def test_cells_are_drawn_in_proportion(spark):
    cells = spark.createDataFrame([("a", "x", 30), ("a", None, 10), ("b", "x", 60)], "k string, l string, n long")
    got = bootstrap.cell_replicates(cells, ["k", "l"], "n", 400).toPandas()
    assert (got.groupby("b")["n"].sum() == 100).all() and len(got) == 1200
    assert abs(got[got["k"] == "b"]["n"].mean() - 60) < 1.5


def test_no_draw_is_a_row(spark, rows):
    """What leaves a task is a total for a block of replicates: no plan has a row for each draw."""
    plan = bootstrap.replicates(rows, "g", ["x"], 2000)._jdf.queryExecution().toString()
    assert "Range" not in plan and "Generate" not in plan and "Join" not in plan
