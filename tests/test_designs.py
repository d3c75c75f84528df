"""Many fits in two scans against numpy's least-norm solution of each full design with dummies."""

import math

import numpy as np
import pytest

from parlance.operators import designs, regress
from parlance.operators.designs import Design

PANEL = "g string, z string, y double, w double, a double, b double, c double, flat double, bylevel double"


def panel(seed=0, n=400, levels=7):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        g = int(rng.integers(levels))
        a, b = map(float, rng.normal(size=2))
        row = [f"g{g}", "one", 2 * a - b + g + float(rng.normal()) * (1 + abs(a)), a * a + float(rng.normal()), a, b, a - b, 5.0, float(g * g)]
        for k in (2, 4, 5):
            if rng.random() < 0.05:
                row[k] = None if rng.random() < 0.5 else math.nan
        rows.append(tuple([None if rng.random() < 0.03 else row[0], *row[1:]]))
    return rows


def full(rows, d, effect="g"):
    """coef, std_err, n, rank, r2 of the design with all its dummies, by the pseudo-inverse."""
    names = PANEL.replace(",", "").split()[::2]
    dicts = [dict(zip(names, r)) for r in rows]
    good = lambda v: v is not None and v == v
    dicts = [r for r in dicts if all(good(r[c]) for c in (d.y, effect, *d.xs))]
    levels = sorted({r[effect] for r in dicts})[1:]
    x = np.array([[1.0, *[r[c] for c in d.xs], *[float(r[effect] == v) for v in levels]] for r in dicts])
    y = np.array([r[d.y] for r in dicts])
    inv = np.linalg.pinv(x, rcond=1e-10)
    beta = inv @ y
    e, rank = y - x @ beta, int(np.linalg.matrix_rank(x, tol=1e-8))
    cov = (inv * (e * e)) @ inv.T * len(y) / (len(y) - rank)
    k = 1 + len(d.xs)
    return beta[:k], np.sqrt(np.diag(cov))[:k], len(y), rank, 1 - e @ e / ((y - y.mean()) @ (y - y.mean()))


CASES = [("a",), ("b", "a"), ("a", "b", "c"), ("c", "a", "b", "flat"), ("a", "bylevel"), ("bylevel", "flat"), ("flat",), ("a", "b", "c", "flat", "bylevel")]


@pytest.mark.parametrize("seed", (0, 1))
def test_all_designs_equal_the_full_ones(spark, seed):
    rows = panel(seed)
    df = spark.createDataFrame(rows, PANEL)
    wanted = [Design("s", y, xs) for xs in CASES for y in ("y", "w")]
    got = designs.fit_all(df, wanted, "g")
    assert [f.design for f in got] == wanted
    for f in got:
        coef, se, n, rank, r2 = full(rows, f.design)
        assert (f.n, f.rank) == (n, rank) and f.members == len(rows) and math.isclose(f.r2, r2, abs_tol=1e-9), f.design
        assert np.allclose(f.coef, coef, atol=1e-7) and np.allclose(f.std_err, se, atol=1e-7), (f.design, f.coef, coef, f.std_err, se)


def test_parts_one_level_and_nothing(spark):
    from pyspark.sql import functions as F

    rows = panel(2, 200)
    df = spark.createDataFrame(rows, PANEL)
    part = Design("p", "y", ("a", "b"), F.col("g").isin("g1", "g2", "g6"))
    one, none = Design("o", "y", ("a",)), Design("n", "y", ("a",), F.col("g") == "nowhere")
    f, = designs.fit_all(df, [none, part], "g")
    coef, se, *_ = full([r for r in rows if r[0] in ("g1", "g2", "g6")], part)
    assert np.allclose(f.coef, coef) and np.allclose(f.std_err, se) and f.members == sum(r[0] in ("g1", "g2", "g6") for r in rows)
    f, = designs.fit_all(df, [one], "z")
    assert np.allclose(f.coef, full(rows, one, "z")[0]) and f.rank == 2
    assert designs.fit_all(df.where("a > 1e9"), [one], "g") == []


def test_levels_in_a_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(designs, "MOST_BROADCAST", 0)
    rows = panel(3, 300, 60)
    f, = designs.fit_all(spark.createDataFrame(rows, PANEL), [Design("s", "y", ("a", "b"))], "g")
    coef, se, *_ = full(rows, f.design)
    assert np.allclose(f.coef, coef) and np.allclose(f.std_err, se)


def test_too_many_dummies_are_refused(spark, monkeypatch):
    monkeypatch.setattr(regress, "MOST_LEVELS", 5)
    with pytest.raises(ValueError, match="levels"):
        regress.ols(spark.createDataFrame(panel(), PANEL), "y", ["a"], "g")
