"""Mutual information by neighbours, against the definition computed point by point."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import neighbours as N


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def slow_class(x, y, k):
    rows = [i for i in range(len(x)) if sum(y == y[i]) > 1]
    total = 0.0
    for i in rows:
        own = [j for j in rows if y[j] == y[i]]
        d = sorted(abs(x[j] - x[i]) for j in own if j != i)[min(k, len(own) - 1) - 1]
        near = lambda js: sum(abs(x[j] - x[i]) < d if d > 0 else x[j] == x[i] for j in js)  # noqa: B023, E731
        total += psi(near(own)) - psi(len(own)) - psi(near(rows))
    return max(0.0, psi(len(rows)) + total / len(rows)) if rows else 0.0


def slow_number(x, y, k):
    x, y = (v / v.std() if v.std() > 0 else v for v in (x, y))
    n, total = len(x), 0.0
    for i in range(n):
        both = np.maximum(np.abs(x - x[i]), np.abs(y - y[i]))
        d = sorted(np.delete(both, i))[k - 1]
        near = lambda a: int((a < d).sum() if d > 0 else (a == 0).sum())  # noqa: B023, E731
        total += psi(near(both)) - psi(near(np.abs(x - x[i]))) - psi(near(np.abs(y - y[i])))
    return max(0.0, psi(n) + total / n)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("k", [1, 3])
def test_estimators_equal_their_definition(seed, k):
    r = np.random.default_rng(seed)
    n = 250
    x = [r.normal(size=n), r.integers(0, 9, n).astype(float), np.round(r.normal(size=n), 1), np.zeros(n), r.random(n), r.lognormal(0, 3, n)][seed]
    y = x + r.normal(size=n) if seed % 2 else r.integers(0, 6, n).astype(float)
    assert N.with_number(x, y, k) == pytest.approx(slow_number(x, y, k), abs=1e-9)
    c = r.integers(0, 4, n) + (x > np.median(x)) * 4
    c[0] = 99
    assert N.with_class(x, c, k) == pytest.approx(slow_class(x, c, k), abs=1e-9)


def test_estimates_come_near_what_is_known():
    r = np.random.default_rng(1)
    x, e = r.normal(size=4000), r.normal(size=4000)
    rho = 0.8
    assert N.with_number(x, rho * x + math.sqrt(1 - rho**2) * e) == pytest.approx(-0.5 * math.log(1 - rho**2), abs=0.06)
    assert N.with_number(x, e) < 0.05
    y = r.integers(0, 2, 4000)
    assert N.with_class(x + 20 * y, y) == pytest.approx(math.log(2), abs=0.01) and N.with_class(e, y) < 0.03
    assert N.with_class(y.astype(float), y) == pytest.approx(math.log(2), abs=0.01)


def test_columns_of_a_table(spark):
    r = np.random.default_rng(2)
    rows = [(float(a), int(a * 3), "hi" if a > 0 else None, None, float("nan") if i % 5 else 1.0, float(a + 0.1 * b)) for i, (a, b) in enumerate(r.normal(size=(600, 2)))]
    df = spark.createDataFrame(rows, "x double, n int, c string, empty double, mostly double, `t.t` double")
    got = {g.column: (g.mi, g.n) for g in N.neighbour_information(df, ["x", "n", "c", "empty", "mostly", "t.t"], "t.t").collect()}
    assert got.keys() == {"x", "n", "c", "empty", "mostly"} and got["empty"] == (0.0, 0)
    assert got["x"][0] > got["n"][0] > 0.5 and got["x"][1] == 600 and got["mostly"][1] == 120 and got["c"][1] < 400
    few = {g.column: g.n for g in N.neighbour_information(df, ["x"], "t.t", sample=100).collect()}
    assert few == {"x": 100}
    classes = {g.column: g.mi for g in N.neighbour_information(df.withColumn("y", (F.col("x") > 0).cast("int")), ["x", "c", "n"], "y").collect()}
    assert classes["x"] == pytest.approx(math.log(2), abs=0.03) and classes["c"] == 0.0
    assert N.neighbour_information(df, [], "x").count() == 0
