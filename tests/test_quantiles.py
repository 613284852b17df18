"""Exact quantiles against sorted lists, over spreads that are hard for histograms."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import quantiles as Q

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def expected(values, probs):
    """Linear interpolation between neighbouring ranks; NaN is the greatest value."""
    own = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    if not own:
        return [None] * len(probs)
    out = []
    for p in probs:
        at = p * (len(own) - 1)
        a, b = own[math.floor(at)], own[math.ceil(at)]
        out.append(a if a == b or at == int(at) else (math.ceil(at) - at) * a + (at - math.floor(at)) * b)
    return out


def same(got, want):
    return all((g is None) == (w is None) and (g is None or (math.isnan(g) and math.isnan(w)) or g == pytest.approx(w, rel=1e-12)) for g, w in zip(got, want, strict=True))


def spreads():
    r = random.Random(11)
    yield "few values", [r.choice([1.0, 2.0, 2.0, 7.5, None]) for _ in range(500)]
    yield "normal", [r.gauss(0, 1) for _ in range(3000)]
    yield "one far away", [r.random() for _ in range(2000)] + [1e300, -1e300]
    yield "powers", [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(2000)]
    yield "near zero", [r.choice([0.0, -0.0, 5e-324, -5e-324, 1e-310]) for _ in range(300)]
    yield "ends", [float("inf"), float("-inf"), float("nan"), 1.0, None] * 40
    yield "neighbours", [1.0 + k * 2**-52 for k in range(300)]
    yield "one", [4.25]
    yield "none", [None, None]
    yield "largest", [1.7e308, -1.7e308, 1.6e308, 0.5] * 9
    yield "whole", [float(r.randrange(10**9)) for _ in range(5000)]


@pytest.mark.parametrize("few,bins", [(4096, 4096), (3, 4)])
def test_quantiles_of_all_columns_at_once(spark, monkeypatch, few, bins):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "BINS", bins)
    for name, values in spreads():
        if few == 3:
            values = values[:150]
        df = spark.createDataFrame([(v, 1) for v in values], "`a b` double, one int").repartition(3)
        got = Q.quantiles(df, {"a": F.col("`a b`"), "one": F.col("one"), "none": F.lit(None)}, PROBS)
        assert got["a"][0] == sum(v is not None for v in values), name
        assert same(got["a"][1], expected(values, PROBS)), (name, got["a"], expected(values, PROBS))
        assert got["one"] == (len(values), [1.0] * len(PROBS)) and got["none"] == (0, [None] * len(PROBS))


@pytest.mark.parametrize("few,sent", [(4096, 20_000), (5, 20_000), (5, 0)])
def test_quantiles_by_group(spark, monkeypatch, few, sent):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "SENT_RANGES", sent)
    named = dict(spreads())
    rows = [(name if name != "normal" else None, i % 2, v) for name, values in named.items() for i, v in enumerate(values[:400])]
    df = spark.createDataFrame(rows, "g string, `h.h` int, v double").repartition(4)
    got = {(r.g, r["h.h"]): (r.n, r.q) for r in Q.grouped_quantiles(df, ["g", "h.h"], "v", PROBS).collect()}
    groups = {}
    for g, h, v in rows:
        groups.setdefault((g, h), []).append(v)
    want = {k: v for k, v in groups.items() if any(x is not None for x in v)}
    assert got.keys() == want.keys()
    for k, values in want.items():
        assert got[k][0] == sum(x is not None for x in values) and same(got[k][1], expected(values, PROBS)), (k, got[k], expected(values, PROBS))


def test_quantiles_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert Q.quantiles(df, {"v": F.col("v")}, [0.5]) == {"v": (0, [None])}
    assert Q.grouped_quantiles(df, ["g"], "v", [0.5]).collect() == []
    assert Q.quantiles(df, {}, [0.5]) == {}


def test_a_hot_value_is_one_bin(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 3 > 0, 12.5).otherwise(F.col("id")).alias("v"))
    n, (q,) = Q.quantiles(df, {"v": F.col("v")}, [0.5])["v"]
    assert (n, q) == (200_000, 12.5)


def test_values_are_not_listed_in_memory(spark, monkeypatch):
    """No plan gathers values in lists or sorts the whole table, whose memory would grow with a task's input."""
    df = spark.range(6000).select((F.col("id") % 40).alias("g"), (F.col("id") * 7919 % 6007).cast("double").alias("v"))
    for sent in (20_000, 0):
        monkeypatch.setattr(Q, "SENT_RANGES", sent)
        out = Q.grouped_quantiles(df, ["g"], "v", [0.5])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "collect_list(x" not in plan and "SortMergeJoin [k" not in plan
        assert ("row_number()" in plan) and out.count() == 40
