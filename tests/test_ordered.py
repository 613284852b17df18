"""As-of and range joins against plain loops, with hot keys, ties, nulls and empty sides."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import ordered

LEFT, RIGHT = "id int, k string, `t t` double", "rid int, k string, at double, v string"


def rows(seed, n=300, m=200):
    r = random.Random(seed)
    key = lambda: r.choice([None, "hot", "hot", "hot", "a", "b", "c"])
    time = lambda: r.choice([None, *[float(x) for x in range(40)]])
    return [(i, key(), time()) for i in range(n)] + [(0, "hot", 5.0)] * 3, [(i, key(), time(), f"v{i}") for i in range(m)] + [(900, "late", 9.0, None)]


def matched(left, right, operator, by, how):
    test = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b}[operator]
    out = Counter()
    for i, k, t in left:
        fit = [r for r in right if t is not None and r[2] is not None and test(t, r[2]) and (not by or (k is not None and r[1] == k))]
        if fit:
            at = (max if operator[0] == ">" else min)(r[2] for r in fit)
            best = max((r for r in fit if r[2] == at), key=lambda r: r[0])
            out[i, k, t, best[3], best[0]] += 1
        elif how == "left":
            out[i, k, t, None, None] += 1
    return out


@pytest.mark.parametrize("operator", [">=", ">", "<=", "<"])
@pytest.mark.parametrize("by,how", [(True, "left"), (False, "inner")])
def test_asof_equals_loops(spark, operator, by, how):
    left, right = rows(operator + how)
    l, r = spark.createDataFrame(left, LEFT).repartition(5), spark.createDataFrame(right, RIGHT).repartition(3)
    out = ordered.asof_join(l, r, ("t t", operator, "at"), [("k", "k")] if by else None, columns={"v": "seen", "rid": "right id"}, ties=["rid"], how=how)
    assert out.columns == ["id", "k", "t t", "seen", "right id"]
    assert Counter(map(tuple, out.collect())) == matched(left, right, operator, by, how)


def test_asof_of_empty_sides_and_wrong_arguments(spark):
    left, right = rows(1)
    l, r = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    none_l, none_r = spark.createDataFrame([], LEFT), spark.createDataFrame([], RIGHT)
    join = lambda a, b, **o: ordered.asof_join(a, b, ("t t", ">=", "at"), [("k", "k")], columns={"v": "seen"}, **o)
    assert join(none_l, r).count() == 0 and join(l, none_r, how="inner").count() == 0
    assert join(l, none_r).filter("seen is not null").count() == 0 and join(l, none_r).count() == len(left)
    with pytest.raises(ValueError):
        ordered.asof_join(l, r, ("t t", "=", "at"), columns={"v": "seen"})
    with pytest.raises(ValueError):
        ordered.asof_join(l, r, ("t t", ">=", "at"), columns={"v": "k"})


@pytest.fixture
def ranges_kept(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_hot_key_is_spread_over_ranges(spark, ranges_kept):
    l = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    r = spark.range(0, 20_000, 7).select(F.lit(1).alias("k"), F.col("id").alias("at"))
    times = ordered._placed(l.withColumn("_k", F.struct("k")).withColumn("_t", F.col("t")), "_k", "_t")
    assert max(r["count"] for r in times.groupBy("_part").count().collect()) < 8000
    out = ordered.asof_join(l, r, ("t", ">=", "at"), [("k", "k")], columns={"at": "seen"})
    assert out.count() == 20_000 and out.filter("seen <> t - t % 7 or seen is null").count() == 0


@pytest.mark.parametrize("closed", ["both", "low", "high", "neither"])
@pytest.mark.parametrize("bits", [12, 2])
def test_ranges_equal_loops(spark, monkeypatch, closed, bits):
    monkeypatch.setattr(ordered, "BLOCK_BITS", bits)
    r = random.Random(closed)
    points = [(i, r.choice([None, 5, 5, 5, r.randrange(60), r.randrange(1000)])) for i in range(300)] + [(0, 5)] * 2
    spans = [(i, r.choice([None, r.randrange(-20, 80)]), r.choice([None, *[r.randrange(0, 1200)] * 3, 5, 60])) for i in range(80)] + [(80, 5, 5), (81, -9, -1), (82, 2000, 3000)]
    p, s = spark.createDataFrame(points, "pid int, `x.x` int").repartition(4), spark.createDataFrame(spans, "sid int, lo int, hi int")
    out = ordered.range_join(p, s, "x.x", "lo", "hi", closed=closed)
    low = (lambda x, a: x >= a) if closed in ("both", "low") else (lambda x, a: x > a)
    high = (lambda x, b: x <= b) if closed in ("both", "high") else (lambda x, b: x < b)
    want = Counter((*q, *t) for q in points for t in spans if None not in (*q, *t) and low(q[1], t[1]) and high(q[1], t[2]))
    assert Counter(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ranges_of_empty_sides_and_wrong_arguments(spark):
    p, s = spark.createDataFrame([(1, 2)], "pid int, x int"), spark.createDataFrame([(1, 0, 9)], "sid int, lo int, hi int")
    assert ordered.range_join(p.limit(0), s, "x", "lo", "hi").count() == 0 and ordered.range_join(p, s.limit(0), "x", "lo", "hi").count() == 0
    with pytest.raises(ValueError):
        ordered.range_join(p, s.withColumnRenamed("sid", "pid"), "x", "lo", "hi")
    with pytest.raises(ValueError):
        ordered.range_join(p, s, "x", "lo", "hi", closed="left")
