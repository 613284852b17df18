"""Exact quantiles by refinement: histograms narrow the range of each wanted rank, scan by scan.

The first histogram has 16 bins to each power of two on either side of zero, so it needs
no bounds and suits any spread; it keeps count, least and greatest value of each bin.  The bin that holds a
wanted rank becomes a range between two values that occur; the next scan divides it into
``BINS`` equal parts, and so on until a range is one value or holds at most ``FEW``, which are
then looked at one by one.  A range loses a factor of thousands in every scan, so three or four scans end it.

No map of all values, no sort and, without groups, no shuffle but that of bins: their number does not depend
on the input.  Interpolation is that of ``percentile``: linear between neighbouring ranks.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import staged

#: Parts of a range, and values that are looked at one by one.
BINS, FEW = 4096, 4096
#: Ranges that may be sent to all executors; beyond it they are joined by key.
SENT_RANGES = 20_000
#: Ways in which the values of a group are dealt out when ranges are joined by key.
WAYS = 32
_PER_POWER = 16


def first_bin(x: Column) -> Column:
    """The bin of a double in a histogram of all doubles; NaN is the greatest value."""
    size = F.floor(F.log2(F.abs(x)) * _PER_POWER) + 20_000
    return (
        F.when(F.isnan(x), 60_000)
        .when(F.abs(x) == float("inf"), F.signum(x) * 50_000)
        .when(x == 0, 0)
        .otherwise(F.signum(x) * size)
        .cast("int")
    )


def inner_bin(x: Column, low: Column, high: Column) -> Column:
    """The part of a range between two doubles; halves, as the distance of two doubles may be none."""
    share = (x / 2 - low / 2) / (high / 2 - low / 2)
    return F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")


def wanted_ranks(n: int, probs: list[float]) -> list[int]:
    return sorted({f(p * (n - 1)) for p in probs for f in (floor, ceil)})


def interpolated(n: int, probs: list[float], values: dict[int, float]) -> list[float]:
    out = []
    for p in probs:
        at = p * (n - 1)
        low, high = values[floor(at)], values[ceil(at)]
        out.append(low if low == high or floor(at) == ceil(at) else (ceil(at) - at) * low + (at - floor(at)) * high)
    return out


def quantiles(df: DataFrame, columns: dict[str, Column], probs: list[float]) -> dict[str, tuple[int, list[float | None]]]:
    """(number of values, quantiles) of each column, by name, all columns in each scan.

    What comes to the driver are bins and ranges: a bound for each column, whatever the
    size of the table.  Nulls do not count; a column without values has no quantiles (None).
    """
    names = list(columns)
    if not names:
        return {}
    exprs = [columns[c].cast("double") for c in names]
    values = F.inline(F.array(*[F.struct(F.lit(i).alias("c"), e.alias("x")) for i, e in enumerate(exprs)]))
    bins = df.select(values).filter("x is not null").groupBy("c", first_bin(F.col("x")).alias("b")).agg(*_ends())
    found = _by_range((r.c, r.b, r.n, r.low, r.high) for r in bins.collect())
    total = {c: sum(n for _, n, _, _ in rows) for c, rows in found.items()}
    ranks = {c: wanted_ranks(n, probs) for c, n in total.items()}
    known: dict[int, dict[int, float]] = {c: {} for c in total}
    todo = {(c, 0): (rows, 0) for c, rows in found.items()}
    while todo:
        opened: list[tuple[int, float, float, int, int]] = []
        for (c, _), (rows, before) in todo.items():
            for _, n, low, high in sorted(rows):
                inside = [r for r in ranks[c] if before <= r < before + n]
                if inside and (low == high or low != low):
                    known[c] |= dict.fromkeys(inside, low)
                elif inside:
                    opened.append((c, low, high, n, before))
                before += n
        todo = {}
        if not opened:
            break
        scans = []
        for k, (c, low, high, n, _) in enumerate(opened):
            x = exprs[c]
            part = inner_bin(x, F.lit(low), F.lit(high)) if n > FEW else F.lit(None).cast("int")
            each = x if n <= FEW else F.lit(None).cast("double")
            scans.append(F.when(x.between(low, high), F.struct(F.lit(k).alias("c"), part.alias("b"), each.alias("v"), x.alias("x"))))
        rows = df.select(F.explode(F.array_compact(F.array(*scans))).alias("s")).select("s.*")
        parts = _by_range((r.c, r.low if r.b is None else r.b, r.n, r.low, r.high) for r in rows.groupBy("c", "b", "v").agg(*_ends()).collect())
        for k, (c, _, _, _, before) in enumerate(opened):
            todo[c, k + 1] = parts[k], before
    none = [None] * len(probs)
    return {name: (total.get(i, 0), interpolated(total[i], probs, known[i]) if i in total else none) for i, name in enumerate(names)}


def _ends() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")]


def _by_range(rows) -> dict[int, list[tuple]]:
    found: dict[int, list[tuple]] = {}
    for key, *rest in rows:
        found.setdefault(key, []).append(tuple(rest))
    return found


# -- by group --------------------------------------------------------------------------


def grouped_quantiles(df: DataFrame, by: list[str], column: str | Column, probs: list[float]) -> DataFrame:
    """(by..., n, q) for every group with a value: the number of values and the array of quantiles.

    Ranges of all groups are refined together.  They are sent to the executors while at most
    ``SENT_RANGES``; more are joined by group and salt, so no group, however large, meets in one
    task.  Null groups count as groups of their own.
    """
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(by)]).alias("k")
    values = df.select(key, x.alias("x")).filter("x is not null")
    bins = values.groupBy("k", first_bin(F.col("x")).alias("b")).agg(*_ends())
    whole = Window.partitionBy("k")
    bins = bins.withColumn("total", F.sum("n").over(whole)).withColumn("start", F.lit(0).cast("long"))
    state = staged(_holding(bins, ["k"], probs))
    settled: list[DataFrame] = []
    while True:
        is_one = (F.col("low") == F.col("high")) | F.isnan("low")
        settled.append(state.filter(is_one).select("k", "total", F.explode("ranks").alias("rank"), F.col("low").alias("value")))
        few, many = state.agg(F.count_if(~is_one & (F.col("n") <= FEW)), F.count_if(~is_one & (F.col("n") > FEW))).first()
        if few:
            # values go to their range as they are and are sorted there: lists of a task's values would take memory by its size
            listed = _inside(values, state.filter(~is_one & (F.col("n") <= FEW)).drop("n", "ranks"), few).select("k", "total", "start", "low", "x")
            place = F.col("start") + F.row_number().over(Window.partitionBy("k", "low").orderBy("x")) - 1
            placed = listed.select("k", "total", place.alias("rank"), F.col("x").alias("value"))
            settled.append(placed.filter(F.array_contains(_places(probs), F.col("rank"))))
        if not many:
            break
        parts = _inside(values, state.filter(~is_one & (F.col("n") > FEW)), many)
        parts = parts.groupBy("k", "total", "start", F.col("low").alias("from"), inner_bin(F.col("x"), F.col("low"), F.col("high")).alias("b")).agg(*_ends())
        state = staged(_holding(parts, ["k", "from"], probs))
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.unionByName(more)
    found = rows.groupBy("k", "total").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("values"))
    q = F.array(*[_interpolation(p) for p in probs])
    return found.select(*[F.col(f"k.k{i}").alias(c) for i, c in enumerate(by)], F.col("total").alias("n"), q.alias("q"))


def _holding(bins: DataFrame, ranges: list[str], probs: list[float]) -> DataFrame:
    """The bins that hold a wanted rank, with these ranks and the number of values before them."""
    upto = Window.partitionBy(*ranges).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counted = bins.withColumn("start", F.col("start") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
    inside = F.filter(F.array_distinct(_places(probs)), lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n")))
    return counted.select("k", "total", "start", "n", "low", "high", inside.alias("ranks")).filter(F.size("ranks") > 0)


def _places(probs: list[float]) -> Column:
    """The wanted ranks of a group with ``total`` values."""
    return F.array(*[f(F.lit(p) * (F.col("total") - 1)).cast("long") for p in probs for f in (F.floor, F.ceil)])


def _inside(values: DataFrame, ranges: DataFrame, n: int) -> DataFrame:
    """Values with the range of their group that they lie in, if any; ranges of a group do not overlap."""
    if n <= SENT_RANGES:
        joined = values.join(F.broadcast(ranges), "k")  # counted
    else:
        dealt = ranges.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(WAYS)])))
        joined = values.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(WAYS)).cast("int")).join(dealt.hint("shuffle_hash"), ["k", "salt"])
    return joined.filter("x between low and high")


def _interpolation(p: float) -> Column:
    at = F.lit(p) * (F.col("total") - 1)
    low, high = F.floor(at).cast("long"), F.ceil(at).cast("long")
    a, b = F.element_at("values", low), F.element_at("values", high)
    return F.when((low == high) | (a == b), a).otherwise((high - at) * a + (at - low) * b)
