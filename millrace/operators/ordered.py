"""Joins by order: the last row before a time, and the points within an interval.

Both sort one skinny table by ranges, so that a hot key or a hot value is spread over
as many tasks as it fills, and carry what a range needs from those before it as one row per
range.  Neither makes more rows than its input and its result have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import staged

#: Points that make up a block, as a power of two, and places that a partition may number.
BLOCK_BITS, PLACE_BITS = 12, 33


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` in ranges by ``order``, each with its range ``_part`` and its place in it, ``_at``."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return staged(ranged).withColumns({"_part": F.shiftright("_id", PLACE_BITS), "_at": F.col("_id").bitwiseAND((1 << PLACE_BITS) - 1)}).drop("_id")


def _common(*kinds):
    """A type that keeps the order of values of all of them."""
    if len(set(kinds)) == 1:
        return kinds[0]
    return T.DoubleType() if all(isinstance(k, T.NumericType) for k in kinds) else T.TimestampType()


# -- as-of join ------------------------------------------------------------------------


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: tuple[str, str, str],
    by: list[tuple[str, str]] | None = None,
    *,
    columns: dict[str, str],
    ties: list[str] | None = None,
    how: str = "left",
) -> DataFrame:
    """Every row of ``left`` with the nearest row of ``right`` in time.

    ``on`` is (left time, operator, right time): ">=" and ">" take the last row of ``right`` at or
    before, or before, the left time; "<=" and "<" the first one at or after, or after.  ``by`` pairs
    columns that must be equal.  ``columns`` maps columns of ``right`` to their names in the
    result.  Of rows with the same key and time the one last by ``ties`` counts (by all
    columns where it is not given); null keys and times match nothing.  ``how`` is "left" or "inner".

    Times of both sides that differ go through one range-sorted table, once each; rows meet their
    match by equality afterwards, where AQE splits what is skewed.
    """
    left_time, operator, right_time = on
    if operator not in (">=", ">", "<=", "<") or how not in ("left", "inner"):
        raise ValueError(f"unknown operator {operator!r} or join {how!r}")
    by = by or []
    clash = set(columns.values()) & set(left.columns)
    if clash:
        raise ValueError(f"columns of the result would repeat: {sorted(clash)}")
    kind = _common(left.schema[left_time].dataType, right.schema[right_time].dataType)
    mine = F.struct(*[F.col(f"`{a}`").alias(f"k{i}") for i, (a, _) in enumerate(by)]) if by else F.struct(F.lit(0).alias("k0"))
    theirs = F.struct(*[F.col(f"`{b}`").cast(left.schema[a].dataType).alias(f"k{i}") for i, (a, b) in enumerate(by)]) if by else F.struct(F.lit(0).alias("k0"))
    whole = lambda names: " and ".join(f"`{n}` is not null" for n in names)

    carried = F.struct(*[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)])
    chosen = F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(ties or [f.name for f in right.schema if "map" not in f.dataType.simpleString()])])
    known = right.filter(whole([right_time, *[b for _, b in by]])).select(theirs.alias("_k"), F.col(f"`{right_time}`").cast(kind).alias("_r"), carried.alias("_v"), chosen.alias("_o"))
    known = known.groupBy("_k", "_r").agg(F.max_by("_v", "_o").alias("_v"))
    asking = left.filter(whole([left_time, *[a for a, _ in by]])).select(mine.alias("_k"), F.col(f"`{left_time}`").cast(kind).alias("_t"))
    marks = asking.withColumn("_given", F.lit(False)).unionByName(known.select("_k", F.col("_r").alias("_t"), F.lit(True).alias("_given")))
    times = marks.groupBy("_k", "_t").agg(F.bool_or(~F.col("_given")).alias("_asked"), F.bool_or("_given").alias("_given"))
    found = _nearest(_placed(times, "_k", "_t"), operator).filter("_asked and _r is not null").select("_k", "_t", "_r")
    answers = found.join(known, ["_k", "_r"]).select("_k", F.col("_t").alias("_time"), "_v")
    rows = left.withColumn("_key", mine).withColumn("_at", F.col(f"`{left_time}`").cast(kind))
    same = (rows["_key"] == answers["_k"]) & (rows["_at"] == answers["_time"])
    joined = rows.join(answers, same, how)
    return joined.select(*[rows[f"`{c}`"] for c in left.columns], *[F.col(f"_v.v{i}").alias(name) for i, name in enumerate(columns.values())])


def _nearest(placed: DataFrame, operator: str) -> DataFrame:
    """``placed`` times with _r, the nearest given time of the key on the operator's side."""
    back, strict = operator.startswith(">"), not operator.endswith("=")
    given = F.when(F.col("_given"), F.col("_t"))
    way = lambda c: F.col(c).asc() if back else F.col(c).desc()
    inside = Window.partitionBy("_part", "_k").orderBy(way("_t")).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    before = Window.partitionBy("_k").orderBy(way("_part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy("_part", "_k").agg((F.max if back else F.min)(given).alias("_end"))
    carried = ends.select("_part", "_k", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    own = placed.withColumn("_own", F.last(given, ignorenulls=True).over(inside))
    return own.join(carried, ["_part", "_k"]).withColumn("_r", F.coalesce("_own", "_carry"))


# -- range join ------------------------------------------------------------------------


def range_join(
    points: DataFrame,
    intervals: DataFrame,
    point: str,
    low: str,
    high: str,
    *,
    closed: str = "both",
) -> DataFrame:
    """All pairs of a row of ``points`` and one of ``intervals`` between whose ends it lies.

    ``closed`` says which ends belong to an interval: "both", "low", "high" or "neither".
    The points are sorted into blocks of 4096 neighbours, equal values too.  An interval goes to the blocks
    between its ends only, each of which holds a partner but for the first and last, so no
    more rows are made than pairs plus two for each interval.  Intervals find their blocks by as-of
    joins with the blocks' least and greatest values.  Null ends and points and empty intervals match nothing.
    """
    if closed not in ("both", "low", "high", "neither"):
        raise ValueError(f"unknown ends {closed!r}")
    clash = set(points.columns) & set(intervals.columns)
    if clash:
        raise ValueError(f"columns of the result would repeat: {sorted(clash)}")
    kind = _common(points.schema[point].dataType, intervals.schema[low].dataType, intervals.schema[high].dataType)
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in points.columns if "map" not in points.schema[c].dataType.simpleString()])
    rows = points.filter(F.col(f"`{point}`").isNotNull()).withColumn("_x", F.col(f"`{point}`").cast(kind)).withColumn("_s", spread)
    placed = _placed(rows, "_x", "_s").withColumn("_b", F.shiftright("_at", BLOCK_BITS))
    blocks = placed.groupBy("_part", "_b").agg(F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    # a row per range, so the number of partitions bounds both the window and the broadcast
    parts = placed.groupBy("_part").agg(F.max("_b").alias("_last"))
    first = F.coalesce(F.sum(F.col("_last") + 1).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = staged(parts.select("_part", first.alias("_off")))
    number = F.col("_off") + F.col("_b")
    numbered = blocks.join(F.broadcast(offsets), "_part").select("_least", "_most", number.alias("_block"), (-number).alias("_rev"))
    numbered = staged(numbered)

    whole = intervals.filter(F.col(f"`{low}`") <= F.col(f"`{high}`"))
    ends = whole.withColumns({"_low": F.col(f"`{low}`").cast(kind), "_high": F.col(f"`{high}`").cast(kind)})
    ends = asof_join(ends, numbered, ("_low", "<=", "_most"), columns={"_block": "_from"}, ties=["_rev"], how="inner")
    ends = asof_join(ends, numbered, ("_high", ">=", "_least"), columns={"_block": "_to"}, ties=["_block"], how="inner")
    dealt = ends.filter("_from <= _to").withColumn("_block", F.explode(F.sequence("_from", "_to")))
    pairs = placed.join(F.broadcast(offsets), "_part").withColumn("_block", number).join(dealt, "_block")
    pairs = pairs.filter(_within(F.col(f"`{point}`"), F.col(f"`{low}`"), F.col(f"`{high}`"), closed))
    return pairs.select(*[F.col(f"`{c}`") for c in (*points.columns, *intervals.columns)])


def _within(x: Column, low: Column, high: Column, closed: str) -> Column:
    above = x >= low if closed in ("both", "low") else x > low
    below = x <= high if closed in ("both", "high") else x < high
    return above & below
