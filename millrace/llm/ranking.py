"""First places within groups, with ties, by distributed multi-select (DataFrame functions only).

A line's pair of order values becomes one code, its place in the space of pairs.  Lines
are counted once per group and code; a binary search over codes then runs for every
group at once.  A pass is one exact count: of each group's lines up to the pivots that
its next three halvings could ask for.  Wide spaces are searched 12 bits at a time, so
that a group has at most 4096 cells in one task, however many pairs it holds.  The cut
found leaves at most ``k`` pairs per group; only lines of these are range-sorted by all
their order columns, where ties that fill many tasks are no harm, and numbered.

Nothing that grows with the input meets in one task: the counts of a hot group are
combined before they move, its lines are dealt out by pair (joins of a hot pair are
split by AQE) and then by range, and each range passes on ``k`` lines of a group at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import written

#: Halvings of the search that one count answers, and bits of the code that one level searches.
HALVINGS, LEVEL_BITS = 3, 12


def top_places(
    lines: DataFrame,
    groups: list[str],
    pair: list[tuple[str, str]],
    ties: list[str],
    k: int,
    *,
    place: str = "position",
) -> DataFrame:
    """The lines of ``lines`` whose place within their group is at most ``k``.

    ``pair`` names two integral columns with "asc" or "desc"; nulls come first and equal each
    other in both.  ``place`` says what a place is: "position" numbers a group's lines by pair,
    then by ``ties`` (ascending, nulls last), equal lines separately; "rank" is one more than
    the lines of better pairs, "dense" one more than the better pairs, so lines of one pair
    share it and all of them return.  Adds ``place`` and ``tied``, the group's lines with
    the same pair, and for "position" also ``pos`` (the same number); input columns of these
    names are replaced.  Null group values form a group of their own; other columns are
    carried along; an empty table gives an empty one.  Pair values may span 10**31 pairs together.
    """
    if place not in ("position", "rank", "dense") or len(pair) != 2 or {way for _, way in pair} - {"asc", "desc"}:
        raise ValueError(f"unknown place {place!r} or pair {pair!r}")
    kept_cols = [c for c in lines.columns if c not in ("pos", "place", "tied")]
    rest = {c: f"_c{i}" for i, c in enumerate(kept_cols) if c not in groups and c not in (pair[0][0], pair[1][0])}
    codec = _codec(lines, pair)
    coded = lines.select(
        F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(groups)]).alias("_g"),
        codec.code.alias("_code"),
        *[F.col(f"`{c}`").alias(name) for c, name in rest.items()],
    )
    pairs = written(coded.groupBy("_g", "_code").agg(F.count(F.lit(1)).alias("_n")), "rank-pairs")
    best = _best_pairs(pairs, codec, k, dense=place == "dense")
    found = written(coded.join(best, ["_g", "_code"]), "rank-lines")

    if place == "position":
        order = [F.col("_code"), *[F.col(rest[c]).asc_nulls_last() if c in rest else codec.decoded(c).asc_nulls_last() for c in ties]]
        ranged = found.repartitionByRange("_g", *order).sortWithinPartitions("_g", *order)
        found = ranged.withColumn("_pos", F.row_number().over(Window.partitionBy("_g").orderBy(*order))).filter(F.col("_pos") <= k)
        extra = [F.col("_pos").cast("long").alias("pos"), F.col("_pos").cast("long").alias("place")]
    else:
        extra = [F.col("_before" if place == "rank" else "_better") + 1]
        extra = [extra[0].cast("long").alias("place")]
    columns = [
        F.col(f"_g.g{groups.index(c)}").alias(c) if c in groups else F.col(rest[c]).alias(c) if c in rest else codec.decoded(c).alias(c)
        for c in kept_cols
    ]
    return found.select(*columns, *extra, F.col("_n").alias("tied"))


class _codec:
    """The code of a pair: its place in the space spanned by the least and greatest values."""

    def __init__(self, lines: DataFrame, pair: list[tuple[str, str]]):
        names = [name for name, _ in pair]
        bounds = lines.agg(*[f(F.col(c).cast("long")) for c in names for f in (F.min, F.max)]).first()
        self.types = {c: lines.schema[c].dataType for c in names}
        self.ends = {c: (bounds[2 * i] or 0, bounds[2 * i + 1] or 0) for i, c in enumerate(names)}
        self.ways = dict(pair)
        widths = [hi - lo + 2 for lo, hi in self.ends.values()]
        self.second = names[1]
        self.radix, space = widths[1], widths[0] * widths[1]
        if space >= 10**31:
            raise ValueError(f"{names} span more than 10**31 pairs")
        self.kind = "long" if space < 2**62 else "decimal(38,0)"
        self.bits = max(1, (space - 1).bit_length())
        digits = [self._digit(c) for c in names]
        self.code = (digits[0] * _whole(self.radix, self.kind) + digits[1]).cast(self.kind)

    def _digit(self, c: str) -> Column:
        lo, hi = self.ends[c]
        value = F.col(c).cast("long").cast(self.kind)
        step = _whole(hi, self.kind) - value if self.ways[c] == "desc" else value - _whole(lo, self.kind)
        return F.coalesce(step + 1, F.lit(0).cast(self.kind)).cast(self.kind)

    def decoded(self, c: str) -> Column:
        """A pair's value again, from its code."""
        digit = F.col("_code") % _whole(self.radix, self.kind) if c == self.second else _quotient(F.col("_code"), self.radix, self.kind)
        lo, hi = self.ends[c]
        value = _whole(hi + 1) - digit if self.ways[c] == "desc" else digit + _whole(lo - 1)
        return F.when(digit > 0, value).cast(self.types[c])


def _whole(n: int, kind: str = "decimal(38,0)") -> Column:
    """A number that may be longer than a long."""
    return F.lit(str(n)).cast(kind)


def _quotient(value: Column, n: int, kind: str) -> Column:
    """The quotient without remainder, of either kind of code."""
    if kind == "long":
        return F.call_function("div", value, F.lit(n))
    return ((value - value % _whole(n)) / _whole(n)).cast(kind)


def _best_pairs(pairs: DataFrame, codec: "_codec", k: int, *, dense: bool) -> DataFrame:
    """The pairs of first places with their counts, the lines before them and the pairs before them."""
    weight = F.lit(1).cast("long") if dense else F.col("_n")
    cut, shift, kind = None, codec.bits, codec.kind
    while shift > 0:
        low = max(0, shift - LEVEL_BITS)
        if cut is None:
            rows = pairs.withColumn("_need", F.lit(k).cast("long")).withColumn("_rest", F.col("_code"))
        else:
            inside = pairs.join(cut.filter("_open").select("_g", "_cut", "_need"), "_g").filter(_quotient(F.col("_code"), 2**shift, kind) == F.col("_cut"))
            rows = inside.withColumn("_rest", F.col("_code") % _whole(2**shift, kind))
        cells = rows.select("_g", "_need", _quotient(F.col("_rest"), 2**low, kind).cast("long").alias("_cell"), weight.alias("_w"))
        if low:
            cells = cells.groupBy("_g", "_need", "_cell").agg(F.sum("_w").alias("_w"))
        found = _search(cells, shift - low)
        if cut is None:
            cut = found.withColumnRenamed("_lo", "_cut")
        else:
            deeper = found.select("_g", "_lo", F.col("_need").alias("_left"), F.col("_open").alias("_more"))
            scale = _whole(2 ** (shift - low))
            whole = F.col("_cut").cast("decimal(38,0)") * scale
            cut = cut.join(deeper, "_g", "left").select(
                "_g",
                (whole + F.coalesce(F.col("_lo"), scale - 1)).cast("decimal(38,0)").alias("_cut"),
                F.coalesce("_left", "_need").alias("_need"),
                F.coalesce("_more", F.lit(False)).alias("_open"),
            )
        cut = written(cut, "rank-cuts") if low else cut
        shift = low
    ordered = Window.partitionBy("_g").orderBy("_code")
    kept = pairs.join(cut.select("_g", "_cut").hint("shuffle_hash"), "_g").filter("_code <= _cut")
    before = F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    return kept.select("_g", "_code", "_n", F.coalesce(before, F.lit(0)).alias("_before"), (F.row_number().over(ordered) - 1).alias("_better"))


def _search(cells: DataFrame, bits: int) -> DataFrame:
    """(_g, _lo, _need, _open): the least cell up to which a group has ``_need``, and what it still needs inside it.

    Groups with less than that get the last cell of all and are not open any more.
    """
    at, state = -(-bits // HALVINGS) * HALVINGS, None
    while at > 0:
        at -= HALVINGS
        if state is None:
            rows = cells.withColumn("_lo", F.lit(0).cast("long"))
        else:
            rows = cells.join(state.select("_g", "_lo").hint("shuffle_hash"), "_g")
        part = F.shiftright(F.col("_cell") - F.col("_lo"), at)
        pivots = range(2**HALVINGS)
        counts = [F.coalesce(F.sum(F.when(part <= j, F.col("_w"))), F.lit(0)).alias(f"_{j}") for j in pivots]
        short = [F.col(f"_{j}") < F.col("_need") for j in pivots]
        moved = reduce(lambda a, b: a + b, [s.cast("long") for s in short[:-1]])
        below = F.greatest(*[F.when(s, F.col(f"_{j}")).otherwise(0) for j, s in zip(pivots, short, strict=True)])
        state = (
            rows.groupBy("_g", "_need", "_lo")
            .agg(*counts)
            .select("_g", "_need", (F.col("_lo") + moved * F.lit(2**at)).alias("_lo"), below.alias("_below"), (~short[-1]).alias("_open"))
        )
    return state.select("_g", "_lo", (F.col("_need") - F.col("_below")).alias("_need"), "_open")
