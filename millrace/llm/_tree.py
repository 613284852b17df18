"""Tree merge of sorted runs, and the way back down the same tree (DataFrame functions only).

Every row belongs to one of ``ways`` runs by a hash of its identifier.  A run is dealt
out by (run, key), sorted by key, and holds each key once.  Runs then meet in binomial
rounds: a round of radix 2**b takes the low b bits off the run number, so 2**b runs
merge into one.  After the last round there is one run, dealt out by key.  The way back
hands every row what the root says of its key.  No key ever has more rows in one task
than one run has of it, so a key with a third of all rows is spread over ``ways``
tasks and pre-aggregated before it moves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import SPREAD, spread_of


def merge_runs(
    rows: DataFrame,
    keys: list[str],
    id_col: str,
    reduce: dict[str, tuple[Column, Callable[[str], Column]]],
    *,
    ways: int = SPREAD,
    radix_bits: int = 4,
) -> "RunTree":
    """The merged tree of ``rows``; ``reduce`` maps a name to its first aggregate and how two of them merge."""
    bits = (ways - 1).bit_length()
    shifts = [min(radix_bits, bits - done) for done in range(0, bits, radix_bits)]
    spread = spread_of(F.col(id_col).cast("string"), ways)
    runs = rows.withColumn("_run", spread).repartition("_run", *keys).sortWithinPartitions("_run", *keys)
    level = runs.groupBy("_run", *keys).agg(*[first.alias(name) for name, (first, _) in reduce.items()])
    levels = [level]
    for shift in shifts:
        level = (
            level.withColumn("_run", F.shiftright("_run", shift))
            .groupBy("_run", *keys)
            .agg(*[merge(name).alias(name) for name, (_, merge) in reduce.items()])
        )
        levels.append(level)
    return RunTree(runs, keys, shifts, levels)


class RunTree:
    def __init__(self, runs: DataFrame, keys: list[str], shifts: list[int], levels: list[DataFrame]):
        self.runs, self.keys, self.shifts, self.levels = runs, keys, shifts, levels

    @property
    def root(self) -> DataFrame:
        """One row per key, with what it was reduced to."""
        return self.levels[-1].drop("_run")

    def down(self, root: DataFrame) -> DataFrame:
        """Every row with the columns that ``root``, by key, holds of it; rows of keys that it lacks go."""
        found = root.withColumn("_run", F.lit(0))
        for level, shift in zip(self.levels[-2::-1], self.shifts[::-1], strict=True):
            below = level.select("_run", F.shiftright("_run", shift).alias("_up"), *self.keys)
            found = below.join(found.withColumnRenamed("_run", "_up"), ["_up", *self.keys]).drop("_up")
        return self.runs.join(found, ["_run", *self.keys]).drop("_run")
