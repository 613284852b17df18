"""Connected components by alternating stars (DataFrame functions only).

Each round hangs every node's larger neighbours, then its smaller ones, under the
least neighbour.  A hub's neighbours are spread over tasks.  The number of rounds grows with the logarithm of the number of nodes.
Every round is written to the shared folder, so lost executors cost one round at most;
the files of the round before go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import forget, join_spread, tidy, written


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label) for every node of an edge; label is the least node reachable.

    Nodes may be of any ordered type.  Loops, repeated edges and nulls are ignored.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v and u is not null and v is not null")
    e = written(e.distinct(), "edges")
    before, rounds = None, 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = join_spread(both.filter("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        old, e = e, written(small.distinct(), "edges")
        forget(old)
        rounds += 1
        if rounds % 3 == 0:
            tidy(e.sparkSession)
        if rounds == 1:
            continue
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(now) == before:
            break
        before = tuple(now)
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
