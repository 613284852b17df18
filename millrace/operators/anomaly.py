"""Univariate fences and a multivariate isolation forest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .analysis import numeric_columns
from .quantiles import quantiles


def bounds(df: DataFrame, column: str) -> DataFrame:
    """One row: n, q1, q3, mean, std, low, high; fences need four values and a spread."""
    x = F.col(f"`{column}`").cast("double")
    q1, q3 = (F.lit(v).cast("double") for v in quantiles(df, {column: x}, [0.25, 0.75])[column][1])
    s = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")).select("n", q1.alias("q1"), q3.alias("q3"), "mean", "std")
    usable = (F.col("n") >= 4) & (F.col("q3") != F.col("q1"))
    return s.select(
        "*",
        F.when(usable, F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("low"),
        F.when(usable, F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("high"),
    )


def univariate(df: DataFrame, column: str, z: float = 3.0) -> DataFrame:
    """The rows beyond a fence or more than ``z`` deviations from the mean, with is_iqr and is_z."""
    return _beyond(df, column, bounds(df, column), z)


def _beyond(df: DataFrame, column: str, b: DataFrame, z: float) -> DataFrame:
    b = b.select("low", "high", "mean", "std", "n")
    x = F.col(f"`{column}`").cast("double")
    rows = df.crossJoin(F.broadcast(b))  # b is one row
    iqr = F.coalesce((x < F.col("low")) | (x > F.col("high")), F.lit(False))
    far = F.coalesce((F.col("n") >= 4) & (F.col("std") > 0) & (F.abs(x - F.col("mean")) > z * F.col("std")), F.lit(False))
    return rows.withColumn("is_iqr", iqr).withColumn("is_z", far).filter("is_iqr or is_z").drop("low", "high", "mean", "std", "n")


def summary(df: DataFrame, column: str) -> DataFrame:
    """One row: total_rows (that have a value), anomaly_count, anomaly_rate_percent, lower and upper bound."""
    total = df.agg(F.count(F.col(f"`{column}`").cast("double")).alias("total_rows"))
    fences = bounds(df, column)
    found = _beyond(df, column, fences, 3.0).agg(F.count(F.lit(1)).alias("anomaly_count"))
    b = fences.select(F.round("low", 4).alias("lower_bound"), F.round("high", 4).alias("upper_bound"))
    return total.crossJoin(found).crossJoin(b).withColumn("anomaly_rate_percent", F.round(F.try_divide(F.col("anomaly_count") * 100.0, "total_rows"), 2))


# -- isolation forest ------------------------------------------------------------------


def _path_norm(n: float) -> float:
    """The mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(sample: np.ndarray, trees: int, seed: int, subsample: int = 256) -> list[tuple[np.ndarray, ...]]:
    """Isolation trees as arrays: feature (-1 for leaves), threshold, left, right, depth at a leaf."""
    rng = np.random.default_rng(seed)
    size = min(subsample, len(sample))
    limit = int(np.ceil(np.log2(max(2, size))))
    forest = []
    for _ in range(trees):
        feature, threshold, left, right, depth = [], [], [], [], []
        todo = [(sample[rng.choice(len(sample), size, replace=False)], 0, -1, False)]
        while todo:
            x, d, parent, is_right = todo.pop()
            node = len(feature)
            if parent >= 0:
                (right if is_right else left)[parent] = node
            for a, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (depth, d + _path_norm(len(x)))):
                a.append(v)
            spread = np.flatnonzero(np.ptp(x, axis=0) > 0) if len(x) > 1 and d < limit else []
            if len(spread):
                f = int(rng.choice(spread))
                cut = rng.uniform(x[:, f].min(), x[:, f].max())
                feature[node], threshold[node] = f, cut
                todo += [(x[x[:, f] < cut], d + 1, node, False), (x[x[:, f] >= cut], d + 1, node, True)]
        forest.append(tuple(map(np.array, (feature, threshold, left, right, depth))))
    return forest


def forest_scores(forest: list[tuple[np.ndarray, ...]], x: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(len(x))
    for feature, threshold, left, right, depth in forest:
        at = np.zeros(len(x), int)
        while (live := np.flatnonzero(feature[at] >= 0)).size:
            f = feature[at[live]]
            at[live] = np.where(x[live, f] < threshold[at[live]], left[at[live]], right[at[live]])
        total += depth[at]
    return 2 ** (-total / len(forest) / max(1e-9, _path_norm(size)))


def multivariate(df: DataFrame, key: str, columns: list[str] | None = None, *, trees: int = 200, seed: int = 42, sample_rows: int = 20_000) -> DataFrame:
    """(key, score, is_anomaly) of the rows without missing values.

    The trees are grown on the driver from a bounded sample by a hash of the key; every
    row is scored on the executors.
    """
    columns = [c for c in (columns or numeric_columns(df)) if c != key]
    if len(columns) < 2:
        raise ValueError("Need at least 2 numeric columns.")
    rows = df.select(F.col(key).alias("key"), *[F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(columns)]).dropna()
    sample = np.array(rows.orderBy(F.xxhash64("key", F.lit(seed))).limit(sample_rows).drop("key").collect(), float)
    if len(sample) < 20:
        raise ValueError("Need at least 20 complete rows.")
    forest, size = grow(sample, trees, seed), min(256, len(sample))
    kind = rows.schema["key"].dataType.simpleString()

    def score(batches):
        for batch in batches:
            x = np.column_stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(columns))])
            s = forest_scores(forest, x, size) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(s > 0.5)], names=["key", "score", "is_anomaly"])

    from pyspark import cloudpickle

    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return rows.mapInArrow(score, f"key {kind}, score double, is_anomaly boolean").withColumnRenamed("key", key)
