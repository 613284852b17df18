"""Mutual information of continuous columns, from distances to nearest neighbours.

Two estimators: for a number and a class (Ross 2014), and for two numbers (Kraskov,
Stoegbauer and Grassberger 2004).  Both take the ball that reaches a point's k-th neighbour and
count who else lies in it; where the k-th neighbour is at distance 0 the ball is the point
and all its equals are counted (Gao et al. 2017), so repeated values do no harm.

The estimate is made on a sample of at most ``SAMPLE`` rows, chosen by a hash of the row
and so the same in every run; columns are estimated in tasks of their own.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .analysis import numeric_columns

#: Rows of the sample, neighbours, and values up to which a number is a class.
SAMPLE, NEIGHBOURS, CLASSES = 20_000, 3, 20
_EULER = 0.5772156649015329


def digamma(n: np.ndarray) -> np.ndarray:
    """The digamma function of positive whole numbers."""
    harmonic = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, max(2, int(n.max()))))])
    return harmonic[n - 1] - _EULER


def _reach(values: np.ndarray, k: int) -> np.ndarray:
    """Distance from each of the sorted values to its k-th neighbour: of all runs of k + 1 around it, the closest."""
    n, out = len(values), np.full(len(values), np.inf)
    for before in range(k + 1):
        first = np.arange(n) - before
        fits = (first >= 0) & (first + k < n)
        i = first[fits]
        out[fits] = np.minimum(out[fits], np.maximum(values[i + before] - values[i], values[i + k] - values[i + before]))
    return out


def _within(values: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Number of sorted ``values`` nearer to each centre than its radius; at a radius of 0, equal to it."""
    distinct, counts = np.unique(values, return_counts=True)
    upto = np.concatenate([[0], np.cumsum(counts)])
    low, high = np.searchsorted(distinct, centres - radius), np.searchsorted(distinct, centres + radius, side="right")
    inside = lambda at: np.where(radius > 0, np.abs(distinct[np.clip(at, 0, len(distinct) - 1)] - centres) < radius, distinct[np.clip(at, 0, len(distinct) - 1)] == centres)
    for _ in range(2):  # sums are rounded: the ends are decided by the distance itself
        low = np.where((low > 0) & inside(low - 1), low - 1, low)
        high = np.where((high < len(distinct)) & inside(high), high + 1, high)
    for _ in range(3):
        low = np.where((low < high) & ~inside(low), low + 1, low)
        high = np.where((high > low) & ~inside(high - 1), high - 1, high)
    return upto[high] - upto[low]


def with_class(x: np.ndarray, y: np.ndarray, k: int = NEIGHBOURS) -> float:
    """Mutual information in nats of a number and a class; classes of one row do not count."""
    codes, sizes = np.unique(y, return_inverse=True, return_counts=True)[1:]
    keep = sizes[codes] > 1
    x, codes = x[keep], codes[keep]
    if not len(x):
        return 0.0
    radius, own = np.zeros(len(x)), np.zeros(len(x), int)
    for code in np.unique(codes):
        at = np.flatnonzero(codes == code)
        at = at[np.argsort(x[at], kind="stable")]
        radius[at] = _reach(x[at], min(k, len(at) - 1))
        own[at] = _within(x[at], x[at], radius[at])
    everyone = _within(np.sort(x), x, radius)
    sizes = np.bincount(codes)[codes]
    return max(0.0, float(digamma(np.array([len(x)]))[0] + np.mean(digamma(own)) - np.mean(digamma(sizes)) - np.mean(digamma(everyone))))


def with_number(x: np.ndarray, y: np.ndarray, k: int = NEIGHBOURS) -> float:
    """Mutual information in nats of two numbers; distances are the larger of both, in standard deviations."""
    n = len(x)
    if n <= k:
        return 0.0
    x, y = (v / s if (s := v.std()) > 0 else v for v in (x, y))
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    radius, same = np.zeros(n), np.zeros(n, int)
    near = 16 * k
    for start in range(0, n, 256):
        own = np.arange(start, min(n, start + 256))
        # neighbours in x bound the k-th distance; whoever is nearer lies within it in x as well
        lo, hi = max(0, start - near), min(n, start + 256 + near)
        bound = np.partition(np.maximum(np.abs(x[own, None] - x[lo:hi]), np.abs(y[own, None] - y[lo:hi])), k, axis=1)[:, k].max()
        lo, hi = np.searchsorted(x, x[own[0]] - bound), np.searchsorted(x, x[own[-1]] + bound, side="right")
        apart = np.maximum(np.abs(x[own, None] - x[lo:hi]), np.abs(y[own, None] - y[lo:hi]))
        radius[own] = np.partition(apart, k, axis=1)[:, k]
        same[own] = np.where(radius[own] > 0, (apart < radius[own, None]).sum(axis=1), (apart == 0).sum(axis=1))
    in_x, in_y = _within(x, x, radius), _within(np.sort(y), y, radius)
    return max(0.0, float(digamma(np.array([n]))[0] + np.mean(digamma(same)) - np.mean(digamma(in_x)) - np.mean(digamma(in_y))))


def neighbour_information(df: DataFrame, columns: list[str], target: str, *, k: int = NEIGHBOURS, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """(column, mi, n): mutual information in nats of each column with the target, and the rows it was estimated on.

    Numbers are continuous, all else is a class, and so is a target with at most ``CLASSES`` different
    numbers; two classes are compared by counts.  Rows without target, and for each column those without
    value, NaN or infinite, are left out.  Columns with fewer than two rows left have 0.
    """
    numbers = set(numeric_columns(df))
    known = df.filter(F.col(f"`{target}`").isNotNull())
    names = [c for c in columns if c != target]
    pick = known.select(F.xxhash64(*[F.col(f"`{c}`") for c in (*names, target)], F.lit(seed)).alias("_h"), *[F.col(f"`{c}`") for c in (*names, target)])
    rows = pick.orderBy("_h").limit(sample)
    classes = target not in numbers or known.select(f"`{target}`").distinct().limit(CLASSES + 1).count() <= CLASSES

    def cell(c: str, numeric: bool):
        value = F.col(f"`{c}`").cast("double")
        usable = ~(F.isnan(value) | (F.abs(value) == float("inf")))
        return (F.when(usable, value) if numeric else F.lit(None).cast("double")), (F.lit(None).cast("string") if numeric else F.col(f"`{c}`").cast("string"))

    y_number, y_class = cell(target, not classes)
    cells = []
    for c in names:
        number, text = cell(c, c in numbers)
        cells.append(F.struct(F.lit(c).alias("column"), number.alias("x"), text.alias("x_class"), y_number.alias("y"), y_class.alias("y_class")))
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, mi double, n long")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

    def estimate(part: pd.DataFrame) -> pd.DataFrame:
        name = part["column"].iloc[0]
        x, y = ("x", "x_class") if part["x"].notna().any() else ("x_class", "x"), ("y", "y_class") if part["y"].notna().any() else ("y_class", "y")
        part = part[part[x[0]].notna() & part[y[0]].notna()]
        a, b = part[x[0]].to_numpy(), part[y[0]].to_numpy()
        if len(part) < 2:
            mi = 0.0
        elif x[0] == "x":
            mi = with_number(a.astype(float), b.astype(float), k) if y[0] == "y" else with_class(a.astype(float), b.astype(str), k)
        elif y[0] == "y":
            mi = with_class(b.astype(float), a.astype(str), k)
        else:
            joint = pd.crosstab(a, b).to_numpy() / len(part)
            apart = joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True)
            mi = float((joint[joint > 0] * np.log(joint[joint > 0] / apart[joint > 0])).sum())
        return pd.DataFrame({"column": [name], "mi": [mi], "n": [len(part)]})

    return rows.select(F.inline(F.array(*cells))).groupBy("column").applyInPandas(estimate, "column string, mi double, n long")
