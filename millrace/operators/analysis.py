"""Descriptive statistics, comparison, ranking and correlation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import grouped_quantiles, quantiles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def dataset_info(df: DataFrame) -> DataFrame:
    """One row: rows, columns, duplicate_rows."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def unpivoted(df: DataFrame, aggregates: dict[str, list]) -> DataFrame:
    """The named aggregates of one scan as a row (column, ...) each."""
    wide = df.agg(*[e.alias(f"{c}\x1f{n}") for c, es in aggregates.items() for n, e in es])
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}\x1f{n}`").alias(n) for n, _ in es]) for c, es in aggregates.items()]
    return wide.select(F.inline(F.array(*rows)))


def missing_values(df: DataFrame) -> DataFrame:
    """(column, missing) of every column in one scan."""
    return unpivoted(df, {c: [("missing", F.count_if(F.col(f"`{c}`").isNull()))] for c in df.columns})


def statistics(df: DataFrame, columns: list[str] | None = None, digits: int = 3) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max of the numeric columns, a row each."""
    columns = columns or numeric_columns(df)
    q = quantiles(df, {c: F.col(f"`{c}`") for c in columns}, [0.25, 0.5, 0.75])

    def of(c: str) -> list:
        x = F.col(f"`{c}`").cast("double")
        r = lambda e: F.round(e, digits)
        quarters = [(n, r(F.lit(v).cast("double"))) for n, v in zip(("q25", "q50", "q75"), q[c][1], strict=True)]
        return [("count", F.count(x)), ("mean", r(F.avg(x))), ("std", r(F.stddev_samp(x))), ("min", r(F.min(x))), *quarters, ("max", r(F.max(x)))]

    return unpivoted(df, {c: of(c) for c in columns})


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """analyze_column for a number: distinct and missing values, mean, median, min, max."""
    x = F.col(f"`{column}`")
    median = quantiles(df, {column: x}, [0.5])[column][1][0]
    return df.agg(
        F.count_distinct(x).alias("unique_values"),
        F.count_if(x.isNull()).alias("missing_values"),
        F.round(F.avg(x), 4).alias("mean"),
        F.round(F.lit(median).cast("double"), 4).alias("median"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )


def value_counts(df: DataFrame, column: str, top: int | None = 10) -> DataFrame:
    """(value, count) of the most frequent values; ties by value."""
    counts = df.filter(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    ordered = counts.orderBy(F.desc("count"), F.asc("value"))
    return ordered.limit(top) if top else counts


def compare_categories(df: DataFrame, category: str, target: str, digits: int = 4) -> DataFrame:
    """(category, count, mean) of a target by category; rows without category are left out."""
    return (
        df.filter(F.col(f"`{category}`").isNotNull())
        .groupBy(F.col(f"`{category}`").alias("category"))
        .agg(F.count(f"`{target}`").alias("count"), F.round(F.avg(f"`{target}`"), digits).alias("mean"))
    )


AGGREGATES = {"sum": F.sum, "mean": F.avg, "count": F.count, "median": None}


def rank_categories(df: DataFrame, category: str, metric: str, aggregation: str = "sum", top_n: int = 5) -> DataFrame:
    """(rank_type, place, category, value): the best and the worst categories; ties by category."""
    if aggregation not in AGGREGATES:
        raise ValueError(f"Unknown aggregation '{aggregation}'. Use one of {sorted(AGGREGATES)}.")
    if metric not in numeric_columns(df):
        raise ValueError(f"Column '{metric}' is not numeric.")
    n = max(1, min(25, top_n))
    rows = df.filter(F.col(f"`{category}`").isNotNull()).select(F.col(f"`{category}`").alias("category"), F.col(f"`{metric}`").alias("metric"))
    if aggregation == "median":
        grouped = grouped_quantiles(rows, ["category"], "metric", [0.5]).select("category", F.round(F.col("q")[0], 4).alias("value"))
    else:
        grouped = rows.groupBy("category").agg(F.round(AGGREGATES[aggregation]("metric").cast("double"), 4).alias("value")).filter("value is not null")
    parts = []
    for kind, order in (("top", F.desc("value")), ("bottom", F.asc("value"))):
        best = grouped.orderBy(order, F.asc("category")).limit(n)
        listed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("value") if kind == "top" else F.col("value")).alias("k"), "category", "value"))).alias("l"))
        parts.append(listed.select(F.lit(kind).alias("rank_type"), F.posexplode("l")).select("rank_type", (F.col("pos") + 1).cast("long").alias("place"), "col.category", "col.value"))
    return parts[0].unionByName(parts[1])


def correlations(df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> DataFrame:
    """(column_a, column_b, r) of all pairs over rows where both are present, in one aggregate."""
    pairs = list(combinations(columns or numeric_columns(df), 2))
    wide = df.agg(*[F.corr(f"`{a}`", f"`{b}`").alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.round(F.col(f"r{k}"), digits).alias("r")) for k, (a, b) in enumerate(pairs)]
    return wide.select(F.inline(F.array(*rows))).filter("r is not null and not isnan(r)")


def strongest_correlations(df: DataFrame, columns: list[str] | None = None, top: int = 5) -> DataFrame:
    """The pairs with the largest absolute r, exact lines apart."""
    return correlations(df, columns).filter("abs(r) < 1").orderBy(F.desc(F.abs("r")), "column_a", "column_b").limit(top)


def outlier_counts(df: DataFrame, columns: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(column, outliers) beyond 1.5 interquartile ranges, of the numeric columns, the first ``most`` if that is given."""
    columns = (columns or numeric_columns(df))[:most]
    q = quantiles(df, {c: F.col(f"`{c}`") for c in columns}, [0.25, 0.75])

    def beyond(c: str):
        low, high = (F.lit(v).cast("double") for v in q[c][1])
        return F.count_if((F.col(f"`{c}`") < low - 1.5 * (high - low)) | (F.col(f"`{c}`") > high + 1.5 * (high - low)))

    return unpivoted(df, {c: [("outliers", beyond(c))] for c in columns})
