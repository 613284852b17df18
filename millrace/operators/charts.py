"""Chart data as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from .analysis import compare_categories, correlations, numeric_columns, value_counts
from .quantiles import grouped_quantiles, quantiles


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, count) of equal bins; the last holds its upper end.  Empty bins count 0."""
    x = F.col(f"`{column}`").cast("double")
    span = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).filter("a is not null")
    rows = df.select(x.alias("x")).filter("x is not null").crossJoin(F.broadcast(span))  # span is one row
    width = (F.col("b") - F.col("a")) / bins
    number = F.when(F.col("b") == F.col("a"), F.lit(0)).otherwise(F.least(F.floor((F.col("x") - F.col("a")) / width), F.lit(bins - 1)))
    counts = rows.groupBy(number.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = span.select("a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    low = F.col("a") + F.col("bin") * width
    return spine.join(counts, "bin", "left").select("bin", F.round(low, 4).alias("low"), F.round(low + width, 4).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def integer_histogram(df: DataFrame, column: str) -> DataFrame:
    """(value, count) for whole numbers with few distinct values."""
    return df.filter(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").cast("long").alias("value")).agg(F.count(F.lit(1)).alias("count"))


def uses_integer_bins(df: DataFrame, column: str, most: int = 20) -> bool:
    x = F.col(f"`{column}`")
    r = df.agg(F.count_if(x != F.floor(x)).alias("f"), F.count_distinct(x).alias("d")).first()
    return r["f"] == 0 and r["d"] <= most


def bar_chart(df: DataFrame, column: str, top: int = 15) -> DataFrame:
    return value_counts(df, column, top)


def box_plot(df: DataFrame, column: str, category: str | None = None) -> DataFrame:
    """median, q1 and q3, by category if one is given."""
    probs, names = [0.25, 0.5, 0.75], ("q1", "median", "q3")
    if category is None:
        values = quantiles(df, {column: F.col(f"`{column}`")}, probs)[column][1]
        return df.sparkSession.createDataFrame([tuple(values)], "q1 double, median double, q3 double").select(*[F.round(n, 4).alias(n) for n in names])
    grouped = df.filter(F.col(f"`{category}`").isNotNull()).select(F.col(f"`{category}`").alias("category"), F.col(f"`{column}`").alias("value"))
    found = grouped_quantiles(grouped, ["category"], "value", probs).select("category", "q")
    found = grouped.select("category").distinct().join(found, "category", "left")
    return found.select("category", *[F.round(F.col("q")[k], 4).alias(n) for k, n in enumerate(names)])


def identifier_columns(df: DataFrame) -> list[str]:
    """Numeric columns that name rows rather than measure them."""
    named = [c for c in numeric_columns(df) if N.looks_like_id(c)]
    if not named:
        return []
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(f"`{c}`").alias(f"d_{c}") for c in named]).first()
    return [c for c in named if r[f"d_{c}"] >= 0.98 * r["n"]]


def correlation_heatmap(df: DataFrame) -> DataFrame:
    ids = identifier_columns(df)
    return correlations(df, [c for c in numeric_columns(df) if c not in ids])


def scatter(df: DataFrame, x: str, y: str, points: int | None = None) -> DataFrame:
    """(x, y) of all rows that have both; of at most ``points``, chosen by a hash of the pair, if that is given."""
    rows = df.select(F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y")).dropna()
    return rows if points is None else rows.orderBy(F.xxhash64("x", "y"), "x", "y").limit(points)


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    return value_counts(df, target, None)


def category_comparison(df: DataFrame, category: str, target: str) -> DataFrame:
    return compare_categories(df, category, target)


def svg_bars(rows: list[tuple[str, float]], title: str, width: int = 640) -> str:
    """A plain bar chart as SVG text."""
    import html

    most = max((abs(v) for _, v in rows), default=1) or 1
    lines = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{40 + 24 * len(rows)}" font-family="sans-serif" font-size="12">']
    lines.append(f'<text x="8" y="20" font-size="14">{html.escape(title)}</text>')
    for k, (label, v) in enumerate(rows):
        y = 34 + 24 * k
        lines.append(f'<text x="8" y="{y + 13}">{html.escape(str(label))}</text><rect x="170" y="{y}" width="{abs(v) / most * (width - 260):.1f}" height="16" fill="#4a7ab5"/>')
        lines.append(f'<text x="{175 + abs(v) / most * (width - 260):.1f}" y="{y + 13}">{v:g}</text>')
    return "\n".join([*lines, "</svg>"])
