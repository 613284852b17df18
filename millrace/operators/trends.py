"""Trends with filled gaps, comparison of periods, and period labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FREQUENCIES = {"day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}


def frequency(freq: str) -> str:
    """A known frequency; unknown ones count as month."""
    f = {"d": "day", "daily": "day", "w": "week", "weekly": "week", "m": "month", "monthly": "month", "q": "quarter", "quarterly": "quarter", "y": "year", "yearly": "year"}.get(freq.lower(), freq.lower())
    return f if f in FREQUENCIES else "month"


def period_start(c: Column, freq: str) -> Column:
    return F.to_date(F.date_trunc(frequency(freq), c))


def period_end(start: Column, freq: str) -> Column:
    """The last day of a period; weeks end on Sunday."""
    f = frequency(freq)
    if f == "day":
        return start
    if f == "week":
        return F.date_add(start, 6)
    return F.last_day(F.add_months(start, {"month": 0, "quarter": 2, "year": 11}[f]))


def period_label(c: Column, freq: str) -> Column:
    """2024-01-31 as 2024-01-31, 2024-01-29/2024-02-04, 2024-01, 2024Q1 or 2024."""
    f, start = frequency(freq), period_start(c, freq)
    if f == "week":
        return F.concat(start.cast("string"), F.lit("/"), F.date_add(start, 6).cast("string"))
    if f == "quarter":
        return F.concat(F.year(start).cast("string"), F.lit("Q"), F.quarter(start).cast("string"))
    return F.date_format(start, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[f])


def trend(df: DataFrame, date: str, value: str, freq: str = "month", digits: int = 2) -> DataFrame:
    """(period, value, pct_change, rose_from_zero): sums by period, empty periods 0, labelled by their last day."""
    rows = df.select(F.col(date).alias("d"), F.col(value).cast("double").alias("v")).filter("d is not null and v is not null")
    sums = rows.groupBy(period_start(F.col("d"), freq).alias("s")).agg(F.sum("v").alias("v"))
    step = F.expr(f"interval {FREQUENCIES[frequency(freq)]}")
    spine = sums.agg(F.min("s").alias("a"), F.max("s").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b", step)).alias("s"))
    filled = spine.join(sums, "s", "left").select("s", F.coalesce("v", F.lit(0.0)).alias("v"))
    # One row per period: years of days at most, whatever the size of the data.
    before = F.lag("v").over(Window.partitionBy(F.lit(0)).orderBy("s"))
    filled = filled.withColumn("p", before)
    return filled.select(
        period_end(F.col("s"), freq).alias("period"),
        F.round("v", digits).alias("value"),
        F.round(F.try_divide((F.col("v") - F.col("p")) * 100, F.col("p")), digits).alias("pct_change"),
        F.coalesce((F.col("p") == 0) & (F.col("v") != 0), F.lit(False)).alias("rose_from_zero"),
    )


def trend_summary(df: DataFrame, date: str, value: str, freq: str = "month") -> DataFrame:
    """One row: first and last value, direction, total change, largest drop and rise with their periods (earliest wins)."""
    t = trend(df, date, value, freq, 6)
    change = F.when(F.col("rose_from_zero"), F.lit(float("inf"))).otherwise(F.col("pct_change"))
    t = t.withColumn("c", change).withColumn("back", -F.datediff("period", F.lit("1970-01-01").cast("date")))
    s = t.agg(
        F.min_by("value", "period").alias("first_value"),
        F.max_by("value", "period").alias("last_value"),
        F.max(F.when(F.col("c") > 0, F.struct("c", "back", "period"))).alias("rise"),
        F.max(F.when(F.col("c") < 0, F.struct((-F.col("c")).alias("c"), "back", "period"))).alias("drop"),
    )
    change_total = F.col("last_value") - F.col("first_value")
    return s.select(
        F.round("first_value", 2).alias("first_value"),
        F.round("last_value", 2).alias("last_value"),
        F.when(change_total > 0, "increasing").when(change_total < 0, "decreasing").otherwise("flat").alias("direction"),
        F.round(F.try_divide(change_total * 100, "first_value"), 2).alias("total_change_percent"),
        F.col("drop.period").alias("drop_period"),
        F.round(-F.col("drop.c"), 2).alias("drop_percent"),
        F.col("rise.period").alias("rise_period"),
        F.round(F.when(F.col("rise.c") == float("inf"), None).otherwise(F.col("rise.c")), 2).alias("rise_percent"),
    )


def last_two_periods(df: DataFrame, date: str, value: str, freq: str = "month") -> DataFrame:
    """One row (a, b): the last two periods that occur."""
    starts = df.filter(F.col(date).isNotNull() & F.col(value).isNotNull()).select(period_start(F.col(date), freq).alias("s")).distinct()
    last = starts.orderBy(F.desc("s")).limit(2)
    return last.agg(F.min("s").alias("a"), F.max("s").alias("b")).filter("a < b")


def compare_periods(df: DataFrame, date: str, value: str, freq: str = "month", period_a: str | None = None, period_b: str | None = None, group: str | None = None) -> DataFrame:
    """value_a, value_b, change, percent and direction of two periods, by group if one is given.

    Periods are named by any day in them; without names the last two that occur are
    compared.  Rows without group are left out, groups without a period count as 0.
    """
    rows = df.select(period_start(F.col(date), freq).alias("s"), F.col(value).cast("double").alias("v"), *([F.col(group).alias("category")] if group else []))
    rows = rows.filter("s is not null and v is not null")
    if (period_a is None) != (period_b is None):
        period_a = period_b = None
    if period_a:
        pair = df.sparkSession.range(1).select(period_start(F.lit(period_a).cast("date"), freq).alias("a"), period_start(F.lit(period_b).cast("date"), freq).alias("b"))
    else:
        pair = last_two_periods(df, date, value, freq)
    both = rows.join(F.broadcast(pair), F.col("s").isin(F.col("a"), F.col("b")))  # pair is one row
    if group:
        both = both.filter("category is not null")
    sums = both.groupBy("a", "b", *(["category"] if group else [])).agg(
        F.coalesce(F.sum(F.when(F.col("s") == F.col("a"), F.col("v"))), F.lit(0.0)).alias("x"),
        F.coalesce(F.sum(F.when(F.col("s") == F.col("b"), F.col("v"))), F.lit(0.0)).alias("y"),
    )
    d = F.col("y") - F.col("x")
    return sums.select(
        *(["category"] if group else []),
        period_label(F.col("a"), freq).alias("period_a"),
        period_label(F.col("b"), freq).alias("period_b"),
        F.round("x", 2).alias("value_a"),
        F.round("y", 2).alias("value_b"),
        F.round(d, 2).alias("absolute_change"),
        F.round(F.try_divide(d * 100, "x"), 2).alias("percent_change"),
        F.when(d > 0, "increase").when(d < 0, "decrease").otherwise("no change").alias("direction"),
    )


def growth_ranking(df: DataFrame, date: str, value: str, group: str, freq: str = "month", top: int = 5, best: bool = True) -> DataFrame:
    """The groups that grew, or fell, most in percent; groups without a base are left out."""
    found = compare_periods(df, date, value, freq, group=group).filter("percent_change is not null")
    order = F.desc("percent_change") if best else F.asc("percent_change")
    return found.orderBy(order, "category").limit(top)
