"""The tools by name: results and failures are values, never exceptions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import analysis, anomaly, charts, integrate, ml, report, search, sql, trends
from .operators.profile import profile

TOOLS: dict[str, Callable[..., dict]] = {}


def tool(f: Callable[..., dict]) -> Callable[..., dict]:
    TOOLS[f.__name__] = f
    return f


def _rows(df: DataFrame) -> list[dict]:
    return [report.plain(r.asDict(recursive=True)) for r in df.collect()]


def _need(df: DataFrame, *columns: str | None) -> None:
    for c in columns:
        if c is not None and c not in df.columns:
            raise ValueError(f"Column '{c}' not found. Available columns: {df.columns}")


def _number(df: DataFrame, *columns: str) -> None:
    _need(df, *columns)
    for c in columns:
        if c not in analysis.numeric_columns(df):
            raise ValueError(f"Column '{c}' is not numeric.")


@tool
def get_dataset_info(df: DataFrame) -> dict:
    info = analysis.dataset_info(df).first()
    return {
        "rows": info["rows"], "columns": info["columns"], "column_names": df.columns, "data_types": dict(df.dtypes),
        "missing_values": {r["column"]: r["missing"] for r in analysis.missing_values(df).collect()}, "duplicate_rows": info["duplicate_rows"],
    }


@tool
def get_dataset_statistics(df: DataFrame) -> dict:
    if not analysis.numeric_columns(df):
        return {"message": "No numeric columns."}
    names = {"q25": "25%", "q50": "50%", "q75": "75%"}
    return {r["column"]: {names.get(k, k): v for k, v in r.items() if k != "column"} for r in _rows(analysis.statistics(df))}


@tool
def get_dataset_profile(df: DataFrame) -> dict:
    p = profile(df)
    numbers = analysis.numeric_columns(df)
    return {
        "rows": p.rows, "columns": len(df.columns), "numeric_columns": numbers, "categorical_columns": [c for c in df.columns if c not in numbers],
        "missing_percent_by_column": {n: c.missing_percent for n, c in p.columns.items()}, "duplicate_rows": p.duplicate_rows,
        "outlier_counts_by_column": {r["column"]: r["outliers"] for r in analysis.outlier_counts(df).collect()} if numbers else {},
        "strongest_correlations": _rows(analysis.strongest_correlations(df)) if len(numbers) > 1 else [], "candidate_target_columns": integrate.candidate_targets(p),
    }


@tool
def analyze_column(df: DataFrame, column_name: str) -> dict:
    _need(df, column_name)
    out = {"column": column_name, "dtype": dict(df.dtypes)[column_name]}
    if column_name in analysis.numeric_columns(df):
        return out | _rows(analysis.numeric_summary(df, column_name))[0]
    c = F.col(f"`{column_name}`")
    r = df.agg(F.count_distinct(c).alias("unique_values"), F.count_if(c.isNull()).alias("missing_values")).first().asDict()
    return out | r | {"top_values": {x["value"]: x["count"] for x in analysis.value_counts(df, column_name).collect()}}


@tool
def compare_categories(df: DataFrame, category_column: str, target_column: str) -> dict:
    _number(df, target_column)
    _need(df, category_column)
    return {"rows": _rows(analysis.compare_categories(df, category_column, target_column).orderBy("category"))}


@tool
def rank_categories(df: DataFrame, category_column: str, metric_column: str, aggregation: str = "sum", top_n: int = 5) -> dict:
    _need(df, category_column, metric_column)
    rows = _rows(analysis.rank_categories(df, category_column, metric_column, aggregation, top_n))
    side = lambda k: [{"category": r["category"], "value": r["value"]} for r in sorted(rows, key=lambda r: r["place"]) if r["rank_type"] == k]
    return {
        "category_column": category_column, "metric_column": metric_column, "aggregation": aggregation,
        "category_count": df.agg(F.count_distinct(f"`{category_column}`")).first()[0], "top_performers": side("top"), "bottom_performers": side("bottom"),
    }


@tool
def create_churn_plot(df: DataFrame) -> dict:
    name = next((c for c in df.columns if c.lower() == "churn"), None)
    if name is None:
        return {"error": "No 'churn' column found."}
    return {"status": "success", "distribution": {r["value"]: r["count"] for r in analysis.value_counts(df, name, None).collect()}}


@tool
def create_visualization(df: DataFrame, chart_type: str, column: str | None = None, column_x: str | None = None, column_y: str | None = None, category_column: str | None = None, target_column: str | None = None) -> dict:
    _need(df, column, column_x, column_y, category_column, target_column)
    meta: dict = {}
    if chart_type == "histogram":
        _number(df, column)
        s = df.agg(F.avg(f"`{column}`").alias("mean"), F.stddev_samp(f"`{column}`").alias("std")).first()
        meta = {"mean": s["mean"], "std": s["std"]}
        data = charts.integer_histogram(df, column).orderBy("value") if charts.uses_integer_bins(df, column) else charts.histogram(df, column).orderBy("bin")
    elif chart_type == "bar_chart":
        data = charts.bar_chart(df, column)
    elif chart_type == "box_plot":
        _number(df, column)
        data = charts.box_plot(df, column, category_column)
    elif chart_type == "correlation_heatmap":
        if len(analysis.numeric_columns(df)) < 2:
            return {"error": "Need at least 2 numeric columns."}
        data = charts.correlation_heatmap(df)
    elif chart_type == "scatter_plot":
        _number(df, column_x, column_y)
        meta = {"correlation": df.agg(F.corr(f"`{column_x}`", f"`{column_y}`")).first()[0]}
        data = charts.scatter(df, column_x, column_y, 5000)  # rows for the driver
    elif chart_type == "target_distribution":
        data = charts.target_distribution(df, target_column)
    elif chart_type == "category_comparison":
        _number(df, target_column)
        data = charts.category_comparison(df, category_column, target_column)
    else:
        return {"error": f"Unknown chart type '{chart_type}'."}
    return {"status": "success", "chart_type": chart_type, "data": _rows(data), "metadata": report.plain(meta)}


@tool
def analyze_churn(df: DataFrame) -> dict:
    return ml.analyze_churn(df)


@tool
def train_model(df: DataFrame, target_column: str, task_type: str | None = None, feature_columns: list[str] | None = None) -> dict:
    _need(df, target_column, *(feature_columns or []))
    return ml.train_model(df, target_column, task_type, feature_columns)


@tool
def assess_feature_relevance(df: DataFrame, goal: str | None = None, target_column: str | None = None) -> dict:
    _need(df, target_column)
    return ml.assess_feature_relevance(df, profile(df), goal, target_column)


@tool
def detect_anomalies(df: DataFrame, column: str | None = None, date_column: str | None = None) -> dict:
    _need(df, date_column)
    if column is not None:
        _number(df, column)
        s = anomaly.summary(df, column).first()
        shown = anomaly.univariate(df, column)
        shown = shown.orderBy(F.desc(F.abs(F.col(f"`{column}`")))).limit(20)
        return report.plain({
            "method": "iqr_and_zscore", "column": column, "total_rows": s["total_rows"], "anomaly_count": s["anomaly_count"], "anomaly_rate_percent": s["anomaly_rate_percent"],
            "bounds": {"lower": s["lower_bound"], "upper": s["upper_bound"]}, "anomalies": _rows(shown), "truncated": s["anomaly_count"] > 20,
        })
    numbers = analysis.numeric_columns(df)
    keyed = df.withColumn("_row", F.monotonically_increasing_id())
    try:
        found = anomaly.multivariate(keyed, "_row", numbers)
    except ValueError:
        return {"anomalies_by_column": {r["column"]: r["outliers"] for r in analysis.outlier_counts(df).collect()} if numbers else {}}
    s = found.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("k")).first()
    return {"method": "isolation_forest", "columns_used": numbers, "total_rows": s["n"], "anomaly_count": s["k"], "anomaly_rate_percent": round(100 * s["k"] / s["n"], 2), "anomalies": _rows(found.filter("is_anomaly").orderBy(F.desc("score")).limit(20)), "truncated": s["k"] > 20}


@tool
def analyze_trends(df: DataFrame, date_column: str, value_column: str, freq: str = "month") -> dict:
    _need(df, date_column)
    _number(df, value_column)
    rows = _rows(trends.trend(df, date_column, value_column, freq).orderBy("period"))
    if len(rows) < 2:
        return {"error": "Need at least 2 periods."}
    s = trends.trend_summary(df, date_column, value_column, freq).first()
    return report.plain({
        "frequency": trends.frequency(freq), "periods": [{"period": r["period"], "value": r["value"]} for r in rows], "overall_direction": s["direction"],
        "total_change_percent": s["total_change_percent"],
        "largest_period_over_period_drop": {"period": s["drop_period"], "change_percent": s["drop_percent"]} if s["drop_period"] else None,
        "largest_period_over_period_rise": {"period": s["rise_period"], "change_percent": s["rise_percent"], "from_zero": s["rise_percent"] is None} if s["rise_period"] else None,
    })


@tool
def compare_periods(df: DataFrame, date_column: str, value_column: str, freq: str = "month", period_a: str | None = None, period_b: str | None = None, group_column: str | None = None) -> dict:
    _need(df, date_column, group_column)
    _number(df, value_column)
    rows = _rows(trends.compare_periods(df, date_column, value_column, freq, period_a, period_b))
    if not rows:
        return {"error": "Those periods are not in the data." if period_a else "Need at least 2 periods."}
    out = rows[0]
    if group_column:
        groups = [r for r in _rows(trends.compare_periods(df, date_column, value_column, freq, period_a, period_b, group_column)) if r["percent_change"] is not None]
        groups.sort(key=lambda r: (-r["percent_change"], str(r["category"])))
        out |= {"group_column": group_column, "top_growth": groups[:5], "top_decline": groups[::-1][:5]}
    return out


@tool
def run_sql_query(tables: dict[str, DataFrame], sql_query: str) -> dict:
    return sql.run_sql_query(tables, sql_query)


@tool
def semantic_search(df: DataFrame, text_column: str, query: str, top_k: int = 5) -> dict:
    _need(df, text_column)
    keyed = df.withColumn("row_index", F.monotonically_increasing_id())
    rows = _rows(search.text_search(keyed, "row_index", text_column, query, top_k))
    return {"query": query, "matches": [{"row_index": r["row_index"], "text": r[text_column], "similarity": r["similarity"]} for r in rows]}


@tool
def generate_report(df: DataFrame, target_column: str | None = None, folder: str = "outputs") -> dict:
    _need(df, target_column)
    out = report.dataset_report(df, target_column)
    paths = report.write_all("Dataset report", out, folder, "report")
    return {"status": "success", **{f"{k}_path": v for k, v in paths.items()}, "headline": out["key_insights"][0], "key_insights": out["key_insights"]}


@tool
def generate_business_report(df: DataFrame, date_column: str | None = None, value_column: str | None = None, category_column: str | None = None, target_column: str | None = None, folder: str = "outputs") -> dict:
    _need(df, date_column, value_column, category_column, target_column)
    out = report.business_report(df, None, date_column, value_column, category_column, target_column)
    paths = report.write_all("Business report", out, folder, "business_report")
    return {"status": "success", **{f"{k}_path": v for k, v in paths.items()}, **{k: out[k] for k in ("detected_columns", "key_insights", "recommendations", "charts")}}


@tool
def deliver_business_report(df: DataFrame, email_to: str | None = None, send=None, folder: str = "outputs", **columns) -> dict:
    made = generate_business_report(df, folder=folder, **columns)
    paths = {k: made[f"{k}_path"] for k in ("md", "html", "pdf", "docx")}
    return made | report.deliver(paths, email_to, send)


def dispatch(name: str, tables: dict[str, DataFrame], arguments: dict | None = None) -> dict:
    """Runs a tool; ``dataset_name`` may be left out where there is one table."""
    arguments = dict(arguments or {})
    f = TOOLS.get(name)
    if f is None:
        return {"error": f"Unknown tool '{name}'."}
    try:
        if name == "run_sql_query":
            return f(tables, **arguments)
        dataset = arguments.pop("dataset_name", None) or (next(iter(tables)) if len(tables) == 1 else None)
        if dataset not in tables:
            return {"error": f"Dataset '{dataset}' not found. Available: {sorted(tables)}"}
        out = f(tables[dataset], **arguments)
        return {k: (None if isinstance(v, float) and not math.isfinite(v) else v) for k, v in out.items()}
    except Exception as e:
        return {"error": str(e).splitlines()[0] if str(e) else type(e).__name__}
