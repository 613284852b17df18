"""The registered queries of the analytical and preparation operators, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import analysis, anomaly, charts, integrate, latent, ml, prepare, search, trends
from ..operators import profile as profiles
from ..operators import sql as sqltool
from ..streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(name: str, build: Callable[..., DataFrame], tables: str, sql: str | None) -> None:
    """``build`` takes the named tables in order."""
    names = tables.split()
    QUERIES[name] = lambda spark, sf_dir: build(*[table(spark, sf_dir, t) for t in names])
    if sql:
        ORACLE_SQL[name] = sql


# -- trends and periods ------------------------------------------------------------------

_STEP = {"day": "1 DAY", "week": "7 DAY", "month": "1 MONTH", "quarter": "3 MONTH", "year": "1 YEAR"}
_END = {
    "day": "s", "week": "s + INTERVAL 6 DAY", "month": "last_day(s)", "quarter": "last_day(s + INTERVAL 2 MONTH)", "year": "last_day(s + INTERVAL 11 MONTH)",
}


def _filled(freq: str) -> str:
    return f"""
t AS (SELECT CAST(date_trunc('{freq}', o_orderdate) AS DATE) AS s, sum(o_totalprice) AS v FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1),
sp AS (SELECT CAST(unnest(generate_series(min(s), max(s), INTERVAL {_STEP[freq]})) AS DATE) AS s FROM t),
f AS (SELECT sp.s, coalesce(t.v, 0.0) AS v FROM sp LEFT JOIN t ON sp.s = t.s),
g AS (SELECT s, v, lag(v) OVER (ORDER BY s) AS p FROM f)"""


for _freq in trends.FREQUENCIES:
    register(
        f"trend_orders_{_freq}",
        lambda o, freq=_freq: trends.trend(o, "o_orderdate", "o_totalprice", freq),
        "orders",
        f"""WITH {_filled(_freq)}
SELECT CAST({_END[_freq]} AS DATE) AS period, round(v, 2) AS value, CASE WHEN p <> 0 THEN round((v - p) * 100 / p, 2) + 0.0 END AS pct_change,
       coalesce(p = 0 AND v <> 0, false) AS rose_from_zero FROM g""",
    )

register(
    "trend_summary",
    lambda o: trends.trend_summary(o, "o_orderdate", "o_totalprice", "month"),
    "orders",
    f"""WITH {_filled("month")},
h AS (SELECT last_day(s) AS period, round(v, 6) AS v, CASE WHEN p = 0 AND v <> 0 THEN 'inf'::DOUBLE WHEN p <> 0 THEN round((v - p) * 100 / p, 6) END AS c FROM g),
e AS (SELECT arg_min(v, period) AS a, arg_max(v, period) AS b FROM h),
d AS (SELECT period, c FROM h WHERE c < 0 ORDER BY c, period LIMIT 1),
r AS (SELECT period, c FROM h WHERE c > 0 ORDER BY c DESC, period LIMIT 1)
SELECT round(a, 2) AS first_value, round(b, 2) AS last_value, CASE WHEN b > a THEN 'increasing' WHEN b < a THEN 'decreasing' ELSE 'flat' END AS direction,
       round((b - a) * 100 / a, 2) AS total_change_percent, (SELECT period FROM d) AS drop_period, round((SELECT c FROM d), 2) AS drop_percent,
       (SELECT period FROM r) AS rise_period, round((SELECT CASE WHEN isinf(c) THEN NULL ELSE c END FROM r), 2) AS rise_percent FROM e""",
)

_PAIR = "p AS (SELECT min(s) AS a, max(s) AS b FROM (SELECT DISTINCT CAST(date_trunc('{f}', o_orderdate) AS DATE) AS s FROM orders ORDER BY s DESC LIMIT 2))"
_CHANGE = """round(x, 2) AS value_a, round(y, 2) AS value_b, round(y - x, 2) AS absolute_change, CASE WHEN x <> 0 THEN round((y - x) * 100 / x, 2) END AS percent_change,
       CASE WHEN y > x THEN 'increase' WHEN y < x THEN 'decrease' ELSE 'no change' END AS direction"""
_LABEL = {"month": "strftime({c}, '%Y-%m')", "quarter": "strftime({c}, '%Y') || 'Q' || quarter({c})", "week": "CAST({c} AS VARCHAR) || '/' || CAST(CAST({c} + INTERVAL 6 DAY AS DATE) AS VARCHAR)"}
for _freq in ("week", "month", "quarter"):
    register(
        f"compare_last_two_{_freq}",
        lambda o, freq=_freq: trends.compare_periods(o, "o_orderdate", "o_totalprice", freq),
        "orders",
        f"""WITH {_PAIR.format(f=_freq)},
t AS (SELECT a, b, coalesce(sum(CASE WHEN date_trunc('{_freq}', o_orderdate) = a THEN o_totalprice END), 0) AS x,
      coalesce(sum(CASE WHEN date_trunc('{_freq}', o_orderdate) = b THEN o_totalprice END), 0) AS y FROM orders, p GROUP BY a, b)
SELECT {_LABEL[_freq].format(c="a")} AS period_a, {_LABEL[_freq].format(c="b")} AS period_b, {_CHANGE} FROM t""",
    )
_GROUPED = """t AS (SELECT o_orderpriority AS category, a, b, coalesce(sum(CASE WHEN date_trunc('month', o_orderdate) = a THEN o_totalprice END), 0) AS x,
      coalesce(sum(CASE WHEN date_trunc('month', o_orderdate) = b THEN o_totalprice END), 0) AS y FROM orders, p
      WHERE date_trunc('month', o_orderdate) IN (a, b) AND o_orderpriority IS NOT NULL GROUP BY 1, a, b)"""
register(
    "compare_by_priority",
    lambda o: trends.compare_periods(o, "o_orderdate", "o_totalprice", "month", group="o_orderpriority"),
    "orders",
    f"WITH {_PAIR.format(f='month')}, {_GROUPED} SELECT category, strftime(a, '%Y-%m') AS period_a, strftime(b, '%Y-%m') AS period_b, {_CHANGE} FROM t",
)
register(
    "compare_named_periods",
    lambda o: trends.compare_periods(o, "o_orderdate", "o_totalprice", "year", "1996-05-01", "1998-01-01"),
    "orders",
    f"""WITH t AS (SELECT coalesce(sum(o_totalprice) FILTER (year(o_orderdate) = 1996), 0) AS x, coalesce(sum(o_totalprice) FILTER (year(o_orderdate) = 1998), 0) AS y FROM orders)
SELECT '1996' AS period_a, '1998' AS period_b, {_CHANGE} FROM t""",
)
for _best in (True, False):
    register(
        "growth_top" if _best else "growth_bottom",
        lambda o, best=_best: trends.growth_ranking(o, "o_orderdate", "o_totalprice", "o_orderpriority", top=3, best=best),
        "orders",
        f"""WITH {_PAIR.format(f="month")}, {_GROUPED}, r AS (SELECT category, strftime(a, '%Y-%m') AS period_a, strftime(b, '%Y-%m') AS period_b, {_CHANGE} FROM t)
SELECT * FROM r WHERE percent_change IS NOT NULL ORDER BY percent_change {"DESC" if _best else "ASC"}, category LIMIT 3""",
    )

# -- statistics --------------------------------------------------------------------------

_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _stats_sql(t: str, columns: list[str]) -> str:
    q = lambda c, p: f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 3)"
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, round(CAST(min({c}) AS DOUBLE), 3) AS min,
{q(c, 0.25)} AS q25, {q(c, 0.5)} AS q50, {q(c, 0.75)} AS q75, round(CAST(max({c}) AS DOUBLE), 3) AS max FROM {t}"""
        for c in columns
    )


register("stats_lineitem", lambda li: analysis.statistics(li, _LINE), "lineitem", _stats_sql("lineitem", _LINE))
register("stats_customer", lambda c: analysis.statistics(c), "customer", _stats_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"]))
register("stats_part", lambda p: analysis.statistics(p, ["p_size", "p_retailprice"]), "part", _stats_sql("part", ["p_size", "p_retailprice"]))
for _t, _n in (("orders", 6), ("customer", 5), ("part", 6), ("events", 6)):
    register(
        f"info_{_t}",
        analysis.dataset_info,
        _t,
        f"SELECT (SELECT count(*) FROM {_t}) AS rows, CAST({_n} AS BIGINT) AS columns, (SELECT count(*) FROM {_t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_t})) AS duplicate_rows",
    )
register(
    "missing_values",
    lambda c: analysis.missing_values(c.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), "c_mktsegment")),
    "customer",
    """SELECT 'c_custkey' AS "column", count(*) - count(c_custkey) AS missing FROM customer UNION ALL
SELECT 'balance', count(*) FILTER (NOT coalesce(c_acctbal >= 0, false)) FROM customer UNION ALL SELECT 'c_mktsegment', count(*) - count(c_mktsegment) FROM customer""",
)
for _t, _c in (("lineitem", "l_extendedprice"), ("customer", "c_acctbal"), ("part", "p_size")):
    register(
        f"analyze_column_{_c}",
        lambda d, c=_c: analysis.numeric_summary(d, c),
        _t,
        f"""SELECT count(DISTINCT {_c}) AS unique_values, count(*) - count({_c}) AS missing_values, round(avg({_c}), 4) AS mean,
round(quantile_cont(CAST({_c} AS DOUBLE), 0.5), 4) AS median, min({_c}) AS min, max({_c}) AS max FROM {_t}""",
    )
for _t, _c in (("customer", "c_mktsegment"), ("part", "p_type"), ("events", "event_type")):
    register(
        f"value_counts_{_c}",
        lambda d, c=_c: analysis.value_counts(d, c, 10),
        _t,
        f"SELECT {_c} AS value, count(*) AS count FROM {_t} WHERE {_c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    )
register(
    "compare_categories",
    lambda li: analysis.compare_categories(li, "l_returnflag", "l_discount"),
    "lineitem",
    "SELECT l_returnflag AS category, count(l_discount) AS count, round(avg(l_discount), 4) AS mean FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1",
)
_AGG = {"sum": "sum(o_totalprice)", "mean": "avg(o_totalprice)", "count": "count(o_totalprice)", "median": "median(o_totalprice)"}
for _a, _e in _AGG.items():
    register(
        f"rank_segment_{_a}",
        lambda c, o, a=_a: analysis.rank_categories(c.join(o, F.col("c_custkey") == F.col("o_custkey")), "c_mktsegment", "o_totalprice", a, 3),
        "customer orders",
        f"""WITH g AS (SELECT c_mktsegment AS category, round(CAST({_e} AS DOUBLE), 4) AS value FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1),
t AS (SELECT 'top' AS rank_type, row_number() OVER (ORDER BY value DESC, category) AS place, category, value FROM g),
b AS (SELECT 'bottom' AS rank_type, row_number() OVER (ORDER BY value, category) AS place, category, value FROM g)
SELECT * FROM t WHERE place <= 3 UNION ALL SELECT * FROM b WHERE place <= 3""",
    )


def _corr_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 4) AS r FROM lineitem" for k, a in enumerate(_LINE) for b in _LINE[k + 1 :])


register("correlations", lambda li: analysis.correlations(li, _LINE), "lineitem", _corr_sql())
register("correlations_top", lambda li: analysis.strongest_correlations(li, _LINE, 3), "lineitem", f"SELECT * FROM ({_corr_sql()}) WHERE abs(r) < 1 ORDER BY abs(r) DESC, column_a, column_b LIMIT 3")


def _fence(t: str, c: str) -> str:
    return f"f AS (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3, avg({c}) AS m, stddev_samp({c}) AS s, count({c}) AS n FROM {t})"


register(
    "outlier_counts",
    lambda li: analysis.outlier_counts(li, _LINE),
    "lineitem",
    " UNION ALL ".join(
        f"""(WITH {_fence("lineitem", c)} SELECT '{c}' AS "column", count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers FROM lineitem, f)""" for c in _LINE
    ),
)
for _t, _k, _c in (("lineitem", "l_orderkey, l_linenumber", "l_extendedprice"), ("customer", "c_custkey", "c_acctbal"), ("events", "event_id", "value")):
    register(
        f"anomalies_{_t}",
        lambda d, k=_k, c=_c: anomaly.univariate(d, c).select(*k.split(", "), c, "is_iqr", "is_z"),
        _t,
        f"""WITH {_fence(_t, _c)}, r AS (SELECT {_k}, {_c}, coalesce(n >= 4 AND q3 <> q1 AND ({_c} < q1 - 1.5 * (q3 - q1) OR {_c} > q3 + 1.5 * (q3 - q1)), false) AS is_iqr,
coalesce(n >= 4 AND s > 0 AND abs({_c} - m) > 3 * s, false) AS is_z FROM {_t}, f) SELECT * FROM r WHERE is_iqr OR is_z""",
    )
register(
    "anomaly_summary",
    lambda e: anomaly.summary(e, "value"),
    "events",
    f"""WITH {_fence("events", "value")}, r AS (SELECT count(*) AS total_rows, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) OR abs(value - m) > 3 * s) AS anomaly_count,
round(any_value(q1 - 1.5 * (q3 - q1)), 4) AS lower_bound, round(any_value(q3 + 1.5 * (q3 - q1)), 4) AS upper_bound FROM events, f)
SELECT *, round(anomaly_count * 100.0 / total_rows, 2) AS anomaly_rate_percent FROM r""",
)
register("isolation_forest", lambda li: anomaly.multivariate(li.withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "key", _LINE, trees=50), "lineitem", None)

# -- chart data --------------------------------------------------------------------------

register(
    "histogram_20",
    lambda li: charts.histogram(li, "l_extendedprice"),
    "lineitem",
    """WITH s AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem),
n AS (SELECT CAST(least(floor((l_extendedprice - a) / ((b - a) / 20)), 19) AS BIGINT) AS bin, count(*) AS c FROM lineitem, s GROUP BY 1)
SELECT CAST(k AS BIGINT) AS bin, round(a + k * ((b - a) / 20), 4) AS low, round(a + k * ((b - a) / 20) + (b - a) / 20, 4) AS high, coalesce(c, 0) AS count
FROM s, range(0, 20) AS r(k) LEFT JOIN n ON n.bin = k""",
)
register("histogram_integer", lambda p: charts.integer_histogram(p, "p_size"), "part", "SELECT CAST(p_size AS BIGINT) AS value, count(*) AS count FROM part WHERE p_size IS NOT NULL GROUP BY 1")
register("bar_chart", lambda p: charts.bar_chart(p, "p_brand"), "part", "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
_BOX = "round(quantile_cont(CAST(l_quantity AS DOUBLE), 0.25), 4) AS q1, round(quantile_cont(CAST(l_quantity AS DOUBLE), 0.5), 4) AS median, round(quantile_cont(CAST(l_quantity AS DOUBLE), 0.75), 4) AS q3"
register("box_plot", lambda li: charts.box_plot(li, "l_quantity"), "lineitem", f"SELECT {_BOX} FROM lineitem")
register("box_plot_by_flag", lambda li: charts.box_plot(li, "l_quantity", "l_returnflag"), "lineitem", f"SELECT l_returnflag AS category, {_BOX} FROM lineitem GROUP BY 1")
register("target_distribution", lambda x: charts.target_distribution(x, "toxic"), "labels", "SELECT CAST(toxic AS VARCHAR) AS value, count(*) AS count FROM labels GROUP BY 1")
register("category_comparison", lambda o: charts.category_comparison(o, "o_orderstatus", "o_totalprice"), "orders", "SELECT o_orderstatus AS category, count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
register("scatter_points", lambda p: charts.scatter(p, "p_size", "p_retailprice"), "part",
    "SELECT CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL")
register("heatmap", lambda o: charts.correlation_heatmap(o.select("o_totalprice", F.dayofmonth("o_orderdate").alias("day"), F.month("o_orderdate").alias("month"))), "orders",
    " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({x}, {y}), 4) AS r FROM orders" for a, x, b, y in (
        ("o_totalprice", "o_totalprice", "day", "day(o_orderdate)"), ("o_totalprice", "o_totalprice", "month", "month(o_orderdate)"), ("day", "day(o_orderdate)", "month", "month(o_orderdate)"))))

# -- duplicates and profile ----------------------------------------------------------------

register(
    "duplicate_rows_removed",
    lambda li: prepare.drop_duplicate_rows(li.select("l_partkey", "l_suppkey", "l_returnflag")),
    "lineitem",
    "SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem",
)
register(
    "duplicates_keep_first",
    lambda e: prepare.drop_duplicate_rows(e.select("event_id", "user_id", "event_type"), order="event_id"),
    "events",
    "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type",
)
register(
    "duplicate_keys",
    lambda o: prepare.duplicate_keys(o, ["o_orderkey", "o_custkey", "o_orderpriority"]),
    "orders",
    " UNION ALL ".join(f"""SELECT * FROM (SELECT '{c}' AS "column", count({c}) - count(DISTINCT {c}) AS duplicate_values FROM orders) WHERE duplicate_values > 0""" for c in ("o_orderkey", "o_custkey", "o_orderpriority")),
)
for _t, _cs in (("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]), ("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])):
    register(
        f"profile_distinct_{_t}",
        lambda d: profiles.distinct_counts(d),
        _t,
        " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct, count(DISTINCT lower(trim(CAST({c} AS VARCHAR)))) AS folded FROM {_t}""" for c in _cs),
    )
register(
    "top_values",
    lambda p: profiles.top_values(p, ["p_brand", "p_type"], 3),
    "part",
    " UNION ALL ".join(f"""SELECT * FROM (SELECT '{c}' AS "column", {c} AS value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, {c}) AS place FROM part GROUP BY {c}) WHERE place <= 3""" for c in ("p_brand", "p_type")),
)

# -- preparation rules on dirtied columns ------------------------------------------------------

_SEG = "c_mktsegment"


def _dirty(kind: str):
    """Segments with spaces, placeholders and other cases, by the key."""
    k = F.col("c_custkey") % 6
    return (
        F.when(k == 0, F.concat(F.lit("  "), F.col(_SEG), F.lit(" ")))
        .when(k == 1, F.lower(_SEG))
        .when(k == 2, F.lit(" N/A "))
        .when(k == 3, F.lit("unknown"))
        .when(k == 4, F.concat_ws("  ", F.col(_SEG), F.lit("x")))
        .otherwise(F.col(_SEG))
    )


_DIRTY_SQL = """CASE c_custkey % 6 WHEN 0 THEN '  ' || c_mktsegment || ' ' WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN ' N/A ' WHEN 3 THEN 'unknown'
WHEN 4 THEN c_mktsegment || '  x' ELSE c_mktsegment END"""
_STRIP = r"regexp_replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
_NULLS = ", ".join("'" + t.replace("'", "''") + "'" for t in C.NULL_TOKENS)
register(
    "profile_counts",
    lambda c: profiles.column_counts(c.select("c_custkey", "c_acctbal", _dirty("c").alias("c"))).select("column", "n", "missing", "null_like", "spaced", "negative"),
    "customer",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n, count(*) - count({c}) AS missing, 0::BIGINT AS null_like, 0::BIGINT AS spaced, count(*) FILTER ({c} < 0) AS negative FROM customer"""
        for c in ("c_custkey", "c_acctbal")
    )
    + f""" UNION ALL SELECT 'c', count(*), count(*) - count(v), count(*) FILTER (lower(trim(v)) IN ({_NULLS})), count(*) FILTER (v <> {_STRIP.format(c='v')}),
    count(*) FILTER (TRY_CAST(v AS DOUBLE) < 0) FROM (SELECT {_DIRTY_SQL} AS v FROM customer)""",
)
register("strip_whitespace", lambda c: prepare.strip_whitespace(c.select("c_custkey", _dirty("c").alias("v"))), "customer", f"SELECT c_custkey, {_STRIP.format(c=_DIRTY_SQL)} AS v FROM customer")
register("null_like", lambda c: prepare.normalize_null_like(c.select("c_custkey", _dirty("c").alias("v"))), "customer",
    f"WITH d AS (SELECT c_custkey, {_DIRTY_SQL} AS v FROM customer) SELECT c_custkey, CASE WHEN lower(trim(v)) IN ({_NULLS}) THEN NULL ELSE v END AS v FROM d")
register("normalize_categories", lambda c: prepare.normalize_categories(c.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lower(_SEG)).otherwise(F.col(_SEG)).alias("v")), "v"), "customer",
    """WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS v FROM customer),
m AS (SELECT lower(trim(v)) AS k, v, row_number() OVER (PARTITION BY lower(trim(v)) ORDER BY count(*) DESC, v DESC) AS r FROM d GROUP BY 1, 2)
SELECT c_custkey, m.v AS v FROM d LEFT JOIN m ON lower(trim(d.v)) = m.k AND r = 1""")  # fmt: skip


def _money(c: DataFrame) -> DataFrame:
    k, v = F.col("c_custkey") % 5, F.col("c_custkey") * 1234
    text = (
        F.when(k == 0, F.concat(F.lit("$"), F.format_number(v, 0)))
        .when(k == 1, F.concat(F.lit("("), v.cast("string"), F.lit(")")))
        .when(k == 2, F.concat(v.cast("string"), F.lit("%")))
        .when(k == 3, F.concat(F.lit(" "), v.cast("string"), F.lit(" ")))
        .otherwise(F.lit("x"))
    )
    return c.select("c_custkey", text.alias("t"))


register("to_numeric", lambda c: _money(c).select("c_custkey", C.to_numeric(F.col("t")).alias("v")), "customer",
    "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_custkey * 1234 WHEN 1 THEN -c_custkey * 1234 WHEN 2 THEN c_custkey * 1234 WHEN 3 THEN c_custkey * 1234 END::DOUBLE AS v FROM customer")
register("to_boolean", lambda o: o.select("o_orderkey", C.to_boolean(F.element_at(F.array(*[F.lit(x) for x in ("yes", "No", " Y ", "f", "1", "0", "maybe")]), (F.col("o_orderkey") % 7 + 1).cast("int"))).alias("v")), "orders",
    "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN false END AS v FROM orders")
_MIXED = ["yyyy-MM-dd", "MMM d, yyyy", "MM/dd/yyyy", "dd.MM.yyyy"]
register("standardize_dates", lambda o: prepare.standardize_dates(o.select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, F.lit("bad")).otherwise(F.coalesce(*[F.when(F.col("o_orderkey") % 4 == k, F.date_format("o_orderdate", f)) for k, f in enumerate(_MIXED)])).alias("d")), "d"), "orders",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders")
register("gender_standardized", lambda c: prepare.standardize_gender(c.select("c_custkey", F.element_at(F.array(*[F.lit(x) for x in ("M", "male", "F", "Woman", "x")]), (F.col("c_custkey") % 5 + 1).cast("int")).alias("gender"))), "customer",
    "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Male' WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' WHEN 3 THEN 'Female' ELSE 'x' END AS gender FROM customer")


def _signed(o: DataFrame) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in ("shipped", "Cancelled", "returned", "pending", "pending")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    amount = F.when(F.col("o_orderkey") % 5 == 4, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return o.select("o_orderkey", (-(F.col("o_orderkey") % 7)).alias("quantity"), status.alias("status"), amount.alias("amount"))


register("sign_repair", lambda o: prepare.repair_signs(_signed(o), "quantity", "status", "amount"), "orders",
    """WITH d AS (SELECT o_orderkey, -(o_orderkey % 7) AS quantity, CASE o_orderkey % 5 WHEN 0 THEN 'shipped' WHEN 1 THEN 'Cancelled' WHEN 2 THEN 'returned' ELSE 'pending' END AS status,
CASE WHEN o_orderkey % 5 = 4 THEN -o_totalprice ELSE o_totalprice END AS amount FROM orders)
SELECT o_orderkey, CASE WHEN quantity < 0 AND (status IN ('shipped', 'Cancelled') OR (status = 'pending' AND amount >= 0)) THEN abs(quantity) ELSE quantity END AS quantity, status,
CASE WHEN quantity < 0 AND (status = 'shipped' OR (status = 'pending' AND amount >= 0)) THEN abs(amount) ELSE amount END AS amount FROM d""")  # fmt: skip
_AGE = "CASE WHEN c_custkey % 11 = 0 THEN -1 WHEN c_custkey % 13 = 0 THEN 200 ELSE 20 + c_custkey % 50 END"
register("age_repair", lambda c: prepare.repair_ages(c.select("c_custkey", F.expr(_AGE).cast("double").alias("age"))), "customer",
    f"""WITH d AS (SELECT c_custkey, CAST({_AGE} AS DOUBLE) AS age FROM customer), m AS (SELECT quantile_cont(age, 0.5) AS m FROM d WHERE age BETWEEN 0 AND 120)
SELECT c_custkey, CASE WHEN age BETWEEN 0 AND 120 THEN age ELSE m END AS age FROM d, m""")  # fmt: skip


def _impute(c: DataFrame) -> DataFrame:
    rows = c.select(
        F.col("c_custkey").alias("row"),
        F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_custkey") % 8 != 0, F.col("c_custkey") % 3).alias("few"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("sparse"),
    )
    return prepare.handle_missing(rows, profiles.profile(rows).columns)


register("impute", _impute, "customer",
    """WITH d AS (SELECT c_custkey AS "row", CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 3 END AS few, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS sparse FROM customer)
SELECT "row", coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM d)) AS balance,
coalesce(few, (SELECT few FROM d WHERE few IS NOT NULL GROUP BY few ORDER BY count(*) DESC, few LIMIT 1)) AS few, sparse FROM d""")  # fmt: skip
register("convert_types", lambda c: prepare.convert_types(_money(c).withColumn("t", F.expr("CASE WHEN t = 'x' AND c_custkey % 100 <> 4 THEN concat(c_custkey, '.50%') ELSE t END")), {"t": "numeric"}), "customer",
    "SELECT c_custkey, CASE WHEN c_custkey % 100 = 4 THEN NULL WHEN c_custkey % 5 = 4 THEN c_custkey + 0.5 WHEN c_custkey % 5 = 1 THEN -c_custkey * 1234 ELSE c_custkey * 1234 END AS t FROM customer")
register("invalid_values", lambda c: prepare.invalid_values(c.select(F.col("c_acctbal").alias("total_amount"), F.expr(_AGE).alias("age"))), "customer",
    f"""SELECT * FROM (SELECT 'total_amount' AS "column", 'negative' AS rule, count(*) FILTER (c_acctbal < 0) AS n FROM customer UNION ALL
SELECT 'age', 'age_range', count(*) FILTER ({_AGE} NOT BETWEEN 0 AND 120) FROM customer UNION ALL SELECT 'age', 'negative', count(*) FILTER ({_AGE} < 0) FROM customer) WHERE n > 0""")  # fmt: skip

# -- matching and joins --------------------------------------------------------------------

register("key_overlap_matrix", lambda c, n, o: integrate.key_overlaps({"customer": (c, ["c_custkey", "c_nationkey"]), "nation": (n, ["n_nationkey", "n_regionkey"]), "orders": (o, ["o_custkey"])}), "customer nation orders",
    """WITH k AS (SELECT DISTINCT * FROM (SELECT 'customer' AS t, 'c_custkey' AS c, CAST(c_custkey AS VARCHAR) AS k FROM customer UNION ALL SELECT 'customer', 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT 'nation', 'n_nationkey', CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT 'nation', 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation UNION ALL SELECT 'orders', 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders)),
s AS (SELECT t, c, count(*) AS n FROM k GROUP BY ALL),
j AS (SELECT a.t AS ta, a.c AS ca, b.t AS tb, b.c AS cb, count(*) AS shared FROM k a JOIN k b ON a.k = b.k AND a.t < b.t GROUP BY ALL)
SELECT ta AS table_a, ca AS column_a, tb AS table_b, cb AS column_b, shared, x.n AS size_a, y.n AS size_b,
CASE WHEN least(x.n, y.n) >= 2 THEN round(shared / least(x.n, y.n), 4) ELSE 0.0 END AS overlap FROM j JOIN s x ON x.t = ta AND x.c = ca JOIN s y ON y.t = tb AND y.c = cb""")  # fmt: skip
register("key_resolution", lambda s, c: integrate.key_resolution(s, c, "client_id", "client_id"), "sales clients",
    """WITH s AS (SELECT count(*) AS rows, count(c) AS resolved FROM sales LEFT JOIN (SELECT DISTINCT client_id AS c FROM clients) ON client_id = c)
SELECT rows, resolved, rows - resolved AS unmatched, round(resolved / rows, 4) AS resolved_share, CASE WHEN rows = resolved THEN 'passed' WHEN rows - resolved >= 0.1 * rows THEN 'failed' ELSE 'warning' END AS status FROM s""")  # fmt: skip
register("lookup_left_join", lambda o, c: integrate.lookup_join(o.select("o_orderkey", "o_custkey", "o_totalprice"), c.select("c_custkey", "c_name", "c_mktsegment"), "o_custkey", "c_custkey", "customer"), "orders customer",
    "SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
register("lookup_join_deduplicated", lambda c, e: integrate.lookup_join(c.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("event_type")), e.select("user_id", "event_type"), "user_id", "user_id", "events"), "customer events",
    "SELECT c_custkey AS user_id, c_mktsegment AS event_type, m AS events_event_type FROM customer LEFT JOIN (SELECT user_id, min(event_type) AS m FROM events GROUP BY 1) ON c_custkey = user_id")

# -- SQL ---------------------------------------------------------------------------------------


def _sql(name: str, tables: str, text: str, oracle: str | None = None) -> None:
    names = tables.split()
    QUERIES[name] = lambda spark, sf_dir: sqltool.query({t: table(spark, sf_dir, t) for t in names}, text)
    ORACLE_SQL[name] = oracle or text


_sql("sql_group_by", "lineitem", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
_sql("sql_semi_join", "customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
_sql("sql_anti_join", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_sql("sql_full_join", "vendors supplier", "SELECT vendor_id, s_suppkey, s_name FROM vendors FULL JOIN supplier ON vendor_id = s_suppkey")
_sql("sql_cross_join", "region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_sql("sql_rollup", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("sql_cube", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("sql_grouping_sets", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_sql("sql_window", "orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
_sql("sql_qualify", "orders", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1",
     "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
_sql("sql_cte", "customer orders", "WITH t AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), m AS (SELECT avg(s) AS a FROM t) SELECT c_name, round(s, 2) AS s FROM t JOIN customer ON o_custkey = c_custkey CROSS JOIN m WHERE s > 2 * a")
_sql("sql_recursive", "nation", "WITH RECURSIVE r(k) AS (SELECT min(n_nationkey) FROM nation UNION ALL SELECT n_nationkey FROM r JOIN nation ON n_nationkey = k + 1) SELECT k, n_name FROM r JOIN nation ON n_nationkey = k")
_sql("sql_union_except", "customer supplier", "(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
_sql("sql_intersect", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_sql("sql_lateral", "customer orders", "SELECT c_custkey, o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
_sql("sql_pivot", "orders", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
     "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1")
_sql("sql_asof", "events", """SELECT event_id, max_by(prev_id, prev_ts) AS prev FROM (SELECT a.event_id, b.event_id AS prev_id, b.ts AS prev_ts FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts < a.ts AND b.event_type = 'purchase' WHERE a.event_type = 'click') GROUP BY event_id""")
_sql("sql_range_join", "orders lineitem", "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_extendedprice BETWEEN o_totalprice * 0.1 AND o_totalprice * 0.5 GROUP BY o_orderkey")
_sql("sql_filter_agg", "events", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, bool_or(value > 99) AS any_top FROM events GROUP BY event_type")
_sql("sql_string_agg", "nation", "SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
     "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_sql("sql_quoted_names", "region", 'SELECT "r_name" AS "the name", "r_regionkey" AS "select" FROM region')
_sql("sql_json", "events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
_sql("sql_q1", "lineitem", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
     "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")

_sql("sql_strftime", "orders", "SELECT strftime(o_orderdate, '%Y-%m (%b), day''s %d') AS m, count(*) AS n, CAST(max(epoch(o_orderdate)) AS BIGINT) AS last, min(isodow(o_orderdate)) AS dow FROM orders GROUP BY 1")
_sql("sql_strptime", "stamps", "SELECT stamp_id, try_strptime(trim(raw), '%d.%m.%Y %H:%M:%S') AS a, try_strptime(raw, '%Y-%m-%dT%H:%M:%SZ') AS b FROM stamps",
     "SELECT stamp_id, try_strptime(CASE WHEN regexp_full_match(trim(raw), '\\d\\d\\.\\d\\d\\.\\d{4} .*') THEN trim(raw) END, '%d.%m.%Y %H:%M:%S') AS a, try_strptime(CASE WHEN regexp_full_match(raw, '.*Z') THEN raw END, '%Y-%m-%dT%H:%M:%SZ') AS b FROM stamps")
_sql("sql_regexp_matches", "clients", "SELECT client_id, regexp_matches(email, '@[a-m]') AS early, regexp_full_match(city, '[A-Z][a-z]+') AS one_word, strpos(email, '@') AS at, starts_with(name, 'A') AS a, ends_with(email, '.com') AS com FROM clients")
_sql("sql_string_split", "items", "SELECT item_id, CAST(cardinality(string_split(name, ' ')) AS BIGINT) AS words FROM items", "SELECT item_id, len(string_split(name, ' ')) AS words FROM items")
_sql("sql_series_join", "sales", "SELECT p.generate_series AS priority, count(sale_id) AS n FROM generate_series(0, 9) p LEFT JOIN sales ON sales.priority = p.generate_series GROUP BY 1")
_sql("sql_json_text", "events", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, 'k') = '3' AS three FROM events")

# -- search, text, learning --------------------------------------------------------------------


def _nearest(e: DataFrame) -> DataFrame:
    first = e.orderBy("vec_id").select("embedding").first()
    return search.nearest(e, "vec_id", "embedding", list(first[0]) if first else [], 10, 3)


register("vector_topk", _nearest, "embeddings",
    """WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 3) AS similarity FROM embeddings, q)
SELECT * FROM s ORDER BY similarity DESC, vec_id LIMIT 10""")  # fmt: skip
register("text_search", lambda d: search.text_search(d, "doc_id", "text", "license apache version").select("doc_id", "similarity"), "documents",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS n FROM w GROUP BY ALL), df AS (SELECT term, ln((SELECT count(DISTINCT doc_id) + 1 FROM documents) / (count(*) + 1)) AS idf FROM tf GROUP BY term),
x AS (SELECT doc_id, term, n * idf AS w FROM tf JOIN df USING (term)), l AS (SELECT doc_id, sqrt(sum(w * w)) AS len FROM x GROUP BY doc_id),
q AS (SELECT term, idf / sqrt(sum(idf * idf) OVER ()) AS w FROM df WHERE term IN ('license', 'apache', 'version'))
SELECT x.doc_id, round(sum(x.w / len * q.w), 4) AS similarity FROM x JOIN q USING (term) JOIN l ON l.doc_id = x.doc_id GROUP BY x.doc_id ORDER BY similarity DESC, doc_id LIMIT 5""")  # fmt: skip
register("latent_search", lambda d: latent.LatentIndex(search.text_index(d, "doc_id", "text"), rank=32, passes=2).build().search("license apache version", 10, 3).withColumnRenamed("key", "doc_id"), "documents", None)
_KEYWORDS = ["license", "password", "idiot", "the"]
register("keyword_counts", lambda d: search.keyword_counts(d, "text", _KEYWORDS), "documents",
    " UNION ALL ".join(f"SELECT '{w}' AS word, count(*) FILTER (regexp_matches(lower(text), '(^|[^a-z]){w}([^a-z]|$)')) AS rows FROM documents" for w in _KEYWORDS))
register("text_lengths", lambda d: d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"), F.max(F.char_length("text")).alias("longest")), "documents",
    "SELECT lang, count(*) AS n, CAST(sum(len(text)) AS BIGINT) AS chars, max(len(text)) AS longest FROM documents GROUP BY 1")
_MI = "SELECT '{c}' AS \"column\", {c} AS x, l_linestatus AS y, count(*) AS n FROM lineitem GROUP BY 2, 3"
register("mutual_information", lambda li: ml.mutual_information(ml.binned(li.select("l_returnflag", F.col("l_linenumber").cast("string").alias("l_linenumber"), "l_linestatus"), ["l_returnflag", "l_linenumber", "l_linestatus"]), ["l_returnflag", "l_linenumber"], "l_linestatus"), "lineitem",
    " UNION ALL ".join(f"""(WITH j AS ({_MI.format(c=c)}), w AS (SELECT "column", n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY x) AS px, sum(n) OVER (PARTITION BY y) AS py FROM j)
SELECT any_value("column") AS "column", round(sum(n / t * ln(n * t / (px * py))), 6) AS mi FROM w)""" for c in ("l_returnflag", "l_linenumber")))  # fmt: skip


def _metrics(df: DataFrame, target: str, **options) -> DataFrame:
    out = ml.train_model(df, target, trees=20, **options)
    rows = [(k, float(v)) for k, v in out.get("metrics", {}).items() if isinstance(v, (int, float))]
    return df.sparkSession.createDataFrame(rows or [("error", 0.0)], "metric string, value double")


register("train_classifier", lambda o: _metrics(o.select("o_orderstatus", "o_totalprice", "o_orderpriority", F.month("o_orderdate").alias("month")), "o_orderstatus"), "orders", None)
register("train_regressor", lambda p: _metrics(p.select("p_retailprice", "p_size", "p_brand"), "p_retailprice"), "part", None)


def _churn(c: DataFrame, o: DataFrame) -> DataFrame:
    ordered = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k")).filter("k >= 8").withColumn("seen", F.lit(1))
    data = c.join(ordered, c["c_custkey"] == F.col("o_custkey"), "left").select("c_acctbal", "c_mktsegment", F.when(F.col("seen").isNull(), "yes").otherwise("no").alias("churn"))
    out = ml.analyze_churn(data, trees=20)
    return c.sparkSession.createDataFrame([(out.get("rows_used", 0), float(out.get("churn_rate_percent", 0.0)))], "rows_used long, churn_rate_percent double")


register("churn_rate", _churn, "customer orders",
    "SELECT count(*) AS rows_used, CASE WHEN bool_or(o IS NULL) AND bool_or(o IS NOT NULL) THEN round(avg(CASE WHEN o IS NULL THEN 100.0 ELSE 0 END), 2) ELSE 0.0 END AS churn_rate_percent FROM customer LEFT JOIN (SELECT o_custkey AS o FROM orders GROUP BY 1 HAVING count(*) >= 8) ON o = c_custkey")

# -- streams -------------------------------------------------------------------------------------

_BATCH = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"
QUERIES["stream_tumbling"] = lambda spark, sf_dir: windows.tumbling(spark, f"{sf_dir.rstrip('/')}/events.parquet")
ORACLE_SQL["stream_tumbling"] = _BATCH
QUERIES["stream_sliding"] = lambda spark, sf_dir: windows.sliding(spark, f"{sf_dir.rstrip('/')}/events.parquet")
ORACLE_SQL["stream_sliding"] = """SELECT s AS window_start, count(*) AS n, round(sum(value), 2) AS total
FROM (SELECT value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1"""
QUERIES["stream_sessions"] = lambda spark, sf_dir: windows.sessions(spark, f"{sf_dir.rstrip('/')}/events.parquet")
ORACLE_SQL["stream_sessions"] = """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, k"""
QUERIES["stream_dedup"] = lambda spark, sf_dir: windows.deduplicated(spark, f"{sf_dir.rstrip('/')}/events.parquet")
ORACLE_SQL["stream_dedup"] = "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY 1, 2"
