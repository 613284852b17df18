"""Profiles of columns and tables: one scan for counts and rates, one for distinct values."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import names as N
from .analysis import NUMERIC, unpivoted

# Rules of the logical types.
CATEGORICAL_DISTINCT, CATEGORICAL_RATIO = 100, 0.5
NUMERIC_SHARE, DATE_SHARE, DIGITS_SHARE, ID_RATIO = 0.90, 0.85, 0.90, 0.98


@dataclass(frozen=True)
class ColumnProfile:
    name: str
    dtype: str
    logical_type: str
    rows: int
    missing: int
    null_like: int
    distinct: int
    id_candidate: bool
    constant: bool
    issues: dict[str, int] = field(default_factory=dict)

    @property
    def missing_percent(self) -> float:
        return round(100 * (self.missing + self.null_like) / self.rows, 2) if self.rows else 0.0

    @property
    def unique_ratio(self) -> float:
        present = self.rows - self.missing
        return round(self.distinct / present, 4) if present else 0.0


@dataclass(frozen=True)
class TableProfile:
    rows: int
    duplicate_rows: int
    columns: dict[str, ColumnProfile]

    def as_dict(self) -> dict:
        return {
            "rows": self.rows,
            "duplicate_rows": self.duplicate_rows,
            "columns": [asdict(c) | {"missing_percent": c.missing_percent, "unique_ratio": c.unique_ratio} for c in self.columns.values()],
        }


def plain(df: DataFrame) -> DataFrame:
    """``df`` with nested columns as JSON text, so that all columns can be compared."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def column_counts(df: DataFrame) -> DataFrame:
    """(column, n, missing, null_like, numeric, boolean, date, digits, spaced, negative) in one scan."""
    spec = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        none = F.lit(0).cast("long")
        text = isinstance(f.dataType, T.StringType)
        real = c.isNotNull() & ~C.is_null_like(c) if text else c.isNotNull()
        negative = F.count_if(c < 0) if isinstance(f.dataType, NUMERIC) else F.count_if(C.to_numeric(c) < 0) if text else none
        spec[f.name] = [
            ("n", F.count(F.lit(1))),
            ("missing", F.count_if(c.isNull())),
            ("null_like", F.count_if(c.isNotNull() & C.is_null_like(c)) if text else none),
            ("numeric", F.count_if(real & F.regexp_like(C.stripped(c), F.lit(C.NUMERIC_TEXT))) if text else none),
            ("boolean", F.count_if(real & C.token(c).isin(C.TRUE_TOKENS + C.FALSE_TOKENS)) if text else none),
            ("date", F.count_if(real & C.to_timestamp(c).isNotNull()) if text else none),
            ("digits", F.count_if(real & F.regexp_like(C.stripped(c), F.lit(r"^\d+$"))) if text else none),
            ("spaced", F.count_if(c != C.strip_whitespace(c)) if text else none),
            ("negative", negative),
        ]
    return unpivoted(df, spec)


def distinct_counts(df: DataFrame) -> DataFrame:
    """(column, distinct, folded): exact distinct values, and distinct ones regardless of case and edges.

    Each value is a row of its column's own group, so no aggregate carries a set.
    """
    texts = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns]
    values = plain(df).select(F.inline(F.array(*texts))).filter("v is not null").groupBy("column", "v").agg(F.lit(1).alias("one"))
    folded = values.select("column", "v", C.token(F.col("v")).alias("f"))
    return (
        folded.groupBy("column", "f")
        .agg(F.count(F.lit(1)).alias("d"))
        .groupBy("column")
        .agg(F.sum("d").alias("distinct"), F.count(F.lit(1)).alias("folded"))
    )


def logical_type(name: str, dtype: T.DataType, counts: dict, distinct: int) -> str:
    """numeric, categorical, datetime, boolean or text, from the whole column."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, NUMERIC):
        return "numeric"
    real = counts["n"] - counts["missing"] - counts["null_like"]
    if real > 0:
        if counts["boolean"] == real and 1 <= distinct <= 4:
            return "boolean"
        if counts["date"] >= DATE_SHARE * real and (counts["digits"] <= DIGITS_SHARE * real or N.looks_like_date(name)):
            return "datetime"
        if counts["numeric"] >= NUMERIC_SHARE * real:
            return "numeric"
        if distinct <= CATEGORICAL_DISTINCT and distinct <= CATEGORICAL_RATIO * (counts["n"] - counts["missing"]):
            return "categorical"
    return "text"


def profile(df: DataFrame) -> TableProfile:
    """The profile of a table; three jobs, of which only a row per column comes to the driver."""
    counts = {r["column"]: r.asDict() for r in column_counts(df).collect()}
    distinct = {r["column"]: r for r in distinct_counts(df).collect()}
    groups = plain(df).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    dup = groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("d")).first()["d"]
    out = {}
    for f in df.schema.fields:
        k = counts[f.name]
        d = distinct.get(f.name)
        n, folded = (int(d["distinct"]), int(d["folded"])) if d else (0, 0)
        present = k["n"] - k["missing"]
        kind = logical_type(f.name, f.dataType, k, n)
        ratio = n / present if present else 0.0
        is_id = ratio >= ID_RATIO and k["missing"] + k["null_like"] == 0 and n > 1 and (N.looks_like_id(f.name) or ratio == 1.0)
        issues = {"null_like_text": k["null_like"], "surrounding_whitespace": k["spaced"]}
        if kind == "categorical":
            issues["inconsistent_casing"] = n - folded
        if kind == "numeric" and N.NON_NEGATIVE_NAME.search(f.name):
            issues["negative_values"] = k["negative"]
        out[f.name] = ColumnProfile(f.name, f.dataType.simpleString(), kind, k["n"], k["missing"], k["null_like"], n, is_id, n <= 1, {a: b for a, b in issues.items() if b})
    rows = next(iter(counts.values()))["n"] if counts else 0
    return TableProfile(rows, int(dup), out)


def top_values(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """(column, value, count, place) of the most frequent values of several columns at once."""
    from pyspark.sql import Window

    texts = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    counts = df.select(F.inline(F.array(*texts))).filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value")))
    return counts.withColumn("place", place.cast("long")).filter(F.col("place") <= top)
