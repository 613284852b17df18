"""Standardization, cleaning and de-duplication, every change in a log."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import dates
from ..functions import names as N
from ..shared import staged
from .analysis import NUMERIC
from .profile import ColumnProfile, TableProfile, plain, profile
from .quantiles import quantiles

CONVERT_SHARE, DATE_SHARE = 0.95, 0.5
MISSING_LIMIT, DISCRETE, MODE_SHARE = 0.40, 12, 0.5
AGE_LOW, AGE_HIGH = 0, 120
#: Spellings of a category that are sent to all executors.
SPELLINGS = 10_000


@dataclass
class Log:
    actions: list[dict] = field(default_factory=list)

    def add(self, stage: str, action: str, detail: str, columns: list[str] | None = None, rows: int | None = None) -> None:
        self.actions.append({"stage": stage, "action": action, "detail": detail, "columns": columns or [], "rows": rows})


def _text(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


# -- standardization -------------------------------------------------------------------


def normalize_names(df: DataFrame, log: Log | None = None) -> DataFrame:
    names = C.unique_names(df.columns)
    if log and names != df.columns:
        log.add("standardize", "renamed_columns", f"{sum(a != b for a, b in zip(df.columns, names))} column(s) renamed", names)
    return df.toDF(*names)


def strip_whitespace(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumns({c: C.strip_whitespace(F.col(c)) for c in columns or _text(df)})


def normalize_null_like(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumns({c: C.null_like(F.col(c)) for c in columns or _text(df)})


def spelling_map(df: DataFrame, column: str) -> DataFrame:
    """(value, standard): each spelling with the most frequent one that is equal but for case and edges."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    key = C.token(F.col("value"))
    best = counts.groupBy(key.alias("key")).agg(F.max_by("value", F.struct("n", F.col("value"))).alias("standard"))
    return counts.join(best, key == F.col("key")).select("value", "standard")


def normalize_categories(df: DataFrame, column: str) -> DataFrame:
    """Spellings of a category that differ in case or edges become the most frequent of them.

    The map holds the spellings that change.  It is counted, and sent to the executors while it has at most
    ``SPELLINGS`` rows, so the rows of a frequent category do not meet in one task; AQE splits the join of longer ones.
    """
    changed = staged(spelling_map(df, column).filter("value <> standard"))
    n = changed.count()
    if not n:
        return df
    found = changed.select(F.col("value").alias("_value"), F.col("standard").alias("_standard"))
    joined = df.join(F.broadcast(found) if n <= SPELLINGS else found, F.col(column) == F.col("_value"), "left")
    return joined.withColumn(column, F.coalesce("_standard", column)).select(*df.columns)


def standardize_dates(df: DataFrame, column: str, log: Log | None = None) -> DataFrame:
    """Dates in mixed formats as dates, or times if any has one; refused below half parsed.

    Whether days or months come first in numbers is settled by the whole column.
    """
    t = dates.to_timestamp(F.col(column), dates.day_first(df, F.col(column)))
    s = df.agg(F.count(column).alias("n"), F.count(t).alias("ok"), F.count_if(t != F.date_trunc("day", t)).alias("timed")).first()
    if not s["ok"] or s["ok"] < DATE_SHARE * s["n"]:
        if log:
            log.add("standardize", "skipped_dates", f"only {s['ok']} of {s['n']} values are dates", [column])
        return df
    if log:
        log.add("standardize", "standardized_dates", f"{s['ok']} of {s['n']} values are dates", [column], s["ok"])
    return df.withColumn(column, t if s["timed"] else F.to_date(t))


def standardize(df: DataFrame, p: TableProfile, log: Log) -> DataFrame:
    renamed = dict(zip(df.columns, C.unique_names(df.columns)))
    out = normalize_null_like(strip_whitespace(normalize_names(df, log)))
    for old, c in p.columns.items():
        name = renamed[old]
        if c.dtype != "string":
            continue
        if c.logical_type == "categorical" and c.issues.get("inconsistent_casing"):
            out = normalize_categories(out, name)
            log.add("standardize", "standardized_categories", f"{c.issues['inconsistent_casing']} spelling(s) merged", [name])
        elif c.logical_type == "datetime":
            out = standardize_dates(out, name, log)
    return out


# -- cleaning --------------------------------------------------------------------------


def convert_types(df: DataFrame, kinds: dict[str, str], log: Log | None = None) -> DataFrame:
    """Text columns of numeric or boolean kind converted, where 95 % of the values survive."""
    to = {"numeric": C.to_numeric, "boolean": C.to_boolean}
    todo = {c: to[k](F.col(c)) for c, k in kinds.items() if k in to and c in _text(df)}
    if not todo:
        return df
    s = df.agg(*[F.count(c).alias(f"n_{c}") for c in todo], *[F.count(e).alias(f"ok_{c}") for c, e in todo.items()], *[F.count_if(e.cast("double") != F.floor(e.cast("double"))).alias(f"frac_{c}") for c, e in todo.items()]).first()
    done: dict[str, Column] = {}
    for c, e in todo.items():
        n, ok = s[f"n_{c}"], s[f"ok_{c}"]
        if n and ok >= CONVERT_SHARE * n:
            done[c] = e.try_cast("bigint") if kinds[c] == "numeric" and not s[f"frac_{c}"] else e
            if log:
                log.add("clean", "converted_types", f"{c} to {kinds[c]}: {ok} of {n}", [c], ok)
        elif log:
            log.add("clean", "skipped_type_conversion", f"{c}: only {ok} of {n} values are {kinds[c]}", [c])
    return df.withColumns(done) if done else df


def imputation(df: DataFrame, p: dict[str, ColumnProfile]) -> dict[str, object]:
    """The value that fills each column's gaps, for the columns that may be filled."""
    out: dict[str, object] = {}
    numeric = [c for c in p if isinstance(df.schema[c].dataType, NUMERIC)]
    other = [c for c in p if isinstance(df.schema[c].dataType, (T.StringType, T.BooleanType))]

    def may(c: str) -> bool:
        k = p[c]
        return bool(k.rows) and 0 < k.missing <= MISSING_LIMIT * k.rows and not k.id_candidate and not N.looks_like_id(c)

    medians = [c for c in numeric if may(c) and p[c].distinct > DISCRETE]
    if medians:
        out |= {c: q[0] for c, (_, q) in quantiles(df, {c: F.col(c) for c in medians}, [0.5]).items()}
    modes = [c for c in numeric if may(c) and p[c].distinct <= DISCRETE] + [c for c in other if may(c) and p[c].logical_type in ("categorical", "boolean")]
    for c in modes:
        counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        best = counts.orderBy(F.desc("n"), F.asc(c)).first()
        if best and (c in numeric or best["n"] >= MODE_SHARE * (p[c].rows - p[c].missing)):
            out[c] = best[c]
    return out


def handle_missing(df: DataFrame, p: dict[str, ColumnProfile], log: Log | None = None) -> DataFrame:
    fills = imputation(df, p)
    if log:
        for c, k in p.items():
            if k.missing:
                log.add("clean", "filled_missing_values" if c in fills else "left_missing_values", f"{c}: {k.missing} of {k.rows}" + (f" with {fills[c]}" if c in fills else ""), [c], k.missing)
    kind = lambda c: df.schema[c].dataType
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(kind(c) if not isinstance(v, float) or v == int(v) else "double")) for c, v in fills.items()}) if fills else df


def standardize_gender(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or [c for c in _text(df) if "gender" in c.lower() or "sex" in c.lower().split("_")]
    return df.withColumns({c: C.gender(F.col(c)) for c in columns}) if columns else df


def repair_signs(df: DataFrame, quantity: str, status: str, amount: str | None = None) -> DataFrame:
    """Negative quantities by status: done and cancelled orders become positive, returns stay, pending by the amount."""
    s = C.token(F.col(status))
    q, a = F.col(quantity), F.col(amount) if amount else F.lit(None).cast("double")
    done = s.isin("shipped", "complete", "completed", "processing")
    cancelled = s.isin("cancelled", "canceled")
    pending = (s == "pending") & ~F.coalesce(a < 0, F.lit(False))
    negative = q < 0
    out = {quantity: F.when(negative & (done | cancelled | pending), F.abs(q)).otherwise(q)}
    if amount:
        out[amount] = F.when(negative & (done | pending), F.abs(a)).otherwise(a)
    return df.withColumns(out)


def find_sign_columns(names: list[str]) -> tuple[str, str, str | None] | None:
    import re

    first = lambda p: next((n for n in names if re.search(p, n, re.I)), None)
    quantity, status, amount = first("quant|qty|count"), first("status|state"), first("amount|total|price|sales")
    return (quantity, status, amount) if quantity and status else None


def repair_ages(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Ages outside 0 to 120 become the median of the others."""
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and "age" in f.name.lower().split("_")]
    if not columns:
        return df
    ok = lambda c: F.col(c).between(AGE_LOW, AGE_HIGH)
    m = {c: q[0] for c, (_, q) in quantiles(df, {c: F.when(ok(c), F.col(c)) for c in columns}, [0.5]).items()}
    return df.withColumns({c: F.when(F.col(c).isNull() | ok(c), F.col(c)).otherwise(F.lit(m[c]).cast(df.schema[c].dataType)) for c in columns})


def invalid_values(df: DataFrame) -> DataFrame:
    """(column, rule, n): negatives where none can be, ages and dates out of range."""
    from .analysis import unpivoted

    spec: dict[str, list] = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        zero = F.lit(0).cast("long")
        number = isinstance(f.dataType, NUMERIC)
        dated = isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        negative = F.count_if(c < 0) if number and N.NON_NEGATIVE_NAME.search(f.name) else zero
        age = F.count_if(~c.between(AGE_LOW, AGE_HIGH)) if number and "age" in f.name.lower().split("_") else zero
        day = F.count_if((F.to_date(c) < F.lit("1900-01-01").cast("date")) | (F.to_date(c) > F.date_add(F.current_date(), 5 * 365))) if dated else zero
        spec[f.name] = [("negative", negative), ("age_range", age), ("date_range", day)]
    wide = unpivoted(df, spec)
    return wide.select("column", F.expr("stack(3, 'negative', negative, 'age_range', age_range, 'date_range', date_range) as (rule, n)")).filter("n > 0")


def clean(df: DataFrame, p: TableProfile, log: Log) -> DataFrame:
    out = convert_types(df, {c: k.logical_type for c, k in p.columns.items()}, log)
    out = handle_missing(out, p.columns, log)
    out = standardize_gender(out)
    signs = find_sign_columns(out.columns)
    if signs and isinstance(out.schema[signs[0]].dataType, NUMERIC) and isinstance(out.schema[signs[1]].dataType, T.StringType):
        amount = signs[2] if signs[2] and isinstance(out.schema[signs[2]].dataType, NUMERIC) else None
        out = repair_signs(out, signs[0], signs[1], amount)
    return repair_ages(out)


# -- duplicates ------------------------------------------------------------------------


def drop_duplicate_rows(df: DataFrame, order: str | None = None) -> DataFrame:
    """Rows equal in all columns once, nulls being equal; the first by ``order``, which then does not count as a column."""
    if order is None:
        nested = {f.name for f, g in zip(df.schema.fields, plain(df).schema.fields) if f.dataType != g.dataType}
        if not nested:
            return df.dropDuplicates()
        keys = [f"_k{i}" for i in range(len(df.columns))]
        flat = plain(df)
        both = df.select("*", *[(F.to_json(f"`{c}`") if c in nested else F.col(f"`{c}`")).alias(k) for c, k in zip(flat.columns, keys)])
        return both.dropDuplicates(keys).select(*df.columns)
    data = [c for c in df.columns if c != order]
    # The least order of each group, pre-aggregated, instead of a window over whole groups.
    return df.groupBy(*data).agg(F.min(order).alias(order)).select(*df.columns)


def duplicate_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, duplicate_values) of the keys that repeat."""
    texts = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns]
    counts = df.select(F.inline(F.array(*texts))).filter("v is not null").groupBy("column", "v").agg((F.count(F.lit(1)) - 1).alias("extra"))
    return counts.groupBy("column").agg(F.sum("extra").alias("duplicate_values")).filter("duplicate_values > 0")


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written and read again; names that Parquet does not take are numbered meanwhile."""
    return staged(df.toDF(*[f"c{i}" for i in range(len(df.columns))])).toDF(*df.columns)


def prepare(df: DataFrame) -> tuple[DataFrame, TableProfile, Log]:
    """A table standardized, cleaned and without duplicates, with its profile after and the log.

    Each stage is written once to the shared folder, so that no later job computes it again from raw text.
    """
    log = Log()
    standard = _kept(standardize(df, profile(df), log))
    before = profile(standard)
    cleaned = clean(standard, before, log)
    out = _kept(drop_duplicate_rows(cleaned))
    after = profile(out)
    if before.rows != after.rows:
        log.add("deduplicate", "removed_duplicate_rows", f"{before.rows - after.rows} row(s)", rows=before.rows - after.rows)
    keys = [c for c in out.columns if N.looks_like_id(c)]
    for r in duplicate_keys(out, keys).collect() if keys else []:
        log.add("deduplicate", "flagged_duplicate_keys", f"{r['duplicate_values']} repeated value(s)", [r["column"]], r["duplicate_values"])
    return out, after, log


