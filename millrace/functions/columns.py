"""Column expressions of the preparation rules; all stay inside whole-stage codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates

# Texts that mean a missing value, compared after trimming and lower-casing.
NULL_TOKENS = ["", "na", "n/a", "n.a.", "nan", "null", "none", "nil", "-", "--", "?", "unknown", "undefined", "missing", "not available", "#n/a", "#null!", "\\n"]
TRUE_TOKENS = ["true", "yes", "y", "t", "1"]
FALSE_TOKENS = ["false", "no", "n", "f", "0"]
# What may stand around a number.
NUMBER_NOISE = r"[,\s$€£¥₹%]"
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
NUMERIC_TEXT = r"^\(?[+-]?[$€£¥₹]?\s*(?:\d[\d,]*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*%?\)?$"


def stripped(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_whitespace(c: Column) -> Column:
    """Without white space at either end, runs inside as one space."""
    return F.regexp_replace(stripped(c), r"\s+", " ")


def token(c: Column) -> Column:
    """Trimmed and lower-cased, for comparisons."""
    return F.lower(stripped(c))


def is_null_like(c: Column) -> Column:
    return token(c).isin(NULL_TOKENS)


def null_like(c: Column) -> Column:
    """Null for texts that mean a missing value."""
    return F.when(is_null_like(c), None).otherwise(c)


def to_numeric(c: Column) -> Column:
    """A number from text: (x) is negative; thousands separators, currencies and percent signs go; else null."""
    text = stripped(c)
    inside = F.regexp_extract(text, r"^\((.*)\)$", 1)
    negative = F.regexp_like(text, F.lit(r"^\(.*\)$"))
    plain = F.regexp_replace(F.when(negative, inside).otherwise(text), NUMBER_NOISE, "")
    value = F.when(F.regexp_like(plain, F.lit(NUMBER)), plain.try_cast("double"))
    return F.when(negative, -value).otherwise(value)


def to_boolean(c: Column) -> Column:
    t = token(c)
    return F.when(t.isin(TRUE_TOKENS), True).when(t.isin(FALSE_TOKENS), False)


def to_timestamp(c: Column) -> Column:
    """A time from text in any of the shapes of ``dates``, else null."""
    return dates.to_timestamp(c)


def gender(c: Column) -> Column:
    t = token(c)
    return F.when(t.isin("m", "male", "man"), "Male").when(t.isin("f", "female", "woman"), "Female").otherwise(c)


def join_key(c: Column) -> Column:
    """A key as text: trimmed, lower-cased, 12.0 as 12; null stays null and never matches."""
    return F.regexp_replace(token(c.cast("string")), r"^(\d+)\.0$", "$1")


def churn_label(c: Column) -> Column:
    t = token(c.cast("string"))
    return F.when(t.isin("yes", "true", "1", "y"), 1).when(t.isin("no", "false", "0", "n"), 0)


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


# -- names ---------------------------------------------------------------------------


def column_name(name: str) -> str:
    """A column name in lower snake case."""
    name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.strip()).replace(".", "_")
    name = re.sub(r"_+", "_", re.sub(r"[^0-9a-zA-Z_]+", "_", name)).strip("_").lower()
    return "column" if not name else f"c_{name}" if name[0].isdigit() else name


def unique_names(names: list[str], normalise=column_name) -> list[str]:
    """Normalised names, repeated ones with _2, _3 and so on."""
    out: list[str] = []
    for raw in names:
        base = name = normalise(raw)
        k = 2
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


def table_name(name: str) -> str:
    """A table name from a file name."""
    base = re.sub(r"\.[^.]*$", "", name.rsplit("/", 1)[-1]) if "." in name else name
    base = re.sub(r"_+", "_", re.sub(r"[^0-9a-zA-Z]+", "_", base)).strip("_").lower()
    return "dataset" if not base else f"t_{base}" if base[0].isdigit() else base
