"""Functions that analysts' SQL expects and Spark lacks, as temporary SQL functions of a query's session.

They are expressions, which Catalyst inlines: no Python runs, and filters on them are pushed as far as others.
Forms that would need another parser or planner (QUALIFY, ASOF JOIN, * EXCLUDE, sampling clauses, list literals) are not offered: the
window, as-of and range operators of this library take their place.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Fields of a time format, and their patterns here.
TIME_FIELDS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE",
}


def _pattern(f: str) -> str:
    """The pattern of a time format as SQL: fields stand bare, all else in quotes; chr(1) marks where quotes open and close."""
    out = f"concat(chr(1), replace({f}, '''', ''''''), chr(1))"
    for field, letters in TIME_FIELDS.items():
        out = f"replace({out}, '{field}', concat(chr(1), '{letters}', chr(1)))"
    return f"replace(replace(replace({out}, '%%', '%'), concat(chr(1), chr(1)), ''), chr(1), '''')"


#: By name: parameters, type of the result and body.
FUNCTIONS = {
    "strftime": ("t TIMESTAMP, f STRING", "STRING", f"date_format(t, {_pattern('f')})"),
    "strptime": ("s STRING, f STRING", "TIMESTAMP", f"to_timestamp(s, {_pattern('f')})"),
    "try_strptime": ("s STRING, f STRING", "TIMESTAMP", f"try_to_timestamp(s, {_pattern('f')})"),
    "epoch": ("t TIMESTAMP", "DOUBLE", "unix_micros(t) / 1000000D"),
    "epoch_ms": ("t TIMESTAMP", "BIGINT", "unix_millis(t)"),
    "epoch_us": ("t TIMESTAMP", "BIGINT", "unix_micros(t)"),
    "isodow": ("t TIMESTAMP", "BIGINT", "weekday(t) + 1"),
    "today": ("", "DATE", "current_date()"),
    "regexp_matches": ("s STRING, p STRING", "BOOLEAN", "regexp_like(s, p)"),
    "regexp_full_match": ("s STRING, p STRING", "BOOLEAN", "regexp_like(s, concat('^(?:', p, ')$(?!\\\\n)'))"),
    "strpos": ("s STRING, x STRING", "BIGINT", "instr(s, x)"),
    "starts_with": ("s STRING, x STRING", "BOOLEAN", "startswith(s, x)"),
    "prefix": ("s STRING, x STRING", "BOOLEAN", "startswith(s, x)"),
    "ends_with": ("s STRING, x STRING", "BOOLEAN", "endswith(s, x)"),
    "suffix": ("s STRING, x STRING", "BOOLEAN", "endswith(s, x)"),
    "string_split": ("s STRING, x STRING", "ARRAY<STRING>", "split(s, concat('\\\\Q', x, '\\\\E'))"),
    "str_split": ("s STRING, x STRING", "ARRAY<STRING>", "split(s, concat('\\\\Q', x, '\\\\E'))"),
    "json_extract_string": ("j STRING, p STRING", "STRING", "get_json_object(j, if(startswith(p, '$'), p, concat('$.', p)))"),
    "generate_series": ("a BIGINT, b BIGINT", "TABLE (generate_series BIGINT)", "SELECT explode(if(a <= b, sequence(a, b), array()))"),
}


def install(spark: SparkSession) -> None:
    """Creates the functions in a session of its own; those that the session has already stay."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
