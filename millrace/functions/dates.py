"""Times from text of many shapes, each value taken apart once and cast once.

A value is a date in one of six shapes, perhaps followed by a time of day with fraction,
AM or PM, and a zone.  The date's shape says where year, month and day stand; what is left open, whether
01/02/2024 is in January or February, is decided by the other values of the column (``day_first``).
All is rewritten to one ISO text, which is cast; a day or hour that does not exist gives null.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("/", "-", ".")
#: Whether the day comes first where no value of the column tells: by separator.
DEFAULT_DAY_FIRST = {"/": False, "-": True, ".": True}
_MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
_NAME = r"(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]{0,6}"
_REST = r"(?:(?:T|,? )(.*))?$"
_YEAR = r"(\d{4}|\d{2})"
#: What a date looks like in upper case, by shape; the last group is the time of day.
SHAPES = {
    "ymd": r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _REST,
    "numbers": r"^(\d{1,2})([-/.])(\d{1,2})[-/.]" + _YEAR + _REST,
    "day_name": r"^(\d{1,2})[ -]?" + _NAME + r"[., -]*" + _YEAR + _REST,
    "name_day": "^" + _NAME + r"\.? (\d{1,2}),? " + _YEAR + _REST,
    "compact": r"^(\d{4})(\d{2})(\d{2})(?:T?(\d{2}:?\d{2}(?::?\d{2})?.*))?$",
    "month": r"^(\d{4})-(\d{1,2})$",
}
_CLOCK = r"^(\d{1,2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)? ?([AP])?\.?(?:M\.?)? ?(Z|UTC|GMT|[+-]\d{2}(?::?\d{2})?)?$"


def _plain(c: Column) -> Column:
    """Upper case, single spaces, without the name of the weekday."""
    text = F.upper(F.trim(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", " ")))
    return F.regexp_replace(text, r"^(?:MON|TUE|WED|THU|FRI|SAT|SUN)[A-Z]*,? ", "")


def _twelve_hours(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"\d ?[AP]\.?M\.?"))


def day_first(df: DataFrame, column: Column) -> dict[tuple[str, bool], bool]:
    """By separator and whether hours go to twelve: does the day come first?

    One aggregate counts the values whose first number, or second, can be no month; the more
    frequent order wins, the other values' order if these do not tell, and the usual one if none does.
    """
    text = _plain(column)
    parts = df.select(text.alias("t")).filter(F.regexp_like("t", F.lit(SHAPES["numbers"])))
    first, sep, second = (F.regexp_extract("t", SHAPES["numbers"], i) for i in (1, 2, 3))
    told = parts.select(first.cast("int").alias("a"), sep.alias("s"), second.cast("int").alias("b"), _twelve_hours(F.col("t")).alias("h"))
    seen = told.groupBy("s", "h").agg(F.count_if((F.col("a") > 12) & (F.col("b") <= 12)).alias("day"), F.count_if((F.col("b") > 12) & (F.col("a") <= 12)).alias("month")).collect()  # six rows at most
    votes = {(r["s"], r["h"]): r["day"] - r["month"] for r in seen}
    out = {}
    for s, h in product(SEPARATORS, (False, True)):
        vote = votes.get((s, h), 0) or votes.get((s, not h), 0)
        out[s, h] = vote > 0 if vote else DEFAULT_DAY_FIRST[s]
    return out


def to_timestamp(c: Column, order: dict[tuple[str, bool], bool] | None = None, *, epochs: bool = False) -> Column:
    """A time from text, else null.

    ``order`` is what ``day_first`` found; a value that can be read in one order only is read so in any case.  Texts with
    a zone give that instant, others the time in the session's zone.  Years of two digits
    lie between 1969 and 2068.  With ``epochs``, ten digits are seconds since 1970 and thirteen milliseconds.
    """
    order = order or {(s, h): d for s, d in DEFAULT_DAY_FIRST.items() for h in (False, True)}
    return _let(_plain(c), lambda t: _time(t, _let(_taken_apart(t, order), _rebuilt), epochs))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _time(t: Column, iso: Column, epochs: bool) -> Column:
    if not epochs:
        return iso.try_cast("timestamp")
    digits = F.regexp_like(t, F.lit(r"^(\d{10}|\d{13})$"))
    scale = F.when(F.length(t) == 13, 1_000).otherwise(1_000_000)
    return F.when(digits, F.timestamp_micros(t.try_cast("long") * scale)).otherwise(iso.try_cast("timestamp"))


def _taken_apart(t: Column, order: dict[tuple[str, bool], bool]) -> Column:
    """year|month|day|time of day, or null."""
    parts = lambda shape, to: F.regexp_replace(t, SHAPES[shape], to)
    like = lambda shape: F.regexp_like(t, F.lit(SHAPES[shape]))
    leads = lambda hours: [F.lit(s) for (s, h), d in order.items() if d and h == hours] or [F.lit("")]

    def numbers() -> Column:
        a, sep, b = (F.regexp_extract(t, SHAPES["numbers"], i) for i in (1, 2, 3))
        usual = F.when(_twelve_hours(t), sep.isin(*leads(True))).otherwise(sep.isin(*leads(False)))
        day_leads = F.when(a.cast("int") > 12, True).when(b.cast("int") > 12, False).otherwise(usual)
        return F.when(day_leads, parts("numbers", "$4|$3|$1|$5")).otherwise(parts("numbers", "$4|$1|$3|$5"))

    return (
        F.when(like("ymd"), parts("ymd", "$1|$2|$3|$4"))
        .when(like("numbers"), numbers())
        .when(like("day_name"), parts("day_name", "$3|$2|$1|$4"))
        .when(like("name_day"), parts("name_day", "$3|$1|$2|$4"))
        .when(like("compact"), parts("compact", "$1|$2|$3|$4"))
        .when(like("month"), parts("month", "$1|$2|1|"))
    )


def _rebuilt(split: Column) -> Column:
    """One ISO text of what was taken apart; null where the time of day is none."""
    part = lambda i: F.split_part(split, F.lit("|"), F.lit(i))
    named = F.lpad(((F.instr(F.lit(_MONTHS), part(2)) + 2) / 3).cast("int").cast("string"), 2, "0")
    month = F.when(F.length(part(2)) == 3, named).otherwise(F.lpad(part(2), 2, "0"))
    day = F.concat_ws("-", _century(part(1)), month, F.lpad(part(3), 2, "0"))

    def clocked(fields: Column) -> Column:
        of = lambda i: F.split_part(fields, F.lit("|"), F.lit(i))
        hour = of(1).cast("int")
        half = F.when(of(5) == "", hour).when(hour.between(1, 12), hour % 12 + F.when(of(5) == "P", 12).otherwise(0))
        zone = F.when(of(6).isin("UTC", "GMT"), "Z").otherwise(F.regexp_replace(F.regexp_replace(of(6), r"^([+-]\d{2}):?(\d{2})$", "$1:$2"), r"^([+-]\d{2})$", "$1:00"))
        second = F.when(of(3) == "", "00").otherwise(of(3))
        fraction = F.when(of(4) == "", "").otherwise(F.concat(F.lit("."), of(4)))
        return F.concat(F.lit("T"), F.lpad(half.cast("string"), 2, "0"), F.lit(":"), of(2), F.lit(":"), second, fraction, zone)

    clock = F.when(F.regexp_like(part(4), F.lit(_CLOCK)), F.regexp_replace(part(4), _CLOCK, "$1|$2|$3|$4|$5|$6"))
    return F.when(part(4) == "", day).otherwise(F.concat(day, _let(clock, clocked)))


def _century(y: Column) -> Column:
    return F.when(F.length(y) == 4, y).otherwise(F.concat(F.when(y >= "69", "19").otherwise("20"), y))
