"""Times from text of many shapes."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.operators import prepare

CASES = {
    "2024-03-01": (2024, 3, 1),
    "  2024/3/1 ": (2024, 3, 1),
    "2024.03.01 7:05": (2024, 3, 1, 7, 5),
    "2024-03-01T10:11:12Z": (2024, 3, 1, 10, 11, 12),
    "2024-03-01T10:11:12.5Z": (2024, 3, 1, 10, 11, 12, 500000),
    "2024-03-01 10:11:12.123456789": (2024, 3, 1, 10, 11, 12, 123456),
    "2024-03-01T10:11:12+05:30": (2024, 3, 1, 4, 41, 12),
    "2024-03-01T10:11:12-0800": (2024, 3, 1, 18, 11, 12),
    "2024-03-01 10:11 +02": (2024, 3, 1, 8, 11),
    "03/31/2024": (2024, 3, 31),
    "31/03/2024": (2024, 3, 31),
    "3/4/2024 1:02:03 pm": (2024, 3, 4, 13, 2, 3),
    "03/04/24": (2024, 3, 4),
    "03-04-69": (1969, 4, 3),
    "12/31/2024 12:43 AM": (2024, 12, 31, 0, 43),
    "12/31/2024 12:43 P.M.": (2024, 12, 31, 12, 43),
    "05.06.2024 23:59:59": (2024, 6, 5, 23, 59, 59),
    "1 Jan 2024": (2024, 1, 1),
    "01 October 2024 08:10": (2024, 10, 1, 8, 10),
    "05-Sep-2024": (2024, 9, 5),
    "Sept 5, 2024": (2024, 9, 5),
    "May 5 2024, 6:00 AM": (2024, 5, 5, 6),
    "Mon, 01 Jan 2024 10:00:00 GMT": (2024, 1, 1, 10),
    "20240229": (2024, 2, 29),
    "20240229T101112": (2024, 2, 29, 10, 11, 12),
    "2024-07": (2024, 7, 1),
}
WRONG = ["", " ", "2024-13-01", "31/02/2024", "2023-02-29", "2024-01-01 25:00", "2024-01-01 13:00 PM", "2024-01-01 10", "12345", "1704087432720", "n/a", "03/06/2", "99/99/2024", "Jan 2024 5", "2024-01-01 10:00 XYZ", "Foo 5, 2024"]


def read(spark, texts, order=None, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", dates.to_timestamp(F.col("t"), order, **options).cast("timestamp_ntz").alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


def test_shapes(spark):
    assert dict(zip(CASES, read(spark, CASES))) == {t: datetime(*v) for t, v in CASES.items()}
    assert read(spark, [*WRONG, None]) == [None] * (len(WRONG) + 1)


def test_epochs(spark):
    assert read(spark, ["1704087432720", "1704080486", "170408048"], epochs=True) == [datetime(2024, 1, 1, 5, 37, 12, 720000), datetime(2024, 1, 1, 3, 41, 26), None]


@pytest.mark.parametrize(
    "texts,first",
    [
        (["01/02/2024", "13/02/2024"], datetime(2024, 2, 1)),
        (["01/02/2024", "02/13/2024"], datetime(2024, 1, 2)),
        (["01/02/2024"], datetime(2024, 1, 2)),
        (["01/02/2024", "13/02/2024", "02/13/2024 1:00 PM", "03/14/2024 1:00 PM"], datetime(2024, 2, 1)),
        (["01/02/2024 1:00 AM", "13/02/2024", "02/13/2024 1:00 PM"], datetime(2024, 1, 2, 1)),
        (["01.02.2024", "02.13.2024"], datetime(2024, 1, 2)),
        ([None, "01/02/2024", "x"], None),
    ],
)
def test_the_column_says_whether_days_come_first(spark, texts, first):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert read(spark, texts, dates.day_first(df, F.col("t")))[0] == first


def test_standardized_dates_use_the_evidence(spark):
    df = spark.createDataFrame([("01/02/2024",), ("25/12/2024",), ("bad",)], "d string")
    assert [r.d and r.d.isoformat() for r in prepare.standardize_dates(df, "d").collect()] == ["2024-02-01", "2024-12-25", None]
