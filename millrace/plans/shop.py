"""Queries over the shop's tables: clicks, sales, their lines, clients and their changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import neighbours, ordered, quantiles
from ..streaming import windows
from .catalogue import ORACLE_SQL, QUERIES, register

_PROBS = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}
_MEASURES = ["quantity", "amount", "discount", "item_id"]


def _quantiles(lines: DataFrame) -> DataFrame:
    found = quantiles.quantiles(lines, {c: F.col(c) for c in _MEASURES}, list(_PROBS.values()))
    rows = [(c, n, *q) for c, (n, q) in found.items()]  # a row per column
    kinds = ", ".join(f"{p} double" for p in _PROBS)
    return lines.sparkSession.createDataFrame(rows, f"column string, n long, {kinds}").select("column", "n", *[F.round(p, 4).alias(p) for p in _PROBS])


def _cont(c: str) -> str:
    return ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {q}), 4) AS {p}" for p, q in _PROBS.items())


register(
    "quantiles_sale_lines",
    _quantiles,
    "sale_lines",
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, {_cont(c)} FROM sale_lines""" for c in _MEASURES),
)
register(
    "quantiles_by_vendor",
    lambda li: quantiles.grouped_quantiles(li, ["vendor_id"], "amount", list(_PROBS.values())).select(
        "vendor_id", "n", *[F.round(F.col("q")[i], 4).alias(p) for i, p in enumerate(_PROBS)]
    ),
    "sale_lines",
    f"SELECT vendor_id, count(amount) AS n, {_cont('amount')} FROM sale_lines GROUP BY vendor_id HAVING count(amount) > 0",
)
register(
    "asof_client_change",
    lambda c, ch: ordered.asof_join(
        c.select("click_id", "client_id", "ts"), ch, ("ts", ">=", "valid_at"), [("client_id", "client_id")], columns={"change_id": "change_id", "valid_at": "valid_at"}, ties=["change_id"]
    ),
    "clicks client_changes",
    """SELECT c.click_id, c.client_id, c.ts, ch.change_id, ch.valid_at FROM clicks c ASOF LEFT JOIN
(SELECT client_id, valid_at, max(change_id) AS change_id FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL GROUP BY ALL) ch
ON c.client_id = ch.client_id AND c.ts >= ch.valid_at""",
)
register(
    "asof_next_sale",
    lambda c, s: ordered.asof_join(
        c.select("click_id", "client_id", "ts"), s, ("ts", "<", "sold_at"), [("client_id", "client_id")], columns={"sale_id": "sale_id", "sold_at": "sold_at"}, ties=["sale_id"], how="inner"
    ).select("click_id", "sale_id", F.floor(F.unix_micros(F.col("sold_at").cast("timestamp")) / 1_000_000 - F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("seconds")),
    "clicks sales",
    """SELECT c.click_id, s.sale_id, CAST(floor(epoch_us(s.sold_at) / 1000000 - epoch_us(c.ts) / 1000000) AS BIGINT) AS seconds FROM clicks c ASOF JOIN
(SELECT client_id, sold_at, max(sale_id) AS sale_id FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL GROUP BY ALL) s
ON c.client_id = s.client_id AND c.ts < s.sold_at""",
)
register(
    "asof_vendor_by_price",
    lambda i, v: ordered.asof_join(
        i.select("item_id", "price"), v, ("price", ">=", "balance"), columns={"vendor_id": "vendor_id"}, ties=["vendor_id"]
    ),
    "items vendors",
    """SELECT item_id, price, vendor_id FROM items ASOF LEFT JOIN
(SELECT balance, max(vendor_id) AS vendor_id FROM vendors WHERE balance IS NOT NULL GROUP BY ALL) v ON price >= balance""",
)
register(
    "range_clicks_before_sales",
    lambda c, s: ordered.range_join(
        c.select("click_id", "ts"), s.select("sale_id", "sold_at", (F.col("sold_at") - F.expr("interval 1 minute")).alias("from_ts")), "ts", "from_ts", "sold_at", closed="low"
    ).select("click_id", "sale_id"),
    "clicks sales",
    "SELECT click_id, sale_id FROM clicks JOIN sales ON ts >= sold_at - INTERVAL 1 MINUTE AND ts < sold_at",
)
register(
    "range_prices_in_totals",
    lambda i, s: ordered.range_join(
        i.select("item_id", "price"), s.filter("status is not null").groupBy("status").agg(F.min("total").alias("least"), F.max("total").alias("most")), "price", "least", "most"
    ).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("sum_price")),
    "items sales",
    """SELECT status, count(*) AS n, round(sum(price), 2) AS sum_price FROM items JOIN
(SELECT status, min(total) AS least, max(total) AS most FROM sales WHERE status IS NOT NULL GROUP BY 1) ON price BETWEEN least AND most GROUP BY status""",
)


def _stamps(stamps: DataFrame) -> DataFrame:
    order = dates.day_first(stamps, F.col("raw"))
    return stamps.select("stamp_id", dates.to_timestamp(F.col("raw"), order, epochs=True).cast("timestamp_ntz").alias("ts"))


register(
    "stamps_as_times",
    _stamps,
    "stamps",
    r"""WITH t AS (SELECT stamp_id, trim(raw) AS r FROM stamps),
n AS (SELECT stamp_id, r, r LIKE '%M' AS h, CAST(split_part(r, '/', 1) AS INT) AS a, CAST(split_part(r, '/', 2) AS INT) AS b FROM t WHERE regexp_matches(r, '^\d{1,2}/\d{1,2}/(\d{2}|\d{4})( |$)')),
v AS (SELECT h, count(*) FILTER (a > 12 AND b <= 12) > count(*) FILTER (b > 12 AND a <= 12) AS day_first FROM n GROUP BY h),
m AS (SELECT stamp_id, CASE WHEN (a > 12 OR (b <= 12 AND day_first)) THEN try_strptime(r, ['%d/%m/%Y %H:%M', '%d/%m/%Y %I:%M %p', '%d/%m/%Y'])
                       ELSE try_strptime(r, ['%m/%d/%Y %H:%M', '%m/%d/%Y %I:%M %p', '%m/%d/%Y']) END AS ts FROM n JOIN v USING (h))
SELECT t.stamp_id, CASE
  WHEN regexp_full_match(r, '\d{10}') THEN make_timestamp(CAST(r AS BIGINT) * 1000000)
  WHEN regexp_full_match(r, '\d{13}') THEN make_timestamp(CAST(r AS BIGINT) * 1000)
  WHEN regexp_full_match(r, '\d{8}') THEN try_strptime(r, '%Y%m%d')
  WHEN regexp_full_match(r, '.*T.*(Z|[+-]\d\d:?\d\d)') THEN CAST(try_strptime(replace(r, 'Z', '+0000'), ['%Y-%m-%dT%H:%M:%S%z']) AS TIMESTAMPTZ) AT TIME ZONE 'UTC'
  WHEN regexp_full_match(r, '\d{4}-\d\d') THEN try_strptime(r, '%Y-%m')
  WHEN regexp_full_match(r, '\d\d?/\d\d?/.*') THEN m.ts
  ELSE try_strptime(r, ['%Y-%m-%d %H:%M:%S', '%d.%m.%Y %H:%M:%S', '%d %b %Y %H:%M']) END AS ts
FROM t LEFT JOIN m ON m.stamp_id = t.stamp_id""",
)

QUERIES["stream_client_states"] = lambda spark, sf_dir: windows.last_states(
    spark, f"{sf_dir.rstrip('/')}/client_changes.parquet", ["client_id"], ["valid_at", "seq", "change_id"], removed="op = 'D'"
).select("client_id", "change_id", "valid_at", "op")
ORACLE_SQL["stream_client_states"] = """SELECT client_id, change_id, valid_at, op FROM
(SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY valid_at DESC NULLS LAST, seq DESC NULLS LAST, change_id DESC NULLS LAST) AS r FROM client_changes)
WHERE r = 1 AND coalesce(op <> 'D', true)"""

register(
    "neighbour_information",
    lambda li: neighbours.neighbour_information(li, ["quantity", "amount", "discount", "item_id", "shipped_at"], "flag").select("column", F.round("mi", 6).alias("mi"), "n"),
    "sale_lines",
    None,
)
