"""The queries of this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    audit,
    chat_format,
    decontaminate,
    exact_dedup,
    html_text,
    jaccard_join,
    licenses,
    mixing,
    ranking,
    secrets_scan,
    sentence_pieces,
    token_counts,
    toxicity,
)
from ._tables import read

#: Where the public tokenizer files are; a parameter of the operators that use them.
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_bytes(name: str) -> bytes:
    """The content of a public tokenizer file, read on the driver (at most 2 MB)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat_format.turns_as_calls(read(spark, sf_dir, "conversations"))
    schemas = spark.sql(
        "SELECT * FROM VALUES ('reply', 'chars', 'integer', true), ('reply', 'words', 'integer', true), ('reply', 'after', 'string', false) AS s(name, param, type, required)"
    )
    return chat_format.format_chats(messages, schemas)


OP2_SQL = """
WITH m AS (
  SELECT conv_id, turn, role, text, coalesce(len(text), 0) AS chars, len(regexp_extract_all(coalesce(text, ''), '[^ \n]+')) AS words,
         CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS pos,
         CASE role WHEN 'user' THEN conv_id || '-' || turn WHEN 'assistant' THEN conv_id || '-' || (turn - 1) END AS call_id,
         role IN ('user', 'assistant') AS tool
  FROM conversations
),
link AS (
  SELECT conv_id, call_id, pos, bool_or(role = 'user') AS c, bool_or(role = 'assistant') AS r FROM m WHERE tool GROUP BY ALL
),
lev AS (
  SELECT conv_id, call_id, CASE WHEN pos < 2 THEN 0 WHEN count(*) FILTER (r) OVER w = pos // 2 THEN pos // 2 ELSE -1 END AS level
  FROM link WHERE c WINDOW w AS (PARTITION BY conv_id, pos % 2 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT m.conv_id, turn, role, m.call_id, CASE WHEN tool THEN coalesce(c AND r, false) END AS linked,
       CAST(level AS BIGINT) AS level,
       CASE WHEN role = 'user' THEN concat_ws(',', CASE WHEN words % 7 = 0 THEN 'missing:chars' END, CASE WHEN chars % 5 = 0 THEN 'type:words' END) ELSE '' END AS errors,
       CASE role
         WHEN 'user' THEN '{"arguments":{' || CASE WHEN turn >= 2 THEN '"after":"$ref:' || m.conv_id || '-' || (turn - 2) || '",' ELSE '' END
              || CASE WHEN words % 7 <> 0 THEN '"chars":' || chars || ',' ELSE '' END
              || '"words":' || CASE WHEN chars % 5 = 0 THEN '"' || words || '"' ELSE CAST(words AS VARCHAR) END
              || '},"call_id":' || to_json(m.call_id) || CASE WHEN text IS NULL THEN '' ELSE ',"content":' || to_json(text) END || ',"name":"reply","role":"user"}'
         WHEN 'assistant' THEN '{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || to_json(text) || ',' END || '"result_of":' || to_json(m.call_id) || ',"role":"assistant"}'
         ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' END AS json
FROM m LEFT JOIN link ON m.conv_id = link.conv_id AND m.call_id = link.call_id LEFT JOIN lev ON m.conv_id = lev.conv_id AND m.call_id = lev.call_id
"""


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.find_secrets(read(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"), keep="max")


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item, least(len(w), 10) AS n,
         array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM pat),
pos AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n
),
hit AS (SELECT doc_id, i, pos.n, item FROM pos JOIN pat ON pos.g = pat.g AND pos.n = pat.n),
words AS (SELECT DISTINCT doc_id, k FROM hit, unnest(range(i, i + n)) AS u(k)),
nw AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nw USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_documents(read(spark, sf_dir, "documents"), tokenizer_bytes(PIECE_MODEL))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_bytes(BYTE_BPE), "json", limit=1024)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents")).drop("detections")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(read(spark, sf_dir, "documents"), width=3, percent=90)


OP9_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 3) - 1), ' ') AS s
  FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS u(i) WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM sh AS a JOIN sh AS b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  WHERE na.n * 10 >= nb.n * 9 AND nb.n * 10 >= na.n * 9
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))
),
reach AS (
  SELECT doc_id AS node, doc_id AS label FROM d
  UNION
  SELECT links.y, reach.label FROM reach JOIN links ON links.x = reach.node WHERE reach.label < links.y
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.label) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.node = d.doc_id GROUP BY d.doc_id, n.n
"""

def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(read(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.0, repeats=3)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(':' || coalesce('s' || source, 't') || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h
  FROM documents
),
src AS (
  SELECT s, CAST(sum(size) AS BIGINT) AS total, [5, 2, 1][1 + (row_number() OVER (ORDER BY s) - 1) % 3] AS w FROM d GROUP BY s
),
t AS (SELECT CAST(sum(total) AS BIGINT) AS budget FROM src),
level AS (
  SELECT 0 AS i, CAST(budget AS DOUBLE) / (SELECT sum(w) FROM src) AS lam FROM t
  UNION ALL
  SELECT i + 1, coalesce(((SELECT budget FROM t) - (SELECT coalesce(sum(3 * total), 0) FROM src WHERE w * lam > 3 * total))
                         / nullif((SELECT sum(w) FROM src WHERE w * lam <= 3 * total), 0), lam)
  FROM level WHERE i < 60
),
goal AS (SELECT s, total, least(w * (SELECT lam FROM level WHERE i = 60), CAST(3 * total AS DOUBLE)) AS target FROM src),
q AS (
  SELECT doc_id, d.s, h, size, total, target,
         CAST(sum(size) OVER (PARTITION BY d.s ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
  FROM d JOIN goal ON d.s = goal.s
),
e AS (
  SELECT doc_id, s, h, size, cum, epoch, CAST(epoch * total + cum AS DOUBLE) / target AS finish
  FROM q, (VALUES (0), (1), (2)) AS v(epoch) WHERE size > 0 AND target > 0
),
run AS (SELECT *, sum(size) OVER (ORDER BY finish, s, epoch, cum ROWS UNBOUNDED PRECEDING) AS upto FROM e),
got AS (SELECT s, h, cum, CAST(sum(size) AS BIGINT) AS taken FROM run WHERE upto <= (SELECT budget FROM t) GROUP BY s, h, cum)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.total AS source_size, q.target, CASE WHEN q.size > 0 THEN coalesce(got.taken, 0) ELSE 0 END AS taken
FROM q LEFT JOIN got ON q.s = got.s AND q.h = got.h AND q.cum = got.cum
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH least AS (SELECT coalesce(text, '') AS t, min(doc_id) AS low FROM documents GROUP BY 1),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
m AS (
  SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(w.doc_id > low, false) AS e, coalesce(good, false) AS good, coalesce(bad, false) AS bad
  FROM w JOIN least USING (t) LEFT JOIN lab ON lab.doc_id = w.doc_id
),
sets AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
         || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
         count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (bad) AS n_bad
  FROM m GROUP BY ALL
),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT o1.x || o2.x || o3.x || o4.x || o5.x AS filter_order
  FROM l AS o1, l AS o2, l AS o3, l AS o4, l AS o5 WHERE len(list_distinct([o1.x, o2.x, o3.x, o4.x, o5.x])) = 5
),
steps AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i] AS f, substr(filter_order, 1, CAST(i - 1 AS BIGINT)) AS before
  FROM o, unnest(range(1, 6)) AS u(i)
),
r AS (
  SELECT part, filter_order, step, f,
         CAST(sum(CASE WHEN length(translate(fails, before || f, '')) = length(fails) THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN contains(fails, f) AND length(translate(fails, before, '')) = length(fails) THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN contains(fails, f) AND length(translate(fails, before, '')) < length(fails) THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN fails = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN contains(fails, f) AND length(translate(fails, before, '')) = length(fails) THEN n_good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN contains(fails, f) AND length(translate(fails, before, '')) = length(fails) THEN n_bad ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM sets, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""


def ranked_lines(lines: DataFrame) -> DataFrame:
    """Sale lines with their group, pair and cents, as op13 ranks them."""
    hot = F.coalesce(F.crc32(F.col("sale_id").cast("string")) % 5 == 0, F.lit(False))
    own = lambda value: F.when(hot, -1).otherwise(value).cast("long")
    month = 100 * F.year("shipped_at") + F.month("shipped_at")
    return lines.select(
        own(F.col("vendor_id")).alias("vendor_id"),
        own(F.coalesce(F.col("item_id") % 5, F.lit(-1))).alias("part"),
        own(F.coalesce(month, F.lit(-1))).alias("month"),
        F.floor(F.col("quantity") / 10).cast("long").alias("tens"),
        F.floor(100 * F.col("discount") + 0.5).cast("long").alias("percent"),
        F.col("sale_id").cast("long").alias("sale_id"),
        F.col("line_no").cast("long").alias("line_no"),
        F.col("quantity").cast("long").alias("quantity"),
        F.floor(100 * F.col("amount") + 0.5).cast("long").alias("amount_cents"),
    )


def op13_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = ranking.top_places(
        ranked_lines(read(spark, sf_dir, "sale_lines")),
        ["vendor_id", "part", "month"],
        [("tens", "desc"), ("percent", "asc")],
        ["sale_id", "line_no", "quantity", "amount_cents"],
        2,
    )
    return first.select("vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")


OP13_SQL = """
WITH byte AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS tab
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n)
),
ids AS (
  SELECT sale_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
                                  lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) % 5 = 0 AS hot
  FROM (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL), byte
),
l AS (
  SELECT CASE WHEN hot THEN -1 ELSE vendor_id END AS vendor_id, CASE WHEN hot THEN -1 ELSE coalesce(item_id % 5, -1) END AS part,
         CASE WHEN hot THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END AS month,
         CAST(floor(quantity / 10) AS BIGINT) AS tens, CAST(floor(100 * discount + 0.5) AS BIGINT) AS percent,
         s.sale_id, CAST(line_no AS BIGINT) AS line_no, CAST(quantity AS BIGINT) AS quantity, CAST(floor(100 * amount + 0.5) AS BIGINT) AS amount_cents
  FROM sale_lines AS s LEFT JOIN ids ON ids.sale_id = s.sale_id
),
r AS (
  SELECT *, count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied,
         row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent NULLS FIRST,
                            sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos
  FROM l
)
SELECT CAST(vendor_id AS BIGINT) AS vendor_id, CAST(part AS BIGINT) AS part, CAST(month AS BIGINT) AS month, pos, pos AS place,
       sale_id, line_no, quantity, percent, amount_cents, tied
FROM r WHERE pos <= 2
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_chat_format": op2_chat_format,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_secrets": op5_secrets,
    "op6_sentence_pieces": op6_sentence_pieces,
    "op7_token_counts": op7_token_counts,
    "op8_html_text": op8_html_text,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_licenses": op10_licenses,
    "op11_source_mix": op11_source_mix,
    "op12_filter_audit": op12_filter_audit,
    "op13_first_lines": op13_first_lines,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op4_decontaminate": OP4_SQL,
    "op9_jaccard_join": OP9_SQL,
    "op11_source_mix": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_first_lines": OP13_SQL,
}
