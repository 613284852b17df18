"""Exact duplicates by a tree merge of sorted digest runs (DataFrame functions only).

Partitions hold sorted runs of digests and exchange them in binomial rounds (see
``_tree``).  At every level entries merge only if SHA-256, a second hash of 64 bits and
the byte length all agree, and one identifier is retained.  What is retained is a pair of
whether there is an identifier and that identifier; Spark aggregates such pairs over sorted input only,
so each level sorts its runs by digest and merges them in one pass, without a table of digests.

Only digests move; texts never leave the scan, which reads them once: the digests are
written to the shared folder (some 3 % of the input) and all rounds read them there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import SPREAD, written
from ._tree import merge_runs

KEY = ["_sha", "_h64", "_len"]


def exact_groups(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    *,
    keep: str = "max",
    ways: int = SPREAD,
    radix_bits: int = 4,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are.  Null counts as the empty text.  ``keep``
    says which identifier stays, "max" or "min".  Rows that repeat an identifier
    count in group_size each; the row that stays is then every row with that
    identifier and text.  Rows without an identifier are kept out of the choice
    unless the group has nothing else; keep_id is then null and kept is true.
    Other columns of the input are ignored; an empty table gives an empty one.
    """
    choose = {"max": F.max, "min": F.min}[keep]
    has = F.col("_id").isNotNull() if keep == "max" else F.col("_id").isNull()
    text = F.coalesce(F.col(text_col), F.lit(""))
    digests = written(
        docs.select(
            F.col(id_col).alias("_id"),
            # rows without identifier are spread over the runs by their number
            F.coalesce(F.col(id_col).cast("string"), F.monotonically_increasing_id().cast("string")).alias("_spread"),
            F.unhex(F.sha2(text, 256)).alias("_sha"),
            F.xxhash64(text).alias("_h64"),
            F.octet_length(text).alias("_len"),
        ),
        "digests",
    )
    tree = merge_runs(
        digests,
        KEY,
        "_spread",
        {"_kept": (choose(F.struct(has.alias("has"), "_id")), choose), "_n": (F.count(F.lit(1)), F.sum)},
        ways=ways,
        radix_bits=radix_bits,
    )
    return tree.down(tree.root).withColumn("_keep", F.col("_kept._id")).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").cast("long").alias("group_size"),
        F.coalesce(F.col("_id") == F.col("_keep"), F.col("_keep").isNull()).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows without an identifier stay, since no decision can be tied to them; rows
    that repeat both identifier and text are one document and stay together.  Rows that
    share an identifier but not the text are judged each by its own text, so no text is lost.
    """
    gone = (
        exact_groups(docs, text_col, id_col, **options)
        .filter(~F.col("kept") & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_gone"), F.col("text_sha256").alias("_sha"))
        .distinct()
    )
    same = (docs[id_col] == gone["_gone"]) & (F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == gone["_sha"])
    return docs.join(gone, same, "left_anti")
