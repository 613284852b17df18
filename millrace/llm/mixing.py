"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, served again from the start
once it is through.  A document's virtual finish time is its source's words up to and
with it, divided by the source's target; so at time 1 each source has given its target.
All finish times are range-sorted together and the mix ends where its words would
pass the budget.

Prefix sums within a source run over buckets of the shuffle key on two levels, so a
source with a third of all rows has many short windows; the running total over the global order is one
scan of sorted ranges, with one number per range added.  Texts never leave the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import bounded_batches, written

#: Rows that a window over a bucket of the shuffle key holds, about.
BUCKET_ROWS = 256
#: The first letter of a word: what no word character stands before.
_STARTS = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]"
_BEFORE = (Window.unboundedPreceding, -1)


def n_words(text: Column) -> Column:
    """Number of maximal runs of other than ASCII white space, as the letters that go with the first of each."""
    return (F.length(text) - F.length(F.regexp_replace(text, _STARTS, ""))).cast("long")


def _source_key(source_col: str) -> Column:
    """A string that sorts like the source, null last."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t"))


def shuffle_key(id_col: str, text_col: str, source_col: str, seed: str) -> Column:
    """A digest by which documents are shuffled: 32 hexadecimal digits of seed, source, identifier and text."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, text_col)]
    return F.md5(F.concat_ws(":", F.lit(seed), _source_key(source_col), *parts))


def mix_sources(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
    *,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    repeats: int = 3,
    seed: str = "",
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, weight, target, copies, taken, finish, key.

    Sources in order of their code points, null last, take ``weights`` in turn; targets are
    ``share`` of all words, dealt by weight, and stop at ``repeats`` times their source's size, what
    is over going to the others by weight.  ``copies`` is how often the mix takes the
    document, at most ``repeats``, and ``taken`` its words in the mix; ``finish`` is the virtual finish
    time of its first copy, ``key`` its place in the shuffle.  Documents are taken whole, so a source's
    words differ from its target by about a document.  The same rows give the same mix, in any order and partitioning; identical rows
    are told apart by number only.  Null and empty texts have no words and are not taken
    (finish null where the target is 0).  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    keyed = written(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).alias("_source"),
            _source_key(source_col).alias("_s"),
            n_words(F.coalesce(F.col(text_col), F.lit(""))).alias("_size"),
            shuffle_key(id_col, text_col, source_col, seed).alias("_h"),
        ),
        "mix-docs",
    )
    rows, words = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    placed = written(_cumulated(keyed, rows, int(words * share), weights, repeats), "mix-queues")
    last = _cut(placed, int(words * share), repeats)
    copies = F.lit(0)
    for epoch in range(repeats if last else 0):
        at = F.struct(_finish(F.lit(epoch)).alias("f"), F.col("_s").alias("s"), F.lit(epoch).alias("e"), F.col("_cum").alias("c"))
        end = F.struct(F.lit(last[0]).alias("f"), F.lit(last[1]).alias("s"), F.lit(last[2]).alias("e"), F.lit(last[3]).cast("long").alias("c"))
        copies = copies + F.when((F.col("_size") > 0) & (F.col("_target") > 0) & (at <= end), 1).otherwise(0)
    return placed.select(
        F.col("_id").alias(id_col),
        F.col("_source").alias(source_col),
        F.col("_size").alias("size"),
        F.col("_total").alias("source_size"),
        F.col("_weight").alias("weight"),
        F.col("_target").alias("target"),
        copies.alias("copies"),
        (copies * F.col("_size")).cast("long").alias("taken"),
        F.when(F.col("_target") > 0, _finish(F.lit(0))).alias("finish"),
        F.col("_h").alias("key"),
    )


def mixed_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as taken, with the virtual finish time ``mix_finish`` of each copy.

    Sorted by ``mix_finish`` it is the order of training.  A column of that name is replaced.
    """
    plan = mix_sources(docs, text_col, id_col, source_col, **options).filter("copies > 0")
    step = F.col("source_size") / F.col("target")
    times = plan.select(
        F.col("key").alias("_key"),
        F.explode(F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda e: F.col("finish") + e * step)).alias("mix_finish"),
    )
    rows = docs.drop("mix_finish").withColumn("_key", shuffle_key(id_col, text_col, source_col, options.get("seed", ""))).dropDuplicates(["_key"])
    return rows.join(times, "_key").drop("_key")


def _cumulated(keyed: DataFrame, rows: int, budget: int, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """``keyed`` with _cum, the words of its source up to and with a row, and its source's _total, _weight and _target."""
    fine = max(2, (max(1, rows) // BUCKET_ROWS).bit_length())
    coarse = fine // 2
    number = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")
    dealt = keyed.withColumn("_b", F.shiftright(number, 32 - fine))
    small = written(dealt.groupBy("_s", "_b").agg(F.sum("_size").alias("_n")), "mix-buckets")
    large = small.groupBy("_s", F.shiftright("_b", fine - coarse).alias("_a")).agg(F.sum("_n").alias("_m"))
    sources = _targets(written(large.groupBy("_s").agg(F.sum("_m").alias("_total")), "mix-sources"), budget, weights, repeats)
    upto_large = F.coalesce(F.sum("_m").over(Window.partitionBy("_s").orderBy("_a").rowsBetween(*_BEFORE)), F.lit(0))
    upto_small = F.coalesce(F.sum("_n").over(Window.partitionBy("_s", "_a").orderBy("_b").rowsBetween(*_BEFORE)), F.lit(0))
    starts = (
        small.withColumn("_a", F.shiftright("_b", fine - coarse))
        .join(large.withColumn("_from", upto_large).join(sources, "_s").drop("_m"), ["_s", "_a"])
        .select("_s", "_b", (F.col("_from") + upto_small).alias("_start"), "_total", "_weight", "_target")
    )
    inside = Window.partitionBy("_s", "_b").orderBy("_h", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(starts, ["_s", "_b"]).withColumn("_cum", F.col("_start") + F.sum("_size").over(inside)).drop("_start", "_b")


def _targets(sources: DataFrame, budget: int, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """Sources with _weight and _target: the level at which targets, stopped at ``repeats`` sizes, make up the budget."""
    ranked = _running(sources.withColumn("_one", F.lit(1).cast("long")), [F.col("_s")], "_one", "mix-ranks")
    turn = F.pmod(F.col("_run") + F.col("_off") - 1, F.lit(len(weights))).cast("int")
    weighed = written(
        ranked.select("_s", "_total", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), turn + 1).alias("_weight")), "mix-weights"
    )
    cap = F.col("_total") * repeats
    level, closed = float(budget) / (weighed.agg(F.sum("_weight")).first()[0] or 1), -1
    while True:
        over = F.col("_weight") * F.lit(level) > cap
        n, held, free = weighed.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("_weight"))), F.lit(0))
        ).first()
        if n == closed or not free:
            break
        level, closed = (budget - held) / free, n
    return weighed.withColumn("_target", F.least(F.col("_weight") * F.lit(level), cap.cast("double")))


def _finish(epoch: Column) -> Column:
    return (epoch * F.col("_total") + F.col("_cum")).cast("double") / F.nullif("_target", F.lit(0.0))


def _cut(placed: DataFrame, budget: int, repeats: int):
    """The last entry of the global order with which the words stay within the budget; none where even the first passes it."""
    entries = placed.filter((F.col("_size") > 0) & (F.col("_target") > 0)).select(
        "_s", "_cum", "_size", "_total", "_target", F.explode(F.array(*[F.lit(e) for e in range(repeats)])).alias("_epoch")
    )
    entries = entries.select(_finish(F.col("_epoch")).alias("_finish"), "_s", "_epoch", "_cum", "_size")
    order = [F.col(c) for c in ("_finish", "_s", "_epoch", "_cum")]
    ranged = _running(entries, order, "_size", "mix-order")
    last = ranged.filter(F.col("_run") + F.col("_off") <= budget).agg(F.max(F.struct(*order)).alias("last")).first()
    return last["last"]


def _running(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``rows`` range-sorted, with _run, the sum of ``value`` within the range so far, and _off, that of all ranges before."""
    schema = rows.schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            run = total + np.cumsum(batch.column(value).to_numpy(zero_copy_only=False), dtype=np.int64)
            total = int(run[-1]) if len(run) else total
            parts = np.full(len(run), part, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts), pa.array(run)], [*batch.schema.names, "_part", "_run"])

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ran = written(ranged.mapInArrow(add, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, _part int, _run long"), name)
    ends = ran.groupBy("_part").agg(F.max("_run").alias("_end"))
    # a row per range, so the number of partitions bounds both the window and the broadcast
    offsets = ends.select("_part", F.coalesce(F.sum("_end").over(Window.orderBy("_part").rowsBetween(*_BEFORE)), F.lit(0)).alias("_off"))
    return ran.join(F.broadcast(offsets), "_part").drop("_part")
