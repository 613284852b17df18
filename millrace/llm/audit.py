"""Interaction of filters: what each removes in every order in which they could be applied.

A document's failures are a set of filters, five bits.  A table of 32 sets by 120 orders,
made once, says at which step a set first fails.  Each task counts its documents by
part, set and label, looks the steps up and adds the counts to an array of part, order,
step and label; the arrays of all tasks are summed.  Everything else follows from these
sums.  Only digests and bits are shuffled, and groups of equal texts are salted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import bounded_batches, spread_of, written

#: Ways in which the rows of one text are dealt out, parts that a task counts before it passes them on.
WAYS, PARTS = 32, 256
#: Counts are kept for documents that are neither, good, toxic, or both.
LABELS = 4
_UPPER = bytes(range(0x41, 0x5B))
_LATER = bytes(range(0x80, 0xC0))


class Facts(NamedTuple):
    """What filters ask of a text."""

    words: int
    distinct: int
    upper: int
    points: int
    data: bytes


def facts_of(data: bytes) -> Facts:
    """Words are maximal runs of other than ASCII white space; points are code points."""
    words = data.split()
    rest = data.translate(None, _UPPER)
    return Facts(len(words), len(set(words)), len(data) - len(rest), len(data.translate(None, _LATER)), data)


def _marked(f: Facts) -> bool:
    return any(c in f.data for c in b"#$%&*|")


#: Conditions of failure by letter; the letter ``duplicate`` of audit_filters has none, as it looks at other rows.
FILTERS: dict[str, Callable[[Facts], bool]] = {
    "A": lambda f: f.words < 200,
    "B": lambda f: 100 * f.distinct < 50 * f.words,
    "C": lambda f: 100 * f.upper > 3 * f.points,
    "D": _marked,
}


def first_failures(n: int) -> np.ndarray:
    """By set of failures and order: the step, from 0, that removes such a document; ``n`` if none does."""
    orders = np.array(list(permutations(range(n))))
    fails = (np.arange(2**n)[:, None, None] >> orders[None]) & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), n)


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    part_col: str = "lang",
    *,
    filters: dict[str, Callable[[Facts], bool]] = FILTERS,
    duplicate: str = "E",
) -> DataFrame:
    """A row per part, order of all filters and step: what the step's filter does there.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.  A text fails ``duplicate`` if a smaller identifier has the same; rows
    without an identifier never do, and repeated rows with the same identifier do so together.  Null texts and null parts
    count as empty; labels repeated for an identifier count as good or toxic if any of them says so.
    Every part gets all rows, zeros included; an empty table gives none.  Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    letters = [*filters, duplicate]
    conditions = list(filters.values())
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    id_type = docs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for value in batch.column(2).cast(pa.binary()):
                data = value.as_py() or b""
                facts = facts_of(data)
                masks.append(sum(bool(fails(facts)) << i for i, fails in enumerate(conditions)))
                digests.append(hashlib.sha256(data).digest())
            columns = [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "part", "_mask", "_digest"])

    texts = docs.select(F.col(id_col).alias("_id"), part, F.col(text_col).cast("string").alias("_text"))
    judged = written(texts.mapInArrow(judge, f"_id {id_type}, part string, _mask int, _digest binary"), "audit-judged")

    copied = judged.groupBy("_digest").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).filter("_least < _most")
    salts = F.explode(F.array(*[F.lit(i) for i in range(WAYS)])).alias("_salt")
    least = copied.select("_digest", "_least", salts)
    known = labels.groupBy(F.col(id_col).alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic")
    )
    again = F.coalesce(F.col("_id") > F.col("_least"), F.lit(False)).cast("int")
    label = F.coalesce(F.col("_good"), F.lit(0)) + 2 * F.coalesce(F.col("_toxic"), F.lit(0))
    marked = (
        judged.withColumn("_salt", spread_of(F.coalesce(F.col("_id").cast("string"), F.col("_digest").cast("string")), WAYS))
        .join(least, ["_digest", "_salt"], "left")
        .select("_id", "part", (F.col("_mask") + again * 2 ** len(conditions)).alias("_mask"))
        .join(known, "_id", "left")
        .select("part", "_mask", label.cast("int").alias("_label"))
    )
    n = len(letters)
    sums = (
        marked.mapInArrow(_removals(n), "part string, counts array<long>")
        .select("part", F.posexplode("counts").alias("_pos", "_n"))
        .groupBy("part", "_pos")
        .agg(F.sum("_n").alias("_n"))
    )
    whole = sums.groupBy("part").agg(F.collect_list(F.struct("_pos", "_n")).alias("cells"))
    return whole.mapInArrow(
        _report(letters),
        "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long",
    )


def _removals(n: int):
    """Counts of a task as one array per part: order, step (one more for those that stay), label."""
    table = first_failures(n)
    sets, orders = table.shape

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            rows = []
            for at in range(len(parts)):
                seen = counts[at]
                mask, label = np.nonzero(seen)
                slots = (np.arange(orders) * (n + 1) + table[mask]) * LABELS + label[:, None]
                weights = np.broadcast_to(seen[mask, label][:, None], slots.shape)
                rows.append(np.bincount(slots.ravel(), weights.ravel(), orders * (n + 1) * LABELS).astype(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.string()), pa.array(rows, pa.list_(pa.int64()))], ["part", "counts"])

        parts: dict[str, int] = {}
        counts = np.zeros((PARTS, sets, LABELS), np.int64)
        for batch in batches:
            found = batch.column(0).dictionary_encode()
            names = found.dictionary.to_pylist()
            for start in range(0, len(names), PARTS):
                some = names[start : start + PARTS]
                if len(set(some) | parts.keys()) > PARTS:
                    yield out()
                    parts.clear()
                    counts[:] = 0
                own = np.full(len(names), -1)
                own[start : start + len(some)] = [parts.setdefault(name, len(parts)) for name in some]
                at = own[found.indices.to_numpy(zero_copy_only=False)]
                cell = (at * sets + batch.column(1).to_numpy()) * LABELS + batch.column(2).to_numpy()
                counts += np.bincount(cell[at >= 0], minlength=counts.size).reshape(counts.shape)
        if parts:
            yield out()

    return count


def _report(letters: list[str]):
    """The rows of a part from its summed array."""
    n = len(letters)
    orders = np.array(list(permutations(range(n))))
    names = ["".join(letters[i] for i in order) for order in orders]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flat = np.zeros(len(orders) * (n + 1) * LABELS, np.int64)
                flat[[c["_pos"] for c in cells]] = [c["_n"] for c in cells]
                by_label = flat.reshape(len(orders), n + 1, LABELS)[:, :n]
                removed, total = by_label.sum(axis=2), flat[: (n + 1) * LABELS].sum()
                fails, alone, shapley = (np.zeros(n, np.int64) for _ in range(3))
                fails[orders[:, 0]] = removed[:, 0]  # first of all, a filter removes all that fail it,
                alone[orders[:, -1]] = removed[:, -1]  # last of all, those that fail it only
                np.add.at(shapley, orders, removed)
                columns = [
                    total - removed.cumsum(axis=1), removed, fails[orders] - removed, alone[orders],
                    by_label[:, :, 1::2].sum(axis=2), by_label[:, :, 2:].sum(axis=2), shapley[orders],
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * removed.size, pa.string()),
                        pa.array(np.repeat(names, n)),
                        pa.array(np.tile(np.arange(1, n + 1), len(orders)).astype(np.int32)),
                        *[pa.array(c.ravel()) for c in columns],
                    ],
                    ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
                )

    return rows
