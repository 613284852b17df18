"""Benchmark decontamination with one Aho-Corasick automaton over word numbers.

Every window of ten consecutive words of a benchmark item (or the whole item, if
it has fewer) is a pattern.  Words are numbered, so that a pattern is a sequence of
numbers and a match is bounded by words; the automaton reads each document once,
and a match at word k maps back to character offsets of the text as it was written.

The patterns are broadcast.  Their size is checked: beyond ``max_pattern_words``
words they are dealt into blocks of at most that size and each block is a pass over
the documents, whose findings are united, so no window is ever left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import bounded_batches
from ._words import word_spans, words_of

#: Words in all patterns of one automaton; some 300 MB of memory at most.
MAX_PATTERN_WORDS = 3_000_000


def item_windows(text: str | None, width: int) -> list[tuple[bytes, ...]]:
    """The windows of one item."""
    words = words_of(text)
    if not words:
        return []
    return list(dict.fromkeys(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))))


def _blocks(items: Iterator[tuple[object, str | None]], width: int, most: int) -> Iterator[list[tuple]]:
    block, words = [], 0
    for item, text in items:
        windows = item_windows(text, width)
        n = sum(map(len, windows))
        if block and words + n > most:
            yield block
            block, words = [], 0
        if windows:
            block.append((item, windows))
            words += n
    if block:
        yield block


class WindowScanner:
    """The automaton of one block of items."""

    def __init__(self, block: list[tuple[object, list[tuple[bytes, ...]]]]):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        self.items: list[object] = [item for item, _ in block]
        owners: dict[tuple[int, ...], list[int]] = {}
        for i, (_, windows) in enumerate(block):
            for window in windows:
                key = tuple(self.number.setdefault(w, len(self.number) + 1) for w in window)
                owners.setdefault(key, []).append(i)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, of in owners.items():
            self.automaton.add_word(key, (len(key), tuple(of)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners
        # A match lies inside a run of words that all occur in patterns.
        self.run = re.compile(b"\x01{%d,}" % min(map(len, owners), default=1))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged hit ranges of word positions [start, end), and the numbers of the items."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        if self.empty or not words:
            return spans, items
        number = self.number
        for run in self.run.finditer(bytes(map(number.__contains__, words))):
            base = run.start()
            for last, (n, of) in self.automaton.iter(tuple([number[w] for w in words[base : run.end()]])):
                items.update(of)
                start = base + last - n + 1
                while spans and spans[-1][1] >= start:  # patterns of several lengths can reach back
                    start = min(start, spans.pop()[0])
                spans.append((start, base + last + 1))
        return spans, items


def scan_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    width: int = 10,
    spans: bool = True,
    max_pattern_words: int = MAX_PATTERN_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items, spans, contaminated.

    ``items`` holds the identifiers of the items found, as strings, sorted; ``spans``
    the hit passages as [start, end) offsets in characters of the original text.
    Null and empty texts have no words and no hits.  Items without words match
    nothing; items that are repeated or share an identifier count once.  Items
    without an identifier count as the identifier "null".  Other columns are ignored.
    An empty benchmark hits nothing; an empty table of documents gives none.
    """
    bounded_batches(docs.sparkSession)
    items = (
        (str(r[0]) if r[0] is not None else "null", r[1])
        for r in benchmark.select(item_col, item_text_col).orderBy(item_col, item_text_col).toLocalIterator()
    )
    id_type = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    schema = (
        f"id {id_type}, n_words long, n_hit long, n_items long, items array<string>, "
        "spans array<struct<start:int,end:int>>, contaminated boolean"
    )
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = list(_blocks(items, width, max_pattern_words)) or [[]]
    if len(blocks) == 1:
        return source.mapInArrow(_scanning(blocks[0], spans), schema).withColumnRenamed("id", id_col)
    # Several passes: each gives the words hit, united per row; runs of them are the passages.
    row = F.monotonically_increasing_id()
    keyed = source.withColumn("row", row)
    passes = None
    for block in blocks:
        part = keyed.mapInArrow(
            _ranges(block, spans), f"id {id_type}, row long, n_words long, hits array<struct<k:int,start:int,end:int>>, items array<string>"
        )
        passes = part if passes is None else passes.unionByName(part)
    united = passes.groupBy("row").agg(
        F.first("id").alias("id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
    )
    # The outer transform binds the array of words once.
    passages = """flatten(transform(array(hits), h -> zip_with(
        filter(h, (x, i) -> i = 0 or h[greatest(i - 1, 0)].k < x.k - 1),
        filter(h, (x, i) -> i = size(h) - 1 or h[least(i + 1, size(h) - 1)].k > x.k + 1),
        (x, y) -> struct(x.start as start, y.end as end))))"""
    return united.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.expr(passages if spans else "cast(array() as array<struct<start:int,end:int>>)").alias("spans"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _scanning(block, with_spans: bool):
    def scan(batches):
        scanner = WindowScanner(block)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                out = {k: [] for k in ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")}
                for text in batch.column(1).to_pylist():
                    words = words_of(text)
                    ranges, found = scanner.scan(words)
                    hit = sum(b - a for a, b in ranges)
                    names = sorted({scanner.items[i] for i in found})
                    places = word_spans(text) if hit and with_spans else []
                    out["n_words"].append(len(words))
                    out["n_hit"].append(hit)
                    out["n_items"].append(len(names))
                    out["items"].append(names)
                    out["spans"].append([{"start": places[a][0], "end": places[b - 1][1]} for a, b in ranges] if places else [])
                    out["contaminated"].append(hit > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(out["n_words"], pa.int64()),
                        pa.array(out["n_hit"], pa.int64()),
                        pa.array(out["n_items"], pa.int64()),
                        pa.array(out["items"], pa.list_(pa.string())),
                        pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array(out["contaminated"], pa.bool_()),
                    ],
                    names=["id", *out],
                )

    return scan


def _ranges(block, with_spans: bool):
    def scan(batches):
        scanner = WindowScanner(block)
        for batch in batches:
            n_words, hits, items = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                ranges, found = scanner.scan(words)
                places = word_spans(text) if ranges and with_spans else None
                n_words.append(len(words))
                hit = [(k, *(places[k] if places else (0, 0))) for a, b in ranges for k in range(a, b)]
                hits.append([dict(zip(("k", "start", "end"), x)) for x in hit])
                items.append(sorted({scanner.items[i] for i in found}))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(n_words, pa.int64()),
                    pa.array(hits, pa.list_(pa.struct([(n, pa.int32()) for n in ("k", "start", "end")]))),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=["id", "row", "n_words", "hits", "items"],
            )

    return scan


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with all their columns, in one pass."""
    found = scan_documents(
        docs.withColumn("_row", F.struct(*docs.columns)), benchmark, text_col, "_row", spans=False, **options
    )
    return found.filter(~F.col("contaminated")).select("_row.*")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
