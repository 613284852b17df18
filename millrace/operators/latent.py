"""Latent vectors of texts: a randomised decomposition of the matrix of documents and terms.

The matrix is the table of an index's postings, packed into tiles of whole documents.  Vectors of random signs, drawn from each term's digest, are
taken through the matrix and back a few times (Halko, Martinsson and Tropp 2011).  A task goes through a band of tiles, one after another: a term's
vector comes to the band once, before the first tile that has the term, its sum leaves once, after the last, and both are held between these only.
What moves is a row for each band and term of it, with numbers of two bytes, and the tiles, of which a posting takes about two bytes.
Between passes the vectors are made orthogonal by their Gram matrix, whose size is that of a vector squared; nothing else reaches the driver.

Texts then are near that share no word but words that go together elsewhere.
"""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import forget, place_of, save, staged
from .search import TextIndex, nearest

#: Dimensions, further ones that only the passes have, and passes.
RANK, SPARE, PASSES = 64, 16, 4
#: Postings of a tile, about: documents are dealt to tiles by hash and stay whole.
TILE = 1_500_000
#: Tiles of a band at most.
BAND = 32
#: Postings that a task deals to tiles at once.
DEALT = 1_000_000
#: Postings that are multiplied at once, and rows that are given at once.
AT_ONCE, ROWS = 40_000, 10_000


def _drawn(terms: list[str], width: int, seed: int) -> np.ndarray:
    """A vector of random signs for each term, the same in every run."""
    size = -(-width // 8)
    digests = b"".join(hashlib.blake2b(t.encode(), digest_size=size, key=str(seed).encode()).digest() for t in terms)
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(len(terms), size), axis=1)[:, :width]
    return bits.astype(np.int16) * 2 - 1


def _band(tiles: int, tasks: int) -> int:
    """Tiles of a band: all tasks have one, or about equally many."""
    rounds = max(1, -(-tiles // (tasks * BAND)))
    return max(1, -(-tiles // (tasks * rounds)))


def _planes(values: np.ndarray) -> bytes:
    """Numbers of four bytes: their first bytes together, then their second ones, and so on."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: pa.Scalar, kind: type) -> np.ndarray:
    planes = np.frombuffer(data.as_buffer(), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _written(lists: dict, planes: dict[str, np.ndarray]) -> bytes:
    """Lists and numbers of four bytes as a compressed Arrow stream of one row."""
    row = {name: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for name, c in lists.items()}
    batch = pa.record_batch(row | {name: pa.array([_planes(x)], pa.binary()) for name, x in planes.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read(data: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(data.as_buffer()).read_next_batch()


def _dealt(postings: DataFrame, count: int) -> DataFrame:
    """(tile, data): what a task has for a tile, posting by posting by term, with weights as numbers of times the least one of their term."""

    def deal(table: pa.Table):
        tile = table.column("tile").to_numpy()
        term = table.column("term").combine_chunks().dictionary_encode()
        at, w = term.indices.to_numpy(), table.column("weight").to_numpy()
        unit = np.full(len(term.dictionary), np.inf)
        np.minimum.at(unit, at, w)
        times, unit = (w / unit[at]).astype(np.float32), unit.astype(np.float32)
        order = np.lexsort((at, tile))
        keys, ends = table.column("key").combine_chunks(), np.flatnonzero(np.diff(tile[order], append=-1)) + 1
        for lo, hi in zip([0, *ends], ends):
            mine = order[lo:hi]
            terms, counts = np.unique(at[mine], return_counts=True)
            lists = {"keys": keys.take(pa.array(mine)), "terms": term.dictionary.take(pa.array(terms)), "unit": unit[terms]}
            yield pa.record_batch({"tile": pa.array([tile[mine[0]]], pa.int32()), "data": pa.array([_written(lists, {"counts": counts.astype(np.int32), "times": times[mine]})], pa.binary())})

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= DEALT:
                yield from deal(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from deal(pa.Table.from_batches(held))

    tile = F.pmod(F.xxhash64("key"), F.lit(count)).cast("int").alias("tile")
    return postings.select(tile, "key", "term", "weight").mapInArrow(run, "tile int, data binary")


def _tiles(postings: DataFrame, count: int) -> DataFrame:
    """(tile, data), rows of unit length: keys and terms of a tile, and for each posting, document by document, its term's place and weight.

    A weight is a number of times a unit of its term, over the length of its document; places are steps within a document.
    """

    def pack(table: pa.Table) -> pa.Table:
        parts = [_read(data) for data in table.column("data")]
        key, term = (pa.concat_arrays([x.column(c)[0].values for x in parts]).dictionary_encode() for c in ("keys", "terms"))
        counts = np.concatenate([_from_planes(x.column("counts")[0], np.int32) for x in parts])
        of, at = key.indices.to_numpy(), np.repeat(term.indices.to_numpy(), counts)
        w = np.concatenate([_from_planes(x.column("times")[0], np.float32) for x in parts]) * np.repeat(np.concatenate([x.column("unit")[0].values.to_numpy() for x in parts]), counts)
        del parts, counts
        length = np.sqrt(np.bincount(of, w.astype(float) * w))
        unit = np.full(len(term.dictionary), np.inf, np.float32)
        np.minimum.at(unit, at, w)
        times = w / unit[at]
        common = np.argsort(-np.bincount(at), kind="stable")  # common terms first, so that steps are short
        place = np.empty(len(common), np.int32)
        place[common] = np.arange(len(common), dtype=np.int32)
        at = place[at]
        order = np.lexsort((at, of))
        sizes = np.bincount(of).astype(np.int32)
        starts = np.cumsum(sizes) - sizes
        steps = np.diff(at[order], prepend=np.int32(0))
        steps[starts] = at[order[starts]]
        lists = {"keys": key.dictionary, "terms": term.dictionary.take(pa.array(common)), "sizes": sizes, "scale": (1 / length).astype(np.float32), "unit": unit[common]}
        data = _written(lists, {"steps": steps, "times": times[order]})
        return pa.table([table.column("tile").slice(0, 1), pa.array([data], pa.binary())], ["tile", "data"])

    return staged(_dealt(postings, count).groupBy("tile").applyInArrow(pack, "tile int, data binary"))


def _sums(values: np.ndarray, by: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The weighted sums of the rows ``values[by]`` from each start to the next; no run is empty."""
    out = np.empty((len(starts), values.shape[1]), np.float32)
    ends = np.append(starts[1:], len(by))
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + AT_ONCE, "right")))
        lo, hi = starts[first], ends[last - 1]
        out[first:last] = np.add.reduceat(values[by[lo:hi]] * weight[lo:hi, None], starts[first:last] - lo, axis=0)
        first = last
    return out


class _Tile:
    def __init__(self, data: pa.BinaryScalar):
        row = _read(data)
        get = lambda c: row.column(c)[0].values
        self.keys, self.terms, self.sizes = get("keys"), get("terms"), get("sizes").to_numpy()
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        sums = np.cumsum(_from_planes(row.column("steps")[0], np.int32), dtype=np.int64)
        self.at = (sums - np.repeat(np.append(0, sums[ends[:-1] - 1]), self.sizes)).astype(np.int32)
        self.weight = _from_planes(row.column("times")[0], np.float32) * get("unit").to_numpy()[self.at] * np.repeat(get("scale").to_numpy(), self.sizes)

    def forth(self, x: np.ndarray, scale: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Vectors of documents from those of terms, which are in the rows ``place`` of ``x`` times ``scale``."""
        by = place[self.at]
        return _sums(x, by, self.weight * scale[by], self.starts)

    def back(self, y: np.ndarray) -> np.ndarray:
        """The tile's share in the vectors of its terms."""
        order = np.argsort(self.at, kind="stable")
        counts = np.bincount(self.at)
        return _sums(y, np.repeat(np.arange(len(y), dtype=np.int32), self.sizes)[order], self.weight[order], np.cumsum(counts) - counts)


def _listed(ids: pa.Array, vectors: np.ndarray):
    """Batches of (id, vec), as numbers of four bytes."""
    for k in range(0, len(ids), ROWS):
        part = np.ascontiguousarray(vectors[k : k + ROWS], np.float32)
        ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
        yield pa.RecordBatch.from_arrays([ids.slice(k, ROWS), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))], ["id", "vec"])


def _packed(ids: pa.Array, vectors: np.ndarray, **more: pa.Array):
    """Batches of (id, vec) and more columns: the vector's scale, and its numbers over that as whole ones of two bytes."""
    for k in range(0, len(ids), ROWS):
        part = vectors[k : k + ROWS]
        scale = np.maximum(np.abs(part).max(axis=1, initial=0) / 32767, 1e-30).astype(np.float32)
        whole = np.clip(np.rint(part / scale[:, None]), -32767, 32767).astype(np.int16)
        data = np.hstack([scale[:, None].view(np.uint8), whole.view(np.uint8)])
        ends = np.arange(len(part) + 1, dtype=np.int32) * data.shape[1]
        vec = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(data.ravel())])
        yield pa.RecordBatch.from_arrays([ids.slice(k, ROWS), vec, *(c.slice(k, ROWS) for c in more.values())], ["id", "vec", *more])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers and scales of vectors; there is one at least."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)
    return np.ascontiguousarray(data[:, 4:]).view(np.int16), np.ascontiguousarray(data[:, :4]).view(np.float32).ravel()


def _numbers(column: pa.Array) -> np.ndarray:
    whole, scale = _unpacked(column)
    return whole * scale[:, None].astype(float)


def _spans(tiles: DataFrame, band: int) -> DataFrame:
    """(id, first, last) of each band and term: the first and the last tile that has it."""

    def terms(batches):
        for batch in batches:
            for tile, data in zip(batch.column("tile").to_pylist(), batch.column("data")):
                ids = _Tile(data).terms
                for k in range(0, len(ids), ROWS):
                    part = ids.slice(k, ROWS)
                    at = pa.array(np.full(len(part), tile, np.int32))
                    yield pa.RecordBatch.from_arrays([part, at, at], ["id", "first", "last"])

    rows = tiles.mapInArrow(terms, "id string, first int, last int")
    return rows.groupBy(F.floor(F.col("first") / band), "id").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("id", "first", "last") if band > 1 else rows


def _through(tiles: DataFrame, cut: tuple[int, int], vectors: DataFrame | None, width: int, seed: int, units: np.ndarray | None, kind: str = "string") -> DataFrame:
    """(id, vec, first, last): vectors of terms, random ones if none are given, through the matrix and back, by band and term, in ``units`` of each dimension.

    Without units (id, vec) of documents, whose keys are of that kind.  ``cut``: the bands, and the tiles of one.
    """
    drawn = vectors is None

    def run(batches):
        # the terms that tiles to come may have: their first and last tile, vectors and sums
        names, span = pa.array([], pa.string()), np.zeros((0, 2), np.int32)
        x, scale, z = np.zeros((0, width), np.int16), np.zeros(0, np.float32), np.zeros((0, width), np.float32)
        new: list[pa.RecordBatch] = []
        for batch in batches:
            begun = 0
            for k in [*np.flatnonzero(batch.column("last").is_null().to_numpy(zero_copy_only=False)), batch.num_rows]:
                if k > begun:
                    new.append(batch.slice(begun, k - begun))
                if k == batch.num_rows:
                    break
                begun = k + 1
                tile = _Tile(batch.column("data")[k])
                if new:
                    rows = pa.Table.from_batches([r.select(["id", "tile", "last", "data"]) for r in new]).combine_chunks()
                    ids = rows.column("id").combine_chunks()
                    whole, by = (_drawn(ids.to_pylist(), width, seed), np.ones(len(ids), np.float32)) if drawn else _unpacked(rows.column("data").combine_chunks())
                    names, span = pa.concat_arrays([names, ids]), np.concatenate([span, np.column_stack([rows.column("tile"), rows.column("last")])])
                    x, scale, new = np.concatenate([x, whole]), np.append(scale, by), []
                    z = np.concatenate([z, np.zeros((len(ids), width), np.float32)]) if units is not None else z
                place = pa.compute.index_in(tile.terms, names)
                if place.null_count:
                    raise ValueError("a tile has a term without vector")
                place = place.to_numpy()
                y = tile.forth(x, scale, place)
                kept = span[:, 1] > batch.column("tile")[k].as_py()
                if units is None:
                    yield from _listed(tile.keys, y)
                else:
                    z[place] += tile.back(y)
                    over = z[~kept]
                    over /= units.astype(np.float32)
                    yield from _packed(names.filter(pa.array(~kept)), over, first=pa.array(span[~kept, 0]), last=pa.array(span[~kept, 1]))
                    z, over = z[kept], None
                names, span, x, scale = names.filter(pa.array(kept)), span[kept], x[kept], scale[kept]

    bands, band = cut
    sent = _spans(tiles, band).withColumn("vec", F.lit(None).cast("binary")) if drawn else vectors.select("id", "vec", F.inline(F.arrays_zip("first", "last")))
    sent = sent.select(F.col("first").alias("tile"), "id", "last", F.col("vec").alias("data"))
    rows = sent.union(tiles.select("tile", F.lit(None), F.lit(None), "data"))
    # a tile follows the vectors that come with it
    in_order = rows.repartitionById(bands, F.floor(F.col("tile") / band).cast("int")).sortWithinPartitions("tile", F.col("last").asc_nulls_last())
    return in_order.mapInArrow(run, f"id {kind}, vec array<float>" if units is None else "id string, vec binary, first int, last int")


def _summed(shares: DataFrame) -> DataFrame:
    """(id, vec, first, last): the sums by term of what bands give, with the tiles between which each band has the term; one run of sorted rows after another."""

    def given(names: pa.Array, sums: np.ndarray, spans: np.ndarray, starts: np.ndarray):
        ends = pa.array(np.append(starts, len(spans)).astype(np.int32))
        return _packed(names, sums, **{c: pa.ListArray.from_arrays(ends, pa.array(spans[:, k])) for k, c in enumerate(("first", "last"))})

    def run(batches):
        name = total = held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, spans = batch.column("id"), np.column_stack([batch.column("first"), batch.column("last")])
            other = np.append(True, pa.compute.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)) if len(ids) > 1 else np.array([True])
            starts = np.flatnonzero(other)
            sums, names = np.add.reduceat(_numbers(batch.column("vec")), starts, axis=0), ids.take(pa.array(starts))
            if name is not None and name == names[0].as_py():
                sums[0] += total
                spans, starts = np.concatenate([held, spans]), np.append(0, starts[1:] + len(held))
            elif name is not None:
                yield from given(pa.array([name]), total[None, :], held, np.zeros(1, int))
            name, total, held = names[-1].as_py(), sums[-1], spans[starts[-1] :]
            yield from given(names.slice(0, len(names) - 1), sums[:-1], spans[: starts[-1]], starts[:-1])
        if name is not None:
            yield from given(pa.array([name]), total[None, :], held, np.zeros(1, int))

    return staged(shares.repartition("id").sortWithinPartitions("id").mapInArrow(run, "id string, vec binary, first array<int>, last array<int>"))


def _gram(vectors: DataFrame, width: int) -> np.ndarray:
    """The sum of the outer products of all vectors with themselves; each task gives one matrix, which are summed by cell."""

    def add(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                x = _numbers(batch.column(0))
                total += x.T @ x
        cells = pa.array(np.arange(width * width, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([cells, pa.array(total.ravel())], ["cell", "value"])

    sums = vectors.select("vec").mapInArrow(add, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(width * width)
    for r in sums:  # width squared rows
        out[r.cell] = r.value
    return out.reshape(width, width)


def _times(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    def apply(batches):
        for batch in batches:
            if batch.num_rows:
                yield from _packed(batch.column("id"), _numbers(batch.column("vec")) @ matrix, first=batch.column("first"), last=batch.column("last"))

    return vectors.mapInArrow(apply, vectors.schema)


def _as_lists(vectors: DataFrame) -> DataFrame:
    def apply(batches):
        for batch in batches:
            if batch.num_rows:
                yield from _listed(batch.column(0), _numbers(batch.column(1)))

    return vectors.select("id", "vec").mapInArrow(apply, "id string, vec array<float>")


def _principal(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Axes and lengths of a Gram matrix, longest first; those that rounding alone could make are left out."""
    squares, axes = np.linalg.eigh(gram)
    order = np.argsort(-squares)
    squares, axes = squares[order], axes[:, order]
    kept = squares > max(squares.max(initial=0.0), 1e-300) * 1e-12
    return axes[:, kept], np.sqrt(squares[kept])


class LatentIndex:
    """Latent vectors of an index's terms and documents, kept beside it and used again."""

    def __init__(self, index: TextIndex, *, rank: int = RANK, passes: int = PASSES, seed: int = 42):
        self.index, self.spark, self.rank, self.passes, self.seed = index, index.spark, rank, passes, seed
        self.path = f"{index.path}/latent-{rank}-{passes}-{seed}"

    @property
    def built(self) -> bool:
        system, place = place_of(self.spark, f"{self.path}/documents/_SUCCESS")
        return system.exists(place)

    def build(self) -> "LatentIndex":
        """Writes the vectors unless they are there; a text without known terms has none."""
        if self.built:
            return self
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
        postings = self.spark.read.parquet(f"{self.index.path}/postings").filter("weight > 0")
        count = max(1, -(-postings.count() // TILE))
        tiles, band = _tiles(postings, count), _band(count, self.spark.sparkContext.defaultParallelism)
        cut = -(-count // band), band
        width, vectors, summed = self.rank + SPARE, None, None
        units = np.ones(width)
        for k in range(self.passes):
            before, summed = summed, _summed(_through(tiles, cut, vectors, width, self.seed, units))
            if before is not None:
                forget(before)
            axes, lengths = _principal(units[:, None] * _gram(summed, width) * units)
            matrix = (axes / lengths)[:, : self.rank if k == self.passes - 1 else None]
            # the next sums are about as long as these in each dimension
            vectors, width, units = _times(summed, units[:, None] * matrix), matrix.shape[1], np.maximum(lengths / lengths.max(initial=0), 1e-6)
        # the terms' vectors are orthonormal now; a document's is its row of the matrix, seen along them
        save(_as_lists(vectors.select("id", "vec").repartitionByRange("id").sortWithinPartitions("id")), f"{self.path}/terms")
        documents = _through(tiles, cut, vectors, width, self.seed, None, postings.schema["key"].dataType.simpleString())
        save(documents.withColumnRenamed("id", "key"), f"{self.path}/documents")
        forget(summed)
        forget(tiles)
        return self

    def vector(self, query: str) -> list[float] | None:
        """The latent vector of a query; None if no term of it is known."""
        n, weights = self.index.documents, self.index.query_weights(query)
        known = self.spark.read.parquet(f"{self.path}/terms").filter(F.col("id").isin(list(weights))).collect() if n and weights else []
        total = sum((np.array(r.vec) * weights[r.id] for r in known), np.zeros(1))
        return [float(x) for x in total] if known and float(np.abs(total).max()) > 0 else None

    def search(self, query: str, top_k: int = 5, digits: int = 4) -> DataFrame:
        """(key, similarity) of the documents whose latent vectors are nearest to the query's; ties by key."""
        documents = self.spark.read.parquet(f"{self.path}/documents")
        wanted = self.vector(query)
        if wanted is None:
            return documents.select("key", F.lit(0.0).alias("similarity")).limit(0)
        return nearest(documents, "key", "vec", wanted, top_k, digits)


def latent_rank(texts: int) -> int:
    """Dimensions for so many texts: a few where there are few."""
    return max(2, min(RANK, math.isqrt(4 * max(1, texts))))
