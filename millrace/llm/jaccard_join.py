"""N-gram Jaccard join with set relations: index lists skipped by block, answers derived.

Links are exact: a document's set holds its distinct shingles, and two documents link
when their sets' Jaccard similarity reaches the threshold.  The stages:

1. A scan makes each document's set and its digest; equal sets become one.  It also
   counts the frequent shingles.
2. A second scan makes part signatures.  A hash cuts all shingles into an ordered list of
   parts, frequent shingles into parts at its end, and a set signs its first K + c parts
   that are not empty, K being the most that it can differ in from a set it links with.
   Each differing element spoils one part, so linked sets agree in c parts that both sign.
   Sets that share fewer than c signatures with any others link with nothing; the rest is
   joined by shared signatures into families (stars, never pairs).
3. Only differences are kept: each member's from its family's leader, then from the
   family's consensus, whose elements are those that most members hold.  The difference of
   X and Y is that of their differences, so answers for X follow from those of its family
   without reading what they share.  The member with most slack answers for all that
   the triangle rule links with it; no pairs are formed for them.
4. Members without a link yet share out into sub-families by the most frequent element of
   their differences; each has its own consensus, and its answers follow in turn.
5. What is left must share elements of differences.  Index lists hold these, rarest first;
   ``rest`` says how many follow at a position, and both sets' rests must cover the
   overlap that a link needs.  Lists are cut into blocks by rest, and a probe reads only
   blocks that can cover its need.  Lists hold a row per set already connected, not per
   document, so connected documents are never paired; candidates are verified exactly.

A key's rows are combined in the scan or spread, so none comes together in one task.
Lists and blocks decide only what is looked at; no choice of them changes a link.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import bounded_batches, forget, join_spread, spread_of, tidy, written
from ._tree import merge_runs
from .components import components

#: Bits of a signature.  Equal signatures of different parts only make families larger.
SIGNATURE_BITS = 56
#: Ratio between the bounds of neighbouring size windows.
WINDOW = 1.6
#: Shingles or signatures that a scan gathers before it combines them.
CHUNK = 4_000_000
#: Sets of a chunk that may share a signature before one of them stands for all.
CROWD = 64
#: A shingle counts as frequent if it was seen so often, in chunks in which it was seen SEEN
#: times or more; of more than MAX_FREQUENT, the most frequent (8 bytes each on every executor).
FREQUENT, SEEN, MAX_FREQUENT = 20, 3, 500_000
#: Rows of 24 bytes that are sent to all executors at most; more are joined by a shuffle.
MAX_BROADCAST = 500_000
#: Rounds of sub-families; how many members an element must have for a sub-family of its own.
ROUNDS, SPLIT = 4, 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash:
    """Hashes of the words of a text: polynomials over random values of their bytes, two of them, mixed.

    A-Z count as a-z.  Sums up to each byte are taken once; a word's polynomial is a difference of two.
    """

    def __init__(self):
        self.word = np.ones(256, bool)
        self.word[[0x20, *range(0x09, 0x0E)]] = False
        byte = np.arange(256, dtype=np.uint64)
        byte[0x41:0x5B] += np.uint64(32)
        self.values = [_mix(byte + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) for k in (1, 2)]
        self.bases = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        def powers(x: int) -> np.ndarray:
            out = np.full(n, x, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        self.power = [(powers(b), powers(pow(b, -1, 2**64))) for b in self.bases]

    def __call__(self, text: str | None) -> np.ndarray:
        b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if text else np.zeros(0, np.uint8)
        if len(b) > len(self.power[0][0]):
            self._grow(2 * len(b))
        edge = np.diff(self.word[b].astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out = (end - start).astype(np.uint64)
        for values, (power, inverse) in zip(self.values, self.power):
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(values[b] * power[: len(b)], out=sums[1:])
            out = _mix(out + (sums[end] - sums[start]) * inverse[start])
        return out


def shingle_set(text: str | None, width: int, hashes: _WordHash) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a text."""
    h = hashes(text)
    if not len(h):
        return h
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def set_number(key: bytes) -> int:
    """63 bits of a set's digest, by which links name it."""
    return int.from_bytes(key[:8], "little") >> 1


def _rows(columns: list[np.ndarray], names: list[str], most: int = 50_000):
    for at in range(0, len(columns[0]), most):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + most]) for c in columns], names=names)


class Cut:
    """How sets are cut into parts: size windows, and the number of parts of each.

    ``spare`` says how many times a window's parts are to be doubled, for windows in
    which some set had too few parts that are not empty.
    """

    def __init__(self, percent: int, spare: dict[int, int] | None = None):
        self.percent = percent
        self.bounds = [1]
        self.spare = spare or {}

    def differ(self, total: int) -> int:
        """How many elements two linked sets of ``total`` elements together may differ in at most."""
        return total * (100 - self.percent) // (100 + self.percent)

    def windows(self, n: int) -> list[tuple[int, int]]:
        """(window, K + 1) for a set of n elements; windows in which only equal sets link are left out."""
        while self.bounds[-1] <= n * 2:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * max(WINDOW, 100 / self.percent))))
        w = bisect.bisect_right(self.bounds, n) - 1
        most = n * 100 // self.percent
        found = [(w, self.differ(n + min(most, self.bounds[w + 1] - 1)) + 1)]
        if most >= self.bounds[w + 1]:
            found.append((w + 1, self.differ(n + most) + 1))
        return [(w, need) for w, need in found if need > 1]

    def parts(self, window: int) -> int:
        """So many that a set hardly ever has too few that are not empty."""
        most = self.least(window) + self.extra(window)
        return (1024 if most < 6 else most + most // 4 + 4 * math.isqrt(most) + 16) << self.spare.get(window, 0)

    def least(self, window: int) -> int:
        return self.differ(2 * (self.bounds[window + 1] - 1)) + 1

    def extra(self, window: int) -> int:
        """Parts that sets of a window sign beyond K + 1; so many and one more are shared by linked ones."""
        return self.least(window) // 6

    def shared(self, n: Column, most: int) -> Column:
        """How many signatures a set of n elements, at most ``most``, shares at least if it links with another."""
        self.windows(most)
        out = F.lit(1)
        for w in range(len(self.bounds) - 2, -1, -1):
            out = F.when(n < self.bounds[w + 1], 1 + self.extra(w)).otherwise(out)
        return out

    def sign(self, s: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The signatures of a set, and the windows in which it has too few parts."""
        windows = self.windows(len(s))
        if not windows:
            return np.zeros(0, np.uint64), []
        late = np.zeros(len(s), bool)
        if len(frequent):
            at = np.searchsorted(frequent, s)
            at[at == len(frequent)] = 0
            late = frequent[at] == s
        out, short = [], []
        for window, need in windows:
            parts = self.parts(window)
            part = (s % np.uint64(parts)).astype(np.int64) + np.where(late, parts, 0)
            seed = np.uint64((window + 1) * 0xD6E8FEB86659FD93 % 2**64)
            total = np.zeros(2 * parts, np.uint64)
            np.add.at(total, part, _mix(s ^ seed))
            need += self.extra(window)
            full = np.flatnonzero(np.bincount(part, minlength=2 * parts))[:need]
            if len(full) < need:
                short.append(window)
            out.append(_mix(total[full] + _mix((full + 1).astype(np.uint64) * seed)) >> np.uint64(64 - SIGNATURE_BITS))
        return np.concatenate(out), short


def _sliced(batches, rows: int = 500):
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def _scan(width: int):
    """Rows (id, th, n, skey, h) of documents, and rows without identifier of counts n of frequent shingles h."""

    def counts(held):
        token, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0))
        token, n = token[n >= SEEN], n[n >= SEEN]
        return token.view(np.int64), n.astype(np.int64)

    def run(batches):
        hashes, held, seen, size = _WordHash(), [], set(), 0
        like = None
        for batch in _sliced(batches):
            n, keys, numbers = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, width, hashes)
                key = set_key(s)
                n.append(len(s))
                keys.append(key)
                numbers.append(set_number(key))
                if key not in seen:
                    seen.add(key)
                    held.append(s)
                    size += len(s)
            like = batch.schema
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(numbers, pa.int64())], names=["id", "th", "n", "skey", "h"]
            )
            if size >= CHUNK:
                yield from frequent(like, held)
                held, seen, size = [], set(), 0
        if held:
            yield from frequent(like, held)

    def frequent(like, held):
        token, n = counts(held)
        for at in range(0, len(token), 10_000):
            part = token[at : at + 10_000]
            none = lambda kind: pa.nulls(len(part), kind)
            yield pa.RecordBatch.from_arrays(
                [none(like.field(0).type), none(pa.int64()), pa.array(n[at : at + 10_000]), none(pa.binary()), pa.array(part)], names=["id", "th", "n", "skey", "h"]
            )

    return run


def _signed(width: int, percent: int, frequent, spare: dict[int, int]):
    """Rows (sig, h): the signatures of the sets of a chunk.

    Where more than CROWD sets of a chunk share a signature, the one that shares most stands for
    all: the others hang under it by a number that only the two of them bear in place of a
    signature.  How many signatures a set shares in crowds comes as (~h, number); who stands for
    others counts as sharing any number.  A window in which a set has too few parts gives the row (window, -1).
    """

    def combined(sigs, owners, numbers, short):
        sig, owner = np.concatenate(sigs), np.array(numbers, np.int64)[np.repeat(np.arange(len(owners)), owners)]
        order = np.argsort(sig, kind="stable")
        sig, owner = sig[order], owner[order]
        first = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, bool)
        start, group = np.flatnonzero(first), np.cumsum(first) - 1
        crowd = (np.diff(np.append(start, len(sig))) > CROWD)[group] if len(sig) else first
        who, times = np.unique(owner[crowd], return_counts=True)
        a, b = [sig[~crowd].view(np.int64)], [owner[~crowd]]
        if len(who):
            inside, of = owner[crowd], group[crowd]
            count = times[np.searchsorted(who, inside)]
            by = np.lexsort((inside, -count, of))
            lead = inside[by][np.concatenate([[True], of[by][1:] != of[by][:-1]])]
            leads = lead[np.unique(of, return_inverse=True)[1]]
            pairs = np.unique(np.stack([leads, inside], 1)[leads != inside], axis=0)
            bond = (_mix(_mix(pairs[:, 0].view(np.uint64)) * np.uint64(3) + pairs[:, 1].view(np.uint64)) >> np.uint64(64 - SIGNATURE_BITS)).view(np.int64)
            times = np.where(np.isin(who, lead), 1 << 40, times)
            a += [sig[start[np.unique(of)]].view(np.int64), bond, bond, ~who]
            b += [lead, pairs[:, 0], pairs[:, 1], times]
        a.append(np.array(sorted(short), np.int64))
        b.append(np.full(len(short), -1, np.int64))
        yield from _rows([np.concatenate(a), np.concatenate(b)], ["sig", "h"])

    def run(batches):
        hashes, cut, often = _WordHash(), Cut(percent, spare), frequent.value
        sigs, owners, numbers, short, seen, size = [], [], [], set(), set(), 0
        for batch in _sliced(batches):
            for text in batch.column(0).to_pylist():
                s = shingle_set(text, width, hashes)
                key = set_key(s)
                if key in seen:
                    continue
                seen.add(key)
                found, few = cut.sign(s, often)
                short.update(few)
                if len(found):
                    sigs.append(found)
                    owners.append(len(found))
                    numbers.append(set_number(key))
                    size += len(found)
            if size >= CHUNK:
                yield from combined(sigs, owners, numbers, short)
                sigs, owners, numbers, short, seen, size = [], [], [], set(), set(), 0
        if sigs or short:
            yield from combined(sigs or [np.zeros(0, np.uint64)], owners, numbers, short)

    return run


def _sets(width: int):
    """The sets of the rows (text, h, label) whose text has the number h."""

    def run(batches):
        hashes = _WordHash()
        for batch in _sliced(batches, 100):
            for text, h, label in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingle_set(text, width, hashes)
                if set_number(set_key(s)) == h:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label], pa.int64()), pa.array([h], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(s.view(np.int64)))],
                        names=["label", "h", "s"],
                    )

    return run


def _differences(width: int):
    """(h, label, n, d): the differences of the rows (text, h, label, s) from s."""

    def run(batches):
        hashes = _WordHash()
        for batch in _sliced(batches, 100):
            hs, labels, n, flat, ends = [], [], [], [], [0]
            leaders = batch.column(3)
            for k, (text, h, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                s = shingle_set(text, width, hashes)
                if set_number(set_key(s)) != h:  # another text of a repeated identifier
                    continue
                d = np.setxor1d(s, leaders[k].values.to_numpy(zero_copy_only=False).view(np.uint64), assume_unique=True)
                hs.append(h)
                labels.append(label)
                n.append(len(s))
                flat.append(d)
                ends.append(ends[-1] + len(d))
            if hs:
                d = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat).view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(labels, pa.int64()), pa.array(n, pa.int64()), d], names=["h", "label", "n", "d"])

    return run


def _frequent(base: DataFrame) -> np.ndarray:
    """The frequent shingles, sorted; at most MAX_FREQUENT."""
    seen = base.filter("id is null").groupBy("h").agg(F.sum("n").alias("c")).filter(F.col("c") >= FREQUENT)
    sizes = sorted(seen.groupBy(F.expr("bit_length(bin(c)) div 8").alias("bits")).count().collect(), reverse=True)
    least, total = 64, 0
    for bits, n in sizes:
        if total + n > MAX_FREQUENT:
            break
        least, total = bits, total + n
    tokens = seen.filter(F.col("c") >= F.lit(2 ** min(least - 1, 62))).select("h").toArrow().column(0).to_numpy()
    return np.sort(tokens.astype(np.int64).view(np.uint64))


def _families(source: DataFrame, sets: DataFrame, width: int, percent: int, frequent) -> DataFrame:
    """(node, label) for the numbers of all sets that share as many signatures as linked sets do."""
    most = sets.agg(F.max("n")).first()[0] or 1
    spare: dict[int, int] = {}
    while True:
        signed = source.select("text").mapInArrow(_signed(width, percent, frequent, spare), "sig long, h long")
        signed = signed.filter("sig is not null and h is not null").repartition("sig")
        # One exchange serves the choice of the signatures and the way back to them.
        met = signed.groupBy("sig").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo < hi or lo < 0 or sig < 0").select("sig")
        shared = written(signed.join(met, "sig"), "shared")
        short = [r.sig for r in shared.filter("sig >= 0 and h < 0").select("sig").distinct().collect()]  # windows, some dozens at most
        if not short:
            crowded = F.col("sig") < 0
            weights = shared.select(F.when(crowded, F.expr("~sig")).otherwise(F.col("h")).alias("h"), F.when(crowded, F.col("h")).otherwise(1).alias("w"))
            weights = weights.groupBy("h").agg(F.sum("w").alias("w"))
            strong = weights.join(sets.select("h", "n"), "h").filter(F.col("w") >= Cut(percent).shared(F.col("n"), most)).select("h").distinct()
            kept = written(shared.filter("sig >= 0").join(strong, "h", "left_semi"), "shared")
            forget(shared)
            stars = kept.groupBy("sig").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo < hi").select("sig", "lo")
            found = components(kept.join(stars, "sig").select(F.col("h").alias("u"), F.col("lo").alias("v")))
            forget(kept)
            return found
        forget(shared)
        for window in short:
            spare[window] = spare.get(window, 0) + 1


def _rebased(diff: DataFrame, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """The differences (h, label, n, d) from each label's consensus, with slack s, and the label's most slack bs with its owner bh; the tables behind.

    s = num * n - den * size(d): sets with slacks of a sum of 0 or more link.
    """
    sizes = diff.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    counts = diff.select("label", F.explode("d").alias("token")).groupBy("label", "token").agg(F.count(F.lit(1)).alias("c"))
    most = counts.join(sizes, "label").filter("2 * c > m").groupBy("label").agg(F.collect_list("token").alias("t"))
    turn = sizes.join(most, "label", "left").select("label", F.coalesce("t", F.array().cast("array<bigint>")).alias("t"))
    moved = join_spread(diff, turn, "label", "h").select("h", "label", "n", F.concat(F.array_except("d", "t"), F.array_except("t", "d")).alias("d"))
    moved = written(moved.withColumn("s", F.expr(f"n * {num} - size(d) * {den}")), "rebased")
    best = moved.groupBy("label").agg(F.max(F.struct("s", "h")).alias("b"))
    best = written(best.select("label", F.col("b.s").alias("bs"), F.col("b.h").alias("bh")), "best")
    return join_spread(moved, best, "label", "h"), [moved, best]


def _promising(rows: DataFrame, den: int) -> DataFrame:
    """``rows`` without those whose difference shares too few elements with others of the label for any link, with the shared ones, rarest first.

    Elements that no open member holds do not count: links between the others are known.
    """
    each = rows.select("h", "label", "open", F.explode("d").alias("token"))
    often = each.groupBy("label", "token").agg(F.count(F.lit(1)).alias("c"), F.max("open").alias("o")).filter("c > 1 and o")
    shared = each.select("h", "label", "token").join(often.select("label", "token", "c"), ["label", "token"])
    shared = shared.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("shared"))
    return rows.join(shared, "h").filter(f"2 * {den} * size(shared) >= -(s + bs)")


def _with_open(rows: DataFrame) -> DataFrame:
    """The rows of labels with an open member; ``bs`` becomes the most slack of a partner: any for an open member, an open one's for others."""
    rows = rows.withColumn("open", F.expr("s + bs < 0"))
    most = rows.filter("open").groupBy("label").agg(F.max("s").alias("os"))
    rows = join_spread(rows, most, "label", "h")
    return rows.withColumn("bs", F.when(F.col("open"), F.col("bs")).otherwise(F.col("os"))).drop("os", "bh")


def _derived_links(diff: DataFrame, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """Members rebased on their families' consensus that may have links left, and tables (u, v) of links that follow without pairs.

    The table ``diff`` is used up.
    """
    links: list[DataFrame] = []
    group, before, left = diff, [diff], None
    for _ in range(ROUNDS):
        rows, tables = _rebased(group, num, den)
        for table in before:
            forget(table)
        tidy(diff.sparkSession)
        links.append(written(rows.filter("s + bs >= 0 and h <> bh").select(F.col("h").alias("u"), F.col("bh").alias("v")), "links"))
        if left is None:  # what members share is found once, for their sub-families and for the pairs
            left = open_ = written(_promising(_with_open(rows), den), "left")
        else:
            open_ = _promising(rows.withColumn("open", F.expr("s + bs < 0")).filter("open"), den)
        # The most frequent element of its difference names the sub-family of a member.
        open_ = open_.filter("open").withColumn("top", F.element_at("shared", -1)).filter(f"top.c >= {SPLIT}")
        group = written(open_.select("h", F.xxhash64("label", "top.token").alias("label"), "n", "d"), "open")
        before = [group, *tables]
        if group.isEmpty():
            break
    for table in before:
        forget(table)
    return left, links


def _paired_links(left: DataFrame, comps: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): links between members of the table ``left`` that ``comps`` does not connect, with one of them open at least.

    The table ``left`` is used up.
    """
    rows = left.select("h", "label", "open", "s", "shared", F.expr(f"cast(ceil(-(s + bs) / (2.0 * {den})) as int)").alias("need"))
    rows = rows.join(comps.select(F.col("node").alias("h"), F.col("label").alias("comp")), "h", "left").withColumn("comp", F.coalesce("comp", "h"))
    apart = rows.groupBy("label").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("open").alias("o")).filter("c0 < c1 and o")
    rows = join_spread(rows, apart.select("label"), "label", "h")
    prefix = F.posexplode(F.expr("slice(shared, 1, size(shared) - need + 1)")).alias("p", "x")
    entries = rows.select("h", "label", "comp", "open", "s", "need", prefix, F.size("shared").alias("k"))
    entries = entries.select("h", "label", "comp", "open", "s", "need", F.col("x.token").alias("token"), F.expr("k - p").alias("rest"))
    entries = written(entries.withColumn("block", F.expr("cast(floor(log2(rest)) as int)")), "entries")
    # A row per component, position block and list; a probe reads the blocks that can cover its need.
    lists = entries.groupBy("label", "token", "block", "comp").agg(F.max("rest").alias("rest"), F.max("s").alias("s"), F.max("open").alias("open"))
    probes = entries.filter("open").groupBy("label", "token", "comp").agg(F.max("rest").alias("rest"), F.max("s").alias("s"), F.min("need").alias("need"))
    ends = lists.groupBy("label", "token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("block").alias("last")).filter("c0 < c1")
    probes = probes.join(ends, ["label", "token"]).withColumn("block", F.explode(F.expr("sequence(least(cast(floor(log2(greatest(need, 1))) as int), last), last)")))
    a, b = probes.alias("a"), lists.alias("b")
    met = (
        a.join(b, ["label", "token", "block"])
        .filter(f"a.comp <> b.comp and (not b.open or a.comp < b.comp) and 2 * {den} * least(a.rest, b.rest) >= -(a.s + b.s)")
        .select("label", "token", F.col("a.comp").alias("ca"), F.col("b.comp").alias("cb"))
        .distinct()
    )
    one = entries.select("label", "token", F.col("comp").alias("ca"), F.col("h").alias("u"), F.col("s").alias("su"), F.col("rest").alias("ru"), F.col("open").alias("ou"))
    two = entries.select("label", "token", F.col("comp").alias("cb"), F.col("h").alias("v"), F.col("s").alias("sv"), F.col("rest").alias("rv"), F.col("open").alias("ov"))
    pairs = (
        met.join(one, ["label", "token", "ca"])
        .join(two, ["label", "token", "cb"])
        .filter(f"(ou or ov) and 2 * {den} * least(ru, rv) >= -(su + sv)")
        .select("u", "v")
        .distinct()
    )
    x = left.select(F.col("h").alias("u"), F.col("d").alias("du"), F.col("n").alias("nu"))
    y = left.select(F.col("h").alias("v"), F.col("d").alias("dv"), F.col("n").alias("nv"))
    exact = f"(size(du) + size(dv) - 2 * size(array_intersect(du, dv))) * {den} <= (nu + nv) * {num}"
    found = written(pairs.join(x, "u").join(y, "v").filter(exact).select("u", "v"), "links")
    forget(left)
    forget(entries)
    return found


def _groups(docs: DataFrame, text_col: str, id_col: str, width: int, percent: int) -> DataFrame:
    """(id, th, n, component_id), ``th`` a hash of the text."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    spark = docs.sparkSession
    bounded_batches(spark)
    id_type = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    hashed = source.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    base = written(hashed.mapInArrow(_scan(width), f"id {id_type}, th long, n long, skey binary, h long"), "sets")
    frequent = spark.sparkContext.broadcast(_frequent(base))
    base = base.filter("id is not null")

    # Equal sets become one, under their least identifier.
    tree = merge_runs(base.filter("n > 0").select("id", "th", "n", "skey", "h"), ["skey", "h", "n"], "id", {"node": (F.min("id"), F.min)})
    sets = written(tree.root, "roots")

    family = _families(source, sets, width, percent, frequent)
    members = written(family.join(sets, family["node"] == sets["h"]).select("label", "h", sets["node"]), "members")
    forget(family)
    frequent.destroy()
    lead = members.groupBy("label").agg(F.min("h").alias("lead"))
    leaders = members.join(lead, "label").filter("h = lead").select("label", "h", "node")

    def texts(of: DataFrame) -> DataFrame:
        of = F.broadcast(of) if of.count() <= MAX_BROADCAST else of
        return source.join(of, source["id"] == of["node"]).drop("id", "node")

    leads = written(texts(leaders).select("text", "h", "label").mapInArrow(_sets(width), "label long, h long, s array<long>").dropDuplicates(["label"]).select("label", "s"), "leaders")
    # The leader's set goes to the spreads of its members, never all members to it.
    spread = members.withColumn("way", spread_of("h", 64))
    sent = spread.select("label", "way").distinct().join(leads, "label")
    near = texts(spread).join(sent, ["label", "way"]).select("text", "h", "label", "s")
    diff = written(near.mapInArrow(_differences(width), "h long, label long, n long, d array<long>"), "differences")
    forget(leads)
    if diff.count() > members.count():  # rows that repeat identifier and text
        repeated, diff = diff, written(diff.dropDuplicates(["h"]), "differences")
        forget(repeated)
    forget(members)

    ratio = Fraction(100 - percent, 100 + percent)
    num, den = ratio.numerator, ratio.denominator
    left, links = _derived_links(diff, num, den)
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    comps = components(edges)
    tidy(spark)
    more = _paired_links(left, comps, num, den)
    if not more.isEmpty():
        comps = components(edges.unionByName(more))
    for table in [*links, more]:
        forget(table)

    linked = comps.join(sets, comps["node"] == sets["h"]).select("label", "h", sets["node"])
    least = linked.groupBy("label").agg(F.min("node").alias("component_id"))
    root = sets.join(join_spread(linked, least, "label", "h").select("h", "component_id"), "h", "left")
    root = root.select("skey", "h", "n", F.coalesce("component_id", "node").alias("component_id"))
    found = tree.down(root).select("id", "th", "n", "component_id")
    return found.unionByName(base.filter("n = 0").select("id", "th", "n", F.col("id").alias("component_id")))


def similar_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, width: int = 3, percent: int = 90) -> DataFrame:
    """One row per row with an identifier: id, n_shingles, component_id.

    ``component_id`` is the least identifier reachable over links, itself included.
    Null and empty texts and texts without words have an empty set and link with
    nothing.  Texts of fewer words than a shingle are one shingle.  Rows with equal
    sets are one set.  Rows without an identifier are left out, as nothing can refer to
    them; rows that share an identifier are documents of their own.  Other columns are
    ignored; an empty table gives an empty one.
    """
    found = _groups(docs, text_col, id_col, width, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_similar(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *, width: int = 3, percent: int = 90) -> DataFrame:
    """The rows of ``docs`` of which one per component stays, that with the least identifier, with all columns.

    Rows without an identifier stay; of rows that share one, each stays or goes by its own text.
    """
    found = _groups(docs, text_col, id_col, width, percent)
    gone = written(found.filter("id <> component_id").select(F.col("id").alias("_gone"), F.col("th").alias("_th")).distinct(), "gone")
    same = (docs[id_col] == gone["_gone"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == gone["_th"])
    return docs.join(gone, same, "left_anti")
