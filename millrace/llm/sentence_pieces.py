"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is cut where no piece of the model can reach across, which gives words that
repeat; each batch encodes its new words together.  The symbols of all those words
lie in one flat numpy array.  A round looks up the rank of every adjacent pair,
takes the least rank of each word (a segmented minimum), merges its occurrences
from the left at once, and compacts the array; words without a pair drop out.

Merging all occurrences at once equals merging one at a time unless the merged
piece is part of another piece of the same or a better rank, which could then take
a symbol away from the next occurrence.  Those pieces are found when the model is
read, and for them a round merges the leftmost occurrence alone.

In long words the minimum is taken over a window instead of the word.  A merge of better
rank can take a pair's symbol only as part of a piece that holds both, and no piece is longer
than ``reach`` letters; so a pair may merge as soon as no pair within that distance has a
better rank, and all such pairs do in one round.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import bounded_batches

SPACE = "▁"
#: Words that a worker keeps encoded, and their letters; the store is emptied when it is full.
MAX_WORDS, MAX_LETTERS = 200_000, 4_000_000
#: Letters from which a word is long.
LONG = 300
NONE = np.int64(1) << 60


def read_model(data: bytes) -> dict:
    """The pieces, scores, types and flags of a model file (protocol buffer wire format)."""

    def fields(buf: bytes):
        at = 0
        while at < len(buf):
            tag, at = varint(buf, at)
            kind = tag & 7
            if kind == 0:
                value, at = varint(buf, at)
            elif kind == 1:
                value, at = buf[at : at + 8], at + 8
            elif kind == 5:
                value, at = buf[at : at + 4], at + 4
            else:
                n, at = varint(buf, at)
                value, at = buf[at : at + n], at + n
            yield tag >> 3, value

    def varint(buf: bytes, at: int) -> tuple[int, int]:
        shift = value = 0
        while True:
            byte = buf[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, at
            shift += 7

    pieces, trainer, normalizer = [], {}, {}
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            pieces.append(
                (piece[1].decode(), float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]), piece.get(3, 1))
            )
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            normalizer = dict(fields(value))
    return {
        "pieces": pieces,
        "bpe": trainer.get(3, 1) == 2,
        "byte_fallback": bool(trainer.get(35, 0)),
        "charsmap": normalizer.get(2, b""),
        "dummy_prefix": bool(normalizer.get(3, 1)),
        "trim": bool(normalizer.get(4, 1)),
        "escape": bool(normalizer.get(5, 1)),
    }


class PieceCodec:
    """Encodes and decodes as the model's library does, for a BPE model without normalisation."""

    def __init__(self, data: bytes):
        model = read_model(data)
        pieces = model["pieces"]
        usual = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        odd = [p for p, _, kind in pieces if kind in (4, 5)]
        if not model["bpe"] or not model["byte_fallback"] or model["charsmap"] or model["trim"] or not model["escape"] or not model["dummy_prefix"] or odd:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation are supported")
        if any(SPACE in p.lstrip(SPACE) for p in usual):
            raise ValueError("a piece reaches over the start of a word")
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.end_id = next(i for i, (p, _, kind) in enumerate(pieces) if p == "</s>" and kind == 3)
        self.bytes_of_id = [p.replace(SPACE, " ").encode() if kind == 1 else b"" for p, _, kind in pieces]
        for b, i in self.byte_ids.items():
            self.bytes_of_id[i] = bytes((b,))
        self.digits_of_id = [b"%d" % i for i in range(len(pieces))]
        # Symbols are piece numbers; a character that is no piece gets a number of its own above them.
        self.n = len(pieces)
        self.symbol_of = np.arange(self.n, self.n + 0x110000, dtype=np.int64)
        for p, i in usual.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        score = [s for _, s, _ in pieces]
        order = sorted({score[i] for i in usual.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(order)}
        self.rank = {p: rank_of[score[i]] for p, i in usual.items()}
        tied: dict[int, int] = {}
        for r in self.rank.values():
            tied[r] = tied.get(r, 0) + 1
        risky = {p for p, r in self.rank.items() if tied[r] > 1}
        for p, r in self.rank.items():
            for a in range(len(p)):
                for b in range(a + 2, len(p) + (a > 0)):
                    if p[a:b] in usual and self.rank[p[a:b]] >= r:
                        risky.add(p[a:b])
        keys, merged, ranks = [], [], []
        for p, i in usual.items():
            for cut in range(1, len(p)):
                if p[:cut] in usual and p[cut:] in usual:
                    keys.append(usual[p[:cut]] * self.n + usual[p[cut:]])
                    merged.append(i)
                    ranks.append(self.rank[p])
        at = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[at], NONE)
        self.merged = np.append(np.array(merged, np.int64)[at], -1)
        self.ranks = np.append(np.array(ranks, np.int64)[at], NONE)
        self.single = np.zeros(self.n, bool)
        for p in risky:
            self.single[usual[p]] = True
        self.before = {m: {p[i - 1] + m for p in usual for i in range(1, len(p)) if p[i] == m} for m in ",."}
        self.newline_cuts = not any("\n" in p for p in usual if len(p) > 1)
        self.words: dict[str, tuple[int, bytes, bytes]] = {}
        self.letters = 0
        self.reach = max(map(len, usual))

    # -- cutting ---------------------------------------------------------------

    _RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def cut(self, text: str) -> list[str]:
        """Keys of the words of a text: "x" stands for a space and x, "\\nx" for itself, "\\0..." for any other."""
        if not text:
            return []
        if self.newline_cuts and SPACE not in text and "\0" not in text:
            marked = text.replace("\n", " \n")
            if "  " not in marked and marked[0] != " ":
                for mark, joined in self.before.items():  # no piece reaches from other characters to a mark
                    if mark in marked and not any(j in marked for j in joined) and marked[0] != mark and " " + mark not in marked:
                        marked = marked.replace(mark, " \0" + mark)
                return marked.split(" ")
        escaped = SPACE + text.replace(" ", SPACE)
        return ["\0" + w for w in self._RUNS.findall(escaped)]

    @staticmethod
    def symbols(key: str) -> str:
        return key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else SPACE + key

    # -- merging ---------------------------------------------------------------

    def slots(self, flat: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of the pair table for the pairs that start at the given positions."""
        n, end = self.n, len(flat) - 1
        after = np.minimum(at + 1, end)
        left, right = flat[at], flat[after]
        pair = left * n + right
        whole = (at < end) & (word[at] == word[after]) & (left < n) & (right < n)
        slot = np.searchsorted(self.keys[:-1], pair)
        return np.where(whole & (self.keys[slot] == pair), slot, len(self.keys) - 1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where those of each word begin and end, by rounds over all words at once."""
        n = self.n
        flat = self.symbol_of[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        place = np.arange(len(flat))
        # slot[k]: where the pair of symbols k and k + 1 stands in the table, or its last, empty row.
        slot = self.slots(flat, word, np.arange(len(flat)))
        while len(flat):
            rank = self.ranks[slot]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(flat)))
            if (least == NONE).any():
                live = np.repeat(least < NONE, size)
                done.append((flat[~live], word[~live], place[~live]))
                flat, word, place, slot, rank = flat[live], word[live], place[live], slot[live], rank[live]
                size, least = size[least < NONE], least[least < NONE]
                if not len(flat):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            new = self.merged[slot[at]]
            # Leftmost first: of a run of touching occurrences every other one; of a risky piece the first alone.
            number = np.arange(len(at))
            head = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], number, 0))
            take = (number - head) % 2 == 0
            if self.single[new].any():
                leftmost = np.r_[True, np.diff(word[at]) != 0]
                begin = np.maximum.accumulate(np.where(leftmost, number, 0))
                take &= leftmost | ~self.single[new[begin]]
            at, new = at[take], new[take]
            flat[at] = new
            stay = np.ones(len(flat), bool)
            stay[at + 1] = False
            now = at - np.arange(len(at))  # where the new symbols stand after the compaction
            flat, word, place, slot = flat[stay], word[stay], place[stay], slot[stay]
            changed = np.concatenate([now, now[now > 0] - 1])
            slot[changed] = self.slots(flat, word, changed)
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        sym, of, where = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(where, kind="stable")
        sym, of = sym[order], of[order]
        if (odd := sym >= n).any():  # characters that are no piece become their bytes
            spelt = {c: [self.byte_ids[x] for x in chr(c - n).encode("utf-8", "surrogatepass")] for c in np.unique(sym[odd]).tolist()}
            times = np.ones(len(sym), np.int64)
            times[odd] = [len(spelt[c]) for c in sym[odd].tolist()]
            whole = np.repeat(~odd, times)
            flat = np.repeat(sym, times)
            flat[~whole] = [i for c in sym[odd].tolist() for i in spelt[c]]
            sym, of = flat, np.repeat(of, times)
        return sym, np.searchsorted(of, np.arange(len(words) + 1))

    def encode_long(self, word: str) -> list[int]:
        """The ids of one long word: rounds that merge every pair that is the best within reach."""
        flat = self.symbol_of[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")]
        slot = self.slots(flat, np.zeros(len(flat), np.int8), np.arange(len(flat)))
        while True:
            rank, number = self.ranks[slot], np.arange(len(flat))
            right = np.append(_window_min(rank, self.reach + 1)[1:], NONE)
            left = np.append(NONE, _window_min(rank[::-1], self.reach + 1)[:0:-1])
            best = (rank < NONE) & (rank <= left) & (rank <= right)
            if not best.any():
                break
            # Of a run of touching equals every other one, up to the first that has to wait.
            head = np.maximum.accumulate(np.where(np.r_[False, rank[1:] == rank[:-1]], 0, number))
            waits = np.maximum.accumulate(np.where(best, -1, number))
            new = self.merged[slot]
            alone = np.zeros(len(flat), bool)
            alone[best] = self.single[new[best]]
            at = np.flatnonzero(best & ((number - head) % 2 == 0) & (waits < head) & (~alone | (left > rank)))
            flat[at] = new[at]
            stay = np.ones(len(flat), bool)
            stay[at + 1] = False
            now = at - np.arange(len(at))
            flat, slot = flat[stay], slot[stay]
            changed = np.concatenate([now, now[now > 0] - 1])
            slot[changed] = self.slots(flat, np.zeros(len(flat), np.int8), changed)
        return [i for c in flat.tolist() for i in ((c,) if c < self.n else [self.byte_ids[x] for x in chr(c - self.n).encode("utf-8", "surrogatepass")])]

    def learn(self, keys: Iterable[str]) -> None:
        """Encodes the words that are not known yet."""
        keys = list(keys)
        new = [k for k in keys if k not in self.words]
        if len(self.words) + len(new) > MAX_WORDS or self.letters > MAX_LETTERS:
            self.words.clear()
            self.letters, new = 0, keys
        self.letters += sum(map(len, new))
        digits, text = self.digits_of_id, self.bytes_of_id
        for key in [k for k in new if len(k) > LONG]:
            ids = self.encode_long(self.symbols(key))
            self.words[key] = (len(ids), b" ".join([digits[i] for i in ids]), self.bytes_of(ids))
        new = [k for k in new if len(k) <= LONG]
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            ids, cuts = self.encode_words([self.symbols(k) for k in part])
            ids, cuts = ids.tolist(), cuts.tolist()
            written, spelt = [digits[i] for i in ids], [text[i] for i in ids]
            for key, a, b in zip(part, cuts, cuts[1:]):
                self.words[key] = (b - a, b" ".join(written[a:b]), b"".join(spelt[a:b]))

    # -- whole texts -----------------------------------------------------------

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text, without an end id."""
        keys = self.cut(text or "")
        self.learn(dict.fromkeys(keys))
        return [int(i) for k in keys for i in self.words[k][1].split()]

    def bytes_of(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.bytes_of_id[i] for i in ids])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: pieces joined, the space that the dummy prefix adds taken off."""
        ids = [i for i in ids if i != self.end_id]
        return self.finish(self.bytes_of(ids))

    @staticmethod
    def finish(joined: bytes) -> str:
        """The text of the joined bytes of all pieces; the first of them starts with the dummy space."""
        return joined[1:].decode("utf-8", "replace") if joined[:1] == b" " else joined.decode("utf-8", "replace")


def _window_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each value and the ``size`` - 1 after it."""
    out, length = values.copy(), 1
    while length < size and length < len(out):
        step = min(length, size - length)
        out[:-step] = np.minimum(out[:-step], out[step:])
        length += step
    return out


def encode_documents(
    docs: DataFrame, model: bytes, text_col: str = "text", id_col: str = "doc_id", *, with_ids: bool = False, with_text: bool = False
) -> DataFrame:
    """One row per row: id, n_tokens, ids_sha256, decoded_sha256, and ids and decoded_text if asked for.

    ``model`` is the content of a model file (some MB at most; it goes out with the
    tasks).  The end id follows the ids of every text, so null and empty texts have
    that id alone and decode to the empty text.  Very long texts are one row like any
    other; memory is bounded by the longest text and ``MAX_WORDS`` known words.
    Repeated rows give repeated results; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded_text string"

    def run(batches):
        codec = PieceCodec(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n_tokens, ids_sha, text_sha, ids, texts = [], [], [], [], []
                cuts = [codec.cut(t or "") for t in batch.column(1).to_pylist()]
                for a in range(0, len(cuts), 250):
                    group = cuts[a : a + 250]
                    codec.learn(dict.fromkeys(k for keys in group for k in keys))
                    words = codec.words
                    for keys in group:
                        found = [words[k] for k in keys]
                        joined = b" ".join([*[f[1] for f in found], b"%d" % codec.end_id])
                        decoded = codec.finish(b"".join([f[2] for f in found]))
                        n_tokens.append(sum([f[0] for f in found]) + 1)
                        ids_sha.append(hashlib.sha256(joined).hexdigest())
                        text_sha.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                        ids.append([int(i) for i in joined.split()] if with_ids else None)
                        texts.append(decoded if with_text else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(n_tokens, pa.int64()),
                        pa.array(ids_sha, pa.string()),
                        pa.array(text_sha, pa.string()),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array(texts, pa.string()),
                    ],
                    names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded_text"],
                )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    keep = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else []), *(["decoded_text"] if with_text else [])]
    return out.select(*keep).withColumnRenamed("id", id_col)
