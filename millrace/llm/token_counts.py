"""Token counts through a digest cache.

The cache holds (tokenizer digest, content digest, count) as Parquet in a folder per
tokenizer digest.  Contents are joined with it by digest; only texts that it lacks are
encoded, each distinct one once, and their counts are appended.  Rows then get their
counts from the cache down the tree that found the distinct digests, so neither a hot
text nor a hot count meets in one task.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import bounded_batches, shared_dir, written
from ._tree import merge_runs

CACHE_SCHEMA = "sha binary, n_tokens long"
#: Version of the counting rules; part of the tokenizer's digest.
RULES = "whole text, no added tokens, added-token strings recognised"


def tokenizer_digest(kind: str, data: bytes) -> str:
    """Identifies a tokenizer file together with the way it is applied."""
    return hashlib.sha256(b"\0".join([kind.encode(), RULES.encode(), data])).hexdigest()


class JsonCounter:
    """Counts as the tokenizers library does with a .json file.

    A plain byte-level BPE file (no normaliser, merges in the order of the ids) is run by
    a faster engine over the same merges for texts in Latin letters, for which both cut
    words alike; every other file and text goes to the library itself.
    """

    #: Characters whose class does not depend on a library's version of Unicode.
    SAFE = re.compile("[^\t\n\r -~\xa0-ɏ‐-‧€]")

    def __init__(self, data: bytes):
        self.data = data
        self.library = None
        spec = json.loads(data)
        added = sorted({t["content"] for t in spec.get("added_tokens") or []}, key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = self._engine(spec)

    @staticmethod
    def _engine(spec: dict):
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (
            model.get("type") == "BPE"
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens") or [])
        )
        if not plain:
            return None
        import tiktoken

        # The byte-level alphabet: printable bytes stand for themselves, the others for 256 and on.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letter = {chr(b): b for b in printable}
        letter |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {}
        for token, i in model["vocab"].items():
            if any(c not in letter for c in token):
                return None
            ranks[bytes(letter[c] for c in token)] = i
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if sorted(ranks.values()) != list(range(len(ranks))) or [model["vocab"].get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))) or len(ranks) != 256 + len(pairs):
            return None
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.fast is not None and not self.SAFE.search(text):
            parts, n = [text], 0
            if self.added and self.added.search(text):
                parts = self.added.split(text)
                n = len(parts) - 1
            return n + sum(len(self.fast.encode_ordinary(p)) for p in parts if p)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.data.decode())
            self.library.no_truncation()
            self.library.no_padding()
        return len(self.library.encode(text, add_special_tokens=False).ids)


class PieceCounter:
    """Counts as the sentencepiece library does with a .model file."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)

    def count(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))


COUNTERS = {"json": JsonCounter, "model": PieceCounter}


def _local_distinct(batches):
    """One row per digest and task."""
    seen = set()
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            take = []
            for k, sha in enumerate(batch.column(0).to_pylist()):
                if sha not in seen:
                    seen.add(sha)
                    take.append(k)
            if take:
                yield batch.take(pa.array(take, pa.int32()))


def _encoding(kind: str, data: bytes):
    def run(batches):
        counter, seen = None, set()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                digests, counts = [], []
                for sha, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if sha not in seen:
                        seen.add(sha)
                        counter = counter or COUNTERS[kind](data)
                        digests.append(sha)
                        counts.append(counter.count(text))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], names=["sha", "n_tokens"])

    return run


def count_tokens(
    docs: DataFrame,
    tokenizer: bytes,
    kind: str = "json",
    text_col: str = "text",
    id_col: str = "doc_id",
    *,
    cache: str | None = None,
    limit: int = 1024,
) -> DataFrame:
    """One row per row: id, n_bytes, n_tokens, over_limit.

    ``tokenizer`` is the content of a .json ("json") or .model ("model") file, some MB
    at most.  ``cache`` is a folder that outlives the call; without one a folder of this
    call alone in the shared place is used.  Texts are equal when their bytes are.  Null
    counts as empty, and an empty text has no tokens.  Strings of special tokens inside
    texts count as those tokens, as the library does by default.  Texts are never cut.
    Repeated rows and rows without an identifier each give a row; other columns are
    ignored; an empty table gives an empty one and leaves the cache as it is.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = f"{(cache or shared_dir(spark, f'token-counts-{uuid.uuid4().hex}')).rstrip('/')}/tokenizer={tokenizer_digest(kind, tokenizer)}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.unhex(F.sha2(text, 256)).alias("sha")
    rows = written(docs.select(F.col(id_col).alias("id"), sha, F.octet_length(text).cast("long").alias("n_bytes")), "digests")
    tree = merge_runs(rows, ["sha"], "id", {"_n": (F.count(F.lit(1)), F.sum)})

    texts = docs.select(sha, text.alias("text")).mapInArrow(_local_distinct, "sha binary, text string")
    try:
        known = spark.read.schema(CACHE_SCHEMA).parquet(folder)
    except AnalysisException:  # nothing counted with this tokenizer yet
        known = None
    # Copies that several tasks hold meet here by digest; each digest is encoded once.
    misses = texts.repartition("sha") if known is None else texts.join(known.select("sha"), "sha", "left_anti").repartition("sha")
    misses.mapInArrow(_encoding(kind, tokenizer), CACHE_SCHEMA).write.mode("append").parquet(folder)

    counts = spark.read.schema(CACHE_SCHEMA).parquet(folder).groupBy("sha").agg(F.max("n_tokens").alias("n_tokens"))
    out = tree.down(tree.root.select("sha").join(counts, "sha"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
