"""Exact vector search, and search in texts through an index of terms."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import place_of, save, shared_folder


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(df: DataFrame, key: str, vector: str, query: list[float], top_k: int = 5, digits: int = 4) -> DataFrame:
    """(key, similarity) of the ``top_k`` rows most like a query vector; ties by key."""
    q = F.array(*[F.lit(float(v)) for v in query])
    scored = df.select(F.col(key), F.round(cosine(F.col(vector), q), digits).alias("similarity")).filter("similarity is not null")
    return scored.orderBy(F.desc("similarity"), F.asc(key)).limit(top_k)


# -- texts -----------------------------------------------------------------------------


def terms_of(text: Column) -> Column:
    """The runs of letters and digits of a text, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def term_counts(text: Column) -> Column:
    """The terms of a text with their numbers, as an array of (term, n): sorted, so that each is one run."""

    def runs(words: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        return _within(starts, lambda at: F.transform(at, lambda i, k: F.struct(F.get(words, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(words)) - i).cast("long").alias("n"))))

    return _within(F.sort_array(terms_of(text)), runs)


def _within(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class TextIndex:
    """Weights of terms in documents as Parquet tables, sorted by term, so that a query reads its terms' rows only.

    ``postings`` holds (term, key, weight): TF-IDF by weights from all documents; ``lengths`` holds (key, length), the
    length that a document's weights have together.  ``terms`` holds (term, documents).  Nothing is as wide as the vocabulary.
    Texts are read twice, so postings move once: to their terms.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, df: DataFrame, key: str, text: str, path: str) -> "TextIndex":
        """Writes the index of ``df``; rows with the same key are one document, rows without key none."""
        spark = df.sparkSession
        index = cls(spark, path)
        rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
        n = rows.select("key").distinct().count()
        counts = rows.select("key", F.explode_outer(term_counts(F.col("text"))).alias("c")).select("key", "c.*").filter("term is not null")
        if rows.count() > n:
            counts = counts.groupBy("term", "key").agg(F.sum("n").alias("n"))
        documents = counts.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))
        save(documents.repartitionByRange("term").sortWithinPartitions("term"), f"{index.path}/terms")
        documents = spark.read.parquet(f"{index.path}/terms")
        weighed = counts.join(documents.hint("shuffle_hash"), "term").select("term", "key", (F.col("n") * _rarity(n)).alias("weight"))
        save(weighed.sortWithinPartitions("term", "key"), f"{index.path}/postings")
        postings = spark.read.parquet(f"{index.path}/postings")
        save(postings.groupBy("key").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length")), f"{index.path}/lengths")
        # the size is written last: an index without it was not finished
        spark.createDataFrame([(n,)], "documents long").coalesce(1).write.parquet(f"{index.path}/size")
        return index

    @property
    def documents(self) -> int | None:
        """The number of documents, or None where there is no finished index."""
        system, place = place_of(self.spark, f"{self.path}/size/_SUCCESS")
        if not system.exists(place):
            return None
        return self.spark.read.parquet(f"{self.path}/size").first()[0]

    def query_weights(self, query: str) -> dict[str, float]:
        """The query's known terms with their weights, of unit length together."""
        n = self.documents
        asked = self.spark.range(1).select(F.explode(terms_of(F.lit(query))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()
        known = {r.term: r.documents for r in self.spark.read.parquet(f"{self.path}/terms").filter(F.col("term").isin([r.term for r in asked])).collect()}
        weights = {r.term: r.n * math.log((n + 1) / (known[r.term] + 1)) for r in asked if r.term in known}
        length = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        return {t: w / length for t, w in weights.items()}

    def search(self, query: str, top_k: int | None = 5, digits: int = 4) -> DataFrame:
        """(key, similarity) of the documents most like the query, by the cosine of both; ties by key."""
        weights = self.query_weights(query)
        rows = self.spark.read.parquet(f"{self.path}/postings").filter(F.col("term").isin(list(weights)))
        rows = rows.join(self.spark.read.parquet(f"{self.path}/lengths"), "key")
        share = F.coalesce(*[F.when(F.col("term") == t, w) for t, w in weights.items()], F.lit(0.0))
        scored = rows.groupBy("key").agg(F.round(F.sum(share * F.try_divide("weight", "length")), digits).alias("similarity"))
        return scored.orderBy(F.desc("similarity"), F.asc("key")).limit(top_k) if top_k else scored


def _rarity(n: int) -> Column:
    return F.log((F.lit(n) + 1) / (F.col("documents") + 1))


def text_index(df: DataFrame, key: str, text: str, folder: str | None = None) -> TextIndex:
    """The index of a table's texts, built once for its content: found again by the digest of all keys and texts.

    It lies in ``folder``, or in that of ``spark.checkpoint.dir``, beside the warehouse where it is unset.
    """
    spark = df.sparkSession
    row = F.xxhash64(F.col(key), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("")))
    n, a, b = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
    path = f"{(folder or shared_folder(spark)).rstrip('/')}/text-index-2-{hashlib.sha256(repr((key, text, n, a, b)).encode()).hexdigest()[:32]}"
    index = TextIndex(spark, path)
    if index.documents is None:
        system, place = place_of(spark, path)
        system.delete(place, True)  # what an interrupted build left
        TextIndex.build(df, key, text, path)
    return index


def text_search(df: DataFrame, key: str, text: str, query: str, top_k: int = 5, folder: str | None = None) -> DataFrame:
    """(key, text, similarity) of the ``top_k`` documents most like a query; the index is kept and used again."""
    best = text_index(df, key, text, folder).search(query, top_k).withColumnRenamed("key", key)
    rows = df.select(F.col(key), F.col(text)).join(F.broadcast(best), key)  # top_k rows
    return rows.orderBy(F.desc("similarity"), F.asc(key))


def keyword_counts(df: DataFrame, text: str, words: list[str]) -> DataFrame:
    """(word, rows) whose text has the word, in one scan."""
    hits = [F.count_if(F.regexp_like(F.lower(F.col(text)), F.lit(rf"(^|[^a-z]){w}([^a-z]|$)"))).alias(w) for w in words]
    wide = df.agg(*hits)
    return wide.select(F.inline(F.array(*[F.struct(F.lit(w).alias("word"), F.col(w).alias("rows")) for w in words])))
