"""The index of terms against a dense computation, and latent vectors against the exact decomposition."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from millrace import shared
from millrace.operators import latent, search
from millrace.shared import place_of

TOPICS = ["apple pear plum fruit orchard", "engine wheel car road tyre", "violin cello flute music score", "river lake sea boat harbour"]


def corpus(n=240, seed=3):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        words = TOPICS[k % 4].split()
        text = " ".join(r.choice(words) if r.random() < 0.7 else f"w{r.randrange(60)}" for _ in range(r.randrange(5, 40)))
        rows.append((k, text.upper() if k % 9 == 0 else text))
    return rows + [(900, None), (901, ""), (902, "--- !"), (None, "apple"), (5, "apple again")]


def dense(rows):
    """Keys, terms and the matrix of TF-IDF rows of unit length."""
    by_key = {}
    for k, t in rows:
        if k is not None:
            by_key.setdefault(k, Counter()).update(re.findall(r"\w+", (t or "").lower()))
    keys, terms = sorted(by_key), sorted({w for c in by_key.values() for w in c})
    a = np.array([[by_key[k][t] for t in terms] for k in keys], float)
    idf = np.log((len(keys) + 1) / ((a > 0).sum(axis=0) + 1))
    a *= idf
    return keys, terms, a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300), idf


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame(corpus(), "k long, t string")
    return search.text_index(df, "k", "t", str(tmp_path_factory.mktemp("index")))


def test_scores_equal_a_dense_computation(spark, index):
    keys, terms, a, idf = dense(corpus())
    for query in ("apple", "Fruit fruit car unheardof", "w1 w2 w3", "unheardof", ""):
        words = Counter(w for w in re.findall(r"\w+", query.lower()) if w in terms)
        q = np.array([words[t] for t in terms]) * idf
        scores = a @ q / (np.linalg.norm(q) or 1)
        want = {k: s for k, s in zip(keys, scores) if s > 1e-9}
        got = {r.key: r.similarity for r in index.search(query, None, 12).collect() if r.similarity > 1e-9}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    best = [r.key for r in index.search("violin", 3).collect()]
    assert len(best) == 3


def test_an_index_is_used_again_until_the_texts_change(spark, index, tmp_path):
    rows = corpus(40)
    df = spark.createDataFrame(rows, "k long, t string")
    first = search.text_index(df, "k", "t", str(tmp_path))
    written = list((tmp_path / first.path.rsplit("/", 1)[1] / "postings").iterdir())
    assert search.text_index(df.repartition(7), "k", "t", str(tmp_path)).path == first.path
    assert list((tmp_path / first.path.rsplit("/", 1)[1] / "postings").iterdir()) == written
    other = search.text_index(spark.createDataFrame([*rows[1:], (0, "changed")], "k long, t string"), "k", "t", str(tmp_path))
    assert other.path != first.path
    system, place = place_of(spark, f"{other.path}/size")
    system.delete(place, True)  # as if the build had not ended
    again = search.text_index(spark.createDataFrame([*rows[1:], (0, "changed")], "k long, t string"), "k", "t", str(tmp_path))
    assert again.documents == other.documents is not None and again.search("changed").first().key == 0
    out = search.text_search(df, "k", "t", "flute", 2, str(tmp_path))
    assert out.columns == ["k", "t", "similarity"] and out.count() == 2


def test_a_query_reads_its_terms_only(spark, index):
    plan = index.search("violin cello")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [cello,violin])" in plan or "PushedFilters: [In(term, [violin,cello])" in plan


@pytest.mark.parametrize("rank,passes", [(4, 2), (6, 10)])  # beyond the four topics lengths hardly differ, which takes more passes
def test_latent_vectors_equal_the_exact_decomposition(spark, index, rank, passes):
    top = 10
    keys, terms, a, idf = dense(corpus())
    v = np.linalg.svd(a, full_matrices=False)[2][:rank].T
    docs = a @ v
    found = latent.LatentIndex(index, rank=rank, passes=passes).build()
    hits = asked = 0
    for query in ("apple pear", "engine road", "cello", "harbour", "plum w3", "music w9 w10", "car", "lake sea boat"):
        words = Counter(query.split())
        q = (np.array([words[t] for t in terms]) * idf) @ v
        scores = docs @ q / np.maximum(np.linalg.norm(docs, axis=1) * np.linalg.norm(q), 1e-300)
        best = {keys[i] for i in np.argsort(-scores)[:top]}
        got = {r.key: r.similarity for r in found.search(query, top, 9).collect()}
        hits, asked = hits + len(best & got.keys()), asked + top
    assert hits / asked >= 0.9
    near = found.search("orchard", 30).collect()
    assert sum(r.key % 4 == 0 for r in near if r.key < 240) >= 27  # texts on fruit, with that word or without
    assert found.search("unheardof").count() == 0 and math.isclose(near[0].similarity, 1, abs_tol=0.2)


def test_latent_vectors_are_kept(spark, index):
    first = latent.LatentIndex(index, rank=3, passes=1).build()
    before = first.search("apple", 5).collect()
    assert first.built and latent.LatentIndex(index, rank=3, passes=1).build().search("apple", 5).collect() == before
    assert latent.latent_rank(1) == 2 and latent.latent_rank(10**9) == latent.RANK


@pytest.mark.parametrize("passes", [1, 3])
def test_vectors_move_by_tile_and_term_and_not_by_posting(spark, index, monkeypatch, passes):
    """Documents and terms of several tiles have the vectors that one tile gives them, and what moves is bounded by tiles and terms."""
    whole = latent.LatentIndex(index, rank=5, passes=passes, seed=1).build()
    want = {r.key: r.vec for r in spark.read.parquet(f"{whole.path}/documents").collect()}
    monkeypatch.setattr(latent, "TILE", 700)
    monkeypatch.setattr(latent, "AT_ONCE", 50)
    moved, plain = [], latent._summed

    def counting(shares):
        moved.append(shares.count())
        return plain(shares)

    monkeypatch.setattr(latent, "_summed", counting)
    cut = latent.LatentIndex(index, rank=5, passes=passes, seed=1)
    cut.path += "-cut"
    got = {r.key: r.vec for r in spark.read.parquet(f"{cut.build().path}/documents").collect()}
    assert got.keys() == want.keys()
    a, b = (np.array([x[k] for k in sorted(want)]) for x in (got, want))
    assert np.allclose(a @ a.T, b @ b.T, atol=1e-4)
    postings, terms = (spark.read.parquet(f"{index.path}/{t}").count() for t in ("postings", "terms"))
    tiles = -(-postings // 700)
    assert tiles > 2 and len(moved) == passes and all(terms <= m <= min(postings, tiles * terms) for m in moved)


def test_a_term_moves_once_for_each_band_of_tiles(spark, index, monkeypatch):
    """A band takes a term's vector once and gives its sum once, however many of its tiles have the term, with numbers of two bytes."""
    whole = latent.LatentIndex(index, rank=5, passes=2, seed=2).build()
    want = {r.key: r.vec for r in spark.read.parquet(f"{whole.path}/documents").collect()}
    for name, value in {"TILE": 200, "ROWS": 16, "AT_ONCE": 50, "DEALT": 500, "_band": lambda tiles, tasks: 4}.items():
        monkeypatch.setattr(latent, name, value, raising=False)
    moved, plain = [], latent._summed

    def counting(shares):
        moved.append(shares.agg(F.count("id"), F.max(F.octet_length(F.col("vec").cast("binary")))).first() if dict(shares.dtypes)["vec"] == "binary" else (shares.count(), None))
        return plain(shares)

    monkeypatch.setattr(latent, "_summed", counting)
    cut = latent.LatentIndex(index, rank=5, passes=2, seed=2)
    cut.path += "-bands"
    got = {r.key: r.vec for r in spark.read.parquet(f"{cut.build().path}/documents").collect()}
    assert got.keys() == want.keys()
    a, b = (np.array([x[k] for k in sorted(want)]) for x in (got, want))
    assert np.allclose(a @ a.T, b @ b.T, atol=1e-4)
    postings = spark.read.parquet(f"{index.path}/postings").filter("weight > 0")
    tiles = -(-postings.count() // 200)
    pairs = postings.select("term", F.pmod(F.xxhash64("key"), F.lit(tiles)).alias("tile")).distinct()
    by_band = pairs.select("term", F.floor(F.col("tile") / 4)).distinct().count()
    assert tiles > 8 and by_band < 0.6 * pairs.count() and [tuple(m) for m in moved] == [(by_band, 4 + 2 * 21)] * 2


def test_bands_share_the_tasks_evenly():
    assert [latent._band(tiles, tasks) for tiles, tasks in ((1, 8), (8, 8), (27, 6), (27, 100), (latent.BAND * 12, 12))] == [1, 1, 5, 1, latent.BAND]
    for tiles in range(1, 700, 9):
        band = latent._band(tiles, 12)
        assert 1 <= band <= latent.BAND and band * 12 * -(-tiles // (12 * latent.BAND)) >= tiles


def test_latent_vectors_of_odd_tables(spark, tmp_path):
    rows = [("a", "x y z"), ("b", "x y"), ("c", None), ("d", "z z z w"), ("e", "  ")]
    found = latent.LatentIndex(search.text_index(spark.createDataFrame(rows, "k string, t string"), "k", "t", str(tmp_path / "1")), rank=2, passes=2).build()
    assert {r.key for r in spark.read.parquet(f"{found.path}/documents").collect()} == {"a", "b", "d"} and found.search("w", 1).first().key == "d"
    for k, rows in enumerate([[], [("a", None), ("b", "")], [("a", "one")]]):  # no document, no term, no term with a weight
        df = spark.createDataFrame(rows, "k string, t string")
        found = latent.LatentIndex(search.text_index(df, "k", "t", str(tmp_path / f"0{k}")), rank=2, passes=2).build()
        assert found.search("one").count() == 0 and spark.read.parquet(f"{found.path}/documents").columns == ["key", "vec"]


def test_an_index_moves_postings_once(spark, tmp_path):
    """Texts with a key each: counts by document take no shuffle, and those by term are the only rows of postings that move."""
    rows = [(1, "b a b  c\u00c9 b"), (2, ""), (3, None), (4, "a"), (5, "\u00e9 \u00c9 x" * 3)]
    df = spark.createDataFrame(rows, "k long, t string")
    got = {r.k: [tuple(x) for x in r.c] for r in df.select("k", search.term_counts(F.col("t")).alias("c")).collect()}
    want = {k: sorted(Counter(re.findall(r"\w+", (t or "").lower())).items()) for k, t in rows}
    assert {k: [x for x in v if x[0] is not None] for k, v in got.items()} == want
    plans = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(search, "save", lambda d, path: (plans.append((path.rsplit("/", 1)[1], d._jdf.queryExecution().executedPlan().toString())), shared.save(d, path)))
        search.TextIndex.build(df, "k", "t", str(tmp_path / "index"))
    moves = {name: plan.count("Exchange ") for name, plan in plans}
    assert moves["postings"] == 2 and moves["lengths"] == 1  # one of the two is that of the terms' numbers
