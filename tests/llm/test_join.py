"""The n-gram Jaccard join on groups that tempt to pairs, against all pairs in numpy; growth of what it writes."""

import random

import numpy as np
import pytest

from millrace.llm import jaccard_join

WORDS = [f"w{k}" for k in range(3000)]


def all_pairs(rows, width, percent):
    """{id: (n_shingles, component_id)} from the similarity of all pairs."""
    hashes = jaccard_join._WordHash()
    sets = [jaccard_join.shingle_set(t, width, hashes) for _, t in rows]
    n = np.array(list(map(len, sets)))
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros((len(rows), len(tokens)), np.float32)
    held[np.repeat(np.arange(len(rows)), n), at] = 1
    both = held @ held.T
    linked = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (n[:, None] > 0) & (n[None, :] > 0)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(*np.nonzero(np.triu(linked, 1))):
        parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: (int(n[k]), least[find(k)]) for k, (i, _) in enumerate(rows)}


def words(r, n):
    return [r.choice(WORDS) for _ in range(n)]


def edited(r, base, k):
    out = list(base)
    for _ in range(k):
        out[r.randrange(len(out))] = r.choice(WORDS)
    return " ".join(out)


def joined(spark, rows, width, percent):
    out = jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string, component_id string"), width=width, percent=percent).collect()
    return {x.doc_id: (x.n_shingles, x.component_id) for x in out}


def group(kind, n, r):
    if kind == "one edit":
        base = words(r, 60)
        return [(i, edited(r, base, 1)) for i in range(n)]
    if kind == "two halves":
        base = words(r, 150)
        other = base[:60] + words(r, 15) + base[75:]
        return [(i, edited(r, base if i % 2 else other, r.randint(0, 3))) for i in range(n)]
    base = words(r, 120)
    return [(i, edited(r, base, r.randint(0, 9))) for i in range(n)]


@pytest.mark.parametrize("kind", ["one edit", "two halves", "many edits"])
def test_large_groups_of_near_copies_make_no_pairs(spark, monkeypatch, kind):
    """Twice the members make about twice the rows in every table that is written; crowds share a row a chunk."""
    monkeypatch.setattr(jaccard_join, "CROWD", 3)
    wrote = {}
    plain = jaccard_join.written

    def counting(df, name):
        out = plain(df, name)
        wrote[name] = wrote.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "written", counting)
    sizes = {}
    for n in (200, 400):
        rows = group(kind, n, random.Random(7))
        wrote.clear()
        assert joined(spark, [(*x, "x") for x in rows], 3, 90) == all_pairs(rows, 3, 90)
        sizes[n] = dict(wrote)
    for name, count in sizes[400].items():
        assert count <= 2.6 * sizes[200][name] + 200, name


def test_small_sets_common_passages_and_low_thresholds(spark):
    r = random.Random(3)
    rows = []
    for _ in range(70):
        base = words(r, r.choice([1, 2, 4, 8, 15, 30, 80, 300]))
        rows += [(len(rows) + k, edited(r, base, r.randint(0, max(1, len(base) // 12)))) for k in range(r.choice([1, 2, 5]))]
    common = words(r, 40)
    rows += [(len(rows) + k, " ".join(words(r, r.randint(5, 60)) + common)) for k in range(60)]
    rows += [(len(rows), ""), (len(rows) + 1, " \t\n")]
    for width, percent in ((5, 80), (2, 60)):
        assert joined(spark, [(*x, "x") for x in rows], width, percent) == all_pairs(rows, width, percent)


def test_rows_that_share_an_identifier_are_judged_by_their_text(spark):
    r = random.Random(5)
    one, two = words(r, 100), words(r, 100)
    rows = [(5, " ".join(one)), (5, " ".join(two)), (1, edited(r, two, 1)), (7, " ".join(one)), (7, " ".join(one)), (None, " ".join(one))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard_join.drop_similar(docs, width=3, percent=90).collect()
    assert sorted((str(x.doc_id), x.text) for x in kept) == sorted([("5", " ".join(one)), ("1", rows[2][1]), ("None", " ".join(one))])


def test_word_hashes_tell_words_apart():
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcdefghij é0-") for _ in range(r.randint(1, 9))) for _ in range(5000)) + " İ ß ẞ x A a\x0b\x0cb"
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    import re

    expected = re.findall(r"[^\x20\x09-\x0D]+", lower)
    got = jaccard_join._WordHash()(text).tolist()
    assert len(got) == len(expected) and len(set(got)) == len(set(expected)) == len(set(zip(expected, got)))
