"""Ranking, mixing and the audit of filters, against plain Python."""

import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from millrace.llm import audit, mixing, ranking

LINES = "g int, h string, a int, b long, t long, place string, `x.y` int"


def ranked(rows, k, place, ways=("desc", "asc")):
    """Plain Python: rows are (g, h, a, b, t, ...)."""

    def key(value, way):
        return (0, 0) if value is None else (1, -value if way == "desc" else value)

    groups = defaultdict(list)
    for r in rows:
        groups[r[0], r[1]].append(r)
    out = []
    for own in groups.values():
        own.sort(key=lambda r: (key(r[2], ways[0]), key(r[3], ways[1]), (r[4] is None, r[4] or 0)))
        pairs = [(r[2], r[3]) for r in own]
        dense = {p: i + 1 for i, p in enumerate(dict.fromkeys(pairs))}
        for pos, (r, p) in enumerate(zip(own, pairs, strict=True), 1):
            at = {"position": pos, "rank": pairs.index(p) + 1, "dense": dense[p]}[place]
            if at <= k:
                out.append((*r[:5], at, pairs.count(p)))
    return Counter(out)


def some_lines(n, seed, top):
    r = random.Random(seed)
    pick = lambda most: r.choice([None, *range(most)])
    return [(r.choice([None, 1, 1, 1, 2, 3]), r.choice([None, "u", "v"]), pick(top), pick(3), pick(9), "p", 7) for _ in range(n)]


@pytest.mark.parametrize("place", ["position", "rank", "dense"])
@pytest.mark.parametrize("k,top", [(1, 4), (2, 4), (3, 200), (500, 4)])
def test_places_equal_plain_python(spark, place, k, top):
    rows = some_lines(400, k, top)
    df = spark.createDataFrame(rows, LINES)
    found = ranking.top_places(df, ["g", "h"], [("a", "desc"), ("b", "asc")], ["t"], k, place=place)
    assert [c for c in found.columns if c not in ("pos", "place", "tied")] == ["g", "h", "a", "b", "t", "x.y"]
    got = Counter(tuple(r[c] for c in ("g", "h", "a", "b", "t", "place", "tied")) for r in found.collect())
    assert got == ranked(rows, k, place)


def test_places_of_wide_pairs_search_several_levels(spark):
    r = random.Random(5)
    rows = [(1, "u", r.randrange(-(2**31), 2**31), r.choice([None, -(2**62), 2**62, r.randrange(10**9)]), i, "p", 0) for i in range(300)]
    rows += [(2, "u", 5, 6, i, "p", 0) for i in range(40)] + [(3, None, None, None, None, None, None)] * 3
    found = ranking.top_places(spark.createDataFrame(rows, LINES), ["g", "h"], [("a", "asc"), ("b", "desc")], ["t"], 5)
    got = Counter(tuple(r[c] for c in ("g", "h", "a", "b", "t", "place", "tied")) for r in found.collect())
    assert got == ranked(rows, 5, "position", ("asc", "desc"))


def test_places_of_an_empty_table_and_wrong_arguments(spark):
    df = spark.createDataFrame([], LINES)
    found = ranking.top_places(df, ["g", "h"], [("a", "desc"), ("b", "asc")], ["t"], 2)
    assert found.collect() == [] and {"pos", "place", "tied"} <= set(found.columns)
    with pytest.raises(ValueError):
        ranking.top_places(df, ["g"], [("a", "desc"), ("b", "up")], [], 2)


def test_a_range_hands_on_few_lines_of_a_hot_group(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("g"), F.lit(3).alias("a"), F.lit(4).alias("b"), F.col("id").alias("t"))
    found = ranking.top_places(rows, ["g"], [("a", "desc"), ("b", "asc")], ["t"], 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "rangepartitioning" in plan
    assert [(r.t, r.pos, r.tied) for r in found.orderBy("t").collect()] == [(0, 1, 20_000), (1, 2, 20_000)]


DOCS = "doc_id long, text string, lang string, source string, kept int, size string"


def test_audit_equals_plain_python(spark):
    r = random.Random(3)
    words = ["lorem", "Ipsum", "DOLOR", "sit#", "amet", "wörter", "😀", "x"]
    texts = ["", None, "a\x0bb\x1cc", "A" * 50, *[" ".join(r.choice(words[: r.randrange(1, 9)]) for _ in range(r.choice([1, 3, 260]))) for _ in range(25)]]
    texts += [" ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250))]
    rows = [(r.choice([None, *range(60)]), r.choice(texts), r.choice([None, "", "de", "en"]), "s", 1, "z") for _ in range(300)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1)]
    found = audit.audit_filters(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in found.collect()}

    least = {}
    for doc, text, *_ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    judged = []
    for doc, text, lang, *_ in rows:
        text = text or ""
        own = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text).split(" ") if w]
        fails = {
            "A": len(own) < 200,
            "B": 100 * len(set(own)) < 50 * len(own),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc is not None and doc > least[text],
        }
        judged.append((lang or "", {f for f, x in fails.items() if x}, doc in good, doc in toxic))
    want = {}
    for part in {p for p, *_ in judged}:
        own, shapley = [j for j in judged if j[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                shapley[f] += len(gone)
                want[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in j[1] for j in own) - len(gone), sum(j[1] == {f} for j in own), sum(j[2] for j in gone), sum(j[3] for j in gone)
                ]
        for (p, order, step), row in want.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    assert got == {k: tuple(v) for k, v in want.items()}


def test_audit_of_an_empty_table_and_of_many_parts(spark, monkeypatch):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_filters(spark.createDataFrame([], DOCS), labels).count() == 0
    monkeypatch.setattr(audit, "PARTS", 3)
    docs = spark.createDataFrame([(i, f"text {i % 5}", f"part {i % 10}", "s", 1, "z") for i in range(50)], DOCS)
    rows = audit.audit_filters(docs, labels).filter("filter_order = 'EABCD' and step = 1").collect()
    assert len(rows) == 10 and sum(r.removed for r in rows) == 45


def mix_rows(n, seed):
    r = random.Random(seed)
    sources = [None, "b", "a", "Z", "ä", "tiny"]
    rows = []
    for i in range(n):
        source = r.choices(sources, [3, 6, 4, 2, 2, 0.2])[0]
        rows.append((r.choice([None, i, i, i, i % 7]), r.choice([None, "", " \t", *(" ".join("w" * r.randrange(1, 60)) for _ in range(6))]), "en", source, 1, "z"))
    return rows + rows[:20]


@pytest.mark.parametrize("share,repeats", [(1.0, 3), (0.5, 2), (2.5, 3)])
def test_mixes_meet_their_targets(spark, share, repeats):
    rows = mix_rows(900, 1)
    docs = spark.createDataFrame(rows, DOCS)
    mix = mixing.mix_sources(docs, share=share, repeats=repeats)
    found = mix.collect()
    sizes = Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, closed = int(sum(sizes.values()) * share), {}, set()
    while True:
        level = (total - sum(repeats * sizes[s] for s in closed)) / max(1, sum(w for s, w in weight.items() if s not in closed))
        more = {s for s in order if weight[s] * level > repeats * sizes[s]} - closed
        if not more:
            break
        closed |= more
    target = {s: float(repeats * sizes[s]) if s in closed else weight[s] * level for s in order}
    assert len(found) == len(rows)
    taken, longest = Counter(), max(r.size for r in found)
    for r in found:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and r.weight == weight[r.source]
        assert 0 <= r.copies <= repeats and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 2 * longest
    assert total - longest <= sum(taken.values()) <= total
    again = mixing.mix_sources(docs.repartition(7), share=share, repeats=repeats)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, found))

    copies = mixing.mixed_documents(docs, share=share, repeats=repeats)
    assert set(copies.columns) == {*docs.columns, "mix_finish"}
    words = Counter()
    for r in copies.collect():
        words[r.source] += len(r.text.split())
    assert words == +taken


def test_mixes_of_nothing(spark):
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).collect() == []
    docs = spark.createDataFrame([(1, None, "en", None, 1, "z"), (2, " ", "en", "a", 1, "z")], DOCS)
    assert [(r.size, r.target, r.taken) for r in mixing.mix_sources(docs).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mixed_documents(docs).count() == 0
