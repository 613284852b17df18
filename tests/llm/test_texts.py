"""Operators on texts against brute force, the public libraries and exact round trips."""

import hashlib
import random
import re

import pytest

from millrace.llm import decontaminate, jaccard_join, licenses, sentence_pieces, token_counts, toxicity
from millrace.llm.queries import tokenizer_bytes

PIECES = tokenizer_bytes("piece_bpe_32k.model")
BPE = tokenizer_bytes("byte_bpe_50k.json")
DOCS = "doc_id long, text string, id string, n_tokens int, label string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)


def texts(n, seed=5):
    r = random.Random(seed)
    words = ["".join(r.choice("abdeginorst") for _ in range(r.randint(1, 7))) for _ in range(60)]
    return [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(n)]


# -- SentencePiece ------------------------------------------------------------------------


def odd_texts(n, seed=2):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=PIECES)
    r = random.Random(seed)
    alphabet = " \n\tabcdefghijklmnop▁\r;(){}éß日=-_*/'\".,0123ABC👍"
    fixed = ["", " ", "  a", "a  b ", "▁x", "\x00z", "\r\n", "a" * 64, "a " * 60, " " * 37, "<s></s><unk>", "<0x41>", "a,.b. ,c", "é" * 50]
    mixed = ["".join(r.choice(alphabet[: r.choice([4, 9, 30, len(alphabet)])]) for _ in range(r.randint(1, 50))) for _ in range(n)]
    pieces = [sp.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    return sp, fixed + mixed + ["".join(r.choice(pieces) for _ in range(r.randint(1, 20))) for _ in range(n)]


def test_pieces_match_the_library():
    sp, cases = odd_texts(1500)
    codec = sentence_pieces.PieceCodec(PIECES)
    for t in cases:
        ids = codec.encode(t)
        assert ids == sp.encode(t), t
        assert codec.decode([*ids, codec.end_id]) == sp.decode([*ids, 2]), t


def test_piece_rows(spark):
    sp, cases = odd_texts(40, 9)
    rows = [(k, t) for k, t in enumerate(cases)] + [(None, None), (3, "again"), (4, "long " * 40_000)]
    out = sentence_pieces.encode_documents(docs(spark, rows), PIECES, with_ids=True, with_text=True).collect()
    assert len(out) == len(rows)
    want = {}
    for i, t in rows:
        ids = [*sp.encode(t or ""), 2]
        want.setdefault(i, []).append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    for r in out:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in want[r.doc_id]
        assert r.decoded_text == sp.decode(r.ids)
    assert sentence_pieces.encode_documents(docs(spark, []), PIECES).count() == 0


# -- token counts ----------------------------------------------------------------------------


def test_counts_match_the_library_and_fill_the_cache(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(BPE.decode())
    r = random.Random(3)
    alphabet = "  \n\t\r'sdtrevml ABC 0123 .,;:!?<|endoftext|> éß\xa0\xad²½ñ“”日本👍\x85\x1c"
    rows = [(k, "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))) for k in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "a<|endoftext|>b<|endoftext|>"), (None, "twice"), (5, "twice"), (1003, "word " * 3000)]
    cache = str(tmp_path / "cache")
    first = token_counts.count_tokens(docs(spark, rows), BPE, cache=cache, limit=1024).collect()
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert sorted((str(x.doc_id), x.n_bytes, x.n_tokens) for x in first) == want
    assert {x.over_limit for x in first if x.doc_id == 1003} == {True}
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in rows})
    more = rows[:50] + [(2000, "a new text")]
    again = token_counts.count_tokens(docs(spark, more), BPE, cache=cache).collect()
    assert len(again) == 51 and spark.read.parquet(cache).count() == len({t or "" for _, t in rows}) + 1
    assert token_counts.count_tokens(docs(spark, []), BPE, cache=cache).count() == 0


def test_counts_with_other_files(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=PIECES)
    rows = [(1, "a b  c"), (2, "é\n日本"), (3, "")]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs(spark, rows), PIECES, "model").collect()}
    assert got == {i: len(sp.encode(t)) for i, t in rows}
    assert token_counts.tokenizer_digest("json", BPE) != token_counts.tokenizer_digest("model", BPE)


# -- decontamination -----------------------------------------------------------------------------


def brute_hits(text, items, width=10):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - width + 1)) if w else ():
            window = w[k : k + width]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("most", [10**6, 40])
def test_windows_against_brute_force(spark, most):
    base = texts(30, 8)
    items = [(k, base[k]) for k in range(8)] + [(50, "ab"), (51, ""), (52, None), (53, "Ab"), (8, base[9]), (8, base[9])]
    r = random.Random(1)
    rows = []
    for k in range(60):
        a, b = r.choice(base).split(), r.choice(base).split()
        i = r.randint(0, max(0, len(b) - 1))
        rows.append((k, " ".join(a[: r.randint(0, 20)] + b[i : i + r.randint(0, 30)]).replace(" ", r.choice([" ", ", ", "  ", "-"])).upper() if k % 3 else base[k % 30]))
    rows += [(100, None), (101, ""), (None, base[0]), (102, (base[1] + " ") * 200)]
    out = decontaminate.scan_documents(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), max_pattern_words=most).collect()
    got = sorted((str(x.doc_id), x.n_words, x.n_hit, x.n_items, tuple(x.items)) for x in out)
    want = sorted((str(i), *(lambda w, h, f: (w, h, len(f), tuple(f)))(*brute_hits(t, items))) for i, t in rows)
    assert got == want
    if most > 40:
        for x in out:
            t = dict(rows).get(x.doc_id)
            inside = [w.span() for w in WORD.finditer(lower(t))]
            assert sum(any(s.start <= a and b <= s.end for s in x.spans) for a, b in inside) == x.n_hit


@pytest.mark.parametrize("most", [10**6, 40])
def test_spans_in_one_pass_and_in_several(spark, most):
    items = [(k, " ".join(f"w{(k * 7 + j) % 90}" for j in range(12 if k % 3 else 4))) for k in range(12)]
    whole = "Hé, " + " - ".join(t.title() for _, t in items[:7]) + " é x " + items[8][1] + "! zz " + items[3][1]
    rows = [(1, whole), (2, "nothing of it"), (3, None), (4, items[5][1]), (None, whole)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.scan_documents(docs(spark, rows), bench, max_pattern_words=most).collect()
    lone = {str(r.doc_id): r.spans for r in decontaminate.scan_documents(docs(spark, rows), bench).collect()}
    assert len(out) == 5 and {str(r.doc_id): r.spans for r in out} == lone and len(lone["1"]) > 1
    for x in out:
        t = dict(rows).get(x.doc_id) or ""
        inside = [w.span() for w in WORD.finditer(lower(t))]
        assert sum(any(s.start <= a and b <= s.end for s in x.spans) for a, b in inside) == x.n_hit
    assert all(r.spans == [] for r in decontaminate.scan_documents(docs(spark, rows), bench, max_pattern_words=most, spans=False).collect())


def test_empty_benchmark_and_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.scan_documents(docs(spark, [(1, "a b")]), none).collect()] == [0]
    assert decontaminate.scan_documents(docs(spark, []), none).count() == 0
    d = docs(spark, [(1, "one two"), (2, "three"), (None, "one two x")])
    kept = decontaminate.drop_contaminated(d, spark.createDataFrame([(1, "One, two")], "item_id long, text string"))
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [2]


# -- Jaccard join -----------------------------------------------------------------------------------


def brute_components(rows, width, percent):
    split = re.compile(r"[\x20\x09-\x0D]+")
    sets, parent = {}, {}
    for i, t in rows:
        w = [x for x in split.split(lower(t)) if x]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width,percent,seed", [(3, 90, 1), (5, 80, 2), (1, 60, 3)])
def test_join_against_brute_force(spark, width, percent, seed):
    r = random.Random(seed)
    base = texts(12, seed) + ["a", "a b", "A b", "a b c", "", None, "a " * 300, "q w e r t y u i o p " * 3]
    rows = []
    for k in range(260):
        w = (r.choice(base) or "").split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            if w:
                w[r.randrange(len(w))] = r.choice(["new", "x", str(k)])
        if r.random() < 0.2:
            w = w[: len(w) - r.randint(0, 3)]
        rows.append((k * 3 % 263, " ".join(w) if k % 50 else None))
    out = jaccard_join.similar_groups(docs(spark, rows), width=width, percent=percent).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out} == brute_components(rows, width, percent)


def test_join_of_nothing_and_whole_rows(spark):
    assert jaccard_join.similar_groups(docs(spark, [])).count() == 0
    d = docs(spark, [(5, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, None), (4, ""), (9, "z")])
    kept = jaccard_join.drop_similar(d)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "9", "None"]


# -- licenses ----------------------------------------------------------------------------------------


def brute_base(text):
    words = WORD.findall(lower(text))
    found = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_licenses_against_brute_force(spark):
    cases = [
        "Released under the MIT License.", "CC BY-NC cc by nc", "Apache License, Version 2.0; under the mit license", None, "", "clean text", "under the mit-license x" * 3,
        "This work is licensed under the GNU General Public License, version 3.", "x " * 50_000 + "cc by nc",
    ]
    rows = list(enumerate(cases)) + [(None, cases[0]), (0, cases[0])]
    out = licenses.scan_licenses(docs(spark, rows)).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in out)
    assert got == sorted((str(i), n, b, str(f), str(z), s) for i, t in rows for n, b, f, z, s in [brute_base(t)])
    labels = {r.doc_id: r.labels for r in out}
    assert labels[7] == "gpl-3" and labels[0] == "mit" and labels[5] == "" and labels[2] == "apache-2,mit"
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def test_rules_and_suppression():
    s = licenses.LicenseScanner()
    assert len(s.rules) >= 300 and [r.priority for r in s.rules] == sorted((r.priority for r in s.rules), reverse=True)
    scan = lambda t: s.scan(t)["labels"]
    assert scan("the GNU Lesser General Public License v2.1") == "lgpl-2.1"
    assert scan("SPDX-License-Identifier: BSD-3-Clause") == "bsd-3"
    assert scan("CC BY-SA 4.0") == "cc-by-sa"
    assert scan("we ate apples under the tree") == ""


def brute_kept(s, joined):
    found = [(m.start(), m.end(), rule) for rule in s.rules for m in rule.pattern.finditer(joined)]
    kept = []
    for a, b, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label)):
        if not any(x <= a and b <= y for x, y, _ in kept):
            kept.append((a, b, rule))
    return kept


def test_suppression_against_all_pairs_and_on_long_texts():
    s, r = licenses.LicenseScanner(), random.Random(4)
    parts = "spdx license identifier mit|gnu lesser general public license v2 1|gnu general public license version 3|licensed under the|apache license version 2 0|or|this|gpl 3|license|bsd 3 clause license|mit license|under the mit license".split("|")
    for _ in range(60):
        text = " ".join(r.choice(parts) for _ in range(r.randint(1, 40)))
        joined = f" {text} ".encode()
        expected = brute_kept(s, joined)
        assert s.detections(joined) == expected
        words = text.split()
        found = s.scan(text)
        assert [(d["start"], d["end"]) for d in found["detections"]] == [(len(joined[:a].split()), len(joined[:b].split())) for a, b, _ in expected]
        assert (found["n_words"], found["n_base"], found["first_word"], found["last_word"], found["base_labels"]) == brute_base(" ".join(words))
    long = s.scan(" ".join(r.choice(parts) for _ in range(60_000)))
    assert len(long["detections"]) > 10_000


def examples(part, r):
    """A string that a parsed pattern matches."""
    out = ""
    for op, value in part:
        name = str(op)
        if name == "LITERAL":
            out += chr(value)
        elif name == "IN":
            out += chr(r.choice(value)[1])
        elif name == "BRANCH":
            out += examples(r.choice(value[1]), r)
        elif name == "SUBPATTERN":
            out += examples(value[3], r)
        elif name == "MAX_REPEAT":
            out += "".join(examples(value[2], r) for _ in range(r.randint(*value[:2])))
        elif name not in ("ASSERT", "ASSERT_NOT"):
            raise AssertionError(name)
    return out


def test_keywords_skip_no_rule():
    gated, ungated, r = licenses.LicenseScanner(), licenses.LicenseScanner(), random.Random(3)
    ungated.prefilter = ungated.keywords = [b" "]
    ungated.rules = [licenses.Rule(x.label, x.priority, x.score, x.pattern, (b" ",)) for x in ungated.rules]
    for rule in gated.rules:
        for _ in range(20):
            text = "aa " + examples(re._parser.parse(rule.pattern.pattern.decode()), r) + " zz"
            assert rule.pattern.search(f" {text} ".encode()), text
            assert gated.scan(text) == ungated.scan(text) and gated.scan(text)["labels"], (rule.label, text)
    scan = lambda t: gated.scan(t)["labels"]
    assert scan("Dual EPL 2.0 code") == "epl-2" and scan("code: CDDL 1.0") == "cddl-1"
    assert scan("SPDX-License-Identifier: OFL-1.1") == "ofl-1" and scan("SPDX-License-Identifier: MS-PL") == "ms-pl"


# -- toxicity ------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    terms = ["idiot", "scum", "worthless", "pathetic", "clown"]
    auto = toxicity.LexiconAutomaton(terms, ["lowei"])
    r = random.Random(4)
    words = set(terms)
    for t in terms:
        for _ in range(250):
            w = list(t)
            for _ in range(r.randint(1, 3)):
                k = r.randrange(len(w) + 1)
                op = r.random()
                if op < 0.34:
                    w.insert(k, r.choice("aeot"))
                elif op < 0.67 and len(w) > 2:
                    w.pop(min(k, len(w) - 1))
                else:
                    w[min(k, len(w) - 1)] = r.choice("aeotz")
            words.add("".join(w))
    budget = lambda t: 0 if len(t) < 5 else 1 if len(t) < 9 else 2
    for w in words:
        exact = w in terms
        near = any(distance(w[1:], t[1:]) <= budget(t) for t in terms if w[:1] == t[0])
        assert (auto.match(w)[0] > 0) == (exact or near), w
        assert (auto.match(w)[0] == 2) == exact
    assert auto.match("loweischaft")[0] == 2 and auto.match("lowe")[0] == 0


def test_density_of_long_texts():
    r = random.Random(4)
    for n in (1, 5, 60, 400):
        places = sorted(r.sample(range(3 * n + 20), n))
        assert toxicity.densest(places, 50) == max(sum(0 <= p - i <= 50 for p in places) for i in places)
    scorer = toxicity.Scorer(toxicity.ToxicityModel(words=["zorble"]))
    far = lambda n: scorer.features(("zorble " + "calm " * 60) * n)[7]
    assert scorer.hits(["zorble", "calm"]) and far(1999) == far(2001) == 0
    near = lambda n: scorer.features("zorble " * n)[7]
    assert near(10) < near(30) < near(51) and near(51) == near(3000)


def test_learning_scores_and_quotation(spark):
    r = random.Random(6)
    clean = texts(300, 11)
    rows = []
    for k in range(600):
        words = clean[k % 300].split() + [f"w{k}"]
        y = int(k % 5 == 0)
        if y:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "moron", "scum", "lowei" + r.choice(["ab", "ef", "gh", "ij", "kl", "mn"])]))
        rows.append((k, " ".join(words), y))
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (9999, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, labels)
    assert {"idiot", "moron", "scum"} <= set(model.words) and any(s.startswith("lowe") for s in model.stems)
    out = toxicity.score_documents(docs(spark, [(i, t) for i, t, _ in rows] + [(None, None), (7000, ""), (7001, "w " * 50_000)]), model).collect()
    y = {i: t for i, _, t in rows}
    held = [x for x in out if x.held_out and x.doc_id in y]
    assert held and sum(x.predicted == y[x.doc_id] for x in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in out)
    s = model.scorer()
    assert s.score("you idiot moron") > s.score('he said "idiot" again')
    kept = toxicity.drop_toxic(docs(spark, [(1, "you idiot moron scum"), (2, "fine"), (3, None)]), model)
    assert sorted(x.doc_id for x in kept.collect()) == [2, 3]
    assert toxicity.score_documents(docs(spark, []), toxicity.learn([], [])).count() == 0


def test_long_words_equal_the_library():
    import random
    import time

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=PIECES)
    codec = sentence_pieces.PieceCodec(PIECES)
    r = random.Random(12)
    letters = ["ab", "abcdefghijklmnopqrstuvwxyz", "aeiourstln", "ABCDEFabcdef0123456789", "0123456789", "=-_*#", "éèüñçß", "日本語中文字", "theingtionerre", "\x01😀a"]
    for k in range(300):
        own = letters[k % len(letters)]
        word = "".join(r.choices(own, k=r.randrange(301, 900)))
        if k % 5 == 0:
            word = "".join(r.choices(own, k=r.randrange(1, 9))) * 100
        assert codec.encode_long(sentence_pieces.SPACE + word) == sp.encode(word), word[:60]
    blob = "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=1_000_000))
    began = time.perf_counter()
    ids = codec.encode(f"data {blob} end")
    assert time.perf_counter() - began < 60
    assert ids == sp.encode(f"data {blob} end")


def test_the_store_of_words_is_bounded_by_letters(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "MAX_LETTERS", 1000)
    codec = sentence_pieces.PieceCodec(PIECES)
    for i in range(20):
        codec.learn([f"{i}word{j}" * 5 for j in range(20)])
        assert len(codec.words) <= 60


def test_notices_of_licenses():
    s = licenses.LicenseScanner()
    cases = {
        "apache-2": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "bsd-3": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "bsd-4": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
        "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "cc0": "To the extent possible under law, the author(s) have waived all copyright and related or neighboring rights",
        "lgpl": "You should have received a copy of the GNU Lesser General Public License along with this library",
        "json": "The Software shall be used for Good, not Evil.",
        "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
        "psf-2": 'PSF is making Python available to Licensee on an "AS IS" basis.',
    }
    for label, text in cases.items():
        assert label in s.scan("intro words " + text + " and more")["labels"].split(","), label
    assert s.scan("the name of the holder and its contributors may be used")["labels"] == ""
