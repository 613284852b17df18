"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learnt from labelled rows: words, and stems that head many words, which
mark toxic documents far beyond chance (near copies of a document count once).  The
trie of the lexicon is intersected with Levenshtein automata; the product is made
deterministic as it is used, so a word costs one table step per letter until it dies.
Windows around each hit tell quotation (quote marks, verbs of saying, "the word ...")
from abuse (second person, several hits close by).  A logistic regression over the
window sums gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import bounded_batches, tidy

#: Labelled rows of which a model is learnt at most, taken in the order of a hash.
MAX_LABELLED = 4000
#: Words on either side of a hit that count as its context.
WINDOW = 8
#: Words that a task remembers.
MAX_WORDS = 100_000

# Letters often put for others, quote marks, words that report speech, words that address.
FOLD = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
EDGES = " \t.,;:!?\"'()[]{}<>«»“”„‘’…*_-|/\\&%#"
QUOTES = frozenset("\"«»“”„")
REPORTING = frozenset(
    "said says say called calls wrote writes quoted quote quotes word words term slur insult reported reports "
    "dit disait mot sagte sagt wort dijo dice palabra".split()
)
ADDRESS = frozenset("you your you're youre u ur tu toi vous te vos du dich dir ihr eres usted ustedes".split())
N_FEATURES = 8


def held_out(id_col: str | Column) -> Column:
    """True for the fifth of all identifiers that no model may learn from."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fold(token: str) -> str:
    """A token as the lexicon has it: lower case, without edges, letters unfolded."""
    word = token.strip(EDGES)
    return word if word.isalpha() else word.translate(FOLD)


def densest(places: list[int], reach: int) -> int:
    """The most of the ascending places that lie within ``reach`` of the first of them."""
    most = first = 0
    for last, place in enumerate(places):
        while place - places[first] > reach:
            first += 1
        most = max(most, last - first + 1)
    return most


class LexiconAutomaton:
    """Trie x Levenshtein automaton, made deterministic step by step.

    A term of 5 letters or more allows one edit and of 9 or more two, the first letter
    apart; stems must match exactly.  ``match`` gives 2 for an exact hit, 1 for one
    with edits, 0 for none, and the number of the term.
    """

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.stem: list[bool] = [False]
        self.budget: list[int] = [0]
        self.edits: list[int] = []
        for term, is_stem in [*((w, False) for w in words), *((s, True) for s in stems)]:
            allowed = 0 if is_stem or len(term) < 5 else 1 if len(term) < 9 else 2
            at = 0
            for ch in term:
                if ch not in self.children[at]:
                    self.children[at][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.stem.append(False)
                    self.budget.append(0)
                at = self.children[at][ch]
                self.budget[at] = max(self.budget[at], allowed)
            self.ends[at], self.stem[at] = len(self.edits), is_stem
            self.edits.append(allowed)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.result: list[tuple[int, int]] = []
        self.early: list[tuple[int, int]] = []
        self.dead = self._state(frozenset())
        self.start = self._state(frozenset({(0, 0)}))

    def _state(self, items: frozenset) -> int:
        best: dict[int, int] = {}
        todo = list(items)
        while todo:  # a letter of the term that the word lacks
            node, e = todo.pop()
            if best.get(node, 99) <= e:
                continue
            best[node] = e
            if node:
                todo += [(child, e + 1) for child in self.children[node].values() if e + 1 <= self.budget[child]]
        closed = frozenset(best.items())
        if closed not in self.states:
            self.states[closed] = len(self.sets)
            self.sets.append(closed)
            self.steps.append({})
            ends = [(e, self.ends[n], self.stem[n]) for n, e in best.items() if self.ends[n] >= 0 and e <= self.edits[self.ends[n]]]
            self.result.append(min(((0 if e == 0 else 1, t) for e, t, _ in ends), default=(9, -1)))
            self.early.append(min(((0, t) for e, t, s in ends if s and e == 0), default=(9, -1)))
        return self.states[closed]

    def _step(self, state: int, ch: str) -> int:
        after: dict[int, int] = {}
        for node, e in self.sets[state]:
            for c, child in self.children[node].items():
                cost = e + (c != ch)
                if cost <= self.budget[child] and (c == ch or node):
                    after[child] = min(after.get(child, 99), cost)
            if node and e + 1 <= self.budget[node]:
                after[node] = min(after.get(node, 99), e + 1)
        self.steps[state][ch] = found = self._state(frozenset(after.items()))
        return found

    def match(self, word: str) -> tuple[int, int]:
        state = self.start
        steps, early = self.steps, self.early
        for ch in word:
            state = steps[state].get(ch, -1) if ch in steps[state] else self._step(state, ch)
            if state == self.dead:
                return 0, -1
            if early[state][0] == 0:
                return 2, early[state][1]
        kind, term = self.result[state]
        return (2, term) if kind == 0 else (1, term) if kind == 1 else (0, -1)


@dataclass
class ToxicityModel:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    benign: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=lambda: [-2.0, *[0.0] * (N_FEATURES - 1)])

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.automaton = LexiconAutomaton(model.words, model.stems)
        self.benign = model.benign
        self.weights = np.array(model.weights)
        self.known: dict[str, tuple[int, int]] = {}

    def look(self, token: str) -> tuple[int, int]:
        word = fold(token)
        kind, term = self.automaton.match(word) if word else (0, -1)
        if kind == 1 and word in self.benign:
            kind, term = 0, -1
        if len(self.known) >= MAX_WORDS:
            self.known.clear()
        self.known[token] = (kind, term)
        return kind, term

    def hits(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """(position, kind, term) of all tokens that the lexicon matches."""
        known, look = self.known, self.look
        found = [known.get(t) or look(t) for t in tokens]
        return [(i, kind, term) for i, (kind, term) in enumerate(found) if kind]

    @staticmethod
    def quoted(tokens: list[str], at: int) -> float:
        """How far the window of a hit reads as quotation, 0 to 1."""
        left, right = tokens[max(0, at - WINDOW) : at], tokens[at + 1 : at + 1 + WINDOW]
        opened = sum(q in t for t in [*left, tokens[at]] for q in QUOTES)
        closed = sum(q in t for t in [tokens[at], *right] for q in QUOTES)
        return 0.5 * bool(opened and closed) + 0.3 * any(t.strip(EDGES) in REPORTING for t in left) + 0.2 * (tokens[at][:1] in QUOTES)

    def features(self, text: str | None) -> np.ndarray:
        tokens = (text or "").lower().split()
        f = np.zeros(N_FEATURES)
        f[0] = 1
        hits = self.hits(tokens)
        if not hits:
            return f
        abuse = edits = quoted = addressed = 0.0
        for i, kind, _ in hits:
            q = self.quoted(tokens, i)
            quoted += q
            if kind == 2:
                abuse += 1 - q
            else:
                edits += 1 - q
            addressed += (1 - q) * any(t.strip(EDGES) in ADDRESS for t in tokens[max(0, i - WINDOW) : i + WINDOW + 1])
        places = [i for i, _, _ in hits]
        close = densest(places, 50)
        f[1:] = (
            min(1.0, abuse),
            math.log1p(abuse),
            math.log1p(edits),
            math.log1p(quoted),
            math.log1p(len({t for _, _, t in hits})),
            math.log1p(addressed),
            math.log1p(close - 1) * (abuse + edits) / len(hits),
        )
        return f

    def score(self, text: str | None) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.features(text) @ self.weights))))))


# -- learning ------------------------------------------------------------------------


def _families(texts: Iterable[list[str]]) -> list[int]:
    """A number per text that near copies share: one of eight least shingle hashes in common."""
    import zlib

    first: dict[tuple[int, int], int] = {}
    parent: list[int] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, tokens in enumerate(texts):
        parent.append(i)
        h = np.array([zlib.crc32(" ".join(tokens[k : k + 3]).encode()) for k in range(max(1, len(tokens) - 2))], np.uint64)
        for seed in range(8):
            low = int(((h * np.uint64(2 * seed + 2654435761) + np.uint64(seed * 97)) % np.uint64(2**32 - 5)).min())
            j = first.setdefault((seed, low), i)
            parent[find(i)] = find(j)
    return [find(i) for i in range(len(parent))]


def _beyond_chance(k: int, n: int, p: float, tries: int) -> bool:
    """Whether k of n at rate p is too many to arise once in a hundred among so many candidates."""
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))
    return tail * tries < 0.01


def learn(texts: list[str | None], labels: list[int]) -> ToxicityModel:
    """A model from labelled texts; without both labels the one that calls everything clean."""
    if not texts or len(set(labels)) < 2:
        return ToxicityModel()
    same: dict[str, str] = {}  # equal words of all texts are one string
    folded = [{same.setdefault(f, f) for f in map(fold, (t or "").lower().split()) if f} for t in texts]
    toxic = [i for i, y in enumerate(labels) if y]
    clean = [i for i, y in enumerate(labels) if not y]
    family = dict(zip(toxic, _families((texts[i] or "").lower().split() for i in toxic)))
    base = max(1e-3, min(0.5, len(set(family.values())) / (len(set(family.values())) + len(clean))))

    def stems_of(words: set[str]) -> set[str]:
        return {w[:k] for w in words for k in range(4, 9) if len(w) > k} | {w + "$" for w in words if len(w) >= 4}

    in_toxic: dict[str, set[int]] = defaultdict(set)
    for i in toxic:
        for s in stems_of(folded[i]):
            in_toxic[s].add(family[i])
    candidates = {s for s, f in in_toxic.items() if len(f) >= 3}
    in_clean: Counter[str] = Counter()
    for i in clean:
        in_clean.update(candidates.intersection(stems_of(folded[i])))
    support = {s: len(in_toxic[s]) for s in candidates}
    good = {
        s
        for s in candidates
        if support[s] >= 0.9 * (support[s] + in_clean[s]) and _beyond_chance(support[s], support[s] + in_clean[s], base, len(in_toxic))
    }
    words = sorted(s[:-1] for s in good if s[-1] == "$")
    stems: list[str] = []
    for s in sorted((s for s in good if s[-1] != "$"), key=lambda s: (len(s), s)):
        if any(s.startswith(t) for t in stems):
            continue
        heads = {w for i in toxic for w in folded[i] if w.startswith(s)}
        if len(heads) < 5:  # a word with a few endings, not a stem
            continue
        while True:  # as long as can be with nearly the same support
            longer = [t for t in good if len(t) == len(s) + 1 and t.startswith(s) and t[-1] != "$" and support[t] >= 0.97 * support[s]]
            if not longer:
                break
            s = max(longer, key=lambda t: (support[t], t))
        if not any(s.startswith(t) for t in stems):
            stems.append(s)
    words = [w for w in words if not any(w.startswith(s) for s in stems)]

    # Misspellings that clean texts of one half hold are words of their own; weights come from the other half.
    model = ToxicityModel(words, stems)
    scorer = model.scorer()
    halves = [list(range(0, len(texts), 2)), list(range(1, len(texts), 2))]
    benign = {w for i in halves[0] if not labels[i] for w in folded[i] if scorer.automaton.match(w)[0] == 1}
    model.benign = frozenset(benign)
    scorer = model.scorer()
    x = np.array([scorer.features(texts[i]) for i in halves[1]])
    y = np.array([labels[i] for i in halves[1]], float)
    if len(set(y)) < 2:
        x, y = np.array([scorer.features(t) for t in texts]), np.array(labels, float)
    model.weights = _logistic(x, y).tolist()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights by Newton's method; quotation and misspelling start from a prior of their own."""
    prior = np.zeros(x.shape[1])
    prior[1], prior[2], prior[3], prior[4] = 2.0, 1.0, 1.5, -0.5
    w = prior.copy()
    pull = np.full(len(w), ridge * 10)
    pull[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-6)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", *, max_rows: int = MAX_LABELLED) -> ToxicityModel:
    """Learns from at most ``max_rows`` labelled rows outside the held-out fifth, chosen by a hash of the identifier.

    Their number is bounded, so is what comes to the driver.  Nulls in any column,
    labels without a document and documents without a label are left out.
    """
    tidy(docs.sparkSession)
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .filter("_id is not null and _y in (0, 1)")
        .filter(~held_out("_id"))
        .dropDuplicates(["_id"])
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_text is not null")
    rows = texts.join(F.broadcast(chosen), "_id").select("_id", "_text", "_y").toArrow().sort_by([("_id", "ascending"), ("_text", "ascending")])
    model = learn(rows.column("_text").to_pylist(), rows.column("_y").to_pylist())
    del rows
    pa.default_memory_pool().release_unused()
    tidy(docs.sparkSession)
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row: id, held_out, score, predicted, n_hits.

    Null and empty texts have no hits and the score of a text without any.  Texts are
    scored whole, however long.  Repeated rows give repeated results; rows without an
    identifier are scored and are not held out; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()

    def run(batches):
        scorer = model.scorer()
        weights = scorer.weights
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                x = np.array([scorer.features(t) for t in batch.column(1).to_pylist()])
                score = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["id", "score", "predicted"]
                )

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, score double, predicted int")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below 0.5, with all their columns, in one pass."""

    bounded_batches(docs.sparkSession)

    def run(batches):
        scorer = model.scorer()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                keep = [scorer.score(t) < 0.5 for t in batch.column(text_col).to_pylist()]
                if any(keep):
                    yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
