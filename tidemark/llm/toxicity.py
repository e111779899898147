r"""Toxicity: a fuzzy lexicon automaton and context windows.

*Lexicon.* Words and word beginnings (stems) that the labelled documents of the
training folds hold far more often where they are toxic, and more clearly so than
the best of as many terms would by chance.  *Matching.* The
Levenshtein automata of all terms, intersected with the trie of the lexicon and
made deterministic as texts ask for it, read a word once and give the term within
the allowed distance.  They read only words that share a spelling with deletions with
some term, which every word within the distance does.  Words of clean training
documents that happen to lie that near to a term are exceptions.  *Context.* A hit
between paired quotation marks, or beside words of reporting, is weakened, one beside
words of address strengthened.
*Score.* A logistic model over a few sums of hits.

All of it is fitted on a bounded sample of labelled rows, ``SAMPLE`` documents
chosen by a hash of doc_id, and that bounds the lexicon and its exceptions: they are
words of the sample.  Every document is scored, as a whole.  Only ``text`` enters a
score.

Defined cases: a null text is empty; texts without hits share one low score; a
null doc_id counts as the text '' in the fold rule, so it is held out; labels that
are null or absent teach nothing; of several labels of a doc_id the highest
holds; without a toxic label every score is the share of toxic labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, slices, table, text_or_empty

#: Bound of the labelled sample the model is fitted on (documents).
SAMPLE = 20_000
#: A term needs so many toxic documents and so large log odds; no share of them, or rare languages would have no terms.
MIN_TOXIC, MIN_ODDS = 3, 2.5
#: The chance that any term at all gets into the lexicon without cause.
FALSE_TERMS = 0.05
STEM_CHARS = (4, 5, 6)
WINDOW = 6
QUOTED, ADDRESSED = 0.15, 1.3
#: Longest term whose spellings with deletions are listed.
LISTED = 24
#: Bounds of what a worker remembers; beyond them it starts anew.
REMEMBERED, MAX_STATES = 150_000, 50_000

# Words and marks of context, in the languages of the table.
REPORTING = frozenset("said says wrote called calls quote quoted quotes reported term word insult slur sagte schrieb nannte zitat dit écrit appelé citation dijo escribió llamó cita".split())
ADDRESS = frozenset("you your youre u ur du dich dein ihr euch tu te toi vous ton votre tú ti usted vosotros".split())
CLOSING = {'"': '"', "'": "'’", "“": "”", "„": "“”", "‘": "’", "‚": "‘’", "«": "»", "»": "«", "‹": "›", "›": "‹"}
MARKS = re.compile(r"^[\W_]+|[\W_]+$")


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


BASE = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(BASE, i, 1 << 64) for i in range(64)], np.uint64)
TABLE_BITS = 22


def _letters(words: list[str]) -> np.ndarray:
    """A row of 64-bit codes for each of *words*, which are of one length."""
    codes = np.array(words, f"<U{len(words[0])}").view("<u4").reshape(len(words), -1).astype(np.uint64)
    return (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


def spelling_hashes(words: list[str], most: int) -> Iterator[np.ndarray]:
    """Polynomial hashes of *words*, which are of one length, with up to *most* (at most two) letters left out: an array for each way."""
    letters = np.ascontiguousarray(_letters(words).T)
    n, base = len(letters), np.uint64(BASE)
    before = [np.zeros(len(words), np.uint64)]  # of the first i letters
    for c in letters:
        before.append(before[-1] * base + c)
    after = [before[n] - before[j] * _POWERS[n - j] for j in range(n + 1)]  # of the letters from j on
    yield before[n]
    for i in range(n if most else 0):
        yield before[i] * _POWERS[n - 1 - i] + after[i + 1]
        if most > 1:
            here = before[i]
            for j in range(i + 1, n):
                yield here * _POWERS[n - 1 - j] + after[j + 1]
                here = here * base + letters[j]


def _slots(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(BASE)
    return mixed >> np.uint64(64 - TABLE_BITS)


def by_length(words: Iterable[str], most: int = 50_000) -> Iterator[list[str]]:
    """Groups of words of one length."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for group in groups.values():
        for at in range(0, len(group), most):
            yield group[at : at + most]


class FuzzyLexicon:
    """The trie of the terms, read through Levenshtein automata; states are made when first reached.

    A state is a set of (trie node, edits so far).  Characters outside the terms
    behave alike and share a transition.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float], exceptions=frozenset()):
        self.weights = {**{w: x for w, x in words.items()}, **{s + "*": x for s, x in stems.items()}}
        self.exceptions = exceptions
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        for term in words:
            node = 0
            for c in term:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                node = nxt
            self.word[node] = term
        self.letters = {c for kids in self.children for c in kids}
        self.reach = [0] * len(self.children)  # most edits of any term below
        for node in range(len(self.children) - 1, -1, -1):  # children come after their parents
            own = edits_allowed(self.word[node]) if self.word[node] else 0
            self.reach[node] = max([own, *(self.reach[k] for k in self.children[node].values())])
        self.stem_chars = sorted({len(s) for s in stems}, reverse=True)
        # which slots the spellings with deletions of the terms fall into, for each number of edits; and what lengths to read
        self.slots = [np.zeros(1 << TABLE_BITS, bool) if any(edits_allowed(w) == k for w in words) else None for k in range(3)]
        self.sizes: list[set[int]] = [set(), set(), set()]
        self.long_sizes: set[int] = set()
        for group in by_length(words):
            n = len(group[0])
            k = edits_allowed(group[0])
            if k and n <= LISTED:
                for hashes in spelling_hashes(group, k):
                    self.slots[k][_slots(hashes)] = True
                self.sizes[k].update(range(n - k, n + k + 1))
            elif k:
                self.long_sizes.update(range(n - k, n + k + 1))
        self.found: dict[str, tuple[str, int] | None] = {}
        self._reset()

    def near(self, words: Iterable[str]) -> Iterator[str]:
        """Those of *words* that a term may be within its distance of; no other word is.

        Two words within k edits have a spelling with at most k letters left out in common.
        """
        for group in by_length(words):
            n = len(group[0])
            if n in self.long_sizes:
                yield from group
                continue
            hit = np.zeros(len(group), bool)
            for k in (1, 2):
                if n in self.sizes[k]:
                    for hashes in spelling_hashes(group, k):
                        hit |= self.slots[k][_slots(hashes)]
            yield from (group[i] for i in np.flatnonzero(hit))

    def learn(self, tokens: Iterable[str]) -> dict[str, tuple[str, int] | None]:
        """The memory, which knows all *tokens* now: (term, distance) of the nearest term of each without its marks, a stem counting as distance 0."""
        if len(self.found) > 4 * REMEMBERED:
            self.found = {}
        found, words, doubtful = self.found, {}, []
        for t in tokens:
            if t not in found:
                w = words[t] = plain(t)
                if w not in found:
                    found[w] = hit = self._exact(w)
                    if not hit and w not in self.exceptions:
                        doubtful.append(w)
        for w in self.near(doubtful):
            found[w] = self._read(w)
        for t, w in words.items():
            found[t] = found[w]
        return found

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, at: dict[int, int]) -> int:
        """The id of a set of places, closed under skipped term letters; -1 if empty."""
        todo = list(at.items())
        while todo:
            node, e = todo.pop()
            if at.get(node, 99) < e:
                continue
            for kid in self.children[node].values():
                if e + 1 <= self.reach[kid] and at.get(kid, 99) > e + 1:
                    at[kid] = e + 1
                    todo.append((kid, e + 1))
        if not at:
            return -1
        key = tuple(sorted(at.items()))
        known = self.ids.get(key)
        if known is None:
            known = self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            ends = [(e, w) for node, e in key if (w := self.word[node]) and e <= edits_allowed(w)]
            self.accepts.append(min(ends)[::-1] if ends else None)
        return known

    def _step(self, state: int, c: str) -> int:
        at: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.reach[node] and at.get(node, 99) > e:
                at[node] = e

        for node, e in self.states[state]:
            reach(node, e + 1)
            for letter, kid in self.children[node].items():
                reach(kid, e + (letter != c))
        return self._state(at)

    def lookup(self, word: str) -> tuple[str, int] | None:
        return self.learn([word])[word]

    def _exact(self, word: str) -> tuple[str, int] | None:
        if word in self.weights:
            return word, 0
        stem = next((s for k in self.stem_chars if (s := word[:k] + "*") in self.weights and len(word) >= k), None)
        return (stem, 0) if stem else None

    def _read(self, word: str) -> tuple[str, int] | None:
        if len(self.states) > MAX_STATES:
            self._reset()
        state = self.start
        for c in word:
            c = c if c in self.letters else "\0"
            nxt = self.next[state].get(c)
            if nxt is None:
                nxt = self.next[state][c] = self._step(state, c)
            if nxt < 0:
                return None
            state = nxt
        return self.accepts[state]


def plain(token: str) -> str:
    """A token without the marks around it."""
    return token if token.isalnum() else MARKS.sub("", token)


def hits(text: str, lexicon: FuzzyLexicon) -> list[tuple[int, str, int, float]]:
    """(token index, term, distance, weight) of every hit, the weight by its context."""
    tokens = text.lower().split()
    known = lexicon.learn(set(tokens))
    found = [(i, *hit) for i, t in enumerate(tokens) if (hit := known[t])]
    if not found:
        return []
    inside = quoted(tokens)
    return [(i, t, d, lexicon.weights[t] * context_factor(tokens, i, i in inside)) for i, t, d in found]


def learn_all(texts: Iterable[str], lexicon: FuzzyLexicon) -> None:
    """Look up the words of many texts at once, before :func:`hits` reads them one by one."""
    if len(lexicon.found) > REMEMBERED:  # here, so that what a slice learns stays until it is read
        lexicon.found = {}
    lexicon.learn(set().union(*(set(t.lower().split()) for t in texts)))


def quoted(tokens: list[str]) -> set[int]:
    """The places of the tokens between paired quotation marks, however far apart.

    A mark before the letters of a token opens, one after them closes what it fits and
    was opened last; a token of marks alone does what it can.  A mark without its partner does nothing.
    """
    opened: dict[str, int] = {}
    out: set[int] = set()
    for i, token in enumerate(tokens):
        if token.isalnum():
            continue
        first = next((k for k, c in enumerate(token) if c.isalnum()), len(token))
        last = next((k for k in range(len(token), 0, -1) if token[k - 1].isalnum()), 0)
        for k, c in enumerate(token):
            if first <= k < last:
                continue  # inside the word
            partners = [m for m in opened if c in CLOSING[m]] if k >= last else ()
            if partners:
                out.update(range(opened.pop(max(partners, key=opened.get)), i + 1))
            elif c in CLOSING and k < first:
                opened[c] = i
    return out


def context_factor(tokens: list[str], i: int, inside: bool, window: int = WINDOW) -> float:
    """QUOTED inside a quotation or beside words of reporting, ADDRESSED beside words of address."""
    near = {plain(t) for t in tokens[max(0, i - window) : i] + tokens[i + 1 : i + window + 1]}
    if inside or near & REPORTING:
        return QUOTED
    return ADDRESSED if near & ADDRESS else 1.0


def features(text: str, lexicon: FuzzyLexicon) -> tuple[float, float, float]:
    """Log sums of exact and of misspelled hits, and of all hits per thousand characters."""
    exact = near = 0.0
    for _, _, distance, weight in hits(text, lexicon):
        if distance:
            near += weight
        else:
            exact += weight
    return math.log1p(exact), math.log1p(near), math.log1p(1000 * (exact + near) / (len(text) + 200))


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset = frozenset()
    #: Intercept and the weights of the features.
    weights: tuple[float, ...] = (-2.0, 0.0, 0.0, 0.0)

    def lexicon(self) -> FuzzyLexicon:
        return FuzzyLexicon(self.words, self.stems, self.exceptions)

    def score(self, x: tuple[float, float, float]) -> float:
        z = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], x))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


# -- fitting ------------------------------------------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """text, toxic and part (0: counts, 1: weights) of at most *size* training documents, by a hash of doc_id.

    Copies count once, or the rare words of a copied text would look like terms.
    """
    usable = labels.filter(~held_out()).filter("doc_id is not null and toxic is not null")
    share = min(1.0, 1.1 * size / max(1, usable.count()))  # by hash, so that few rows over *size* are ever sorted
    chosen = (
        usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(share * (1 << 32)))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(size)
    )
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most *size* rows
    part = F.when(F.pmod(F.xxhash64("text"), F.lit(3)) == 0, 1).otherwise(0)
    return materialize(rows.groupBy("text").agg(F.max("toxic").alias("toxic")).select("text", "toxic", part.alias("part")), "toxic-sample")


def _counted(rows: DataFrame, of_text, before=None) -> DataFrame:
    """term and n0 to n3, the documents of each class (2 * part + toxic) whose text gives the term; summed in the task first.

    *before* is called with some texts before *of_text* is with each.
    """
    names, most = ["n0", "n1", "n2", "n3"], 200_000
    ddl = "term string, " + ", ".join(f"{n} long" for n in names)
    schema = pa.schema([("term", pa.string()), *((n, pa.int64()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = tuple(Counter() for _ in names)

        def flush() -> pa.RecordBatch:
            terms = list(set().union(*counts))
            out = [terms, *([c[t] for t in terms] for c in counts)]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

        for batch in batches:
            for rows in slices(batch, 4_000_000):
                columns = [c.to_pylist() for c in rows.columns]
                if before:
                    before(columns[0])
                for text, toxic, part in zip(*columns):
                    counts[2 * part + bool(toxic)].update(of_text(text))
                    if sum(map(len, counts)) > most:
                        yield flush()
        yield flush()

    summed = rows.select("text", "toxic", "part").mapInArrow(run, ddl).groupBy("term")
    return summed.agg(*(F.sum(n).alias(n) for n in names))


def _telling(counts: DataFrame, sizes: list[int], parts: tuple[int, ...]) -> list:
    """term, toxic (documents), odds of the terms that speak for toxicity in *parts*.

    A term's evidence bounds the log chance that its documents are toxic so often
    (Chernoff); it has to hold against all the terms that are tested (``FALSE_TERMS``).
    """
    n_clean, n_toxic = (sum(sizes[2 * p + y] for p in parts) for y in (0, 1))
    clean, toxic = (sum((F.col(f"n{2 * p + y}") for p in parts), F.lit(0)) for y in (0, 1))
    tested = counts.select("term", clean.alias("clean"), toxic.alias("toxic")).filter(F.col("toxic") >= MIN_TOXIC)
    n, base = F.col("clean") + F.col("toxic"), n_toxic / max(1, n_clean + n_toxic)
    share = F.col("toxic") / n
    evidence = F.col("toxic") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / max(1e-9, 1 - base))).otherwise(0)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    return (
        tested.withColumn("odds", odds)
        .filter((F.col("odds") >= MIN_ODDS) & (evidence >= math.log(max(1, tested.count()) / FALSE_TERMS)))
        .orderBy(F.desc(F.col("odds") * F.col("toxic")), "term")
        .collect()
    )


def _terms(text: str) -> set[str]:
    words = {w for t in set(text.lower().split()) if (w := plain(t))}
    return words | {w[:n] + "*" for w in words for n in STEM_CHARS if len(w) > n}


def _pruned(rows: list) -> tuple[dict[str, float], dict[str, float]]:
    """All words, for stems match without edits only; and the stems worth keeping: one only if no single longer term does its work."""
    odds = {r.term: r.odds for r in rows}
    toxic = {r.term: r.toxic for r in rows}
    below: dict[str, list[str]] = {}
    for t in toxic:
        body = t.rstrip("*")
        for k in STEM_CHARS:
            if k < len(body) or (k == len(body) and not t.endswith("*")):
                below.setdefault(body[:k] + "*", []).append(t)
    stems: dict[str, float] = {}
    for t in sorted((t for t in toxic if t.endswith("*")), key=lambda t: (len(t), t)):
        covered = any(t[:k] in stems for k in STEM_CHARS if k < len(t) - 1)
        enough = any(toxic[u] >= 0.95 * toxic[t] or (toxic[u] >= 0.5 * toxic[t] and odds[u] > odds[t] + 0.5) for u in below.get(t, ()))
        if not covered and not enough:
            stems[t[:-1]] = odds[t]
    return {t: odds[t] for t in toxic if not t.endswith("*")}, stems


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> tuple[float, ...]:
    """Newton's method with a ridge; the slopes stay non-negative, as hits never speak for a text."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + ridge * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
        w[1:] = np.maximum(w[1:], 0)
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Weights from a third of the sample by a lexicon of the others, then the lexicon and its exceptions from all of it."""
    sample = labelled_sample(docs, labels, size)
    sizes = [0] * 4
    for r in sample.groupBy("part", (F.col("toxic") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[2 * r.part + r.y] = r.n
    base = math.log((sizes[1] + sizes[3] + 0.5) / (sizes[0] + sizes[2] + 1))
    if not sizes[1] + sizes[3]:
        return Model(weights=(base, 0.0, 0.0, 0.0))
    counts = materialize(_counted(sample, _terms).filter(F.col("n1") + F.col("n3") >= MIN_TOXIC), "toxic-terms")
    weights = _weights(_model(sample, counts, sizes, (0,)), sample.filter("part = 1"), base)
    model = _model(sample, counts, sizes, (0, 1))
    model.weights = weights
    return model


def _model(sample: DataFrame, counts: DataFrame, sizes: list[int], parts: tuple[int, ...]) -> Model:
    """Lexicon and exceptions by the documents of *parts*."""
    words, stems = _pruned(_telling(counts, sizes, parts))
    model = Model(words, stems)

    def misspelled(text: str) -> set[str]:
        lexicon = _lexicon(model)
        seen = {w for t in set(text.lower().split()) if (w := plain(t))}
        known = lexicon.learn(seen)
        return {w for w in seen if (hit := known[w]) and hit[1]}

    n_clean, n_toxic = (sum(sizes[2 * p + y] for p in parts) for y in (0, 1))
    clean, toxic = (sum((F.col(f"n{2 * p + y}") for p in parts), F.lit(0)) for y in (0, 1))
    odds = F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))
    exceptions = (
        _counted(sample.filter(F.col("part").isin(*parts)), misspelled, lambda texts: learn_all(texts, _lexicon(model)))
        .filter((clean > 0) & (odds < MIN_ODDS))
        .orderBy(F.desc(clean), "term")
        .collect()
    )
    return Model(words, stems, frozenset(r.term for r in exceptions))


def _weights(model: Model, sample: DataFrame, base: float) -> tuple[float, ...]:
    """The intercept and slopes of the score, by documents that the lexicon has not seen."""
    found = with_features(sample.select(F.col("toxic").cast("long").alias("doc_id"), "text"), model).collect()
    if not any(r.doc_id for r in found):
        return (base, 1.0, 0.5, 0.5)
    # every toxic document a second time with its hits taken as misspelled, against the near hits of clean ones
    rows = [((r.exact, r.near, r.dense), r.doc_id > 0) for r in found]
    rows += [((0.0, math.log1p(math.expm1(x[0]) + math.expm1(x[1])), x[2]), y) for x, y in rows if y]
    return _logistic(np.array([x for x, _ in rows]), np.array([float(y) for _, y in rows]))


_held: list = []


def _lexicon(model: Model) -> FuzzyLexicon:
    """The worker's automaton of *model*, kept between batches."""
    if not _held or _held[0] is not model:
        _held[:] = [model, model.lexicon()]
    return _held[1]


# -- scoring ---------------------------------------------------------------------------------


def with_features(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, exact, near, dense."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of a bounded sample

    def rows(columns: list[list]) -> list[list]:
        lexicon = _lexicon(shared.value)
        learn_all(columns[1], lexicon)
        found = [features(t, lexicon) for t in columns[1]]
        return [columns[0], *(list(c) for c in zip(*found))]

    names = ("exact", "near", "dense")
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.float64()) for n in names)])
    ddl = "doc_id long, " + ", ".join(f"{n} double" for n in names)
    return map_rows(docs.select("doc_id", text_or_empty().alias("text")), rows, schema, ddl)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    w = model.weights
    z = F.lit(w[0]) + F.col("exact") * w[1] + F.col("near") * w[2] + F.col("dense") * w[3]
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return with_features(docs, model).select(
        "doc_id", held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of *docs*, with all their columns, whose text scores below *threshold*."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # words of a bounded sample

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        _held.clear()  # what fitting remembered; the words of this task go with it
        lexicon = model.lexicon()
        for batch in batches:
            for part in slices(batch, 2_000_000):
                texts = [t or "" for t in part.column(part.schema.names.index("text")).to_pylist()]
                learn_all(texts, lexicon)
                yield part.filter(pa.array([model.score(features(t, lexicon)) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
