import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.data import AWKWARD, docs_frame
from tidemark.llm import toxicity as m


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_brute_force_edit_distance():
    rng = random.Random(0)
    terms = ["idiot", "idiom", "moron", "worthless", "scum", "disgusting", "ab", "abcde"]
    lexicon = m.FuzzyLexicon({t: 1.0 for t in terms}, {})
    probes = set(terms) | {"", "zzz", "\0"}
    for t in terms * 60:
        w = list(t)
        for _ in range(rng.randrange(4)):
            at, op = rng.randrange(len(w) + 1), rng.randrange(3)
            w[at : at + (op > 0)] = [rng.choice("abcdeiotsmz漢")] if op < 2 else []
        probes.add("".join(w))
    for w in probes:
        near = [(d, t) for t in terms if (d := distance(w, t)) <= m.edits_allowed(t)]
        got = lexicon.lookup(w)
        assert (got is None) == (not near), w
        assert got is None or got == min(near)[::-1]


def test_stems_and_exceptions():
    lexicon = m.FuzzyLexicon({"moron": 1.0}, {"grob": 2.0}, frozenset(["oron"]))
    assert lexicon.lookup("grobian") == ("grob*", 0) and lexicon.lookup("gro") is None
    assert lexicon.lookup("oron") is None and lexicon.lookup("moran") == ("moron", 1)


def test_words_under_a_stem_are_found_misspelled():
    from types import SimpleNamespace as Row

    rows = [Row(term=t, odds=4.0, toxic=n) for t, n in (("kretz*", 40), ("kretzwarg", 20), ("kretzbold", 18), ("scum", 9))]
    words, stems = m._pruned(rows)
    assert list(stems) == ["kretz"] and "scum" in words
    lexicon = m.FuzzyLexicon(words, stems)
    assert lexicon.lookup("kretzfink") == ("kretz*", 0) and lexicon.lookup("kretzwarg")[1] == 0
    assert lexicon.lookup("krezwarg") == ("kretzwarg", 1) and lexicon.lookup("kretwbold") == ("kretzbold", 1)


def test_quotation_weakens_and_address_strengthens():
    lexicon = m.FuzzyLexicon({"idiot": 4.0}, {})
    weight = lambda t: sum(h[3] for h in m.hits(t, lexicon))
    assert weight('the word "idiot" was there') < weight("an idiot was there") < weight("you idiot")
    assert weight("he said idiot once") < 1


def test_marks_have_to_be_paired():
    lexicon = m.FuzzyLexicon({"idiot": 4.0}, {})
    weight = lambda t: sum(h[3] for h in m.hits(t, lexicon))
    assert weight('"hello" he idiot "bye"') == weight('so "what idiot . !') == weight("an idiot") == 4
    assert weight("an ' idiot thing") == weight("‹ idiot «") == weight("» idiot") == 4
    for t in ('a "stupid idiot", so', "«vrai idiot»", "„so ein idiot“", "“idiot.”", '" idiot "', "›idiot‹", "'an idiot today'", '("idiot")'):
        assert weight(t) == m.QUOTED * 4, t
    for n in (17, 40, 200, 5000):  # quotations of any length
        assert weight('"' + "other " * n + 'idiot" and so on') == m.QUOTED * 4
        assert weight('"' + "other " * n + '" idiot') == 4
    assert weight("x" + '"' * 30_000 + " idiot") == 4


def test_words_of_any_length_are_terms():
    assert m._terms("Git, git «sot» x idiotic") == {"git", "sot", "x", "idiotic", "idio*", "idiot*", "idioti*"}
    lexicon = m.FuzzyLexicon({"git": 3.0, "x": 2.0}, {})
    assert [h[:3] for h in m.hits("you git, x gits", lexicon)] == [(1, "git", 0), (2, "x", 0)]


def test_only_words_within_reach_are_read_and_no_hit_is_lost():
    rng = random.Random(2)
    terms = ["".join(rng.choice("abcd") for _ in range(rng.randrange(3, 30))) for _ in range(60)]
    lexicon = m.FuzzyLexicon({t: 1.0 for t in terms}, {})
    for t in terms * 10:
        w = list(t)
        for _ in range(rng.randrange(5)):
            at, op = rng.randrange(len(w) + 1), rng.randrange(3)
            w[at : at + (op > 0)] = [rng.choice("abcde")] if op < 2 else []
        w = "".join(w)
        assert (lexicon.lookup(w) is not None) == any(distance(w, t) <= m.edits_allowed(t) for t in terms)
    assert len(list(lexicon.near({"e" * n for n in range(1, 24)} | {"wxyz" * n for n in range(1, 6)}))) <= len(lexicon.long_sizes)


def test_terms_of_a_rare_language_count_however_many_toxic_documents_there_are(spark):
    rows = [("raro", 0, 12, 0, 0), ("often", 10, 300, 0, 0), ("chance", 40, 3, 0, 0)]
    counts = spark.createDataFrame(rows, "term string, n0 long, n1 long, n2 long, n3 long")
    assert {r.term for r in m._telling(counts, [9_000, 1_000, 0, 0], (0,))} == {"raro", "often"}


def corpus(n=900):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        ws, toxic = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 120))], i % 6 == 0
        if toxic:
            for _ in range(3):
                ws.insert(rng.randrange(len(ws)), rng.choice(["kretzwarg", "blofumpe", "zwackdepp"]))
        rows.append((i, " ".join(ws)))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_misspellings(spark):
    rows, labels = corpus()
    extra = [(10_001, "alone a kretzwarq and blofumpee or zwackdep here"), (10_002, "nothing of the kind here")]
    docs = docs_frame(spark, rows + AWKWARD + extra, ("score", "held_out"))
    model = m.fit(docs, spark.createDataFrame(labels + [(10_000_000, 1), (None, 1), (4, None)], "doc_id long, toxic int"))
    got = {}
    for r in m.scored(docs, model).collect():
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        got.setdefault(r.doc_id, r)
    right = [got[i].predicted == int(i % 6 == 0) for i, _ in rows if i > 10 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(right) / len(right) > 0.98
    assert got[10_001].predicted == 1 and got[10_002].predicted == 0
    kept = m.drop_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i, _ in rows if i % 6} <= ids and not any(i % 6 == 0 and i > 10 and i in ids for i, _ in rows)


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert m.scored(docs_frame(spark, []), m.fit(docs_frame(spark, []), none)).collect() == []
    got = m.scored(docs_frame(spark, AWKWARD), m.fit(docs_frame(spark, AWKWARD), none)).collect()
    assert len(got) == len(AWKWARD) and {r.predicted for r in got} == {0}


def test_terms_and_weights_equal_a_plain_version(spark):
    """Term counts and the chance test by loops over the sample; the logistic weights by their gradient."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    sample = m.labelled_sample(docs, labels)
    rows = [(r.text, r.toxic) for r in sample.collect()]
    texts, truth = {r.doc_id: r.text or "" for r in docs.collect()}, {}
    for r in labels.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.toxic is not None:
            truth[texts[r.doc_id]] = max(truth.get(texts[r.doc_id], 0), r.toxic)
    assert dict(rows) == truth
    sizes = [sum(1 for _, y in rows if y == k) for k in (0, 1)]
    counts = (Counter(), Counter())
    for text, y in rows:
        found = {re.sub(r"^[\W_]+|[\W_]+$", "", t) for t in text.lower().split()}
        found = {w for w in found if len(w) >= min(m.STEM_CHARS)}
        counts[y].update(found | {w[:n] + "*" for w in found for n in m.STEM_CHARS if len(w) > n})
    tested = [t for t in counts[1] if counts[1][t] >= m.MIN_TOXIC]
    want = set()
    for t in tested:
        c, x = counts[0][t], counts[1][t]
        share, base = x / (c + x), sizes[1] / sum(sizes)
        evidence = x * math.log(share / base) + (c * math.log((1 - share) / (1 - base)) if c else 0)
        odds = math.log((x + 0.5) / (sizes[1] + 1)) - math.log((c + 0.5) / (sizes[0] + 1))
        if odds >= m.MIN_ODDS and evidence >= math.log(len(tested) / m.FALSE_TERMS):
            want.add(t)
    of_part = [sample.filter(f"part = {p} and toxic = {y}").count() for p in (0, 1) for y in (0, 1)]
    assert want and {r.term for r in m._telling(m._counted(sample, m._terms), of_part, (0, 1))} == want


def test_logistic_weights_are_where_the_gradient_vanishes():
    rng = np.random.default_rng(0)
    x = rng.exponential(1, (400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.5, 0.7, 0.4] - 2)))).astype(float)
    w = np.array(m._logistic(x, y))
    a = np.hstack([np.ones((400, 1)), x])
    assert (w[1:] > 0).all() and np.abs(a.T @ (1 / (1 + np.exp(-a @ w)) - y) + 0.05 * w).max() < 1e-6


@pytest.mark.parametrize("sf, recall", [("sf0.01", 0.6), ("sf0.1", 0.9)])
def test_query_on_held_out_rows(spark, sf, recall):
    sf = f"/root/testdata/{sf}"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in m.op4_toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    toxic, said = [r for r in rows if truth[r.doc_id]], [r for r in rows if r.predicted]
    hit = [r for r in toxic if r.predicted]
    assert len(hit) / len(toxic) >= recall and len(hit) / len(said) >= 0.9
    for each in {lang[r.doc_id] for r in toxic}:
        own = [r for r in toxic if lang[r.doc_id] == each]
        assert len(own) < 5 or sum(r.predicted for r in own) / len(own) >= 0.7, each
