import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import AWKWARD, docs_frame
from tidemark.llm import spelling as m


def counts(rows):
    found = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda x: x[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] = found.get(run, 0) + 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(rows):
    words = counts(rows)
    forms, n_near = {}, {}
    for w, n in words.items():
        others = [(-k, v) for v, k in words.items() if near(w, v)]
        n_near[w] = len(others)
        if others and -min(others)[0] >= 2 * n:
            forms[w] = min(others)[1]

    def root(w):
        while w in forms:
            w = forms[w]
        return w

    return sorted(((w, forms.get(w), root(w), n, n_near[w], words.get(forms.get(w))) for w, n in words.items()), key=str)


def found(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def corpus():
    rng, rows = random.Random(6), list(AWKWARD)
    base = ["spelling", "variant", "größe", "aaaaa", "abababab", "straße", "Kettle", "naïve", "×÷×÷×", "thing", "things", "théâtre"]
    for i in range(400):
        text = []
        for _ in range(rng.randrange(1, 40)):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aeé") + w[at:], w[:at] + rng.choice("bß") + w[at + 1 :]]) or "x"
            text.append(rng.choice([w, w.upper(), w.capitalize()]))
        rows.append((rng.choice([i, None]), rng.choice([" ", ", ", "1", "\n"]).join(text)))
    return rows


def test_equals_all_pairs(spark):
    rows = corpus()
    expected = brute(rows)
    assert found(m.variants(docs_frame(spark, rows, ("word", "n", "form", "share")).repartition(3))) == expected
    assert sum(r[1] is not None for r in expected) > 50 and any(r[2] not in (r[0], r[1]) for r in expected)


def test_shares_and_slices_lose_nothing(spark):
    rows = corpus()
    assert found(m.variants(docs_frame(spark, rows), share=3, slice_chars=30)) == brute(rows)


def test_nulls_long_texts_repeats_and_the_empty_table(spark):
    rows = [(1, "wordy " * 200_000), (2, "x" * 30_000 + " wordy"), (2, "x" * 30_000 + " wordy"), (3, "y" * 30_000), (None, None), (4, ""), (2, "x" * 30_000), (5, "x" * 29_999 + " " + "x" * 29_999 + " " + "x" * 29_999)]
    assert found(m.variants(docs_frame(spark, rows))) == brute(rows)
    assert m.variants(docs_frame(spark, [])).collect() == []
    assert m.variants(docs_frame(spark, [(1, "one two"), (2, None)])).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("ab", min_size=1, max_size=7), min_size=1, max_size=40))
def test_an_automaton_numbers_its_words_and_is_minimal(words):
    order = sorted(words)
    a = m.Automaton()
    for w in order:
        a.add(w)
    a.done()
    assert [a.number(w) for w in order] == list(range(len(order)))
    assert a.number("c") is None and a.root.words == len(order)
    nodes, todo = {}, [a.root]
    while todo:
        node = todo.pop()
        if id(node) not in nodes:
            nodes[id(node)] = node
            todo += [child for child, _ in node.edges.values()]

    def language(node):
        return frozenset(({""} if node.final else set()) | {c + rest for c, (child, _) in node.edges.items() for rest in language(child)})

    languages = [language(node) for node in nodes.values()]
    assert len(set(languages)) == len(languages)
    for half in ("", "a", "ab"):
        node, first = a.after(half)
        if node is not None:
            for rest in ("", "a", "ba", "abab"):
                got = {order[i] for i in m.with_one_error(node, first, rest)}
                assert got == {w for w in order if w.startswith(half) and near(half + rest, w) and near(rest, w[len(half) :])}


def test_words_of_texts_give_way_to_their_roots(spark):
    docs = docs_frame(spark, [(1, "Speling, spelling 'spelng'"), (2, None), (3, "nothing here"), (3, "nothing here")], ("word", "root"))
    found_ = spark.createDataFrame([("speling", "spelling"), ("spelng", "spelling"), ("spelling", "spelling")], "word string, root string")
    out = m.normalized(docs, found_)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, "spelling, spelling 'spelling'"), (2, ""), (3, "nothing here"), (3, "nothing here")]
