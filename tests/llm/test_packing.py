import zlib
from array import array

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.data import AWKWARD, docs_frame, words
from tidemark.llm import packing as m

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole():
    return Tokenizer.from_file(PATH)  # as it is


WHOLE, ENCODER = whole(), m.WordEncoder(PATH)


def same(text):
    assert ENCODER.encode(text) == array("I", WHOLE.encode(text, add_special_tokens=False).ids).tobytes()


def test_words_encoded_apart_equal_the_whole_text():
    texts = [x or "" for _, x in AWKWARD] + ["Don't 'S 'st ''s !'s x's 'll've", "ΑΣ ΣΑΣ", "é Å ﬁ ½ ² ٣", "a\x1cb\x85c d", "İI ǅ ẞ", "<|startoftext|>a", "̈ͅΣ"]
    texts += ["a<|endoftext|>b <|endoftext|>, <|ENDOFTEXT|> <|endof text|>", "\u1c89 \ua7cb \U00010d50", "fußé, İ, ª. ŉ! dž?", "x\u0301, e\u0301\u0327. \u0301;", "é'S été's, n't,"]
    for x in texts:
        same(x)


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=20))
def test_latin_words_that_the_model_reads_have_the_ids_of_the_library(text):
    same(text)


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30))
def test_any_text_has_the_ids_of_the_library(text):
    same(text)


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "|>", "é", "İ", "Σ", "'s", "'", ",", ".", "a", "Z", "ß", "ñ", "\u0301", "\u0327", "\u0345", "1", " ", "\x1c", "\x85", "ª", "ĳ"]), max_size=14).map("".join))
def test_marks_and_control_strings_have_the_ids_of_the_library(text):
    same(text)


def check(df, rows, t):
    pieces = df.collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for ps in by_seq.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:k]) for k in range(len(ps))]
        n = sum(p.length for p in ps)
        assert n <= 2048 and n & (n - 1) == 0
    texts = {}
    for i, x in rows:
        texts.setdefault(i, []).append(t.encode(x or "", add_special_tokens=False).ids + [1])
    assert by_doc.keys() == texts.keys()
    for i, lists in texts.items():
        if len(lists) > 1:  # repeated ids: only the sum can be told
            assert sum(p.length for p in by_doc[i]) == sum(map(len, lists))
            continue
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            part = lists[0][p.start : p.start + p.length]
            assert (p.start, p.doc_tokens, len(part)) == (at, len(lists[0]), p.length)
            assert p.ids_crc32 == zlib.crc32(array("I", part).tobytes())
            at += p.length
        assert at == len(lists[0])


def test_every_id_lies_in_one_piece(spark):
    rows = AWKWARD + [(100 + i, " ".join(words(30 + 97 * (i % 9), i))) for i in range(60)] + [(500, " ".join(words(9000, 3)))]
    check(m.pack(docs_frame(spark, rows, ("key",)), PATH), rows, whole())
    assert m.pack(docs_frame(spark, []), PATH).collect() == []


def test_a_third_of_copies_spreads_over_ranges(spark):
    rows = [(i, "one and the same text " * 20) for i in range(300)]
    df = m.pack(docs_frame(spark, rows).repartition(6), PATH)
    check(df, rows, whole())
    assert len({r.sequence_id >> 40 for r in df.collect()}) == 4
    without = m.pack(docs_frame(spark, [(None, t) for _, t in rows], ("tie", "range")).repartition(6), PATH).collect()
    assert len({r.sequence_id >> 40 for r in without}) == 4  # and so without ids
    assert sum(r.length for r in without) == sum(r.length for r in df.collect())


def test_a_memory_that_ends_with_its_task_changes_no_piece(spark):
    rows = AWKWARD + [(100 + i, " ".join(words(300, i))) for i in range(40)]
    pieces = [sorted(map(tuple, m.pack(docs_frame(spark, rows), PATH, remembered=size, keep=keep).collect()), key=str) for size, keep in ((m.REMEMBERED, True), (5000, False))]
    assert pieces[0] == pieces[1]


def test_hilbert_keys_walk_the_grid_by_single_steps():
    side, bits = 8, 3
    grid = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    keys = m.hilbert_keys(grid, bits)
    assert sorted(keys.tolist()) == list(range(side**3))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_similar_texts_lie_nearer_on_the_curve():
    vectors = np.array([m.hashed_vector(" ".join(words(200, k // 5) + [str(k)])) for k in range(50)])
    keys = m.hilbert_keys(m.coordinates(vectors))
    order = np.argsort(keys, kind="stable") // 5
    assert (np.diff(order) == 0).sum() >= 30
