import hashlib
import struct

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import AWKWARD, docs_frame, words
from tidemark.llm import bpe as m

RANKS = m.read_ranks(m.rank_path())
ENCODING = tiktoken.Encoding("own", pat_str=m.split_pattern(), mergeable_ranks=RANKS, special_tokens={})


def want(rows):
    out = []
    for i, t in rows:
        ids = ENCODING.encode_ordinary(t or "")
        blob = struct.pack(f"<{len(ids)}I", *ids)
        out.append((i, len(ids), hashlib.sha256(blob).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **args):
    df = docs_frame(spark, rows, ("ids", "block", "words"))
    return sorted(map(tuple, m.decode(m.encode(df, m.rank_path(), m.split_pattern(), **args), m.rank_path()).collect()), key=str)


def test_awkward_rows(spark):
    rows = AWKWARD + [(20, "it's  WE'LL\n\n\n x\x1c\x1d\x85y  z 's't ½²٣ é")]
    assert got(spark, rows) == want(rows)
    assert got(spark, []) == []


def test_many_blocks(spark):
    rows = [(i, " ".join(words(i * 13 % 300, i % 7))) for i in range(200)]
    assert got(spark, rows, block_chars=3000) == want(rows)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("bpe_")]  # nothing stays in the catalogue


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_words_apart_equal_the_whole_text(text):
    import regex

    found = regex.findall(m.split_pattern(), text)
    assert "".join(found) == text
    assert [i for w in found for i in ENCODING.encode_ordinary(w)] == ENCODING.encode_ordinary(text)
