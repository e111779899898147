import re

from pyspark.sql import functions as F

from tests.llm.data import AWKWARD, docs_frame
from tidemark.llm import exact_dedup as m


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    best = {k: min(v, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)) for k, v in groups.items()}
    out = []
    for i, t in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        out.append((i, best[k][0], len(groups[k]), i == best[k][0] and len(t or "") == len(best[k][1])))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)


def test_awkward_rows(spark):
    df = docs_frame(spark, AWKWARD, extra=("digest", "content", "salt"))
    assert rows_of(m.assign(df)) == brute(AWKWARD)


def test_weak_digest_never_merges_different_texts(spark):
    rows = [(i, f"text {i % 7}" + " " * (i % 3)) for i in range(60)]
    weak = lambda content: F.unhex(F.hex(F.crc32(content.cast("binary")) % 2))
    assert rows_of(m.assign(docs_frame(spark, rows), weak)) == brute(rows)


def test_a_third_is_one_text(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(900)]
    assert rows_of(m.assign(docs_frame(spark, rows).repartition(8))) == brute(rows)


def test_empty_table(spark):
    assert m.assign(docs_frame(spark, [])).collect() == []


def test_keep_one_leaves_one_row_of_each_content(spark):
    df = docs_frame(spark, AWKWARD, extra=("tm_digest",))
    kept = m.keep_one(df)
    assert kept.columns == df.columns
    contents = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    assert sorted(contents) == sorted({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in AWKWARD})


WEAK = lambda content: F.unhex(F.hex(F.crc32(content.cast("binary")) % 2))


def stays(rows):
    """The (doc_id, text) that stay, one of each content."""
    best = {}
    for i, t in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        now = (-len(t or ""), i is None, i or 0)
        if k not in best or now < best[k][0]:
            best[k] = (now, i, len(t or ""))
    return sorted(((i, k, n) for k, (_, i, n) in best.items()), key=str)


def test_keep_one_with_repeated_ids_null_ids_and_colliding_digests(spark):
    rows = [(i % 20, f"text {i % 7}" + " " * (i % 3)) for i in range(60)] + [(None, "text 1   "), (None, "only here"), (None, "only here"), (99, "other"), (99, "another"), (99, None)]
    for digest in (m.sha256_bytes, WEAK):
        kept = m.keep_one(docs_frame(spark, rows, ("content", "tm_same")), digest).collect()
        found = sorted(((r.doc_id, re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), len(r.text or "")) for r in kept), key=str)
        assert found == stays(rows)


def test_the_ends_of_the_id_range(spark):
    rows = [(2**63 - 1, "a"), (-(2**63), "a"), (0, "a"), (None, "a"), (2**63 - 1, "b"), (None, "b"), (-5, "c "), (-6, "c"), (None, "d  "), (1, "d ")]
    assert rows_of(m.assign(docs_frame(spark, rows))) == brute(rows)
