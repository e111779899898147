"""run() against plain Python over the smallest table, and each stage's contract on awkward rows."""

import re
import zlib
from array import array

import corpus_pipeline
from tests.llm.data import AWKWARD, docs_frame
from tests.llm.test_ngram_join import brute as near_brute
from tests.llm.test_packing import whole
from tidemark.llm import secrets, toxicity
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(spark):
    """doc_id -> final text."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    lexicon = model.lexicon()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows = [(i, t) for i, t in rows if model.score(toxicity.features(t, lexicon)) < 0.5]
    best = {}
    for i, t in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", t)
        if k not in best or (-len(t), i) < (-len(best[k][1]), best[k][0]):
            best[k] = (i, t)
    rows = sorted(best.values())
    classes = near_brute(rows)
    return {i: secrets.redacted(t) for i, t in rows if classes[i][0] == i}


def test_run_equals_brute_force(spark):
    t, pieces = whole(), corpus_pipeline.run(spark, SF).collect()
    want = brute(spark)
    got = {}
    for p in pieces:
        got.setdefault(p.doc_id, []).append(p)
    assert got.keys() == want.keys()
    for i, text in want.items():
        ids = t.encode(text, add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(got[i], key=lambda p: p.start):
            part = ids[p.start : p.start + p.length]
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(array("I", part).tobytes())
            at += p.length
        assert at == len(ids)


def test_stages_keep_the_columns_and_take_awkward_rows(spark):
    for rows, extra in ((AWKWARD, ()), (AWKWARD, ("key", "score", "digest", "rid", "block", "range")), ([], ())):
        df = docs_frame(spark, rows, extra)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns and out.schema == df.schema
            out.collect()
        pieces = corpus_pipeline.STAGES[-1][1](spark, df, SF)
        assert (pieces.count() > 0) == bool(rows)
