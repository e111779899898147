"""Stored models, vectors and batches: merges, caches, ledgers; notes and events; neighbours by streams."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import providers
from tidemark.operators import retrieve
from tidemark.sources import datasets, world_model
from tidemark.streaming import state


def cosines(a, b):
    out = np.zeros((len(a), len(b)))
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n = min(len(x or []), len(y or []))
            scale = np.linalg.norm(x or [0.0]) * np.linalg.norm(y or [0.0])
            out[i, j] = round(float(np.dot((x or [])[:n], (y or [])[:n]) / scale), 9) if scale else 0.0
    return out


@pytest.mark.parametrize("key", ["long", "string"])
def test_neighbours_of_one_context_by_blocks_and_shares(spark, key):
    rng = random.Random(3)
    rows = [(i, None if i % 31 == 5 else [float(rng.randrange(-2, 3)) for _ in range(3 if i % 13 else 2)], rng.choice("abc") if i < 120 else None) for i in range(130)]
    made = (lambda i: i) if key == "long" else (lambda i: f"v{i:03}")
    df = spark.createDataFrame([(made(i), v, c) for i, v, c in rows], f"id {key}, vector array<double>, context string")
    got = {}
    for r in retrieve.nearest_in_context(df.filter(F.col("id").isin([made(i) for i in range(0, 130, 4)])), df, 5, block=3, share=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.item_id, r.similarity))
    sims = cosines([v for _, v, _ in rows], [v for _, v, _ in rows])
    for q in range(0, 120, 4):
        best = sorted((-sims[q, j], made(j)) for j, _, c in rows if c == rows[q][2] and j != q)[:5]
        assert sorted(got[made(q)]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert not any(made(q) in got for q in range(120, 130))


def test_a_note_of_any_depth_keeps_its_order():
    def looped(n):
        inner = (n.get("text") or "") + "".join(map(looped, n.get("content") or ()))
        return inner + ("\n" if n.get("type") in datasets.BLOCKS else "")

    rng = random.Random(2)

    def tree(depth):
        kids = [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else []
        return {"type": rng.choice(["paragraph", "text", "heading", None]), "text": rng.choice(["", "a \"quoted\" [b]", "ünï", None]), "content": kids}

    for _ in range(30):
        note = tree(4)
        assert datasets.flattened_note(json.dumps({"doc": note})) == looped(note).strip() == datasets.flattened_note(json.dumps(note))
        assert datasets._nested(json.dumps(note)) == note
    deep = '{"type":"paragraph","content":[' * 5000 + '{"text":"end, \\"x\\""}' + "]}" * 5000
    assert datasets.flattened_note(deep) == 'end, "x"'
    assert [datasets.flattened_note(x) for x in (None, "", "bad", "[1]", "3", "[" * 9000, '{"a":' * 9000)] == [None, None, None, "", "", None, None]


def test_events_keep_their_dates_and_types_are_mapped(spark):
    told = [
        ("Opera night", "event", {"date": "2023-05-20", "description": "saw it"}, None), ("Move", "Event", "helped", "2023-05-19"), ("Move 2", "event", {"x": "1"}, "2023-05-18"),
        ("tea", "preference", "green", "2023-01-01"), ("home", "place", "here", None), ("Ann", "person", "friend", None), ("odd", None, "?", None),
    ]
    raw = json.dumps({"entities": [{"name": n, "type": t, "state": s, "date": d} for n, t, s, d in told]})
    rows = world_model.extraction(spark.createDataFrame([(1, raw)], "at long, text string"), "at", "text", mark_events=True)["entities"].orderBy("i").collect()
    assert [(r.name, r.type, dict(r.state)) for r in rows] == [
        ("Opera night", "event", {"date": "2023-05-20", "description": "saw it", "_is_event": "true"}),
        ("Move", "event", {"description": "helped", "_is_event": "true", "date": "2023-05-19"}),
        ("Move 2", "event", {"x": "1", "_is_event": "true", "date": "2023-05-18"}),
        ("tea", "belief", {"description": "green"}), ("home", "concept", {"description": "here"}), ("Ann", "person", {"description": "friend"}), ("odd", "concept", {"description": "?"}),
    ]


def test_a_merge_rewrites_touched_buckets_only(spark, tmp_path):
    folder = str(tmp_path / "entities")
    schema = "id string, name string, state map<string,string>"
    rows = {f"e{i}": f"n{i}" for i in range(50)}
    world_model.write_merged(spark.createDataFrame([(k, v, {"a": v}) for k, v in rows.items()], schema), folder, "id", F.lit(1.0), buckets=8)
    before = {f"{p.parent.name}/{p.name}" for p in tmp_path.glob("entities/bucket=*/*.parquet")}
    delta = [("e3", "later", {"a": "z"}), ("e3", "earlier", {"a": "b"}), ("new", "n", None)]
    world_model.write_merged(spark.createDataFrame(delta, schema), folder, "id", F.lit(2.0), buckets=3)
    stored = {r.id: (r.name, r.updated_at) for r in spark.read.parquet(folder).collect()}
    assert stored == {k: (v, 1.0) for k, v in rows.items()} | {"e3": ("later", 2.0), "new": ("n", 2.0)}
    after = {f"{p.parent.name}/{p.name}" for p in tmp_path.glob("entities/bucket=*/*.parquet")}
    assert 0 < len(before - after) <= 2 and len(list(tmp_path.glob("entities/bucket=*"))) == 8


class Counting:
    """Writes down what it is asked."""

    def __init__(self, path, factor):
        self.path, self.factor = str(path), factor

    def embed(self, texts):
        with open(self.path, "a") as f:
            f.writelines(json.dumps(t) + "\n" for t in texts)
        return [[float(len(t)) * self.factor, 1.0] for t in texts]


def test_vectors_are_kept_by_model_and_text(spark, tmp_path):
    asked = lambda: sorted(json.loads(x) for x in (tmp_path / "asked").read_text().splitlines()) if (tmp_path / "asked").exists() else []
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb"), (4, None), (5, "")], "id int, text string")
    made = lambda df, model, factor: {r.id: list(r.vector) for r in providers.embedded_by_content(df, "text", Counting(tmp_path / "asked", factor), model, str(tmp_path / "cache")).collect()}
    assert made(rows, "m1", 1) == {1: [1.0, 1.0], 2: [1.0, 1.0], 3: [2.0, 1.0], 4: [0.0, 1.0], 5: [0.0, 1.0]}
    assert asked() == ["", "a", "bb"]
    more = rows.unionByName(spark.createDataFrame([(6, "ccc")], "id int, text string"))
    assert made(more, "m1", 9)[6] == [27.0, 1.0] and made(more, "m1", 9)[1] == [1.0, 1.0]
    assert asked() == ["", "a", "bb", "ccc"]
    assert made(rows, "m2", 2)[3] == [4.0, 1.0] and len(asked()) == 7


def test_a_batch_is_written_once_and_a_run_goes_on_where_it_stopped(spark, tmp_path):
    sink, dead, calls = str(tmp_path / "sink"), str(tmp_path / "dead"), []

    def make(rows, number):
        calls.append(number)
        if number == 3 and calls.count(3) < 3:
            raise ValueError("not yet")
        return rows.groupBy("day").agg(F.sum("x").alias("x"))

    table = spark.range(60).select((F.col("id") % 6).cast("int").alias("day"), F.col("id").alias("x"))
    assert state.resumed(table, "day", make, sink, skip=1, limit=2) == [1, 2]
    with pytest.raises(ValueError):
        state.resumed(table, "day", make, sink)
    assert state.resumed(table, "day", make, sink, dead_letters=dead) == [4, 5]
    assert state.resumed(table, "day", make, sink, dead_letters=dead) == [3] and state.resumed(table, "day", make, sink) == []
    got = {r.day: r.x for r in spark.read.parquet(sink).collect()}
    assert got == {d: sum(range(d, 60, 6)) for d in range(6)} and calls.count(0) == 1
    again = state.isolated(lambda b, n: 1 / 0, dead)
    again(table.limit(2), 3)
    again(table.limit(2), 3)
    assert spark.read.parquet(dead).filter("_batch = 3").count() == 2
