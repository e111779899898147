"""Operators that SQL cannot say, against plain loops over all pairs or rows."""

import random
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions.text import normalize_name
from tidemark.operators import compile as narrate
from tidemark.operators import graph, resolve, retrieve
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = ["AI", "OpenAI", "Smith", "smyth", "abxcd", "abycd", "ab cd ef gh", "abcdefgh", "it", "itx", "art", "partner", "postgres", "PostgreSQL", "x", "", "-", "é", "Éclair", "a_b-c", "a b c"]


def score(a, b):
    r = SequenceMatcher(None, a, b).ratio()
    return max(r, 0.9) if a and b and (a in b or b in a) else r


def random_names(n, seed=0, letters="abcde "):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 14)))
        out.append(w)
        v = list(w)
        for _ in range(rng.randrange(3)):
            v[rng.randrange(len(v)) : rng.randrange(len(v)) + 1] = rng.choice(letters)
        out.append("".join(v))
    return out


def normal(spark, names):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "i long, x string")
    return {r.i: r.n for r in df.select("i", normalize_name("x").alias("n")).collect()}


@pytest.mark.parametrize("threshold", [0.95, 0.85, 0.8, 0.6, 0.3])
def test_fuzzy_pairs_equal_all_pairs(spark, threshold):
    names = NAMES + random_names(60, 1) + ["the quick brown fox jumps", "the quack brown fox jump", "quick the brown fox jumps"]
    df = spark.createDataFrame([(i, x, None) for i, x in enumerate(names)], "entity_id long, name string, aliases array<string>")
    asked = df.selectExpr("entity_id AS mention_id", "name AS mention")
    n = normal(spark, names)
    want = {(i, j): s for i in n for j in n if n[i] and n[j] and (s := score(n[i], n[j])) >= threshold}
    got = {(r.mention_id, r.entity_id): r.score for r in resolve.fuzzy_matches(asked, df, threshold).collect()}
    assert got == want


@settings(max_examples=2000, deadline=None)
@given(st.text("abc z", min_size=1, max_size=12), st.text("abc z", min_size=1, max_size=12), st.sampled_from([0.3, 0.6, 0.7, 0.8, 0.85, 0.9, 1.0]))
def test_names_that_match_share_a_key(a, b, threshold):
    if SequenceMatcher(None, a, b).ratio() >= threshold:
        assert set(resolve.near_keys(a, threshold)) & set(resolve.near_keys(b, threshold))


def test_containment_equals_all_pairs(spark):
    names = list(dict.fromkeys(NAMES + random_names(40, 2)))
    n = normal(spark, names)
    want = {(min(names[i], names[j]), max(names[i], names[j])) for i in n for j in n if i != j and n[i] and n[j] and n[i] in n[j]}
    got = {(r.a, r.b) for r in resolve.containment_pairs(spark.createDataFrame([(x,) for x in names], "name string")).collect()}
    assert got == want


def clusters(pairs):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_duplicates_and_batches(spark):
    names = NAMES + random_names(30, 3) + ["same name"] * 4
    rows = [(i, "p" if i % 3 else "q", x) for i, x in enumerate(names)]
    n = normal(spark, names)
    want, leaders = {}, {}
    for i, kind, _ in rows:  # one mention after the other, against the representatives before it
        near = [j for j in leaders.setdefault(kind, []) if n[i] and score(n[i], n[j]) >= 0.85]
        want[i] = near[0] if near else i
        leaders[kind] += [] if near or not n[i] else [i]
    df = spark.createDataFrame(rows, "mention_id long, type string, mention string")
    got = {r.mention_id: r.representative for r in resolve.in_batch(df, 0.85).collect()}
    assert got == want


def test_fuzzy_query_and_clusters_equal_all_pairs(spark):
    part = duckdb.sql(f"select p_name, min(p_partkey) from read_parquet('{SF}/part.parquet') group by 1").fetchall()
    n = dict(zip((i for _, i in part), normal(spark, [x for x, _ in part]).values()))
    pairs = {(i, j): round(s, 9) for i in n for j in n if i < j and (s := score(n[i], n[j])) >= 0.8}
    assert {(r.a, r.b): r.score for r in catalogue.QUERIES["fuzzy_match"](spark, SF).collect()} == pairs
    labels = clusters(pairs)
    sizes = {c: sum(1 for x in labels.values() if x == c) for c in labels.values()}
    assert {r.cluster: r["size"] for r in catalogue.QUERIES["duplicate_clusters"](spark, SF).collect()} == sizes


def test_name_topk_equals_all_pairs(spark):
    names = random_names(15, 5)
    df = spark.createDataFrame([(i, x, None) for i, x in enumerate(names)], "entity_id long, name string, aliases array<string>")
    n = normal(spark, names)
    got = {}
    for r in resolve.name_topk(df.selectExpr("entity_id AS mention_id", "name AS mention"), df, 3).collect():
        got.setdefault(r.mention_id, []).append((r.rank, r.entity_id))
    for i in n:
        best = sorted(((-score(n[i], n[j]), j) for j in n if n[i] and n[j] and score(n[i], n[j]) > 0.3))[:3]
        assert [j for _, j in sorted(got.get(i, []))] == [j for _, j in best]


def test_components_of_all_edges_equal_union_find(spark):
    rows = duckdb.sql(f"select 2 * l_partkey, 2 * l_suppkey + 1 from read_parquet('{SF}/lineitem.parquet')").fetchall()
    got = {r.node: r.component for r in catalogue.QUERIES["connected_components"](spark, SF).collect()}
    assert got == clusters(rows)


@pytest.mark.parametrize("block", [3, 4096])
@pytest.mark.parametrize("same_type", [False, True])
def test_nearest_equals_all_pairs(spark, block, same_type):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(40, 5)).round(1)
    vectors[7] = 0
    vectors[9] = vectors[8]
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(vectors)], "id long, vector array<double>, type int")
    got = {}
    for r in retrieve.nearest(df.filter("id % 4 = 0"), df, 4, same_type, block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.item_id, r.similarity))
    length = np.sqrt((vectors**2).sum(axis=1))
    for q in range(0, 40, 4):
        near = []
        for j in range(40):
            if j != q and (not same_type or j % 3 == q % 3):
                scale = length[q] * length[j]
                near.append((-round(float(vectors[q] @ vectors[j]) / scale, 9) if scale else 0.0, j))
        assert [(k + 1, j) for k, (_, j) in enumerate(sorted(near)[:4])] == [(k, j) for k, j, _ in sorted(got[q])]


def test_a_chain_of_150_holders_is_whole(spark):
    df = spark.createDataFrame([(i, "r", 1, 1000 + i, 1001 + i) for i in range(150)], "subject int, role string, object int, start int, end int")
    assert narrate.succession_chains(df).first().chain == " → ".join(map(str, range(150)))


def test_paths_are_not_cut_unless_asked(spark):
    edges = spark.createDataFrame([("hub", f"n{i:03d}", "t") for i in range(120)], "src string, dst string, type string")
    seeds = spark.createDataFrame([("hub", 1.0)], "node string, score double")
    assert graph.scored_paths(edges, seeds, 2).count() == 121
    assert graph.scored_paths(edges, seeds, 2, max_paths=50).count() == 50
    names = spark.createDataFrame([("hub", "Hub"), ("n000", "Zero")], "node string, name string")
    texts = {r.text for r in graph.described(graph.scored_paths(edges, seeds, 1), names).collect()}
    assert {"Hub", "Hub --[t]--> Zero", "Hub --[t]--> n001"} <= texts
