"""Seeds and traversals of many queries in one plan equal a loop over queries."""

import random

import numpy as np
import pytest

from tests.core.test_leaders import misspelt, normal, score
from tidemark.operators import subgraph


def graph_of(seed, nodes=40, n=140):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}", rng.choice("xyz")) for _ in range(n)]
    return edges + [("n0", f"n{i}", "x") for i in range(nodes)]  # a hub


def looped(edges, seeds, pattern, wanted, hops, most):
    paths = sorted(((-s, [n], []) for n, s in seeds), key=lambda p: (p[0], p[1], p[2]))[:most]
    paths, frontier, used = [(s, n, t, 0) for s, n, t in paths], list(paths), set()
    for h in range(1, hops + 1) if pattern != "direct" else []:
        grown = {}
        for s, nodes, types, *_ in frontier:
            here = nodes[-1]
            for a, b, kind in edges:
                for x, y in ((a, b), (b, a)):
                    edge = (min(a, b), max(a, b))
                    if x != here or edge in used or (pattern == "transitive" and types and types[-1] != kind):
                        continue
                    new = (s * 0.8 * (1.0 if not wanted or kind in wanted else 0.3), nodes + [y], types + [kind])
                    if edge not in grown or new < grown[edge]:
                        grown[edge] = new
        step = sorted(grown.values())[: most - len(paths)]
        used |= {(min(n[-2:]), max(n[-2:])) for _, n, _ in step}
        frontier = step
        paths += [(s, n, t, h) for s, n, t in step]
    return sorted((n, t, round(-s, 9), h) for s, n, t, h in paths)


def test_fifty_queries_equal_a_loop(spark):
    rng, edges = random.Random(2), graph_of(1)
    queries = [(i, ["direct", "transitive", "neighborhood", None][i % 4], [[], ["x"], ["y", "z"], None][i // 4 % 4]) for i in range(50)]
    seeds = [(i, f"n{n}", 1.0 - 0.1 * j) for i, *_ in queries for j, n in enumerate(rng.sample(range(40), i % 4))]
    frames = (
        spark.createDataFrame(edges, "src string, dst string, type string"), spark.createDataFrame(seeds, "query_id int, node string, score double"),
        spark.createDataFrame(queries, "query_id int, pattern string, wanted array<string>"),
    )
    for most in (20, None):
        got = {}
        for r in subgraph.explored(*frames, hops=2, max_paths=most).collect():
            got.setdefault(r.query_id, []).append((r.nodes, r.types, round(r.score, 9), r.hop))
        want = {i: looped(edges, [(n, s) for q, n, s in seeds if q == i], p or "direct", w, 2, most or 10**9) for i, p, w in queries}
        assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in want.items() if v}


@pytest.mark.parametrize("most", [3, 6])
def test_a_hub_adds_only_the_neighbours_that_can_count(spark, most):
    rng = random.Random(most)
    edges = [(f"n{i % 30}", "hub", "xy"[i % 2]) for i in range(90)] + [("hub", f"n{i}", "z") for i in range(9)] + graph_of(most, 12, 40) + [("hub", "hub", "x")]
    queries = [(i, ["transitive", "neighborhood"][i % 2], [[], ["x"]][i // 2 % 2]) for i in range(12)]
    seeds = [(i, f"n{rng.randrange(12)}", 1.0) for i, *_ in queries] + [(i, "hub", 0.9) for i, *_ in queries if i % 3 == 0]
    e, s = spark.createDataFrame(edges, "src string, dst string, type string"), spark.createDataFrame(seeds, "query_id int, node string, score double")
    got = {}
    for r in subgraph.explored(e, s, spark.createDataFrame(queries, "query_id int, pattern string, wanted array<string>"), hops=3, max_paths=most).collect():
        got.setdefault(r.query_id, []).append((r.nodes, r.types, round(r.score, 9), r.hop))
    assert {i: sorted(v) for i, v in got.items()} == {i: looped(edges, [(n, x) for q, n, x in seeds if q == i], p, w, 3, most) for i, p, w in queries}
    sides = subgraph.first_neighbours(subgraph.both_ways(e), s.filter("node = 'hub'"), most).collect()
    assert sorted((r.type, r.other) for r in sides) == sorted((t, o) for t in "xyz" for o in sorted({b for a, b, k in edges + [(y, x, k) for x, y, k in edges] if a == "hub" and k == t})[:most])


def test_retrieved_nodes_have_their_best_path_and_source(spark):
    paths = spark.createDataFrame([(1, ["a"], 1.0), (1, ["a", "b"], 0.8), (1, ["a", "b", "c"], 0.2), (2, ["c"], 0.5)], "query_id int, nodes array<string>, score double")
    names = spark.createDataFrame([("a", "Ann")], "node string, name string")
    got = sorted((r.query_id, r.node, r.score, r.source, r["rank"], r.name) for r in subgraph.retrieved(paths, 2, names).collect())
    assert got == [(1, "a", 1.0, "seed", 1, "Ann"), (1, "b", 0.8, "hop_1", 2, None), (2, "c", 0.5, "seed", 1, None)]


def test_range_join_of_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 8)) + 1
    items = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, 2.0]), (904, [None] * 8)]
    queries = [(f"q{i}", (v + 0.1).tolist()) for i, v in enumerate(vectors[:40])] + [("null", None), ("zero", [0.0] * 8)]
    schema = "id {}, vector array<double>".format
    hits = subgraph.within(spark.createDataFrame(queries, schema("string")), spark.createDataFrame(items, schema("long")), 0.7, block=7, share_rows=64).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    asked = (vectors[:40] + 0.1) / np.linalg.norm(vectors[:40] + 0.1, axis=1, keepdims=True)
    near = np.round(asked @ unit.T, 9)
    assert {(r.query_id, r.item_id) for r in hits} == {(f"q{i}", j) for i, j in zip(*np.nonzero(near >= 0.7))}


def test_seeds_fall_back_by_query(spark):
    rng = random.Random(8)
    names = sorted(set(misspelt(50, 6)))
    entities = [(i, n, [], rng.choice("pqr"), round(rng.random(), 3)) for i, n in enumerate(names)]
    queries = [(q, [None, [], ["p"], ["p", "q", "p"]][q % 4]) for q in range(16)]
    mentions = [(q, j, rng.choice(names + misspelt(20, 7))) for q, _ in queries for j in range(q % 3)]
    hits = [(q, i, round(0.7 + 0.3 * rng.random(), 4)) for q, _ in queries for i in rng.sample(range(len(names)), q % 5)]
    e = spark.createDataFrame(entities, "entity_id int, name string, aliases array<string>, type string, importance double")
    named = subgraph.named_seeds(spark.createDataFrame(mentions, "query_id int, position int, mention string"), e)
    got = {}
    for r in subgraph.with_fallbacks(spark.createDataFrame(queries, "query_id int, types array<string>"), named, spark.createDataFrame(hits, "query_id int, item_id int, similarity double"), e).collect():
        got.setdefault(r.query_id, []).append((r.entity_id, round(r.score, 9), r.source))
    for q, types in queries:
        seeds = {}
        for _, _, mention in sorted(m for m in mentions if m[0] == q):
            m = normal(mention)
            exact = [i for i, n, *_ in entities if normal(n) == m and m]
            if exact:
                seeds[min(exact)] = (1.0, "named")
                continue
            for s, i in sorted(((-score(m, normal(n)), i) for i, n, *_ in entities if m and normal(n) and score(m, normal(n)) >= 0.8))[:2]:
                seeds.setdefault(i, (-s * 0.95, "named_fuzzy"))
        for _, i, s in [h for h in hits if h[0] == q]:
            if not types or entities[i][3] in types:
                seeds.setdefault(i, (s, "embedding"))
        if types and len(seeds) < 5:
            for kind in dict.fromkeys(types):
                for i in [x[0] for x in sorted((e for e in entities if e[3] == kind), key=lambda e: (-e[4], e[0]))[:10]]:
                    seeds.setdefault(i, (entities[i][4] * 0.5, "type_match"))
        want = sorted(((i, round(s, 9), src) for i, (s, src) in seeds.items()), key=lambda x: (-x[1], x[0]))[:10]
        assert sorted(got.get(q, []), key=lambda x: (-x[1], x[0])) == want


def test_seeds_do_not_send_entities_through_the_driver(spark):
    queries = spark.createDataFrame([(i, ["p"]) for i in range(9)], "query_id int, types array<string>")
    entities = spark.createDataFrame([(i, "p", i / 9) for i in range(9)], "entity_id int, type string, importance double")
    named = spark.createDataFrame([(i, i, 1.0, "named") for i in range(9)], "query_id int, entity_id int, score double, source string")
    hits = spark.createDataFrame([(i, 8 - i, 0.9) for i in range(9)], "query_id int, item_id int, similarity double")
    out = subgraph.with_fallbacks(queries, named, hits, entities)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("SortMergeJoin") >= 2
