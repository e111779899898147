import math
import random

from pyspark.sql import functions as F

from tidemark.operators import batching, deals, facts, graph, history, process, resolve


def test_fold_chains_states(spark):
    rows = [(1, 10, 1, "creation", "a", None), (1, 20, 2, "update", None, "x"), (1, 20, 3, "update", "b", None), (2, 5, 4, "creation", None, None)]
    df = spark.createDataFrame(rows, "entity_id long, us long, ord long, transition_type string, k string, v string")
    got = {r.ord: (r.from_state, r.to_state) for r in history.folded(df, ["k", "v"]).collect()}
    assert got == {1: (None, {"k": "a"}), 2: ({"k": "a"}, {"k": "a", "v": "x"}), 3: ({"k": "a", "v": "x"}, {"k": "b", "v": "x"}), 4: (None, {})}
    last = {r.entity_id: (r.k, r.v) for r in history.state_as_of(df, 20, ["k", "v"]).collect()}
    assert last == {1: ("b", "x"), 2: (None, None)}


def test_matrix_rows_sum_to_one_and_outcomes_do_not_loop(spark):
    rows = [(1, 1, "a", False, None), (1, 2, "b", False, None), (1, 3, "won", True, "won"), (2, 1, "a", True, "lost")]
    df = spark.createDataFrame(rows, "prospect_id long, seq int, stage string, is_last boolean, outcome string")
    got = {(r.from_stage, r.to_stage): r.probability for r in process.transition_matrix(df).collect()}
    assert got == {("a", "b"): 0.5, ("a", "lost"): 0.5, ("b", "won"): 1.0}


def brute_overlaps(rows):
    return {r: sum(1 for o in rows if o is not r and o[2] == r[2] and max(o[3], r[3]) < min(o[4], r[4])) for r in rows}


def test_overlap_counts_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = list({(i % 7, "r", rng.randrange(3), s := rng.randrange(20), s + rng.randrange(6)) for i in range(80)})
    df = spark.createDataFrame(rows, "subject int, role string, object int, start int, end int")
    got = {(r.subject, r.role, r.object, r.start, r.end): r.overlaps for r in facts.overlap_counts(df).collect()}
    assert got == {r: n for r, n in brute_overlaps(rows).items() if r[4] > r[3]}
    capped = facts.capped_overlaps(df, 2).groupBy("a_subject", "a_role", "a_object", "a_start", "a_end").count().collect()
    assert {tuple(r[:5]): r[5] for r in capped} == {r: min(2, n) for r, n in brute_overlaps(rows).items() if n and r[4] > r[3]}


def test_paths_use_an_edge_once_and_decay(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "a", "y"), ("c", "d", "y")], "src string, dst string, type string")
    seeds = spark.createDataFrame([("a", 1.0)], "node string, score double")
    got = graph.scored_paths(edges, seeds, 2, ("x",)).collect()
    used = [frozenset(p) for r in got for p in [r.nodes[-2:]] if len(p) == 2]
    assert len(used) == len(set(used)) == 4
    by = {tuple(r.nodes): r.score for r in got}
    assert math.isclose(by[("a", "b")], 0.8) and math.isclose(by[("a", "c")], 0.24) and math.isclose(by[("a", "b", "c")], 0.64)
    same = {tuple(r.nodes) for r in graph.scored_paths(edges, seeds, 2, same_type=True).collect()}
    assert same == {("a",), ("a", "b"), ("a", "c"), ("a", "b", "c"), ("a", "c", "d")}


def test_components_and_hops(spark):
    edges = spark.createDataFrame([(i, i + 1, "e") for i in range(12)] + [(50, 51, "e"), (60, 60, "e")], "src long, dst long, type string")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(13), 0), 50: 50, 51: 50, 60: 60}
    hops = {r.node: r.hop for r in graph.within_hops(edges, spark.createDataFrame([(5,)], "node long"), 2).collect()}
    assert hops == {5: 0, 4: 1, 6: 1, 3: 2, 7: 2}


def test_cascade_rules_in_order(spark):
    ddl = "mention_id long, hint_id long, string_id long, string_score double, vector_id long, vector_score double, same_type boolean, verified boolean"
    rows = [
        (1, 9, 2, 0.95, 3, 0.9, True, None), (2, None, 2, 0.95, 3, 0.9, True, None), (3, None, 2, 0.5, 3, 0.8, True, None), (4, None, 2, 0.5, 3, 0.8, False, True),
        (5, None, 2, 0.86, 3, 0.72, False, None), (6, None, 2, 0.5, 3, 0.72, False, True), (7, None, 2, 0.5, 3, 0.72, True, None), (8, None, None, None, None, None, None, None),
    ]
    got = {r.mention_id: (r.method, r.matched_id) for r in resolve.cascade(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {1: ("extraction_hint", 9), 2: ("string", 2), 3: ("embedding", 3), 4: ("llm_cross_type", 3), 5: ("embedding+string", 3), 6: ("llm", 3), 7: ("", None), 8: ("", None)}


def test_fuzzy_blocks_lose_no_match(spark):
    from difflib import SequenceMatcher

    rng = random.Random(1)
    base = ["large steel gizmo", "cold copper rod", "tiny brass valve", "grand oak table", "plain glass bowl"]
    names = base + ["".join(c for c in b if rng.random() > 0.06) for b in base * 4]
    df = spark.createDataFrame([(i, n, "part") for i, n in enumerate(names)], "entity_id long, name string, type string")
    got = {(r.a, r.b) for r in resolve.duplicate_pairs(df, 0.85).collect()}
    score = lambda a, b: max(SequenceMatcher(None, a, b).ratio(), 0.9 if a in b or b in a else 0)
    heads = {}
    for i, n in enumerate(names):
        heads.setdefault(n.strip(), i)
    want = {(i, j) for x, i in heads.items() for y, j in heads.items() if i < j and score(x, y) >= 0.85}
    want |= {(heads[n.strip()], i) for i, n in enumerate(names) if heads[n.strip()] != i}  # an equal name goes to its first
    assert want and got == want


def greedy(rows, limit):
    out, held, sub = [], 0, 1
    total = sum(c for _, c in rows)
    for k, c in rows:
        if total <= limit:
            out.append((k, "d"))
            continue
        if held and held + c > limit:
            held, sub = 0, sub + 1
        held += c
        out.append((k, f"d-{sub}"))
    return out


def test_daily_batches_are_greedy(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(1, 60)) for i in range(40)]
    for limit in (100, 10_000):
        df = spark.createDataFrame([(k, "d", k, c) for k, c in rows], "id long, day string, at long, chars long")
        assert sorted((r.id, r.batch) for r in batching.daily_batches(df, "id", "day", "at", "chars", limit).collect()) == greedy(rows, limit)


def test_chunks_cover_the_text():
    text = "One sentence here. " * 900
    cuts = batching.sentence_cuts(text, 1000, 100)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(b[0] == a[1] - 100 for a, b in zip(cuts, cuts[1:])) and all(e - s <= 1000 for s, e in cuts)
    assert all(text[e - 1] == "." for _, e in cuts[:-1]) and batching.sentence_cuts("short") == [(0, 5)]


def test_uncertainties(spark):
    ddl = "id string, stakeholders array<struct<name:string,influence:string,sentiment:string>>, buying_signals array<struct<type:string>>, objections array<struct<description:string,severity:string>>"
    rows = [("p1", [("Ann", "decision_maker", "unknown")], [("budget",)], [("legal", "hard_blocker")]), ("p2", None, None, None)]
    got = {(r.id, r.reference, r.impact) for r in deals.uncertainties(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {("p1", "Timeline", "high"), ("p1", "legal", "high"), ("p1", "Ann", "medium"), ("p2", "Decision maker", "high"), ("p2", "Budget", "high"), ("p2", "Timeline", "high")}


def test_as_of_join(spark):
    a = spark.createDataFrame([(1, 10, "x"), (1, 5, "y"), (2, 1, "z")], "key long, t long, tag string")
    b = spark.createDataFrame([(1, 5, 1, 100), (1, 7, 2, 200), (1, 11, 3, 300)], "key long, at long, o long, v long")
    got = {(r.tag, r.v) for r in history.as_of_join(a, b, "key", "t", "at", "o", ["v"]).collect()}
    assert got == {("x", 200), ("y", 100), ("z", None)}
    assert F.lit(1) is not None
