"""Leaders of batches, interval joins on a grid, feedback memory: against plain loops."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.operators import facts, memory, resolve

CHAIN = ["ggaehgehfdcecb", "ggaxhgehfdcecb", "ggaxhgehfyzecb"]


def normal(x):
    return x.lower().strip().replace("-", " ").replace("_", " ")


def score(new, known):
    s = SequenceMatcher(None, new, known).ratio()
    return max(s, 0.9) if new and known and (new in known or known in new) else s


def resolved(rows, least=0.85):
    """mention_id -> representative, one mention after the other: rows are (id, batch, type, name)."""
    leaders, out = {}, {}
    for i, batch, kind, name in sorted(rows):
        n = normal(name)
        own = leaders.setdefault((batch, kind), [])
        for j, known in own if n else []:
            if score(n, known) >= least:
                out[i] = j
                break
        else:
            out[i] = i
            if n:
                own.append((i, n))
    return out


def misspelt(n, seed):
    rng, out = random.Random(seed), []
    for _ in range(n):
        w = list(rng.choice(["project atlas", "Northwind-Trading", "ann marie", "green_tea", "a", "x7"]))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice("abxz -_")
        out.append("".join(w))
    return out


def test_a_chain_does_not_merge_through_its_middle(spark):
    rows = [(i, "p", n) for i, n in enumerate(CHAIN)]
    got = {r.mention_id: r.representative for r in resolve.in_batch(spark.createDataFrame(rows, "mention_id long, type string, mention string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_batches_equal_a_loop_over_mentions(spark):
    names = misspelt(120, 1) + ["", "  ", "-"] + ["same name"] * 5 + CHAIN
    rows = [(i, i % 3, "pq"[i % 2], n) for i, n in enumerate(names)]
    got = resolve.in_batch(spark.createDataFrame(rows, "mention_id long, batch int, type string, mention string"))
    assert {r.mention_id: r.representative for r in got.collect()} == resolved(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_first_leaders_of_any_graph(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(100 + i, 101 + i) for i in range(9)] + [(7, 7)]
    near = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    want, leaders = {}, []
    for n in sorted({x for e in near for x in e}):
        want[n] = next((m for m in leaders if (m, n) in near), n)
        if want[n] == n:
            leaders.append(n)
    assert {r.node: r.leader for r in resolve.first_leaders(spark.createDataFrame(edges, "a int, b int")).collect()} == want
    assert resolve.first_leaders(spark.createDataFrame([], "a int, b int")).collect() == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_leaders_on_a_line_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("pq"), rng.choice([rng.uniform(-50, 200), float(rng.randrange(-10, 30) * 5)])) for i in rng.sample(range(1000), 300)]
    rows += [(2000, "p", None), (2001, "q", float("nan")), (2002, "q", float("nan")), (2003, "p", float("inf")), (2004, "r", 7.0)]
    leaders, want = {}, {}
    for i, g, x in sorted(rows):
        own = leaders.setdefault(g, [])
        want[i] = next((j for j, y in own if x is not None and y is not None and abs(x - y) < 10), i)
        if want[i] == i:
            own.append((i, x))
    rows += [(3000, None, 1.0), (3001, None, 1.0)]
    want |= {3000: 3000, 3001: 3001}
    got = resolve.line_leaders(spark.createDataFrame(rows, "id int, g string, value double"), ["g"], 10).collect()
    assert {r.id: r.leader for r in got} == want and len(got) == len(rows)
    empty = spark.createDataFrame([], "id int, g string, value double")
    assert resolve.line_leaders(empty, ["g"], 10).collect() == []


def test_names_with_one_beginning_meet_by_their_rare_part(spark):
    n = 3000
    heads = spark.range(n).select(F.lit("p").alias("type"), F.format_string("customer#%09d", "id").alias("normal"))
    _, parts, longest = resolve._keys(1.0)
    x, y = heads.select("type", F.col("normal").alias("na")), heads.select("type", F.col("normal").alias("nb"))
    on = ["type", "key"]
    pieces = y.withColumn("key", F.explode(parts("nb")))
    rarest = x.withColumn("key", F.explode(longest("na"))).join(pieces.groupBy(*on).agg(F.count(F.lit(1)).alias("n")), on).groupBy("na").agg(F.min("n").alias("n"))
    assert rarest.agg(F.sum("n")).first()[0] < 12 * n
    got = resolve._contained(x, y, "na", "nb", parts, longest, ("type",))
    assert got.count() == n and got.filter("na <> nb").isEmpty()


# -- intervals ------------------------------------------------------------------------------


def intervals(seed, n=150, objects=4):
    rng = random.Random(seed)
    rows = [(f"s{rng.randrange(9)}", rng.choice("rq"), rng.randrange(objects), s := rng.randrange(-6, 30), s + rng.choice([0, 1, 2, 3, 9, 40])) for _ in range(n)]
    return rows + rows[:5]


SCHEMA = "subject string, role string, object int, start int, end int"


def ordered(r):
    return (r[3], r[4], r[0], r[1])


def meet(a, b):
    return a[2] == b[2] and max(a[3], b[3]) < min(a[4], b[4]) and ordered(a) != ordered(b)


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_pairs_on_a_grid_equal_all_pairs(spark, width):
    rows = intervals(width)
    want = sorted((a, b) for a in rows for b in rows if meet(a, b) and ordered(a) < ordered(b))
    got = facts.overlapping(spark.createDataFrame(rows, SCHEMA), width=width).collect()
    side = lambda r, p: (r[f"{p}_subject"], r[f"{p}_role"], r[f"{p}_object"], r[f"{p}_start"], r[f"{p}_end"])
    assert sorted((side(r, "a"), side(r, "b")) for r in got) == want


@pytest.mark.parametrize("k,width", [(1, 4), (3, 2), (3, 1000), (50, 5)])
def test_capped_overlaps_are_the_first_of_all(spark, k, width):
    rows = sorted(set(intervals(k + width)))
    want = {}
    for a in rows:
        others = sorted((b for b in rows if meet(a, b)), key=ordered)[:k]
        if others and a[3] < a[4]:
            want[a] = others
    got = {}
    for r in sorted(facts.capped_overlaps(spark.createDataFrame(rows + rows[:9], SCHEMA), k, width).collect(), key=lambda r: r["rank"]):
        got.setdefault((r.a_subject, r.a_role, r.a_object, r.a_start, r.a_end), []).append((r.b_subject, r.b_role, r.b_object, r.b_start, r.b_end))
    assert got == want


def test_a_hot_object_is_spread_and_makes_no_pairs_beyond_the_cap(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("subject"), F.lit("r").alias("role"), F.lit(1).alias("object"), (F.col("id") % 100).cast("int").alias("start"), (F.col("id") % 100 + 60).cast("int").alias("end"))
    assert facts.capped_overlaps(df, 3).groupBy("a_subject").count().filter("count = 3").count() == 4000


@pytest.mark.parametrize("hot", [10, 40, 10**6])
@pytest.mark.parametrize("k,width", [(1, 4), (3, 2), (50, 5)])
def test_hot_and_other_objects_have_the_same_overlaps(spark, monkeypatch, hot, k, width):
    monkeypatch.setattr(facts, "HOT_FACTS", hot)
    rows = intervals(k + width) + [("s", "r", 9, 5 * i, 5 * i + 7) for i in range(8)]
    df = spark.createDataFrame(rows + rows[:9], SCHEMA)
    got = sorted((r["rank"], *((r[f"{p}_subject"], r[f"{p}_role"], r[f"{p}_object"], r[f"{p}_start"], r[f"{p}_end"]) for p in "ab")) for r in facts.capped_overlaps(df, k, width).collect())
    assert got == sorted((i, a, b) for a in set(rows) if a[3] < a[4] for i, b in enumerate(sorted({b for b in rows if meet(a, b)}, key=ordered)[:k], 1))


def test_an_object_of_ordinary_size_is_swept_without_a_shuffle_of_pairs(spark):
    df = facts.capped_overlaps(spark.createDataFrame(intervals(1), SCHEMA), 3)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


@pytest.mark.parametrize("hot,batch", [(10, 10000), (40, 3), (10**6, 1), (10**6, 7)])
def test_hot_and_other_objects_have_the_same_counts(spark, monkeypatch, hot, batch):
    monkeypatch.setattr(facts, "HOT_FACTS", hot)
    rows = intervals(8) + [("s", "r", 9 + i // 8, 5 * i, 5 * i + 7) for i in range(40)]
    want = sorted((*r, sum(o[2] == r[2] and max(o[3], r[3]) < min(o[4], r[4]) for o in rows) - 1) for r in rows if r[3] < r[4])
    df = spark.createDataFrame(rows + [("s", "r", None, 1, 2)], SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for kind in ("int", "double", "decimal(9,2)"):
            some = df.withColumn("start", F.col("start").cast(kind)).withColumn("end", F.col("end").cast(kind))
            got = facts.overlap_counts(some)
            assert sorted((r.subject, r.role, r.object, int(r.start), int(r.end), r.overlaps) for r in got.collect()) == want
            if hot > len(rows) and kind == "int":
                assert facts.overlap_counts(some)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_held_counts_are_those_of_the_rows(spark):
    df = spark.createDataFrame(intervals(3) + [("s1", "z", None, 1, 5), ("s1", None, 2, 1, 5), ("s2", "y", 1, 900, 901)], SCHEMA)
    want = facts.holding_in(df, (3, 12, 20)).groupBy("year", "role").agg(F.count(F.lit(1)).alias("n_facts"), F.count_distinct("object").alias("n_objects"))
    got = facts.held_counts(df, (20, 3, 12, 3))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Exchange ")  # facts are not made a row for each year
    assert got.schema.simpleString() == want.schema.simpleString() and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("years", [(), (7,), (3, 12, 20)])
def test_first_sentences_are_those_of_all(spark, years):
    rows = intervals(5) + [("s1", "r", 1, 9, 10), ("s1", "r", 1, 100, 1000), ("s1", "r", 1, -3, 19), (None, "r", 1, 1, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = facts.derived_sentences(df, years).groupBy("subject", "role", "object", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("sentence").alias("sentence"))
    got = facts.first_sentences(df, years)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and plan.index("Generate") < plan.index("Exchange ")
    by = lambda df: sorted(map(str, df.collect()))
    assert got.columns == want.columns and by(got) == by(want)


# -- feedback -------------------------------------------------------------------------------


def looped(entities, corrections):
    """(name, at, i, type, state) in order of conversations: entities of one first, then its corrections."""
    known, out = {}, []
    for at in sorted({r[0] for r in entities} | {r[0] for r in corrections}):
        for _, i, name, info in sorted(e for e in entities if e[0] == at):
            n = normal(name)
            if n:
                out.append((n, at, i, "update" if n in known else "creation", {"description": info}))
                known.setdefault(n, (at, i))
        for _, i, what, right, wrong in sorted(c for c in corrections if c[0] == at):
            w = normal(what)
            best = max(((s, (-b[0], -b[1]), n) for n, b in known.items() if w and (s := score(w, n)) >= 0.7), default=None)
            if best:
                out.append((best[2], at, i, "contradiction", {"corrected": right, "was_wrong": wrong}))
    return sorted(out, key=str)


def test_corrections_meet_the_best_name_known_by_then(spark):
    names = misspelt(60, 4)
    entities = [(i // 3, i % 3, n, f"info {i}") for i, n in enumerate(names)]
    corrections = [(i % 25, 10 + i, n, f"right {i}", f"wrong {i}") for i, n in enumerate(misspelt(60, 5) + ["nothing like it", "", "-"])]
    e = spark.createDataFrame(entities, "at int, i int, name string, info string").select("at", "i", "name", F.create_map(F.lit("description"), "info").alias("state"))
    c = spark.createDataFrame(corrections, "at int, i int, what string, right string, wrong string")
    got = sorted(((r.name, r["at"], r.i, r.transition_type, dict(r.state)) for r in memory.remembered(e, c).collect()), key=str)
    assert got == looped(entities, corrections)
    assert sum(r[3] == "contradiction" for r in got) > 20


def test_the_feedback_query_equals_the_loop(spark):
    from tidemark.plans import catalogue

    sf = "/root/testdata/sf0.001"
    turns = [r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect() if r.text is not None]
    entities = [(r.conv_id, r.turn, r.text.split(" ")[0], "") for r in turns if r.role == "user"]
    corrections = {(r.conv_id, r.turn): (r.conv_id, r.turn, r.text.split(" ")[0], "", "") for r in turns if r.role == "assistant"}
    got = sorted((r.name, r["at"], r.i, r.transition_type) for r in catalogue.QUERIES["feedback_memory"](spark, sf).collect())
    assert got == sorted(r[:4] for r in looped(entities, corrections.values()))
    assert any(r[3] == "contradiction" for r in got)


@pytest.mark.parametrize("least,block,share", [(0.7, 7, 1000), (0.3, 1000, 1000), (0.85, 16, 25)])
def test_improving_names_are_those_that_beat_all_before(spark, least, block, share):
    asked = sorted({normal(x) for x in misspelt(60, 21)} | {"", "é", "a" * 300, "naïve été"})
    names = [*dict.fromkeys(normal(x) for x in misspelt(90, 22) + ["été naïve", "a" * 299 + "b", "e", "at"] if normal(x))]
    a = spark.createDataFrame([(n,) for n in asked + asked[:5]], "normal string")
    b = spark.createDataFrame([(n, i // 2) for i, n in enumerate(names)], "normal string, born int")
    got = resolve.improving_names(a.filter("normal <> ''"), b, "born", least, block, share).collect()
    assert all(r.score == score(r.na, r.nb) >= least for r in got)
    order = sorted((i // 2, n) for i, n in enumerate(names))
    for na in filter(None, asked):
        for until in (4, len(names)):
            want = min(((-s, i, n) for i, n in order if i < until and (s := score(na, n)) >= least), default=None)
            assert min(((-r.score, r.born, r.nb) for r in got if r.na == na and r.born < until), default=None) == want
    if share >= len(names):
        best, want = {}, set()
        for na in filter(None, asked):
            for i, n in order:
                if (s := score(na, n)) >= least and s > best.get(na, 0):
                    best[na] = s
                    want.add((na, n))
        assert {(r.na, r.nb) for r in got} == want and len(got) == len(want)


def test_the_ablation_counts_what_names_would_merge(spark):
    names = misspelt(60, 11) + ["same name"] * 3 + [""]
    rows = [(i, "pq"[i % 2], n, ["x", "y"][: i % 3], i % 4 == 0 or None) for i, n in enumerate(names)]
    root = {i: i for i, *_ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, ti, a, *_ in rows:
        for j, tj, b, *_ in rows[:i]:
            if ti == tj and normal(a) and normal(b) and score(normal(b), normal(a)) >= 0.85:
                root[max(find(i), find(j))] = min(find(i), find(j))
    duplicates, n, aliases = sum(find(i) != i for i in root), len(rows), sum(i % 3 for i in root)
    got = resolve.ablation(spark.createDataFrame(rows, "entity_id int, type string, name string, aliases array<string>, web_verified boolean")).first()
    aliased = sum(i % 3 > 0 for i in root)
    assert tuple(got) == (n, n + aliases, duplicates, n - duplicates, (2 * n - duplicates) // 2, duplicates / n, aliased, aliases, aliases / aliased, sum(i % 4 == 0 for i in root) / n)
    assert duplicates > 10
    empty = resolve.ablation(spark.createDataFrame([], "entity_id int, type string, name string, aliases array<string>, web_verified boolean")).first()
    assert empty.entities == empty.duplicates == empty.duplication_rate == 0


def test_gold_alternatives_and_entity_texts(spark):
    from tidemark.functions import scores
    from tidemark.operators.compile import entity_text

    rows = [("yes", '{"score": 0.8}'), ("  ", '{"score": 0.8}'), (None, '{"score": 1}'), ("no", "broken")]
    df = spark.createDataFrame(rows, "h string, a string")
    assert [r[0] for r in df.select(scores.judged_answer(F.col("h"), F.col("a"))).collect()] == [1.0, 0.0, 0.0, 0.0]
    assert spark.range(1).select(scores.gold_text(F.array(F.lit("a"), F.lit("b")))).first()[0] == "a | b"
    states = [({"description": "d", "x": "1"},), ({"description": "", "b": "2", "a": "1", "_is_event": "true", "c": ""},), (None,), ({},), ({"description": "z" * 900},)]
    texts = [r[0] for r in spark.createDataFrame(states, "s map<string,string>").select(entity_text(F.lit("Ann"), F.lit("person"), F.col("s"))).collect()]
    assert texts == ["Ann (person): d", "Ann (person): a: 1; b: 2", "Ann (person): ", "Ann (person): ", ("Ann (person): " + "z" * 900)[:500]]


def test_shortest_prompts_under_a_budget(spark):
    from tidemark.operators import scoring

    rows = [(i, "ab"[i % 2], "p" * (i % 7), "q" * (i % 5)) for i in range(40)]
    got = scoring.shortest_first(spark.createDataFrame(rows, "id int, kind string, prompt string, question string"), "kind", "prompt", "id", 4, "question", 6)
    for kind in "ab":
        want = sorted((len(p), i) for i, k, p, q in rows if k == kind and len(p + chr(10) + q) < 6)[:4]
        assert [r.id for r in got.filter(F.col("kind") == kind).orderBy("position").collect()] == [i for _, i in want]
