from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tidemark import providers
from tidemark.functions import json_text, scores, text, times, vectors


def values(spark, column, rows, ddl):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(column).collect()]


def test_names_and_ratio(spark):
    assert values(spark, text.normalize_name(F.col("n")), [("  A-b_C ",), ("x",)], "n string") == ["a b c", "x"]
    pairs = [("Large Gizmo", "large gizmos"), ("a", ""), ("abc", "xyz"), ("Gizmo", "Large Gizmo")]
    got = values(spark, text.match_score(F.col("a"), F.col("b")), pairs, "a string, b string")
    for (a, b), x in zip(pairs, got):
        r = SequenceMatcher(None, a.lower(), b.lower()).ratio()
        assert x == (max(r, 0.9) if b and (a.lower() in b.lower() or b.lower() in a.lower()) else r)


def test_answers(spark):
    rows = [('{"answer": "Paris"}', "paris"), ("Answer: Paris.", "Paris"), ('{"answer": 4, "x"', "4"), ("a,b", "a, b"), ("b, a", "a, b"), ("'Rome'", "Rome"), ("x", "y")]
    assert values(spark, text.answers_match(F.col("p"), F.col("g")), rows, "p string, g string") == [True, True, True, True, False, True, False]


def test_json(spark):
    rows = [('{"a": 1}',), ('x ```json\n{"a": 1}\n``` y',), ('say {"a": 1} ok',), ("none",)]
    assert values(spark, json_text.json_body(F.col("t")), rows, "t string") == ['{"a": 1}', '{"a": 1}', '{"a": 1}', None]
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c"]), (["a"], ["b"]), (["a"], [])], "w array<string>, r array<string>")
    assert [r[0] for r in df.select(json_text.contains_run(F.col("w"), F.col("r"))).collect()] == [True, False, False]


def test_facts_in_text(spark):
    t = "E1 was the R2 of E3 from 1990 to 1995. Noise. E4 was the R5 of E6 from 2000 to 2000."
    got = values(spark, text.parsed_facts(F.col("t")), [(t,)], "t string")[0]
    assert [tuple(f) for f in got] == [("E1", "R2", "E3", 1990, 1995), ("E4", "R5", "E6", 2000, 2000)]


def test_humanized(spark):
    day = 86_400.0
    cases = [(0.0, "today"), (1.5, "yesterday"), (3.0, "3 days ago"), (8.0, "1 week ago"), (20.0, "2 weeks ago"), (40.0, "about 1 month ago"), (400.0, "about 13 months ago"), (800.0, "about 2.2 years ago")]
    assert values(spark, times.humanized(F.col("s")), [(d * day,) for d, _ in cases], "s double") == [w for _, w in cases]
    short = [(-1.0, "in the future"), (8.0, "~1 week ago"), (60.0, "~2 months ago"), (400.0, "~1.1 years ago")]
    assert values(spark, times.humanized_short(F.col("s")), [(d * day,) for d, _ in short], "s double") == [w for _, w in short]


def test_dates(spark):
    ref = F.lit("2024-03-10 00:00:00").cast("timestamp_ntz")
    got = values(spark, times.parsed_date(F.col("t"), ref).cast("string"), [("2023-05-20",), ("May 5, 2022",), ("june 7",), ("31 May",), ("February 30",)], "t string")
    assert got == ["2023-05-20 00:00:00", "2022-05-05 00:00:00", "2024-06-07 00:00:00", None, None]
    assert values(spark, times.parsed_session_date(F.col("t")).cast("string"), [("2023/05/20 (Sat) 02:21",), ("x",)], "t string") == ["2023-05-20 02:21:00", None]
    got = values(spark, times.parsed_chat_date(F.col("t")).cast("string"), [("18 May 2023 at 1:39 pm",), ("1 Jan 2023 at 12:05 am",), ("1 Jan 2023 at 12:05 PM",)], "t string")
    assert got == ["2023-05-18 13:39:00", "2023-01-01 00:05:00", "2023-01-01 12:05:00"]


def test_bounds_from_questions(spark):
    ref = F.lit("2024-03-10 00:00:00").cast("timestamp_ntz")
    rows = [("What happened in December 2023?",), ("What did I do last week?",), ("as of January 15 what was known",), ("after 2024-01-01 and before 2024-02-01",)]
    got = [tuple(None if x is None else int(x) for x in b) for b in values(spark, times.temporal_bounds(F.col("q"), ref), rows, "q string")]
    now = 1_710_028_800
    assert got == [(1_701_388_800, 1_704_067_200, None), (now - 7 * 86_400, now, None), (None, None, 1_705_276_800), (1_704_067_200, 1_706_745_600, None)]


def test_vectors_and_scores(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [2.0, 9.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-9 and got[1] == 0
    assert values(spark, scores.judged(F.col("s")), [(0.8,), (0.3,), (0.1,), (None,)], "s double") == [1.0, 0.5, 0.0, 0.0]
    assert values(spark, scores.judged_by_words(F.col("s")), [("0.5",), ("Correct",), ("partial",), ("no",)], "s string") == [0.5, 1.0, 0.5, 0.0]
    chance = scores.win_chance(F.col("s"), F.lit(True), F.lit(3), F.lit(True), F.lit(False))
    assert values(spark, chance, [("closed_won",), ("lead",), ("odd",)], "s string") == [1.0, 0.05 + 0.10 + 0.05 + 0.05, 0.1 + 0.10 + 0.05 + 0.05]


def test_wordings(spark):
    assert values(spark, times.duration_words(F.col("y")), [(0,), (1,), (2,), (4,), (9,), (20,)], "y int") == ["less than a year", "1 year", "2 years (brief)", "4 years", "9 years (extended)", "20 years (long-standing)"]
    assert values(spark, times.relative_years(F.lit(2000), F.col("y")), [(2000,), (2001,), (1998,)], "y int") == ["at the same time", "1 year later", "2 years earlier"]
    assert values(spark, text.middle_truncated(F.col("t"), 200), [("x" * 200,), ("a" * 150 + "b" * 150,)], "t string") == ["x" * 200, "a" * 50 + "\n\n[... content truncated due to length ...]\n\n" + "b" * 50]


def test_providers(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "bad")], "id long, prompt string")

    class Flaky:
        def chat(self, prompts):
            if "bad" in prompts:
                raise ValueError("no")
            return [p.upper() for p in prompts]

    got = {r.id: (r.answer, r.error) for r in providers.answered(df, "prompt", Flaky(), batch=1).collect()}
    assert got == {1: ("A B", None), 2: (None, "ValueError: no")}
    vectors_ = {r.id: r.vector for r in providers.embedded(df, "prompt", providers.HashEmbeddings(8)).collect()}
    assert len(vectors_[1]) == 8 and vectors_[1] != vectors_[2]
    one = spark.createDataFrame([("FalkorDB - Redis graph", "falkordb", "Acme Solar", ["x"])], "t string, n string, c string, d array<string>")
    assert one.select(providers.canonical_name(F.col("t"), F.col("n")), providers.industry(F.col("c"), F.col("d"))).first() == ("FalkorDB", "Energy & Utilities")


def test_email_templates(spark):
    note = 'Intro\n1st TOUCH - A\nSubject line: "Hello {{name}}"\n\nHi {{name}},\nbuy.\n2nd TOUCH - B\nSubject lines: Again\nBye\n3rd TOUCH - C\nno subject'
    got = [tuple(t) for t in values(spark, text.email_templates(F.col("t")), [(note,)], "t string")[0]]
    assert got == [("1st TOUCH - A", "Hello {{name}}", "Hi [PERSONALIZE],\nbuy."), ("2nd TOUCH - B", "Again", "Bye")]
