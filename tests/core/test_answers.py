from pyspark.sql import functions as F

from tidemark import providers
from tidemark.functions import json_text, scores, times
from tidemark.operators import deals, negotiation, process, scoring


def one(spark, column, rows, ddl):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(column).collect()]


def test_arithmetic_answers(spark):
    rows = [
        ('{"answer": 4}', '{"answer": "4.0"}', True), ('so {"answer": "Four"} it is', "{'answer': 'four'}", True), ('{"answer": 5}', '{"answer": 4}', False),
        ('{"unordered_list": ["b", "A"]}', '{"unordered_list": ["a", "b"]}', True), ('{"answer": "b, a"}', '{"unordered_list": ["a", "b"]}', True),
        ('{"answer": ["a"]}', '{"unordered_list": ["a", "a"]}', False), ('{"H": 1, "M": "02"}', '{"H": 1, "M": 2, "explanation": "x"}', True), ('{"H": 1}', '{"H": 1, "M": 2}', False),
        ("It is 42 days", '{"answer": 42}', True), ("nothing", '{"answer": 42}', False), ("x", "no label", False), (None, '{"answer": 1}', False), ('{"answer": 1}', None, False), ("", "", False),
    ]
    assert one(spark, json_text.arithmetic_match(F.col("p"), F.col("g")), [r[:2] for r in rows], "p string, g string") == [r[2] for r in rows]


def test_semantic_answers(spark):
    rows = [
        ("e76", "E76", False, True), ("It was E76.", "E76", False, True), ("It was E761.", "E76", False, False), ("in 1999s", "1999", False, True), ("took 12 years", "12", False, True),
        ("took 123", "12", False, False), ("first E1 then E2, E3", "E2, E3", True, True), ("E2 E1 E3", "E2,E3", True, False), ("no", "yes", False, False), (None, "E1", False, False), ("", "E1", True, False),
    ]
    assert one(spark, json_text.semantic_match(F.col("p"), F.col("g"), F.col("t")), [r[:3] for r in rows], "p string, g string, t boolean") == [r[3] for r in rows]


def test_dates_judges_topics(spark):
    assert one(spark, times.worded_session_date(F.col("t")), [("2023/05/20 (Sat) 02:21",), ("soon",)], "t string") == ["May 20, 2023 at 02:21", "soon"]
    assert one(spark, times.worded_chat_date(F.col("t")), [("8 May 2023 at 1:39 pm",), ("soon",)], "t string") == ["May 08, 2023 at 01:39 PM", "soon"]
    rows = [('{"score": 0.8, "overall": 0.7}',), ('```json\n{"score": 0.3}\n```',), ("none",), (None,)]
    assert one(spark, scores.judged_json(F.col("a")), rows, "a string") == [1.0, 0.5, 0.0, 0.0]
    assert one(spark, scores.judged_overall(F.col("a")), rows, "a string") == [0.7, 0.5, 0.5, 0.5]
    assert one(spark, scores.topic(F.col("t")), [("I like my work",), ("I LOVE tea",), ("Married",), ("tall",), (None,)], "t string") == ["job", "interests", "family", "background", "background"]


def test_addresses_and_grounding(spark):
    urls = [["https://news.x", "https://acme-corp.com"], ["https://news.x"], [], None]
    got = one(spark, providers.best_url(F.col("u"), F.lit("Acme Corp")), [(u,) for u in urls], "u array<string>")
    assert got == ["https://acme-corp.com", "https://news.x", "", ""]
    assert one(spark, providers.profile_url(F.col("u")), [(["a", "https://linkedin.com/in/x"],), (["a"],), (None,)], "u array<string>") == ["https://linkedin.com/in/x", "", ""]
    entities = spark.createDataFrame([(1, "Acme", "organization"), (2, "SQL", "tool"), (3, "Ann", "person"), (4, "Nobody", "tool"), (5, None, "tool")], "entity_id long, name string, type string")
    found = spark.createDataFrame([("acme", 1, "News", "other", ""), ("acme", 2, "Acme Inc | Home", "Acme makes", "u2"), ("acme", 4, "Acme late", "x", "u4"), ("ann", 1, "Ann", "x", "u")], "name string, position int, title string, snippet string, url string")
    got = {r.entity_id: (r.canonical, r.description, r.url, r.verified) for r in providers.grounded(entities, found).collect()}
    assert got == {1: ("Acme Inc", "other", "u2", True), 2: ("SQL", "Well-known tool", None, True), 3: (None, None, None, False), 4: (None, None, None, False), 5: (None, None, None, False)}


def test_ratings_and_advice(spark):
    df = spark.createDataFrame([("a", -0.4, 3, 0, 0.6), ("b", 0.2, 0, 3, 0.1), ("c", 0.0, 1, 0, None), ("d", 0.0, 0, 1, 0.3)], "sequence_id string, objection_change double, n_pains int, n_risks int, response double")
    assert {r.sequence_id: (r.points, r.rating) for r in negotiation.rated(df).collect()} == {"a": (5, "strong"), "b": (-4, "risky"), "c": (1, "moderate"), "d": (-1, "weak")}
    df = spark.createDataFrame([("a", 0.1, 2, 1, 20, 3), ("b", 0.5, 0, 2, 2, 3), ("c", None, 0, 2, 10, 5)], "sequence_id string, riskiest_response double, n_risks int, n_pains int, days int, n_steps int")
    got = [(r.sequence_id, r.advice) for r in negotiation.advice(df).collect()]
    assert sorted(got) == [("a", "cover_pains"), ("a", "ghost_risk"), ("a", "preempt_concerns"), ("a", "tighten_timing"), ("b", "spread_timing")]


def test_empty_reports(spark):
    none = spark.createDataFrame([], "stage string, value double")
    assert tuple(deals.summary(none, scores.STAGE_CHANCE).first()) == (0, 0, 0.0, 0.0, 0.0)
    visits = spark.createDataFrame([], "prospect_id long, seq int, stage string, entered_us long, dwell_days double, is_last boolean, outcome string")
    reports = process.analysis(visits, ["a", "b"], 0, 1)
    assert tuple(reports["summary"].first()) == (0, 0, 0, 0.0) and reports["funnel"].count() == 2 and reports["stalls"].count() == 0
    rollouts = spark.createDataFrame([(1, 1.0, [-1.0, -2.0]), (1, 0.0, [-4.0]), (2, 3.0, None)], "q long, r double, p array<double>")
    r = scoring.policy_loss(rollouts, "q", "r", "p").first()
    assert (round(r.loss, 9), round(r.mean_reward, 9), r.mean_advantage) == (round((0.5 + 1.0 - 2.0) / 3, 9), round(4 / 3, 9), 0.0)
    assert scoring.policy_loss(rollouts.limit(0), "q", "r", "p").first().loss == 0.0
