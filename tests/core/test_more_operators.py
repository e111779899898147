from pyspark.sql import functions as F

from tidemark.operators import batching, memory, negotiation, process, quality, retrieve
from tidemark.sources import world_model


def test_payoffs_and_time(spark):
    contracts = spark.createDataFrame([(1, {"price": "low", "term": "long"}), (2, {"price": "odd"})], "contract_id long, choices map<string,string>")
    table = spark.createDataFrame([("price", "low", 10), ("term", "long", 5)], "issue string, option string, value long")
    assert {(r.contract_id, r.payoff) for r in negotiation.payoffs(contracts, table).collect()} == {(1, 15), (2, 0)}
    turns = spark.createDataFrame([(1, 1, 50), (1, 2, 100)], "run_id long, turn int, words long")
    got = [(r.remaining, r.over) for r in negotiation.remaining_time(turns, 60.0).orderBy("turn").collect()]
    assert got == [(40.0, False), (0.0, True)]
    df = spark.createDataFrame([(30.0,), (90.0,), (200.0,)], "t double")
    assert [r[0] for r in df.select(negotiation.urgency(F.col("t"))).collect()] == ["HIGH", "MEDIUM", "LOW"]


def test_sequences(spark):
    ddl = "sequence_id string, step int, delta double, ghost_risk double, pains array<struct<name:string,score:double>>, concerns array<struct<name:string,score:double>>"
    rows = [("s", 1, 0.1, 0.5, [("p", 0.7), ("q", 0.2)], []), ("s", 2, -0.3, 0.5, [("p", 0.9), ("r", 0.8)], [("c", 0.9)])]
    df = spark.createDataFrame(rows, ddl)
    r = negotiation.sequence_totals(df).first()
    assert (round(r.delta, 9), r.n_pains, r.n_concerns, r.riskiest_step) == (-0.2, 2, 1, 1)
    assert [round(x.chance, 9) for x in negotiation.win_trajectory(df).orderBy("step").collect()] == [0.4, 0.05]
    totals = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (1, "c", 1.2)], "prospect_id long, sequence_id string, delta double")
    assert {(x.a, x.b, x.winner) for x in negotiation.compared(totals, "delta").collect()} == {("a", "b", "a"), ("a", "c", "a"), ("b", "c", "tie")}


def test_memory(spark):
    resolved = spark.createDataFrame([("m1", "create", None, None, "s"), ("m2", "update", "e1", True, "t"), ("m3", "update", "e1", None, "u")], "mention_id string, action string, matched_id string, contradiction boolean, summary string")
    assert {(r.entity_id, r.transition_type) for r in memory.applied(resolved, 5).collect()} == {("m1", "creation"), ("e1", "contradiction"), ("e1", "update")}
    entities = spark.createDataFrame([("e1", "Ann", ["A"]), ("e2", "Bob", None)], "entity_id string, name string, aliases array<string>")
    mentions = spark.createDataFrame([("e1", "ann"), ("e1", "Annie"), ("e1", "A")], "entity_id string, name string")
    assert {r.entity_id: r.aliases for r in memory.with_aliases(entities, mentions).collect()} == {"e1": ["A", "Annie"], "e2": []}
    more = spark.createDataFrame([("e2", "Rob", None), ("e3", "Cy", None)], "entity_id string, name string, aliases array<string>")
    assert sorted(r.name for r in memory.merged_missing(entities, more, ["entity_id"]).collect()) == ["Ann", "Bob", "Cy"]


def test_merged_sources_and_noise(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, item_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, item_id long, rank int")
    assert [(r.item_id, r.source) for r in retrieve.merged([a, b], 3).orderBy("position").collect()] == [(10, 0), (11, 0), (12, 1)]
    t = spark.createDataFrame([("x",), ("generic",), ("fine and long",)], "name string")
    rules = {"short": F.length("name") < 3, "generic_name": F.col("name") == "generic"}
    assert {r.name: (r.reasons, r.severity) for r in quality.noise(t, rules).collect()} == {"x": (["short"], "low"), "generic": (["generic_name"], "medium")}
    s = spark.createDataFrame([("Closed Won",), ("won",), ("LOST",), ("Pilot-Phase",)], "s string")
    assert [r[0] for r in s.select(process.stage_name(F.col("s"))).collect()] == ["closed_won", "closed_won", "closed_lost", "pilot_phase"]


def test_extractions_apply_in_order(spark):
    raw = [
        (1, '{"entities": [{"name": "Ana-Maria", "state": "new"}, {"name": "ANA maria", "state": "again"}, {"name": ""}], "state_changes": [{"entity_name": "later", "to_state": "x"}, {"entity_name": "ana maria", "new_state": "y", "is_contradiction": true}]}'),
        (2, '{"entities": [{"name": "Later"}], "relationships": [{"source": "later", "target": "Ana_Maria", "type": "uses"}, {"source": "later", "target": "nobody"}]}'),
        (3, None),
    ]
    found = world_model.extraction(spark.createDataFrame(raw, "at long, text string"), "at", "text")
    got = memory.upserted(found["entities"], found["state_changes"]).collect()
    kinds = sorted((r.name, r.at, r.i, r.transition_type, r.summary) for r in got if r.summary is None)
    assert kinds == [("ana maria", 1, 0, "creation", None), ("later", 2, 0, "creation", None)]
    assert sorted((r.name, r.at, r.i, r.transition_type, r.state["description"]) for r in got if r.summary is not None) == [
        ("ana maria", 1, 1, "contradiction", "y"), ("ana maria", 1, 1, "update", "again"),
    ]
    assert [(r.source, r.target, r.at, r.type) for r in memory.linked(found["relationships"], found["entities"]).collect()] == [("later", "ana maria", 2, "uses")]


def test_no_characters_count_as_none(spark):
    c = spark.createDataFrame([(1, "d", 1, None), (2, "d", 2, 30), (3, "d", 3, 80), (4, "d", 4, None), (5, None, 1, 5)], "k long, day string, o long, n long")
    assert {(r.k, r.batch) for r in batching.daily_batches(c, "k", "day", "o", "n", 100).collect()} == {(1, "d-1"), (2, "d-1"), (3, "d-2"), (4, "d-2"), (5, None)}
