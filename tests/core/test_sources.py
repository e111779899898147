import json

from pyspark.sql import functions as F

from tidemark.sources import chat_export, datasets, sinks, world_model


def message(role, parts, kind="text", at=None):
    return {"author": {"role": role}, "create_time": at, "content": {"content_type": kind, "parts": parts}}


def test_chat_export(spark, tmp_path):
    mapping = {
        "r": {"parent": None, "message": None}, "a": {"parent": "r", "message": message("user", ["hi", {"text": "there"}, {"image": 1}], at=1.7e9)},
        "b": {"parent": "a", "message": message("assistant", ["yes"])}, "side": {"parent": "a", "message": message("assistant", ["other branch"])},
        "c": {"parent": "b", "message": message("tool", ["x"])}, "d": {"parent": "c", "message": message("assistant", ["code"], "code")}, "e": {"parent": "d", "message": message("user", [""])},
    }
    loop = {"x": {"parent": "y", "message": message("user", ["one"])}, "y": {"parent": "x", "message": message("assistant", ["two"])}}
    rows = [
        {"conversation_id": "c1", "title": "T", "create_time": 1.7e9, "current_node": "e", "mapping": mapping},
        {"conversation_id": "c2", "create_time": 1.7e9, "current_node": "x", "mapping": loop},
        {"conversation_id": "c3", "create_time": 1.0e9, "current_node": "x", "mapping": loop},
        {"conversation_id": "c4", "create_time": None, "current_node": "x", "mapping": loop},
    ]
    path = tmp_path / "export.json"
    path.write_text(json.dumps(rows))
    export = chat_export.read_export(spark, str(path))
    got = sorted((r.conv_id, r.turn_idx, r.role, r.text) for r in chat_export.turns(export).collect() if r.conv_id in ("c1", "c2"))
    assert got == [("c1", 0, "user", "hi\nthere"), ("c1", 1, "assistant", "yes"), ("c2", 0, "assistant", "two"), ("c2", 1, "user", "one")]
    heads = {r.conv_id: (r.title, r.n_turns, r.n_chars) for r in chat_export.conversations(export).collect()}
    assert heads == {"c1": ("T", 2, 11), "c2": ("Untitled", 2, 6)}


def test_world_model_round_trip(spark, tmp_path):
    doc = {
        "entities": {"e1": {"id": "e1", "type": "tool", "name": "N", "aliases": ["a"], "current_state": {"k": "v"}, "first_seen": 1.0, "last_seen": 2.0}},
        "transitions": {"t1": {"id": "t1", "entity_id": "e1", "from_state": None, "to_state": {"k": "v"}, "transition_type": "creation", "timestamp": 1.0}},
        "relationships": {},
    }
    path = tmp_path / "wm.json"
    path.write_text(json.dumps(doc))
    tables = world_model.read_json(spark, str(path))
    world_model.write_tables(tables, str(tmp_path / "wm"))
    back = world_model.read_tables(spark, str(tmp_path / "wm"))
    e = back["entities"].first()
    assert (e.id, e.type, e.current_state, e.valid_from) == ("e1", "tool", {"k": "v"}, None)
    assert back["transitions"].first().to_state == {"k": "v"} and back["relationships"].count() == 0


def test_extraction_defaults(spark):
    raw = {
        "entities": [{"name": "X", "type": "Alien", "state": "text"}, {"name": "Y", "type": "EVENT", "state": {"a": "b"}, "confidence": 0.5}],
        "state_changes": [{"entity_name": "X", "old_state": "o", "to_state": "n"}], "relationships": [{"source": "X", "target": "Y", "type": "odd"}],
    }
    df = spark.createDataFrame([(1, json.dumps(raw)), (2, "not json")], "batch long, json string")
    got = world_model.extraction(df, "batch", "json")
    assert {(r.name, r.type, json.dumps(r.state), r.confidence) for r in got["entities"].collect()} == {("X", "concept", '{"description": "text"}', 1.0), ("Y", "event", '{"a": "b"}', 0.5)}
    c = got["state_changes"].first()
    assert (c.from_state, c.to_state, c.is_contradiction) == ("o", "n", False)
    assert got["relationships"].first().type == "related_to"


def test_haystacks(spark, tmp_path):
    item = {"question_id": "q", "haystack_dates": ["2023/05/20 (Sat) 02:21"], "haystack_sessions": [[{"role": "user", "content": "u" * 90}, {"role": "assistant", "content": " "}, {"role": "assistant", "content": "ok"}]]}
    path = tmp_path / "h.json"
    path.write_text(json.dumps([item]))
    t = datasets.haystack_turns(datasets.read_haystacks(spark, str(path)))
    assert [(r.turn_idx, str(r.ts)) for r in t.orderBy("turn_idx").collect()] == [(0, "2023-05-20 02:21:00"), (2, "2023-05-20 02:21:10")]
    assert datasets.session_titles(t).first().title == "u" * 80 + "..."
    chunks = [r.chunk for r in datasets.rag_chunks(t).orderBy("chunk_idx").collect()]
    assert chunks[1] == "user: " + "u" * 90 + "\nassistant: ok"


def test_samples_and_pairs(spark, tmp_path):
    talk = {"speaker_a": "A", "speaker_b": "B", "session_10": [{"name": "B", "text": "late"}], "session_9": [{"name": "A", "text": "early", "blip_caption": "cat"}], "session_9_date_time": "18 May 2023 at 1:39 pm"}
    path = tmp_path / "s.json"
    path.write_text(json.dumps([{"sample_id": "s", "conversation": talk, "qa": [{"question": "q", "answer": 5, "category": 3}, {"question": "r", "answer": "x", "category": 99}]}]))
    df = datasets.read_samples(spark, str(path))
    got = [(r.number, r.role, r.text, str(r.created_at)) for r in datasets.numbered_sessions(df).orderBy("number").collect()]
    assert got == [(9, "user", "early [image: cat]", "2023-05-18 13:39:00"), (10, "assistant", "late", "None")]
    assert [(r.answer, r.category) for r in datasets.flat_questions(df).collect()] == [("5", "temporal"), ("x", "unknown")]
    items = spark.createDataFrame([(1, ["a", "b"], ["x", "y"], ["i"])], "context_id long, questions array<string>, answers array<string>, qa_ids array<string>")
    assert [r.qa_id for r in datasets.question_pairs(items).collect()] == ["i", "1-1"]


def test_notes_and_sinks(spark, tmp_path):
    note = {"doc": {"content": [{"type": "paragraph", "content": [{"text": "a"}, {"text": "b"}]}, {"type": "heading", "content": [{"text": "c"}]}]}}
    df = spark.createDataFrame([(json.dumps(note),), ("bad",)], "n string")
    assert [r[0] for r in df.select(datasets.note_text(F.col("n"))).collect()] == ["ab\nc", None]
    sinks.write_matrix(spark.createDataFrame([("x", 0.0, None)], "b string, m double, n double"), str(tmp_path / "m"))
    assert "x,0.0," in next((tmp_path / "m").glob("*.csv")).read_text()
