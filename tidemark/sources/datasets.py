"""Evaluation datasets as tables: dated haystacks, two-speaker samples, personas, long-context questions, documents."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import parsed_chat_date, parsed_session_date

TURN = "struct<role:string,content:string>"
HAYSTACK = f"question_id string, question_type string, question string, answer string, question_date string, haystack_dates array<string>, haystack_session_ids array<string>, answer_session_ids array<string>, haystack_sessions array<array<{TURN}>>"
# The categories of the two-speaker questions by code.
CATEGORIES = {1: "single_hop", 2: "multi_hop", 3: "temporal", 4: "adversarial", 5: "commonsense"}


def read_haystacks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HAYSTACK).option("multiLine", True).json(path)


def haystack_turns(items: DataFrame, seconds_apart: int = 5) -> DataFrame:
    """question_id, session, created_at, turn_idx, role, text, ts; blank turns go, unequal lengths raise."""
    checked = items.withColumn("ok", F.assert_true(F.size("haystack_sessions") == F.size("haystack_dates"), "sessions and dates differ in number"))
    sessions = checked.filter("ok is null").select("question_id", F.posexplode(F.arrays_zip("haystack_sessions", "haystack_dates")).alias("session", "x"))
    turns = sessions.select("question_id", "session", parsed_session_date(F.col("x.haystack_dates")).alias("created_at"), F.posexplode("x.haystack_sessions").alias("turn_idx", "t"))
    return turns.filter(F.trim("t.content") != "").select(
        "question_id", "session", "created_at", "turn_idx", F.col("t.role").alias("role"), F.col("t.content").alias("text"),
        F.timestamp_add("SECOND", F.col("turn_idx") * seconds_apart, F.col("created_at")).alias("ts"),
    )


def session_titles(turns: DataFrame) -> DataFrame:
    """question_id, session, title: the first user text, 80 characters and "..." at most."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn_idx")))
    title = F.when(F.length("t") > 80, F.concat(F.substring("t", 1, 80), F.lit("..."))).otherwise(F.col("t"))
    return turns.groupBy("question_id", "session").agg(first.alias("t")).select("question_id", "session", title.alias("title"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Two-speaker samples; the conversation's numbered keys stay a map of JSON text."""
    ddl = "sample_id string, conversation map<string,string>, qa array<struct<question:string,answer:string,category:int,evidence:array<string>>>"
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def numbered_sessions(samples: DataFrame) -> DataFrame:
    """sample_id, number, created_at, name, role, text: sessions in numeric order, so 10 follows 9."""
    names = F.map_filter("conversation", lambda k, v: F.rlike(k, F.lit(r"^session_\d+$")))
    rows = samples.select("sample_id", "conversation", F.explode(names).alias("key", "json"))
    number = F.regexp_extract("key", r"(\d+)$", 1).cast("int")
    ddl = "array<struct<name:string,speaker:string,text:string,blip_caption:string>>"
    turns = rows.select("sample_id", "conversation", number.alias("number"), F.try_element_at("conversation", F.concat("key", F.lit("_date_time"))).alias("date"), F.posexplode(F.from_json("json", ddl)).alias("i", "t"))
    speaker = F.coalesce("t.name", "t.speaker")
    role = F.when(speaker == F.try_element_at("conversation", F.lit("speaker_b")), "assistant").otherwise("user")
    text = F.concat_ws(" ", "t.text", F.when(F.col("t.blip_caption").isNotNull(), F.concat(F.lit("[image: "), "t.blip_caption", F.lit("]"))))
    return turns.select("sample_id", "number", parsed_chat_date(F.col("date")).alias("created_at"), "i", speaker.alias("name"), role.alias("role"), text.alias("text"))


def flat_questions(samples: DataFrame) -> DataFrame:
    """sample_id, i, question, answer, category: names for the codes, unknown for others."""
    pairs = [F.lit(x) for kv in CATEGORIES.items() for x in kv]
    name = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("q.category")), F.lit("unknown"))
    return samples.select("sample_id", F.posexplode("qa").alias("i", "q")).select("sample_id", "i", "q.question", "q.answer", name.alias("category"), F.coalesce("q.evidence", F.array().cast("array<string>")).alias("evidence"))


def question_pairs(items: DataFrame) -> DataFrame:
    """context_id, i, question, answer, qa_id of parallel arrays; missing ids are made from the position."""
    zipped = items.select("context_id", F.posexplode(F.arrays_zip("questions", "answers", "qa_ids")).alias("i", "x"))
    made = F.concat(F.col("context_id").cast("string"), F.lit("-"), F.col("i").cast("string"))
    return zipped.filter("x.questions is not null").select("context_id", "i", F.col("x.questions").alias("question"), F.col("x.answers").alias("answer"), F.coalesce("x.qa_ids", made).alias("qa_id"))


def persona_dialogs(examples: DataFrame, seconds_apart: int = 60) -> DataFrame:
    """dialog_id, i, role, text, seconds: lines in turn of user and assistant."""
    return examples.select("dialog_id", F.posexplode("dialog").alias("i", "text")).select("dialog_id", "i", F.when(F.col("i") % 2 == 0, "user").otherwise("assistant").alias("role"), "text", (F.col("i") * seconds_apart).alias("seconds"))


def read_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of JSON documents, the damaged ones left out."""
    rows = spark.read.schema(schema + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    return rows.filter("_corrupt is null").drop("_corrupt")


def rag_chunks(turns: DataFrame, by: str = "turn", prefix: int = 200) -> DataFrame:
    """question_id, session, chunk_idx, chunk: turns (an assistant's after the user's start) or whole sessions."""
    from pyspark.sql import Window

    line = F.concat("role", F.lit(": "), "text")
    if by == "session":
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_idx", line.alias("line")))), lambda x: x["line"]), "\n")
        return turns.groupBy("question_id", "session").agg(lines.alias("chunk")).withColumn("chunk_idx", F.col("session"))
    w = Window.partitionBy("question_id", "session").orderBy("turn_idx")
    asked = F.when((F.col("role") == "assistant") & (F.lag("role").over(w) == "user"), F.concat(F.lit("user: "), F.substring(F.lag("text").over(w), 1, prefix), F.lit("\n")))
    return turns.select("question_id", "session", F.col("turn_idx").alias("chunk_idx"), F.concat(F.coalesce(asked, F.lit("")), line).alias("chunk"))


BLOCKS = frozenset(("paragraph", "heading", "list_item", "blockquote", "code_block"))
_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+', re.DOTALL)


def _nested(raw: str):
    """JSON that is nested deeper than the parser of the language goes: open lists and objects stand on a stack."""
    top: list = []
    stack, key = [top], None
    for m in _TOKENS.finditer(raw):
        token, here = m[0], stack[-1]
        if token in ",:":
            continue
        if token in "}]":
            stack.pop()
            continue
        if isinstance(here, dict) and key is None:
            key = json.loads(token)
            continue
        value = {} if token == "{" else [] if token == "[" else json.loads(token)
        if isinstance(here, dict):
            here[key], key = value, None
        else:
            here.append(value)
        if token in "{[":
            stack.append(value)
    if len(stack) != 1 or len(top) != 1:
        raise ValueError("not one whole value")
    return top[0]


def flattened_note(raw: str | None) -> str | None:
    """The text of a note's tree, depth first, with a line break after each block; null if it is no JSON."""
    try:
        try:
            doc = json.loads(raw)
        except RecursionError:
            doc = _nested(raw)
    except (TypeError, ValueError, IndexError):
        return None
    out, todo = [], [doc.get("doc", doc) if isinstance(doc, dict) else None]
    while todo:
        node = todo.pop()
        if isinstance(node, str):  # the end of a block
            out.append(node)
        elif isinstance(node, dict):
            out.append(node["text"] if isinstance(node.get("text"), str) else "")
            if node.get("type") in BLOCKS:
                todo.append("\n")
            content = node.get("content")
            todo += [n for n in reversed(content if isinstance(content, list) else ()) if isinstance(n, dict)]
    return "".join(out).strip()


def note_text(node: Column) -> Column:
    """The text of rich-text notes in JSON of any depth, in Arrow batches."""

    @F.pandas_udf("string")
    def flatten(raw: pd.Series) -> pd.Series:
        return raw.map(flattened_note)

    return flatten(node)
