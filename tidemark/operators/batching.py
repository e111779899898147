"""Batches and chunks of conversations and texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_totals(conversations: DataFrame, day: str, chars: str) -> DataFrame:
    return conversations.groupBy(day).agg(F.count(F.lit(1)).alias("n_conversations"), F.sum(chars).alias("n_chars"))


def daily_batches(conversations: DataFrame, key: str, day: str, order: str, chars: str, max_chars: int = 80_000) -> DataFrame:
    """Each conversation with its batch: the day, or day-1, day-2 … where a day has more than *max_chars*.

    No characters (null) count as 0.  Greedy: a batch closes before the conversation that would take it over the limit.
    The resetting sum is sequential, so each day's (key, chars) rows stream once, sorted,
    through Python; texts do not.
    """

    narrow = conversations.select(F.col(key).alias("k"), F.col(day).cast("string").alias("d"), F.col(order).alias("o"), F.coalesce(F.col(chars).cast("long"), F.lit(0)).alias("c"))
    sized = narrow.withColumn("total", F.sum("c").over(Window.partitionBy("d")))
    kind = narrow.schema["k"].dataType
    ddl = f"{key} {kind.simpleString()}, batch string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, sub = None, 0, 1
        for batch in batches:
            d = batch.to_pydict()
            out = []
            for k, day_, c, total in zip(d["k"], d["d"], d["c"], d["total"]):
                if day_ != now:
                    now, held, sub = day_, 0, 1
                elif held and held + c > max_chars and total > max_chars:
                    held, sub = 0, sub + 1
                held += c
                out.append(day_ if total <= max_chars else f"{day_}-{sub}")
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(out, pa.string())], names=[key, "batch"])

    dealt = sized.repartition("d").sortWithinPartitions("d", "o", "k")
    return dealt.mapInArrow(run, ddl)


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of (i, chunk): chunks of *size* characters, each beginning *overlap* before the last one's end."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.substring(text, i * step + 1, F.lit(size)).alias("chunk")))


def sentence_cuts(text: str, size: int = 4096, overlap: int = 256) -> list[tuple[int, int]]:
    """(start, end) of chunks that end after a sentence within their last fifth, where there is one."""
    if len(text) <= size:
        return [(0, len(text))]
    out, start = [], 0
    while True:
        end = min(start + size, len(text))
        if end < len(text):
            low = end - size // 5
            for mark in (". ", ".\n", "! ", "? "):
                at = text.rfind(mark, low, end)
                if at > low:
                    end = at + 1
                    break
        out.append((start, end))
        if end >= len(text):
            return out
        start = end - overlap


def sentence_chunks(texts: DataFrame, key: str, text: str, size: int = 4096, overlap: int = 256) -> DataFrame:
    """key, i, start, chunk of every text."""
    ddl = f"{key} {texts.schema[key].dataType.simpleString()}, i int, start int, chunk string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                t = batch.column(1)[j].as_py() or ""
                cuts = sentence_cuts(t, size, overlap)
                columns = [pa.array([batch.column(0)[j].as_py()] * len(cuts), batch.column(0).type), pa.array(range(len(cuts)), pa.int32()), pa.array([a for a, _ in cuts], pa.int32()), pa.array([t[a:b] for a, b in cuts], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "i", "start", "chunk"])

    return texts.select(key, text).mapInArrow(run, ddl)


def head_and_tail(turns: DataFrame, group: str, order: list[str], max_turns: int = 50) -> DataFrame:
    """The first and last half of a long conversation's turns."""
    w = Window.partitionBy(group)
    n = turns.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w))
    first = max_turns // 2
    return n.filter((F.col("_n") <= max_turns) | (F.col("_i") <= first) | (F.col("_i") > F.col("_n") - (max_turns - first))).drop("_i", "_n")
