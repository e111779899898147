"""Stateful streams: running entity states, stalled deals, and batches that may fail alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "n long, last_seen double, values map<string,string>"


def running_states(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """entity_id, n, last_seen and the last value of each key after every batch that touches an entity.

    *events*: entity_id, seconds, and the keys.  Late rows count, but an older value never
    replaces a newer one: the state keeps the time of each value.
    """
    out = "entity_id long, n long, last_seen double, " + ", ".join(f"{k} string" for k in keys)
    state = "n long, last_seen double, " + ", ".join(f"{k} string, {k}_at double" for k in keys)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        n, last, *rest = held.get if held.exists else (0, float("-inf"), *[None, float("-inf")] * len(keys))
        for part in parts:
            n, last = n + len(part), max(last, float(part["seconds"].max()))
            for i, k in enumerate(keys):
                known = part[part[k].notna()].sort_values("seconds", kind="stable")
                if len(known) and float(known["seconds"].iloc[-1]) >= rest[2 * i + 1]:
                    rest[2 * i], rest[2 * i + 1] = str(known[k].iloc[-1]), float(known["seconds"].iloc[-1])
        held.update((n, last, *rest))
        yield pd.DataFrame([[key[0], n, last, *rest[::2]]], columns=["entity_id", "n", "last_seen", *keys])

    return events.groupBy("entity_id").applyInPandasWithState(fold, out, state, "update", GroupStateTimeout.NoTimeout)


def stalled(visits: DataFrame, stall_seconds: int) -> DataFrame:
    """prospect_id and stage of deals without a visit for *stall_seconds* of event time (needs a watermark on ts)."""

    def watch(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            stage, at = held.get
            held.remove()
            yield pd.DataFrame([[key[0], stage, at]], columns=["prospect_id", "stage", "since"])
            return
        stage, at = held.get if held.exists else (None, float("-inf"))
        for part in parts:
            newest = part.sort_values("ts", kind="stable").iloc[-1]
            if newest["ts"].timestamp() >= at:
                stage, at = str(newest["stage"]), newest["ts"].timestamp()
        held.update((stage, at))
        held.setTimeoutTimestamp(max(int((at + stall_seconds) * 1000), held.getCurrentWatermarkMs() + 1))

    return visits.groupBy("prospect_id").applyInPandasWithState(watch, "prospect_id long, stage string, since double", "stage string, at double", "append", GroupStateTimeout.EventTimeTimeout)


def isolated(write: Callable[[DataFrame, int], None], dead_letters: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: a batch that fails goes to the dead letters with its reason, and the stream goes on.

    The letters of a batch have a folder of their own, so a batch that is tried again replaces them.
    """

    def each(batch: DataFrame, number: int) -> None:
        try:
            write(batch, number)
        except Exception as e:  # noqa: BLE001  the stream must outlive any batch
            reason = f"{type(e).__name__}: {e}"[:2000]
            batch.withColumn("_reason", F.lit(reason)).write.mode("overwrite").parquet(f"{dead_letters}/_batch={number}")

    return each


def _done(spark: SparkSession, path: str) -> bool:
    """Whether a write to *path* has committed."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def once(make: Callable[[DataFrame, int], DataFrame], sink: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes what *make* gives for a batch, once, however often the batch is delivered.

    Each batch has a folder of its own below *sink* (``_batch``), written whole; its commit mark is the ledger.  A
    batch that is there is skipped, one that broke off midway is written anew.
    """

    def each(batch: DataFrame, number: int) -> None:
        path = f"{sink}/_batch={number}"
        if not _done(batch.sparkSession, path):
            make(batch, number).write.mode("overwrite").parquet(path)

    return each


def resumed(rows: DataFrame, batch: str, make: Callable[[DataFrame, int], DataFrame], sink: str, skip: int = 0, limit: int | None = None, dead_letters: str | None = None) -> list:
    """Work off a table batch by batch, in the order of the column *batch*; returns the batches that were written now.

    Batches that an earlier run has finished are skipped, so a run that broke off goes on where it stopped; *skip* and
    *limit* leave out the first and the later ones.  With *dead_letters* a failing batch goes there and the next one follows.
    Only batch numbers come to the driver.
    """
    spark, written = rows.sparkSession, []
    numbers = [r[0] for r in rows.select(batch).distinct().orderBy(batch).collect()][skip:]
    write = once(make, sink)
    each = isolated(write, dead_letters) if dead_letters else write
    for number in numbers if limit is None else numbers[:limit]:
        if _done(spark, f"{sink}/_batch={number}"):
            continue
        each(rows.filter(F.col(batch) == number), number)
        if _done(spark, f"{sink}/_batch={number}"):
            written.append(number)
    return written
