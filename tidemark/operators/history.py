"""State history: velocity, as-of states, folds, lookback and diffs over append-only transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def change_velocity(transitions: DataFrame) -> DataFrame:
    """Per entity: n_transitions, velocity (per month of 30 days, over one month at least), mean_interval_days, trend.

    The trend compares the mean interval of the first half with the second's, for
    three intervals or more: under 0.7 accelerating, over 1.3 decelerating.
    """
    w = Window.partitionBy("entity_id").orderBy("us", "ord")
    gaps = transitions.select(
        "entity_id",
        "us",
        (F.col("us") - F.lag("us").over(w)).alias("gap"),
        (F.row_number().over(w) - 1).alias("i"),
        F.count(F.lit(1)).over(Window.partitionBy("entity_id")).alias("n"),
    )
    half = F.floor((F.col("n") - 1) / 2)
    early = F.col("gap").isNotNull() & (F.col("i") <= half)
    late = F.col("gap").isNotNull() & (F.col("i") > half)
    stats = gaps.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n_transitions"),
        (F.max("us") - F.min("us")).alias("span"),
        F.avg("gap").alias("gap"),
        F.avg(F.when(early, F.col("gap"))).alias("early"),
        F.avg(F.when(late, F.col("gap"))).alias("late"),
    )
    trend = F.when(F.col("n_transitions") < 4, "").when(F.col("late") < F.col("early") * 0.7, "accelerating").when(F.col("late") > F.col("early") * 1.3, "decelerating").otherwise("constant")
    return stats.select(
        "entity_id",
        "n_transitions",
        (F.col("n_transitions") / F.greatest(F.col("span") / (30.0 * DAY_US), F.lit(1.0))).alias("velocity"),
        (F.col("gap") / DAY_US).alias("mean_interval_days"),
        trend.alias("trend"),
    )


def state_as_of(transitions: DataFrame, us: int | Column, keys: Sequence[str]) -> DataFrame:
    """Per entity the last value of each key at or before a time; ties by ord.  One hash aggregation."""
    past = transitions.filter(F.col("us") <= us)
    order = F.struct("us", "ord")
    last = [F.max_by(k, F.when(F.col(k).isNotNull(), order)).alias(k) for k in keys]
    return past.groupBy("entity_id").agg(*last, F.count(F.lit(1)).alias("n_changes"), F.max("us").alias("last_us"))


def folded(transitions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each transition with the state before (null for the first) and after: maps of the keys set so far.

    Runs as one ordered window per entity that carries the last value of each key, so a long
    history costs its length, not its square.
    """
    w = Window.partitionBy("entity_id").orderBy("us", "ord")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = [F.last(F.col(k).cast("string"), ignorenulls=True).over(so_far).alias(f"s_{k}") for k in keys]
    held = transitions.select("entity_id", "us", "ord", "transition_type", *values)
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"s_{k}").alias("value")) for k in keys))
    state = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    out = held.withColumn("to_state", state)
    return out.select("entity_id", "us", "ord", "transition_type", F.lag("to_state").over(w).alias("from_state"), "to_state")


def activity(transitions: DataFrame, days: int = 3) -> DataFrame:
    """Each transition with the number of transitions of its entity in the *days* before it (itself included)."""
    w = Window.partitionBy("entity_id").orderBy("us").rangeBetween(-days * DAY_US, 0)
    return transitions.select("entity_id", "us", "ord", F.count(F.lit(1)).over(w).alias("n_recent"))


def recent_entities(transitions: DataFrame, us: int, days: int = 3, top: int = 50) -> DataFrame:
    """The entities changed in the *days* up to a time: most changes first, then the latest."""
    recent = transitions.filter(F.col("us").between(us - days * DAY_US, us))
    return (
        recent.groupBy("entity_id")
        .agg(F.count(F.lit(1)).alias("n_changes"), F.max("us").alias("last_us"))
        .orderBy(F.desc("n_changes"), F.desc("last_us"), "entity_id")
        .limit(top)
    )


def recent_transitions(transitions: DataFrame, us: int, days: int = 3, top: int = 10) -> DataFrame:
    """The newest transitions of the *days* up to a time."""
    return transitions.filter(F.col("us").between(us - days * DAY_US, us)).orderBy(F.desc("us"), F.desc("ord")).limit(top)


def state_diff(transitions: DataFrame, before_us: int, after_us: int, keys: Sequence[str]) -> DataFrame:
    """entity_id, key, old, new: the keys whose value differs between two times."""
    long = lambda df, name: df.select("entity_id", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))).alias("x")).select("entity_id", "x.key", F.col("x.value").alias(name))
    old = long(state_as_of(transitions, before_us, keys), "old")
    new = long(state_as_of(transitions, after_us, keys), "new")
    return new.join(old, ["entity_id", "key"], "left").filter(~F.col("old").eqNullSafe(F.col("new"))).select("entity_id", "key", "old", "new")


def last_n(transitions: DataFrame, n: int = 3) -> DataFrame:
    """The last *n* transitions of each entity."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("us"), F.desc("ord"))
    return transitions.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, right_ord: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the values of the last right row at or before its time, or nulls.

    Union and carry forward: one shuffle on the key for both sides and no pairs, so
    a busy key costs its rows only.
    """
    payload = F.struct(*values)
    kind = right.schema
    struct_type = "struct<" + ",".join(f"{v}:{kind[v].dataType.simpleString()}" for v in values) + ">"
    a = left.select(key, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_o"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(struct_type).alias("_value"))
    b = right.select(key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(right_ord).cast("long").alias("_o"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), payload.alias("_value"))
    w = Window.partitionBy(key).orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    carried = a.unionByName(b).withColumn("_last", F.last("_value", ignorenulls=True).over(w))
    return carried.filter("_side = 1").select("_row.*", *(F.col(f"_last.{v}").alias(v) for v in values))
