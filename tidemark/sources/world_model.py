"""World models: one JSON document of keyed objects, and Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

TABLES = {"entities": schemas.ENTITIES, "transitions": schemas.TRANSITIONS, "relationships": schemas.EDGES}


def _struct(ddl: str) -> str:
    """A table's DDL as a struct type."""
    out, depth, field, fields = "", 0, "", []
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            fields.append(field.strip())
            field = ""
        else:
            field += c
    out = ",".join(f.replace(" ", ":", 1) for f in fields)
    return f"struct<{out}>"


def read_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a document; absent fields are null."""
    ddl = ", ".join(f"{name} map<string,{_struct(t)}>" for name, t in TABLES.items())
    document = spark.read.schema(ddl).option("multiLine", True).json(path)
    return {name: document.select(F.explode(F.map_values(name)).alias("x")).select("x.*") for name in TABLES}


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet; entities by type, so that a type filter prunes."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("type") if name == "entities" else writer).parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(ddl).parquet(f"{folder}/{name}") for name, ddl in TABLES.items()}


def write_merged(delta: DataFrame, folder: str, key: str, now: Column, buckets: int = 64) -> None:
    """Merge *delta* into a stored table: rows of its keys are replaced, others stay; new rows are stamped ``updated_at``.

    The table is partitioned by ``bucket``, a hash of the key.  Only buckets that the delta touches are read and
    written again, and change places as the job commits; of several rows of a key the last by all columns holds.  The number of buckets is
    that of the first write.
    """
    spark = delta.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    stored = spark.read.parquet(folder) if there else None
    if stored is not None:
        buckets = int(stored.select(F.max("n_buckets")).first()[0] or buckets)
    fields = [c for c in delta.columns if c not in ("bucket", "n_buckets", "updated_at")]
    comparable = [F.to_json(c) if delta.schema[c].dataType.typeName() == "map" else F.col(c) for c in fields]
    one = delta.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*fields), F.struct(*comparable)).alias("_last")).select("_last.*")
    new = one.withColumn("updated_at", now).withColumn("n_buckets", F.lit(buckets)).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    if stored is not None:
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most the number of buckets
        kept = stored.filter(F.col("bucket").isin(touched)).join(new.select(key), key, "left_anti")
        new = kept.unionByName(new, allowMissingColumns=True)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def write_json(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as JSON lines."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def extraction(raw: DataFrame, key: str, text: str, mark_events: bool = False) -> dict[str, DataFrame]:
    """entities, state_changes and relationships of a model's JSON, with defaults; ``i`` is the place in its list.

    Unknown types become ``concept`` and ``related_to``; a state that is a string becomes its
    description; with *mark_events* a preference is a ``belief``, and the state of an event is marked ``_is_event`` and
    has the date that is told beside it, where it has none of its own; ``old_state`` and ``new_state`` stand in for ``from_state`` and ``to_state``.
    """
    parsed = raw.select(key, F.from_json(text, schemas.EXTRACTION, {"mode": "PERMISSIVE"}).alias("x"))
    rows = lambda name: parsed.select(key, F.posexplode(f"x.{name}").alias("i", "r")).select(key, "i", "r.*")
    known = lambda c, values, default: F.when(F.lower(c).isin(*values), F.lower(c)).otherwise(default)
    text_of = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    is_object = F.startswith(F.ltrim("state"), F.lit("{"))
    told = F.when(is_object, F.from_json("state", "map<string,string>")).otherwise(F.create_map(F.lit("description"), F.coalesce("state", F.lit(""))))
    is_event = F.lower(F.coalesce("type", F.lit(""))) == "event"
    dated = F.nullif(F.col("date"), F.lit("")).isNotNull() & ~F.map_contains_key(told, "date")
    marked = F.map_concat(told, F.create_map(F.lit("_is_event"), F.lit("true")))
    state = told if not mark_events else F.when(is_event & dated, F.map_concat(marked, F.create_map(F.lit("date"), F.col("date")))).when(is_event, marked).otherwise(told)
    kind = known(F.col("type"), schemas.ENTITY_TYPES, "concept")
    kind = F.when(F.lower("type").isin(*schemas.BELIEF_TYPES), "belief").otherwise(kind) if mark_events else kind
    return {
        "entities": rows("entities").select(
            key, "i", F.coalesce("name", F.lit("")).alias("name"), kind.alias("type"), state.alias("state"),
            F.coalesce("is_new", F.lit(True)).alias("is_new"), "matches_existing", F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        ),
        "state_changes": rows("state_changes").select(
            key, "i", F.coalesce("entity_name", F.lit("")).alias("entity_name"), F.coalesce("what_changed", F.lit("")).alias("what_changed"),
            text_of(F.col("from_state"), F.col("old_state")).alias("from_state"), F.coalesce(text_of(F.col("to_state"), F.col("new_state")), F.lit("")).alias("to_state"),
            F.coalesce("is_contradiction", F.lit(False)).alias("is_contradiction"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        ),
        "relationships": rows("relationships").select(
            key, "i", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("target", F.lit("")).alias("target"),
            known(F.col("type"), schemas.RELATIONSHIP_TYPES, "related_to").alias("type"), F.coalesce("description", F.lit("")).alias("description"),
        ),
    }
