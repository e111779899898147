"""Chat exports: conversation trees in JSON, walked from the current node to the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEEP_ROLES = ("user", "assistant")
KEEP_CONTENT = ("text", "multimodal_text")
SCHEMA = (
    "conversation_id string, title string, create_time double, update_time double, default_model_slug string, current_node string, "
    "mapping map<string, struct<parent:string, message:struct<author:struct<role:string>, create_time:double, "
    "content:struct<content_type:string, parts:array<string>>>>>"
)
MAX_DEPTH = 10_000


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """One row per conversation; parts that are objects stay JSON text."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def text_of_parts(parts: Column) -> Column:
    """The strings, and the ``text`` of objects that have one, by lines and trimmed."""
    one = lambda p: F.when(F.startswith(F.ltrim(p), F.lit("{")), F.get_json_object(p, "$.text")).otherwise(p)
    return F.trim(F.array_join(F.array_compact(F.transform(F.coalesce(parts, F.array().cast("array<string>")), one)), "\n"))


def path_nodes(mapping: Column, leaf: Column) -> Column:
    """The node ids from the leaf to the root, each once, so that cycles end.

    A fold over as many steps as the tree has nodes: one conversation is one
    (bounded) value, so the walk needs no join and no recursion.
    """
    steps = F.sequence(F.lit(1), F.least(F.greatest(F.size(mapping), F.lit(1)), F.lit(MAX_DEPTH)))
    begin = F.struct(leaf.alias("at"), F.array().cast("array<string>").alias("seen"))

    def step(acc: Column, _: Column) -> Column:
        here = F.try_element_at(mapping, acc["at"])
        valid = acc["at"].isNotNull() & here.isNotNull() & ~F.array_contains(acc["seen"], F.coalesce(acc["at"], F.lit("")))
        grown = F.struct(here["parent"].alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen"))
        return F.when(valid, grown).otherwise(F.struct(F.lit(None).cast("string").alias("at"), acc["seen"].alias("seen")))

    return F.aggregate(steps, begin, step)["seen"]


def turns(export: DataFrame) -> DataFrame:
    """conv_id, turn_idx, role, text, ts: kept roles and content types with text, from root to leaf."""
    ids = export.select("conversation_id", "mapping", path_nodes(F.col("mapping"), F.col("current_node")).alias("ids"))
    nodes = ids.select(F.col("conversation_id").alias("conv_id"), F.posexplode(F.reverse("ids")).alias("i", "id"), "mapping")
    message = F.try_element_at("mapping", F.col("id"))["message"]
    rows = nodes.select(
        "conv_id",
        "i",
        F.coalesce(message["author"]["role"], F.lit("unknown")).alias("role"),
        message["content"]["content_type"].alias("kind"),
        text_of_parts(message["content"]["parts"]).alias("text"),
        F.timestamp_seconds(message["create_time"]).alias("ts"),
    )
    kept = rows.filter(F.col("role").isin(*KEEP_ROLES) & F.col("kind").isin(*KEEP_CONTENT) & (F.col("text") != ""))
    w = Window.partitionBy("conv_id").orderBy("i")
    return kept.select("conv_id", (F.row_number().over(w) - 1).alias("turn_idx"), "role", "text", "ts")


def conversations(export: DataFrame, year_min: int = 2023) -> DataFrame:
    """conv_id, title, created_at, model, n_turns, n_chars; dropped: no creation time, too old, no turns."""
    created = F.timestamp_seconds("create_time")
    heads = export.filter(F.coalesce("create_time", F.lit(0.0)) != 0).select(
        F.col("conversation_id").alias("conv_id"),
        F.coalesce("title", F.lit("Untitled")).alias("title"),
        created.alias("created_at"),
        F.coalesce("default_model_slug", F.lit("unknown")).alias("model"),
    )
    sizes = turns(export).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))
    return heads.filter(F.year("created_at") >= year_min).join(sizes, "conv_id")
