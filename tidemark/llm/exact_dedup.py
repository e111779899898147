r"""Exact deduplication by skew-safe combining.

1. *Locally*: the map side of the first aggregation merges equal contents of a
   task, so a text that fills a third of the table leaves a task once.
2. *Salted*: rows of a digest that is still frequent are dealt over salts.
3. *Globally*: the winners of the salts are combined.

The content itself is a grouping key at every stage, so a shared digest never
merges two texts; the digest only decides where rows meet.  A digest is hot if
it holds more than one in ``HOT_SHARE`` of all rows, so there are fewer than
``HOT_SHARE`` hot digests at any input size, and only that list is broadcast.

Texts are read twice: once for the narrow table of digests, once for the combining.

Defined cases: a null text counts as empty; a null doc_id loses against any
other and a group of null ids only keeps null; rows that repeat doc_id and
content are the same document, so each of them carries the flag of that doc_id
(:func:`keep_one` leaves one of them); colliding digests are told apart by content;
other columns are never read.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, text_or_empty

#: A digest is hot with over 1/HOT_SHARE of the rows: under HOT_SHARE digests.
HOT_SHARE = 1000
SALTS = 32


def normalised(text: str = "text") -> Column:
    r"""Without the characters of ``[\x20\x09-\x0D]``; null is empty."""
    return F.translate(text_or_empty(text), " \t\n\x0b\f\r", "")


def sha256_bytes(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def _keyed(docs: DataFrame, digest, with_content: bool) -> DataFrame:
    content = normalised()
    columns = [
        F.col("doc_id"),
        digest(content).alias("digest"),
        F.char_length(text_or_empty()).cast("long").alias("chars"),
    ]
    return docs.select(*columns, *([content.alias("content")] if with_content else []))


#: A rank is ``chars * CHARS + ID - doc_id``, without the last two terms for a null doc_id: a number that sums and
#: maxima keep in place, unlike a struct.
CHARS, ID = Decimal(2**65), Decimal(2**63)


def _best() -> Column:
    """Most code points first, then the smallest doc_id, any before null."""
    by_id = F.coalesce(F.lit(ID) - F.col("doc_id").cast("decimal(19,0)"), F.lit(Decimal(0)))
    return F.max(F.col("chars").cast("decimal(10,0)") * F.lit(CHARS) + by_id).cast("decimal(38,0)").alias("best")


def _flat(df: DataFrame) -> DataFrame:
    by_id = F.col("best") % F.lit(CHARS)
    return df.select(
        "digest",
        "content",
        F.when(by_id > 0, F.lit(ID) - by_id).cast("long").alias("keep_id"),
        ((F.col("best") - by_id) / F.lit(CHARS)).cast("long").alias("keep_chars"),
        "group_size",
    )


def classes(
    docs: DataFrame, keys: DataFrame, digest=sha256_bytes, salts: int = SALTS, hot_share: int = HOT_SHARE
) -> tuple[DataFrame, DataFrame | None]:
    """The groups of equal content: (digest, keep_id, keep_chars, group_size), by *docs* and their *keys* (digest).

    Returns the groups whose digest has one content, and those of colliding
    digests with their ``content`` (None where no digest collides).
    """
    base = _keyed(docs, digest, True)
    total = keys.count()
    hot = (
        keys.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & (F.col("n") * hot_share > total))
        .select("digest", F.lit(True).alias("hot"))
    )
    salted = (
        base.join(F.broadcast(hot), "digest", "left")  # fewer than hot_share rows
        .withColumn("hot", F.coalesce("hot", F.lit(False)))
        .withColumn("salt", F.when(F.col("hot"), F.spark_partition_id() % salts).otherwise(0))  # of a task, whose copies are one row
        .groupBy("digest", "hot", "salt", "content")
        .agg(_best(), F.count(F.lit(1)).alias("group_size"))
    )
    # a cold digest has one salt: its contents are compared and done with here
    stored = materialize(salted.withColumn("content", F.when(F.col("hot"), F.col("content"))).drop("salt"), "dedup-salted")
    merged = (
        stored.filter("hot")
        .groupBy("digest", "content")
        .agg(F.max("best").alias("best"), F.sum("group_size").alias("group_size"))
    )
    groups = materialize(_flat(stored.filter("not hot").drop("hot").unionByName(merged)), "dedup-groups")
    colliding = groups.groupBy("digest").count().filter("count > 1").select("digest")
    if not colliding.head(1):
        return groups.drop("content"), None
    colliding = materialize(colliding, "dedup-colliding")
    again = (
        base.join(colliding, "digest", "left_semi")
        .groupBy("digest", "content")
        .agg(_best(), F.count(F.lit(1)).alias("group_size"))
    )
    return (
        groups.join(colliding, "digest", "left_anti").drop("content"),
        materialize(_flat(again), "dedup-again"),
    )


def assign(docs: DataFrame, digest=sha256_bytes, salts: int = SALTS, hot_share: int = HOT_SHARE) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept."""
    keys = materialize(_keyed(docs, digest, False), "dedup-keys")
    return _assigned(docs, keys, digest, *classes(docs, keys, digest, salts, hot_share))


def _assigned(docs: DataFrame, keys: DataFrame, digest, clear: DataFrame, colliding: DataFrame | None) -> DataFrame:
    columns = ["doc_id", "digest", "keep_id", "group_size", _kept().alias("kept")]
    out = keys.join(clear, "digest").select(*columns)
    if colliding is None:
        return out
    return out.unionByName(_keyed(docs, digest, True).join(colliding, ["digest", "content"]).select(*columns))


def _kept() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))


def keep_one(docs: DataFrame, digest=sha256_bytes, salts: int = SALTS, hot_share: int = HOT_SHARE) -> DataFrame:
    """The rows that stay, with all columns of *docs*; one row of each content.

    A doc_id that occurs once names its row; only rows of other ids are told apart by their texts.
    """
    keys = materialize(_keyed(docs, digest, False), "dedup-keys")
    clear, colliding = classes(docs, keys, digest, salts, hot_share)
    kept = materialize(_assigned(docs, keys, digest, clear, colliding).filter("kept").select("doc_id"), "dedup-kept")
    tm_id = fresh(docs, "tm_keep_id")
    unclear = keys.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(F.col("doc_id").alias(tm_id))
    unclear = materialize(unclear, "dedup-unclear")
    heads = kept.filter("doc_id is not null").select(F.col("doc_id").alias(tm_id))
    if not unclear.head(1):
        return docs.join(heads, F.col("doc_id") == F.col(tm_id), "left_semi").select(*docs.columns)
    clear_heads = heads.join(unclear, tm_id, "left_anti")
    rows = docs.join(clear_heads, F.col("doc_id") == F.col(tm_id), "left_semi").select(*docs.columns)
    # among the rows of repeated ids and of none, one of each content that no row of another id holds better
    content, chars = fresh(docs, "tm_content"), fresh(docs, "tm_chars")
    again = docs.join(unclear, F.col("doc_id").eqNullSafe(F.col(tm_id)), "left_semi")
    again = again.withColumns({content: normalised(), chars: F.char_length(text_or_empty()).cast("long")})
    best = clear.withColumn("content", F.lit(None).cast("string"))
    best = (best if colliding is None else best.unionByName(colliding)).select(
        F.col("digest").alias("tm_digest"), F.col("content").alias("tm_same"), F.col("keep_id").alias("tm_best"), F.col("keep_chars").alias("tm_most")
    )
    stays = (
        (digest(again[content]) == best["tm_digest"])
        & again["doc_id"].eqNullSafe(best["tm_best"])
        & (again[chars] == best["tm_most"])
        & (best["tm_same"].isNull() | (best["tm_same"] == again[content]))
    )
    one = again.join(best, stays, "left_semi").dropDuplicates([content])
    return rows.unionByName(one.select(*docs.columns))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents),
w AS (
  SELECT doc_id, content, chars,
         first_value(doc_id) OVER (PARTITION BY content ORDER BY chars DESC, doc_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         first_value(chars) OVER (PARTITION BY content ORDER BY chars DESC, doc_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_chars,
         count(*) OVER (PARTITION BY content) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND chars = keep_chars AS kept,
       sha256(content) AS text_sha256
FROM w
"""
