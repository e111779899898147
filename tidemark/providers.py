"""Providers of what models and the web would answer; deterministic ones run offline."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ChatProvider(Protocol):
    def chat(self, prompts: list[str]) -> list[str]: ...


class EmbeddingProvider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbeddings:
    """Vectors from hashes of words: equal words, near vectors; for tests and offline runs."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out


class CannedAnswers:
    """Answers by a function of the prompt."""

    def __init__(self, answer: Callable[[str], str]):
        self.answer = answer

    def chat(self, prompts: list[str]) -> list[str]:
        return [self.answer(p) for p in prompts]


def answered(rows: DataFrame, prompt: str, provider: ChatProvider, retries: int = 3, batch: int = 512) -> DataFrame:
    """*rows* with ``answer`` and ``error``: prompts in batches, a failing batch retried, then reported and not raised."""
    out = rows.select("*", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("error"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                piece = part.iloc[at : at + batch].copy()
                error = None
                for _ in range(retries):
                    try:
                        piece["answer"], error = provider.chat(piece[prompt].tolist()), None
                        break
                    except Exception as e:  # noqa: BLE001  any failure of a provider is data
                        error = f"{type(e).__name__}: {e}"
                piece["error"] = error
                yield piece

    return out.mapInPandas(run, out.schema)


def embedded(rows: DataFrame, text: str, provider: EmbeddingProvider, max_chars: int = 8000, batch: int = 512) -> DataFrame:
    """*rows* with ``vector``, the texts cut to what the provider takes."""
    out = rows.select("*", F.lit(None).cast("array<float>").alias("vector"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                piece = part.iloc[at : at + batch].copy()
                piece["vector"] = provider.embed([(t or "")[:max_chars] for t in piece[text]])
                yield piece

    return out.mapInPandas(run, out.schema)


def with_missing_embedded(entities: DataFrame, known: DataFrame, text: str, provider: EmbeddingProvider) -> DataFrame:
    """entity_id and vector: the known ones, and those that are missing, embedded now."""
    missing = entities.join(known.select("entity_id"), "entity_id", "left_anti")
    return known.select("entity_id", "vector").unionByName(embedded(missing, text, provider).select("entity_id", "vector"))


def embedded_by_content(rows: DataFrame, text: str, provider: EmbeddingProvider, model: str, cache: str, max_chars: int = 8000) -> DataFrame:
    """*rows* with ``vector``, from a stored table of vectors by (model, digest of the text); what it lacks is embedded now and added to it.

    Only distinct texts that this model has not seen go to the provider, whatever the rows that hold them.  Vectors
    of other models are never read (the table is partitioned by model), so a changed model is built anew.  Texts are cut to
    what the provider takes before they are told apart; null is empty.  A row that a retried write adds again is read once.
    """
    spark = rows.sparkSession
    cut = F.substring(F.coalesce(F.col(text), F.lit("")), 1, max_chars)
    keyed = rows.withColumn("_digest", F.sha2(cut.cast("binary"), 256))
    folder = f"{cache}/model={model}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    empty = spark.createDataFrame([], "digest string, vector array<float>")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    known = spark.read.schema(empty.schema).parquet(folder) if there else empty
    texts = keyed.groupBy(F.col("_digest").alias("digest")).agg(F.first(cut).alias("text"))
    embedded(texts.join(known, "digest", "left_anti"), "text", provider, max_chars).select("digest", "vector").write.mode("append").parquet(folder)
    now = spark.read.schema(empty.schema).parquet(folder).dropDuplicates(["digest"]).withColumnRenamed("digest", "_digest")
    return keyed.join(now, "_digest").drop("_digest")


# Industries by keyword, in the order of precedence.
INDUSTRIES = (
    ("energy", "Energy & Utilities"), ("grid", "Energy & Utilities"), ("solar", "Energy & Utilities"),
    ("biotech", "Biotechnology & Pharma"), ("pharma", "Biotechnology & Pharma"), ("bio", "Biotechnology & Pharma"),
    ("health", "Healthcare"), ("medical", "Healthcare"), ("bank", "Financial Services"), ("fintech", "Financial Services"),
    ("payment", "Financial Services"), ("insurance", "Insurance"), ("telecom", "Telecommunications"), ("media", "Media & Entertainment"),
    ("travel", "Travel & Hospitality"), ("retail", "Retail & E-commerce"), ("manufacturing", "Manufacturing"),
    ("logistics", "Logistics & Supply Chain"), ("shipping", "Logistics & Supply Chain"), ("aerospace", "Aerospace & Defense"),
    ("education", "Education Technology"), ("government", "Government"), ("food", "Food & Beverage"), ("fashion", "Fashion & Apparel"),
    ("real estate", "Real Estate"),
)


def industry(company: Column, descriptions: Column, default: str = "Technology") -> Column:
    """The first keyword in the company's name, else the first in the descriptions (an array)."""
    out = None
    for text in (F.lower(company), F.lower(F.array_join(descriptions, " "))):
        for word, name in INDUSTRIES:
            hit = F.contains(text, F.lit(word))
            out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def best_snippet(snippets: Column, name: Column, least: int = 50) -> Column:
    """The first snippet that names the entity and is long enough, else the first, else nothing."""
    good = F.filter(snippets, lambda s: F.contains(F.lower(s), F.lower(name)) & (F.length(s) > least))
    return F.coalesce(F.get(good, F.lit(0)), F.get(snippets, F.lit(0)), F.lit(""))


def canonical_name(title: Column, name: Column) -> Column:
    """The head of a page title before the first separator (tried in order) whose head holds the name and is short; else the name."""
    out = None
    for separator in (" - ", " | ", " — ", " · ", ": "):
        head = F.trim(F.substring_index(title, separator, 1))
        fits = F.contains(title, F.lit(separator)) & F.contains(F.lower(head), F.lower(name)) & (F.length(head) < 50)
        out = F.when(fits, head) if out is None else out.when(fits, head)
    return out.otherwise(name)


def best_url(urls: Column, name: Column, key_chars: int = 6) -> Column:
    """The first address that holds the beginning of the name (without blanks and dashes), else the first, else nothing."""
    squeezed = lambda c: F.translate(F.lower(c), " -", "")
    key = F.substring(squeezed(name), 1, key_chars)
    own = F.filter(urls, lambda u: F.contains(squeezed(u), key))
    return F.coalesce(F.get(own, F.lit(0)), F.get(urls, F.lit(0)), F.lit(""))


def profile_url(urls: Column, site: str = "linkedin.com") -> Column:
    """The first address on a site, else nothing."""
    return F.coalesce(F.get(F.filter(urls, lambda u: F.contains(u, F.lit(site))), F.lit(0)), F.lit(""))


# The types of entities that are looked up, and names too general for it.
GROUNDED_TYPES = ("tool", "organization", "concept")
GENERAL_NAMES = ("python", "javascript", "html", "css", "sql", "git", "machine learning", "ai", "api", "database", "web")


def grounded(entities: DataFrame, found: DataFrame) -> DataFrame:
    """Entities with canonical, description, url and verified, from a table of search results.

    *entities*: entity_id, name, type.  *found*: name (as searched), position, title, snippet, url; the
    three first results of a name count, folded by an aggregate, and one join brings them to its entities.
    General names stand as they are; other types, and names without results, are not verified.
    """
    key = F.lower("name")
    kept = found.filter(F.col("position") <= 3).groupBy(key.alias("_key")).agg(F.array_sort(F.collect_list(F.struct("position", "title", "snippet", "url"))).alias("_found"))
    general, kind = key.isin(*GENERAL_NAMES), F.col("type").isin(*GROUNDED_TYPES)
    asked = entities.withColumn("_key", F.when(kind & ~general, key)).join(kept, "_key", "left")
    first = lambda c: F.get(F.filter(F.transform("_found", lambda r: r[c]), lambda x: x != ""), F.lit(0))
    names_it = lambda r: F.contains(F.lower(F.concat_ws(" ", r["title"], r["snippet"])), key)
    title = F.element_at(F.filter("_found", names_it), -1)["title"]
    known = kind & general
    named = F.when(F.size(F.filter("_found", names_it)) > 0, canonical_name(title, F.col("name"))).otherwise(F.col("name"))
    return asked.select(
        *entities.columns,
        F.when(known | F.col("_found").isNotNull(), F.when(known, F.col("name")).otherwise(named)).alias("canonical"),
        F.when(known, F.concat(F.lit("Well-known "), F.col("type"))).otherwise(F.substring(first("snippet"), 1, 200)).alias("description"),
        first("url").alias("url"),
        (F.coalesce(known, F.lit(False)) | F.col("_found").isNotNull()).alias("verified"),
    )
