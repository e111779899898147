"""Shared helpers: table reads, the shared folder, arrow streaming."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where ``spark.checkpoint.dir`` is unset, on one machine (as in tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/tidemark"
#: A key is hot with over 1/HOT_SHARE of the rows: fewer than HOT_SHARE keys.
HOT_SHARE = 1000
#: Columns whose bytes :func:`slices` counts.
SIZED = (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; set here only where the session has none and runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is unset: on {master} it has to name a folder that all executors share")
        found = LOCAL_CHECKPOINTS
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write *df* to the shared folder and read it again: the lineage ends there.

    A lost executor then costs a reread instead of the whole chain of shuffles.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` wrote; nothing may read it afterwards."""
    spark = df.sparkSession
    base, jvm = shared_dir(spark), spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if jvm.org.apache.hadoop.fs.Path(base).toUri().getPath() in path.toUri().getPath():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that *df* does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text"):
    """The text column with null taken as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def skew_join(rows: DataFrame, lookup: DataFrame, *keys: str, hot_share: int = HOT_SHARE) -> DataFrame:
    """Inner join of *rows* with *lookup* (one row a key) on *keys*, whatever a key's share of *rows*.

    Keys with over one in *hot_share* of the rows, fewer than *hot_share* at any size,
    meet their rows by broadcast; all others by a shuffle.
    """
    on, total = list(keys), rows.count()
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(counts.filter(F.col("n") * hot_share > total).select(*on), "hot-keys")
    near = F.broadcast(lookup.join(F.broadcast(hot), on, "left_semi"))
    far = rows.join(F.broadcast(hot), on, "left_anti").join(lookup.hint("merge"), on)
    return rows.join(near, on).unionByName(far)


def map_rows(
    df: DataFrame,
    row_batch: Callable[[list[list]], list[list]],
    schema: pa.Schema,
    ddl: str,
    max_chars: int = 4_000_000,
) -> DataFrame:
    """``mapInArrow`` over column lists, in slices of bounded text.

    *row_batch* gets the columns of a slice as Python lists and returns the
    output columns.  A slice holds about *max_chars* characters (more only where
    a single text is longer), whatever the size of an arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, max_chars):
                columns = row_batch([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
                    schema=schema,
                )

    return df.mapInArrow(run, ddl)


def slices(batch: pa.RecordBatch, max_chars: int) -> Iterator[pa.RecordBatch]:
    """Cut a record batch where its string and binary columns reach *max_chars* bytes."""
    import pyarrow.compute as pc

    sizes = None
    for column in batch.columns:
        if any(of(column.type) for of in SIZED):
            n = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            sizes = n if sizes is None else sizes + n
    if sizes is None or int(sizes.sum()) <= max_chars:
        if batch.num_rows:
            yield batch
        return
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > max_chars:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def give_back() -> None:
    """Return memory that a worker has freed to its machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
