"""Result sinks: JSON lines, summaries and comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_results(results: DataFrame, folder: str) -> None:
    """Rows as JSON lines, by baseline."""
    results.write.mode("overwrite").partitionBy("baseline_name").json(folder)


def write_summary(summary: DataFrame, folder: str) -> None:
    """A small summary as one JSON file."""
    summary.coalesce(1).write.mode("overwrite").json(folder)


def write_matrix(matrix: DataFrame, folder: str) -> None:
    """A comparison table as CSV with a header; zeros stay zeros and nulls are blank."""
    matrix.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def write_by_question(tables: DataFrame, folder: str) -> None:
    """A table by question_id, for point reads of one question."""
    tables.write.mode("overwrite").partitionBy("question_id").parquet(folder)


def write_training_data(rollouts: DataFrame, folder: str) -> None:
    """Each rollout's steps as JSON lines."""
    rollouts.write.mode("overwrite").json(folder)
