"""Keyed checkpoints and iterative jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from arcframe.session import shared_dir


def keyed_checkpoint(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """df written once under label and read again by every later call with it."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{label}"
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.parquet(path)
    return spark.read.parquet(path)


def loop(df: DataFrame, step: Callable[[DataFrame], DataFrame], done: Callable[[DataFrame, DataFrame], bool], most: int) -> DataFrame:
    """step applied until done(before, after), at most `most` times, each result checkpointed."""
    shared_dir(df.sparkSession)
    for _ in range(most):
        after = step(df).checkpoint()
        if done(df, after):
            return after
        df = after
    return df
