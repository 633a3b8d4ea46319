"""Iteration with reliable checkpoints."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Without that setting only a session in one process can go on, in a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-ckpt-")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """Materialises `df` in the checkpoint folder and drops its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Callable[[DataFrame, DataFrame], bool],
            max_rounds: int = 200) -> DataFrame:
    """Applies `step` until `changed(old, new)` is False; raises when `max_rounds` is reached."""
    state = cut(state)
    for _ in range(max_rounds):
        new = cut(step(state))
        if not changed(state, new):
            return new
        state = new
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
