"""A fresh folder per run for round-trip queries, in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from fellwalk.operators.fixpoint import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
