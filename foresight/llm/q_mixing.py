"""Registered query of source mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foresight.llm.mixing import mix
from foresight.llm.registry import query, table


@query("op5_pivotal_mixing")
def pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )
