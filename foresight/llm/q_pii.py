"""Registered query of the PII operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foresight.llm.pii import PATTERNS, find, spans_text
from foresight.llm.registry import query, table


@query("op8_pii_disclosure")
def pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in PATTERNS],
        F.sha2(spans_text(F.filter("spans", lambda s: ~s["kind"].isin("number", "term"))), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
        count("number").alias("n_number"),
        count("term").alias("n_term"),
    )
