"""Registered query of the secret scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foresight.llm.registry import query, table
from foresight.llm.secrets import scan, spans_text


@query("op2_secret_ownership")
def secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))

    def count(field: str, value: str) -> Column:
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("bigint")

    return found.select(
        "doc_id",
        *[count("kind", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(spans_text(F.filter("spans", lambda s: s["kind"] != "token")), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
        count("verdict", "live").alias("n_live"),
        count("verdict", "example").alias("n_example"),
    )
