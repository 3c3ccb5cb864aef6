"""Registered query of language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foresight.llm.langid import fit, held_out, predict
from foresight.llm.registry import query, table


@query("op3_language_kernel")
def language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out("doc_id", 5, 0)
    model = fit(docs.filter(~held))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
