"""Registered query of toxicity scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foresight.llm.registry import query, table
from foresight.llm.langid import held_out
from foresight.llm.toxicity import fit, score

THRESHOLD = 0.7


@query("op10_toxic_lexicon")
def toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out("doc_id", 3, 1)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held)
    scored = score(docs, fit(docs.filter(~held), labels))
    return scored.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
