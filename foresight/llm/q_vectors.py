"""Registered queries of the vector operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foresight.llm.hnsw import nearest
from foresight.llm.pivots import near_vectors
from foresight.llm.products import top_products
from foresight.llm.registry import query, table

QUERY_STEP = 100
NEIGHBOURS = 10


@query("op9_pivot_permutations")
def pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op7_hnsw_shards")
def hnsw_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(f"vec_id % {QUERY_STEP} = 0"), k=NEIGHBOURS)


PRODUCT_STEP = 50
BEST_PRODUCTS = 5


@query(
    "op11_norm_sorted_products",
    f"""
    WITH usable AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS z
        FROM embeddings
        WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.z, c.z)::BIGINT AS score
        FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % {PRODUCT_STEP} = 0
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
    )
    SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= {BEST_PRODUCTS}
    """,
)
def norm_sorted_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.expr(f"vec_id % {PRODUCT_STEP} = 0"), k=BEST_PRODUCTS)
