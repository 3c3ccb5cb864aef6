"""Registered query of the conversation prefix trie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foresight.llm.registry import query, table
from foresight.llm.sql import crc32
from foresight.llm.trie import conversation_trie

#: Conversations of a block start with turns of its first one; heads are shorter than HEADS.
BLOCK, HEADS = 5, 9

SQL = f"""
WITH own AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p,
           coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT c, count(*) AS n, c - c % {BLOCK} AS base, {crc32("c::VARCHAR")} % {HEADS} AS h FROM own GROUP BY c
), rebuilt AS (
    SELECT v.c, o.p AS d, o.role, o.text FROM convs v JOIN own o ON o.c = v.base AND o.p <= v.h
    UNION ALL
    SELECT v.c, o.p - v.h + least(v.h, coalesce(s.n, 0)), o.role, o.text
    FROM convs v JOIN own o ON o.c = v.c AND o.p > v.h LEFT JOIN convs s ON s.c = v.base
), members AS (
    SELECT c, d, octet_length(encode(text)) AS bytes,
           string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS k
    FROM rebuilt
    UNION ALL SELECT c, 0, 0, '' FROM convs
), lengths AS (
    SELECT c, max(d) AS len FROM members GROUP BY c
), nodes AS (
    SELECT k, d AS depth, min(m.c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
           sha256(coalesce(string_agg(CASE WHEN d = len THEN m.c::VARCHAR END, ',' ORDER BY m.c), '')) AS ends_sha256
    FROM members m JOIN lengths l ON l.c = m.c GROUP BY k, d
), linked AS (
    SELECT n.*, p.conv_id AS parent_conv_id, p.k AS parent_k
    FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.k = substr(n.k, 1, 64 * (n.depth - 1))
), kids AS (
    SELECT parent_k, count(*) AS n FROM linked WHERE parent_k IS NOT NULL GROUP BY parent_k
), counted AS (
    SELECT l.*, coalesce(kids.n, 0) AS n_children FROM linked l LEFT JOIN kids ON kids.parent_k = l.k
), subtrees AS (
    SELECT substr(b.k, 1, 64 * up.depth) AS k, sum((b.n_children = 0)::BIGINT)::BIGINT AS n_leaves,
           sum((b.n_convs - 1) * b.bytes)::BIGINT AS saved_tokens
    FROM counted b JOIN (SELECT DISTINCT depth FROM nodes) up ON up.depth <= b.depth GROUP BY 1
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM counted JOIN subtrees USING (k)
"""


@query("op12_conversation_trie", SQL)
def prefix_trie_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    head = F.crc32(conv.cast("string")) % HEADS
    return conversation_trie(table(spark, sf_dir, "conversations"), conv - conv % BLOCK, head)
