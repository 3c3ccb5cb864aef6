"""Registered query of the Merkle manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foresight.llm.merkle import manifest
from foresight.llm.registry import query, table
from foresight.llm.sql import crc32

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_STEP = 7


def _leaf(n_chars: str) -> str:
    values = ("doc_id", "source", "lang", n_chars, "text")
    parts = [f"coalesce(octet_length(encode(({v})::VARCHAR)) || ':' || ({v})::VARCHAR, '-')" for v in values]
    return f"sha256({' || '.join(parts)})"


SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
           CASE WHEN {crc32("doc_id::VARCHAR")} % {TAMPERED_STEP} = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS start,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i,
           count(*) OVER (PARTITION BY lang) AS n
    FROM documents
), tree AS (
    SELECT lang, 0 AS lvl, i, n, leaf AS h FROM leaves
    UNION ALL
    SELECT lang, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i))
    FROM tree WHERE n > 1 GROUP BY lang, lvl, i // 2, n
), subroots AS (
    SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
    FROM tree WHERE n = 1
), top AS (
    SELECT 0 AS lvl, i, n, subroot AS h FROM subroots
    UNION ALL
    SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i))
    FROM top WHERE n > 1 GROUP BY lvl, i // 2, n
), steps AS (
    SELECT l.doc_id, l.leaf, l.start, s.subroot, t.lvl AS lvl,
           CASE WHEN t.i < (l.i >> t.lvl) THEN 'L' ELSE 'R' END || t.h AS code
    FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
    JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND t.i = xor(l.i >> t.lvl, 1)
    UNION ALL
    SELECT l.doc_id, l.leaf, l.start, s.subroot, t.lvl,
           'N' FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
    JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND t.i = l.i >> t.lvl AND t.n > 1
    WHERE t.i = t.n - 1 AND t.i % 2 = 0
    UNION ALL
    SELECT l.doc_id, l.leaf, l.start, s.subroot, 1000 + t.lvl,
           CASE WHEN t.i < (s.i >> t.lvl) THEN 'L' ELSE 'R' END || t.h
    FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN top t ON t.i = xor(s.i >> t.lvl, 1)
    UNION ALL
    SELECT l.doc_id, l.leaf, l.start, s.subroot, 1000 + t.lvl, 'N'
    FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
    JOIN top t ON t.i = s.i >> t.lvl AND t.n > 1 WHERE t.i = t.n - 1 AND t.i % 2 = 0
    UNION ALL
    SELECT l.doc_id, l.leaf, l.start, s.subroot, 2000, 'E'
    FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
), proofs AS (
    SELECT doc_id, leaf, start, subroot, list(code ORDER BY lvl) AS codes FROM steps GROUP BY ALL
), folded AS (
    SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root,
           sha256(array_to_string(list_transform(codes, lambda c: substr(c, 2)), '')) AS proof_sha256,
           list_reduce(list_prepend(start, codes), lambda a, c: CASE
               WHEN c = 'E' THEN a WHEN c = 'N' THEN sha256(a)
               WHEN c[1] = 'L' THEN sha256(substr(c, 2) || a) ELSE sha256(a || substr(c, 2)) END) AS folded_root
    FROM proofs
)
SELECT *, folded_root = root AS verified FROM folded
"""


@query("op13_merkle_manifest", SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPERED_STEP == 0
    more = F.try_add("n_chars", F.lit(1))
    altered = {"n_chars": F.when(tampered, F.coalesce(more, "n_chars")).otherwise(F.col("n_chars"))}
    return manifest(table(spark, sf_dir, "documents"), FIELDS, "doc_id", "lang", altered)
