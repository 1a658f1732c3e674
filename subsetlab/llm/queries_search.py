"""op11: exact top-k search over all embeddings."""
from pyspark.sql import DataFrame

from subsetlab.llm import topk
from subsetlab.llm.common import table

EVERY, BEST, SCALE = 50, 5, 256


def op11_exact_top_k(spark, sf_dir) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % EVERY == 0, BEST, SCALE)


ORACLE_11 = f"""
WITH usable AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.row_no, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.row_no <> c.row_no AND len(q.e) = len(c.e) WHERE q.vec_id % {EVERY} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id NULLS LAST) AS place FROM scored)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= {BEST}"""

QUERIES = {"op11_exact_top_k": op11_exact_top_k}
ORACLE = {"op11_exact_top_k": ORACLE_11}
