"""op4 and op6: line dedup and sanitisation of all documents, on DataFrame functions alone."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.llm import lines, pii
from subsetlab.llm.common import LOWER, UPPER, table


def op4_line_dedup(spark, sf_dir) -> DataFrame:
    kept = lines.keep_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.col("kept_text"), "UTF-8"), 256).alias("kept_sha256"))


ORACLE_4 = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM cut),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

def op6_information_theoretic_pii(spark, sf_dir) -> DataFrame:
    spans = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*map(F.lit, pii.KINDS))

    def listed(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("pii_spans", lambda s: s["kind_no"] == kind)).cast("long").alias(f"n_{pii.KINDS[kind]}")

    base = F.filter("pii_spans", lambda s: s["kind_no"] < 4)
    return spans.select("doc_id", *map(number, range(4)), F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"))


QUERIES = {"op4_line_dedup": op4_line_dedup, "op6_information_theoretic_pii": op6_information_theoretic_pii}
ORACLE = {"op4_line_dedup": ORACLE_4}
