"""op2 and op9: quality rules and language ID over all documents."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.llm import langid, quality
from subsetlab.llm.common import table
from subsetlab.session import cut_lineage


def op2_quality_rules(spark, sf_dir) -> DataFrame:
    rows = cut_lineage(quality.features(table(spark, sf_dir, "documents")))
    cutoffs = quality.choose_cutoffs(rows, table(spark, sf_dir, "labels"))
    return quality.judge(rows, cutoffs).select("doc_id", *quality.COUNTS, "base_failed", "kept", "stratum")


def op9_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.filter(langid.fold() != 0))
    predicted = langid.predict(docs, model)
    return predicted.select("doc_id", F.coalesce(langid.fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "langs", "proportions")


QUERIES = {"op2_quality_rules": op2_quality_rules, "op9_language_id": op9_language_id}
ORACLE = {}
