"""op12: tokens of two public tokenizers aligned over all documents."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.llm import alignment
from subsetlab.llm.common import table


def op12_tokenizer_alignment(spark, sf_dir) -> DataFrame:
    import public_tokenizers
    json_path, model_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = alignment.align_documents(table(spark, sf_dir, "documents"), json_path, model_path)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.encode(F.col("groups"), "UTF-8"), 256)).otherwise("")
    counted = alignment.with_link_counts(aligned.withColumn("groups_sha256", digest).drop("groups"), alignment.vocabulary_size(json_path))
    return counted.select("doc_id", *alignment.COUNTS, "n_best", "count_sum", "groups_sha256")


QUERIES = {"op12_tokenizer_alignment": op12_tokenizer_alignment}
ORACLE = {}
