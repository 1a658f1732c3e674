"""op5 and op8: packing and byte-level BPE over all documents."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.llm import bpe, packing
from subsetlab.llm.common import table


def op5_best_fit_packing(spark, sf_dir) -> DataFrame:
    import public_tokenizers
    pieces = packing.document_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_byte_level_bpe(spark, sf_dir) -> DataFrame:
    import public_tokenizers
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, pattern)
    decoded = bpe.decode_documents(encoded, ranks)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing, "op8_byte_level_bpe": op8_byte_level_bpe}
ORACLE = {}
