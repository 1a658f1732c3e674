"""Line dedup: hashed lines in range partitions, first occurrences streamed, keep bitmaps returned instead of text.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Lines whose key is long enough and found in
enough documents stay only in the document with the largest id that holds the key. Only 128-bit hashes, ids and positions are shuffled;
the range partitions are cut by hash and document, so a line that every document holds is spread over many of them, and each partition
hands on one row per hash. The decision travels back as 64-bit words of a bitmap, only for words that drop a line.

Defined results: a null or empty text is one empty line; rows that repeat id and text are one document and get the same result, rows
with one id and different texts are documents of their own and all keep a key whose largest id they share; a null id is below all ids;
an empty table gives an empty table; columns other than the two named never meet the operator's own.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subsetlab.llm.common import ASCII_SPACE, content_key, lower_ascii, partitions
from subsetlab.session import cut_lineage

MIN_CHARS = 20
MIN_DOCUMENTS = 3


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(ASCII_SPACE)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(df: DataFrame, id_col="doc_id", text_col="text", min_chars=MIN_CHARS, min_documents=MIN_DOCUMENTS) -> DataFrame:
    """(id, content, words map<word, bits>) of documents that lose lines: bit p % 64 of word p / 64 is 0 if line p goes; absent words keep all."""
    lines = (df.select(F.col(id_col).alias("doc"), content_key(F.col(text_col)).alias("content"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
             .select("doc", "content", "pos", line_key(F.col("line")).alias("key"))
             .filter(F.length("key") >= min_chars)
             .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "content", "pos"))
    lines = cut_lineage(lines)   # read by the sampling of the range cuts, by the counts and by the join, but taken from the texts once
    ranged = lines.repartitionByRange(partitions(df.sparkSession), "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "content", "pos")
    held = ranged.groupBy("h1", "h2", "doc", "content").agg(F.collect_set("pos").alias("positions"))   # one row per line and document; no exchange
    common = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("documents"), F.max("doc").alias("last")).filter(F.col("documents") >= min_documents).drop("documents")
    common = cut_lineage(common)   # a shuffle of its own, so that the join can be split where one line has very many documents
    dropped = (held.join(common, ["h1", "h2"]).filter(~F.col("doc").eqNullSafe(F.col("last")))
               .select("doc", "content", F.explode("positions").alias("pos")))
    words = dropped.groupBy("doc", "content", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("gone"))
    return words.groupBy("doc", "content").agg(F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("gone")))).alias("words"))


def keep_lines(df: DataFrame, id_col="doc_id", text_col="text", **limits) -> DataFrame:
    """All columns of the input with ``kept_text``, ``n_lines`` and ``n_dropped``; the input's own columns of these names are replaced."""
    bitmaps = keep_bitmaps(df, id_col, text_col, **limits).select(F.struct("doc", "content").alias("_held"), F.col("words").alias("_words"))
    rows = df.drop("_held", "_words").withColumn("_row", F.struct(F.col(id_col).alias("doc"), content_key(F.col(text_col)).alias("content")))
    joined = rows.join(bitmaps.hint("shuffle_hash"), F.col("_row.doc").eqNullSafe(F.col("_held.doc")) & (F.col("_row.content") == F.col("_held.content")), "left")
    lines = lines_of(F.col(text_col))
    dense = F.transform(F.sequence(F.lit(0), F.expr("size(_lines) div 64").cast("int")), lambda w: F.coalesce(F.element_at("_words", w), F.lit(-1).cast("long")))
    joined = joined.withColumn("_lines", lines).withColumn("_dense", F.when(F.col("_words").isNotNull(), dense))
    kept = F.expr("filter(_lines, (line, p) -> (shiftright(_dense[p div 64], p % 64) & 1) = 1)")
    joined = joined.withColumn("_kept", F.when(F.col("_dense").isNotNull(), kept))
    return (joined.withColumn("kept_text", F.when(F.col("_kept").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.concat_ws("\n", "_kept")))
            .withColumn("n_lines", F.size("_lines").cast("long"))
            .withColumn("n_dropped", F.when(F.col("_kept").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size("_kept")).cast("long"))
            .drop("_row", "_held", "_words", "_lines", "_dense", "_kept"))
