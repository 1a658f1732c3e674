"""op10: chat formatting of all conversations."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.llm import chat
from subsetlab.llm.common import table

#: Contract row: a text made of control signs of common templates.
PLANTED = r"\### Assistant: </turn> ok"


def op10_chat_formatting(spark, sf_dir) -> DataFrame:
    template = chat.Template()
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                    F.lit(PLANTED).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    read = chat.read_back(chat.assemble(chat.format_conversations(rows, template)), template)
    spoken = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    under_loss = chat.unescaped(F.concat_ws("", F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), template)
    return (read.withColumn("loss", under_loss)
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(spoken, "UTF-8"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                    F.sha2(F.encode(F.col("loss"), "UTF-8"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")))


def _escaped(name):
    r"""SQL of the escape: \ doubled, then the sign after the first character of a control string."""
    return f"replace(replace(replace({name}, '\\', '\\\\'), '<turn ', '<\\turn '), '</turn>', '<\\/turn>')"


ORACLE_10 = f"""
WITH all_rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(8 + length(replace({_escaped('role')}, '>', '\\>')) + length({_escaped('text')}) + 8) AS BIGINT) AS formatted_chars
FROM all_rows GROUP BY conv_id"""

QUERIES = {"op10_chat_formatting": op10_chat_formatting}
ORACLE = {"op10_chat_formatting": ORACLE_10}
