"""Text logs: white space, and logs that are split once."""
from pyspark.sql import functions as F

from subsetlab.operators import logs


def test_strip_takes_all_white_space(spark):
    marks = [chr(c) for c in range(1, 0x3100) if not 0x100 <= c < 0x1600] + ["​", "﻿"]
    texts = [f"{m}a{m}b{m}\n{m}" for m in marks] + ["", " \n\t", "a", "\r\n a \r\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", logs.strip(F.col("t")).alias("got"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_a_log_is_split_once(spark):
    text = "<problem_solver 0>s" + "".join(f"\n## Step {n}\n### 👁️ Observation\no{n}\n### 🎯 Action\nbash(command='ls {n}')" for n in range(1, 40)) + "</problem_solver 0>"
    table = spark.createDataFrame([(1, text)], "run int, text string")
    steps = logs.parse_text_logs(table)
    plan = steps._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<problem_solver 0>") == 1
    rows = steps.orderBy("step_index").collect()
    assert [r["action"] for r in rows] == [f"execute_bash: ls {n}" for n in range(1, 40)]
    assert [r["observation"] for r in rows] == [f"o{n}" for n in range(2, 40)] + [""]
