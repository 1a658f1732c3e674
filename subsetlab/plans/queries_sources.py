"""Queries on sources, sinks, run grouping and audits. Files are derived from the tables and live in the checkpoint folder."""
import uuid

from pyspark.sql import functions as F

from ..functions.arrays import clean
from ..operators import logs, runs
from ..session import checkpoint_dir, spread
from ..sources import audits, scans
from . import inputs
from .inputs import sql

QUERIES, ORACLE = {}, {}


def register(name, oracle=None):
    """Decorator: add a query, and its SQL when there is one."""
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function
    return add


def scratch(spark) -> str:
    """A new folder next to the checkpoints (shared by all executors)."""
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def rerun_table(spark, folder):
    """Raw rerun rows: a customer is an instance, each of its orders a trajectory; the outcome is spelled in several ways."""
    resolved = F.expr("CASE WHEN o_orderstatus = 'F' THEN CASE pmod(o_orderkey, 3) WHEN 0 THEN '1' WHEN 1 THEN 'True' ELSE 'success' END ELSE '0' END")
    customer = inputs.table(spark, folder, "customer").select("c_custkey", F.expr("CASE WHEN c_nationkey = 7 THEN NULL ELSE c_mktsegment END").alias("repository"))
    return (inputs.table(spark, folder, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("o_custkey").alias("instance"), "repository", resolved.alias("resolved"), F.col("o_orderkey").alias("trajectory")))


RERUNS = """reruns AS (
  SELECT o_custkey AS instance, CASE WHEN c_nationkey = 7 THEN NULL ELSE c_mktsegment END AS repository, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS passed, o_orderkey AS trajectory,
         count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM orders JOIN customer ON c_custkey = o_custkey),
kept AS (SELECT n FROM reruns WHERE run = 1 GROUP BY n HAVING count(*) > 50)"""


def assigned(spark, folder):
    """Runs by file order after a parquet round trip."""
    path = scratch(spark)
    rerun_table(spark, folder).orderBy("trajectory").write.parquet(path)
    scanned = scans.scan_trajectories(spark, path)
    return runs.assign_runs(scanned, ["file_order"]).withColumn("passed", runs.resolved_flag(F.col("resolved")))


@register("run_group_sizes", sql(RERUNS, query="SELECT n AS reruns, count(*) AS instances, n * count(*) AS trajectories FROM reruns WHERE run = 1 GROUP BY n HAVING count(*) > 50"))
def run_group_sizes(spark, folder):
    """G1: rerun counts shared by more than 50 instances."""
    return runs.run_group_sizes(rerun_table(spark, folder))


@register("assigned_runs", sql(RERUNS, query="SELECT n AS reruns, instance, CAST(run AS INTEGER) AS run, trajectory, passed FROM reruns WHERE n IN (SELECT n FROM kept)"))
def assigned_runs(spark, folder):
    """Parquet scan in file order, the i-th trajectory of an instance is run i."""
    return assigned(spark, folder).select("reruns", "instance", "run", "trajectory", "passed")


@register("run_group_statistics", sql(RERUNS, query="""
SELECT n AS reruns, CAST(run AS INTEGER) AS run, count(*) AS trajectories, CAST(sum(passed) AS BIGINT) AS resolved, count(DISTINCT coalesce(repository, '?')) AS repositories, round(sum(passed) / count(*), 6) AS resolve_rate
FROM reruns WHERE n IN (SELECT n FROM kept) GROUP BY GROUPING SETS ((n, run), (n))"""))
def run_group_statistics(spark, folder):
    """Statistics per run and per group."""
    return runs.run_statistics(assigned(spark, folder)).withColumn("resolve_rate", clean(F.col("resolve_rate")))


@register("run_group_summary", sql(RERUNS, query="""
SELECT reruns, max(instances) AS instances, count(*) AS runs, array_to_string(list(pct ORDER BY run), ' ') AS pct_per_run, min(pct) AS pct_min, max(pct) AS pct_max FROM (
  SELECT n AS reruns, run, count(*) AS instances, round(avg(passed) * 100, 4) AS pct FROM reruns WHERE n IN (SELECT n FROM kept) GROUP BY n, run) GROUP BY reruns"""))
def run_group_summary(spark, folder):
    """Resolve percentage of every run in run order."""
    summary = runs.run_group_summary(assigned(spark, folder))
    return summary.withColumn("pct_per_run", F.array_join(F.transform("pct_per_run", lambda x: x.cast("string")), " "))


@register("trajectory_map", sql(query="""
SELECT trajectory, arg_max(instance, path) AS instance, arg_max(repository, path) AS repository, arg_max(passed, path) AS passed FROM (
  SELECT CAST(o_custkey AS VARCHAR) AS trajectory, o_orderkey AS instance, coalesce(CASE WHEN c_nationkey = 7 THEN NULL ELSE c_mktsegment END, 'unknown') AS repository, o_orderstatus = 'F' AS passed,
         o_orderpriority || '/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS path FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY trajectory"""))
def trajectory_map(spark, folder):
    """Trajectory → instance map, the last file wins."""
    orders = inputs.table(spark, folder, "orders").join(inputs.table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    records = orders.select(F.col("o_custkey").cast("string").alias("trajectory"), F.col("o_orderkey").alias("instance"), F.expr("CASE WHEN c_nationkey = 7 THEN NULL ELSE c_mktsegment END").alias("repository"),
                            (F.col("o_orderstatus") == "F").alias("passed"), F.concat("o_orderpriority", F.lit("/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("path"))
    return runs.trajectory_map(records)


@register("repository_names", sql(RERUNS, query="SELECT DISTINCT coalesce(repository, 'unknown') AS repository FROM reruns WHERE n IN (SELECT n FROM kept)"))
def repository_names(spark, folder):
    """Repositories of all kept groups."""
    return runs.repository_names(rerun_table(spark, folder))


@register("message_log_scan", sql(query="""
SELECT CAST(conv_id % 5 AS VARCHAR) AS run, CAST(conv_id AS VARCHAR) AS trajectory, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS characters, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id"""))
def message_log_scan(spark, folder):
    """Conversations written as one JSON array per file and scanned back."""
    path = scratch(spark)
    parts = F.array(F.struct(F.lit("text").alias("type"), "text"))
    message = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("role", F.col("text").alias("content")))).otherwise(F.to_json(F.struct("role", parts.alias("content"))))
    table = inputs.table(spark, folder, "conversations")
    files = table.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("_m")).select(
        F.pmod("conv_id", F.lit(5)).alias("run"), F.col("conv_id").alias("trajectory"), F.concat(F.lit("["), F.array_join("_m.m", ","), F.lit("]")).alias("value"))
    files.write.partitionBy("run", "trajectory").text(path)
    scanned = scans.scan_message_logs(spark, path, r"run=(\d+)/", r"trajectory=(\d+)/")
    text = F.transform("messages", lambda m: F.length(logs.message_text(m["content"])))
    return scanned.select("run", "trajectory", F.size("messages").cast("long").alias("messages"), F.aggregate(text, F.lit(0), lambda a, b: a + b).cast("long").alias("characters"),
                          F.get("messages", F.lit(0))["role"].alias("first_role"))


@register("text_log_scan", sql(query="SELECT 'p' || (page_id % 5) AS run, CAST(page_id AS VARCHAR) AS trajectory, length(html) AS characters, md5(html) AS text_md5 FROM pages"))
def text_log_scan(spark, folder):
    """S3: pages written as whole text files and scanned back."""
    path = scratch(spark)
    pages = inputs.table(spark, folder, "pages").select(F.concat(F.lit("p"), F.pmod("page_id", F.lit(5)).cast("string")).alias("run"), "page_id", "html")
    # A file per page: tasks move their own files into place; by default the driver moves all of them, one after the other.
    spread(pages).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("lineSep", "\x1e").partitionBy("run", "page_id").text(path)
    scanned = scans.scan_text_logs(spark, path, r"run=(\w+)/", r"page_id=(\d+)/").withColumn("text", F.regexp_replace("text", "\x1e$", ""))
    return scanned.select("run", "trajectory", F.length("text").cast("long").alias("characters"), F.md5("text").alias("text_md5"))


@register("resolved_list_scan", sql(query="""SELECT CAST(o_orderkey % 5 AS VARCHAR) AS run, CAST(o_orderkey AS VARCHAR) AS trajectory FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 < 4"""))
def resolved_list_scan(spark, folder):
    """Resolved lists per run; the list of run 4 is unreadable and counts as empty."""
    path = scratch(spark)
    solved = inputs.table(spark, folder, "orders").where(F.col("o_orderstatus") == "F")
    lists = solved.groupBy(F.pmod("o_orderkey", F.lit(5)).alias("run"), F.pmod("o_orderkey", F.lit(64)).alias("part")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("resolved"))
    body = F.when(F.col("run") == 4, "{\"resolved\": [").otherwise(F.to_json(F.struct("resolved")))
    lists.select("run", "part", body.alias("value")).write.partitionBy("run", "part").text(path)
    return scans.scan_resolved(spark, path, r"run=(\d+)/")


@register("node_tree_scan", sql(query="""SELECT CAST(conv_id % 5 AS VARCHAR) AS run, 'c' || conv_id AS trajectory, count(*) AS steps FROM conversations WHERE role = 'assistant' GROUP BY conv_id"""))
def node_tree_scan(spark, folder):
    """Conversations as node trees in JSON files, scanned and flattened."""
    path = scratch(spark)
    step = F.struct(F.struct("turn").alias("action"), F.struct(F.col("text").alias("message")).alias("observation"))
    table = inputs.table(spark, folder, "conversations").where(F.col("role") == "assistant")
    trees = table.groupBy("conv_id").agg(F.array(F.struct(F.lit(1).alias("node_id"), F.array_sort(F.collect_list(step)).alias("action_steps"))).alias("nodes"))
    trees.select(F.pmod("conv_id", F.lit(5)).alias("run"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), F.to_json(F.struct("nodes")).alias("value")).write.partitionBy("run", "id").text(path)
    steps = logs.parse_node_trees(scans.scan_node_trees(spark, path, r"run=(\d+)/", r"id=(\w+)/"))
    return steps.groupBy("run", "trajectory").agg(F.count(F.lit(1)).alias("steps"))


@register("raw_file_resolution", sql(query="""
SELECT 'r' || (c_custkey % 3) AS run, CAST(c_custkey AS VARCHAR) AS instance, CASE WHEN c_custkey % 5 = 0 THEN NULL
  ELSE 'r' || (c_custkey % 3) || CASE WHEN c_custkey % 2 = 0 THEN '/trajs/' || c_custkey || '.traj' WHEN c_nationkey < 12 THEN '/trajs/' || c_custkey || '/trajectory.json' ELSE '/' || c_custkey || '.json' END END AS path FROM customer"""))
def raw_file_resolution(spark, folder):
    """First existing layout per instance, instances without a file reported."""
    customer = inputs.table(spark, folder, "customer").select(F.concat(F.lit("r"), F.pmod("c_custkey", F.lit(3)).cast("string")).alias("run"), F.col("c_custkey").cast("string").alias("instance"), "c_custkey", "c_nationkey")
    there = customer.where(F.pmod("c_custkey", F.lit(5)) != 0).select(F.explode(F.expr("""filter(array(if(pmod(c_custkey, 2) = 0, concat(run, '/trajs/', instance, '.traj'), null),
        if(c_nationkey < 12, concat(run, '/trajs/', instance, '/trajectory.json'), null), concat(run, '/', instance, '.json')), p -> p IS NOT NULL)""")).alias("path"))
    return scans.resolve_raw_files(customer.select("run", "instance"), there)


@register("vector_names", sql(query="""
SELECT CASE WHEN c_acctbal > 0 THEN 'SUCCESS_' ELSE 'FAIL_' END || lower(c_mktsegment) || '_cust_' || c_custkey || '_ts.npy' AS name, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS passed, lower(c_mktsegment) AS repository,
       'cust_' || c_custkey AS instance, lower(c_mktsegment) || '_cust_' || c_custkey AS trajectory FROM customer"""))
def vector_names(spark, folder):
    """Outcome, repository and instance from vector names."""
    stem = scans.vector_name(F.col("c_acctbal") > 0, F.col("c_mktsegment"), F.concat(F.lit("cust_"), F.col("c_custkey").cast("string")))
    return scans.parse_vector_names(inputs.table(spark, folder, "customer").select(F.concat(stem, F.lit("_ts.npy")).alias("name")))


@register("csv_round_trip", sql(query="SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_nationkey = 5 THEN NULL ELSE c_acctbal END AS balance FROM customer"))
def csv_round_trip(spark, folder):
    """Missing values and NaN become empty cells."""
    path = scratch(spark)
    rows = inputs.table(spark, folder, "customer").selectExpr("c_custkey", "CASE WHEN c_nationkey = 3 THEN NULL ELSE c_mktsegment END AS segment", "CASE WHEN c_nationkey = 5 THEN double('NaN') ELSE c_acctbal END AS balance")
    audits.write_csv(rows, path)
    return spark.read.option("header", True).schema("c_custkey long, segment string, balance double").csv(path)


@register("unified_records", sql(query="SELECT 'chat' AS dataset, CAST(conv_id % 5 AS INTEGER) AS run, count(*) AS steps, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY conv_id % 5"))
def unified_records(spark, folder):
    """Records partitioned by dataset and run, read back from JSON with partition pruning on the dataset."""
    path = scratch(spark)
    table = inputs.table(spark, folder, "conversations").select(F.lit("chat").alias("dataset"), F.pmod("conv_id", F.lit(5)).cast("int").alias("run"), "conv_id", F.col("text").alias("action"))
    audits.write_records(audits.union_formats([table.where(F.col("run") < 3), table.where(F.col("run") >= 3)]), path, "json")
    back = scans.scan_json(spark, path, "dataset string, run int, conv_id long, action string").where(F.col("dataset") == "chat")
    return back.groupBy("dataset", "run").agg(F.count(F.lit(1)).alias("steps"), F.sum(F.length("action")).alias("characters"))


@register("md5_audit", sql(query="""
SELECT CAST(page_id AS VARCHAR) AS name, CASE WHEN page_id % 7 = 0 THEN 'missing' WHEN page_id % 7 = 1 THEN 'extra' ELSE 'differs' END AS state FROM pages WHERE page_id % 7 IN (0, 1, 2)"""))
def md5_audit(spark, folder):
    """Stored files against an md5 manifest."""
    path = scratch(spark)
    docs = inputs.table(spark, folder, "pages").withColumnRenamed("page_id", "doc_id").withColumnRenamed("html", "text").withColumn("m", F.pmod("doc_id", F.lit(7)))
    docs.where(F.col("m") != 0).select("doc_id", "text").write.option("lineSep", "\x1e").partitionBy("doc_id").text(path)
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    files = stored.select(F.regexp_extract("path", r"doc_id=(\d+)/", 1).alias("name"), "content")
    body = F.concat(F.when(F.col("m") == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), F.lit("\x1e"))
    manifest = docs.where(F.col("m") != 1).select(F.col("doc_id").cast("string").alias("name"), F.md5(body).alias("md5"))
    return audits.md5_audit(files, manifest)


@register("run_completeness", sql(query="""
SELECT CAST(conv_id % 5 AS INTEGER) AS run, count(DISTINCT conv_id) AS found, CAST(CASE WHEN conv_id % 5 = 2 THEN (SELECT count(DISTINCT conv_id) // 5 FROM conversations) ELSE 500 END AS BIGINT) AS wanted,
       count(DISTINCT conv_id) = CASE WHEN conv_id % 5 = 2 THEN (SELECT count(DISTINCT conv_id) // 5 FROM conversations) ELSE 500 END AS complete FROM conversations GROUP BY conv_id % 5"""))
def run_completeness(spark, folder):
    """Trajectories per run against the expected number."""
    found = inputs.table(spark, folder, "conversations").select("conv_id").distinct()
    expected = found.agg(F.floor(F.count(F.lit(1)) / 5).alias("wanted")).select(F.lit(2).alias("run"), "wanted")
    return audits.completeness(found.withColumn("run", F.pmod("conv_id", F.lit(5)).cast("int")), expected)


@register("run_dimension", sql("""dimension(dataset, run, ordinal, parser, rules) AS (VALUES
  ('chat', '0', 0, 'openhands', 'multi_model'), ('chat', '1', 1, 'openhands', 'multi_model'), ('chat', '2', 2, 'trae', 'multi_model'), ('chat', '3', 3, 'openhands', 'multi_agent'), ('chat', '4', 4, 'openhands', 'multi_model'),
  ('pages', '2_runs/run_1', 0, 'rebench', 'single_setup'), ('pages', '2_runs/run_2', 1, 'rebench', 'single_setup'), ('pages', '3_runs/run_1', 2, 'rebench', 'single_setup'),
  ('pages', '3_runs/run_2', 3, 'rebench', 'single_setup'), ('pages', '3_runs/run_3', 4, 'rebench', 'single_setup')),
found AS (
  SELECT 'chat' AS dataset, CAST(conv_id % 5 AS VARCHAR) AS run, count(DISTINCT conv_id) AS trajectories FROM conversations GROUP BY ALL
  UNION ALL SELECT 'pages', CASE WHEN page_id % 5 < 2 THEN '2_runs/run_' || (page_id % 5 + 1) ELSE '3_runs/run_' || (page_id % 5 - 1) END, count(*) FROM pages GROUP BY ALL)""",
                               query="SELECT dataset, run, ordinal, parser, rules, coalesce(trajectories, 0) AS trajectories FROM dimension LEFT JOIN found USING (dataset, run)"))
def run_dimension(spark, folder):
    """Ordered runs of two datasets with parser and rules per run, and the trajectories found for each."""
    dimension = audits.run_dimension(spark, {
        "chat": {"runs": ("0", "1", "2", "3", "4"), "parser": "openhands", "rules": "multi_model", "run_parsers": {"2": "trae"}, "run_rules": {"3": "multi_agent"}},
        "pages": {"run_groups": (2, 3), "parser": "rebench", "rules": "single_setup"}})
    chat = inputs.table(spark, folder, "conversations").select(F.lit("chat").alias("dataset"), F.pmod("conv_id", F.lit(5)).cast("string").alias("run"), F.col("conv_id").alias("id")).distinct()
    place = F.pmod("page_id", F.lit(5))
    group = F.when(place < 2, F.concat(F.lit("2_runs/run_"), (place + 1).cast("string"))).otherwise(F.concat(F.lit("3_runs/run_"), (place - 1).cast("string")))
    pages = inputs.table(spark, folder, "pages").select(F.lit("pages").alias("dataset"), group.alias("run"), F.col("page_id").alias("id"))
    found = chat.unionByName(pages).groupBy("dataset", "run").agg(F.count(F.lit(1)).alias("trajectories"))
    return dimension.join(found, ["dataset", "run"], "left").withColumn("trajectories", F.coalesce("trajectories", F.lit(0)))
