"""Session helpers: a session for local work and the checkpoint folder iterative jobs cut their lineage in."""
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores="8", shuffle_partitions=8, app_name="subsetlab"):
    """A session for tests and benchmarks on one machine; on a cluster use the session the cluster hands out."""
    return (SparkSession.builder.master(f"local[{cores}]").appName(app_name)
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "16g")
            .getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local folder is used only when nothing is set (tests)."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder: iterative operators cut their lineage there")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a DataFrame in the reliable checkpoint folder, so that lost executors never replay earlier rounds."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame, partition_by=()) -> DataFrame:
    """The rows as a table in the checkpoint folder, read again with its real size; readers prune columns and ``partition_by`` folders.

    For loops of joins: a checkpoint keeps the size that was estimated before it, and estimates of joins multiply from round to round.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def spread(df: DataFrame) -> DataFrame:
    """The same rows in at least as many partitions as there are cores, for work that is heavy per row.

    A table that already arrives in enough pieces is left alone, so large inputs are not shuffled; a small file with one row group
    would otherwise keep all but one core idle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str = "instance") -> DataFrame:
    """The same rows dealt to all shuffle partitions, for few rows that are about to be multiplied; such a small table would arrive in one piece.

    Dealt by a hash of the key: a table that is already placed by the key itself would be left as it is.
    """
    return df.repartition(partitions(df), F.xxhash64(key))


def partitions(df: DataFrame) -> int:
    """Number of shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
