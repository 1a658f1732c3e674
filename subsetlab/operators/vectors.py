"""Step texts, step vectors, pooled and resampled trajectory vectors, instance vectors."""
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions import arrays

WINDOW_TOKENS, WINDOW_OVERLAP = 8_092, 200
SERIES_LENGTH = 8


def step_text(action: Column, observation: Column) -> Column:
    """Text of a step that is embedded."""
    return F.concat(F.lit("Action: "), F.coalesce(action, F.lit("")), F.lit(" | Result: "), F.coalesce(observation, F.lit("")))


def embedding_input(text: Column, longest=None, head: int = 15_000, tail: int = 10_000) -> Column:
    """Text that is embedded; with ``longest``, texts above so many characters keep their head and tail (``token_windows`` covers whole ones)."""
    if longest is None:
        return text
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, head), F.lit(" ... "), F.substring(text, -tail, tail))).otherwise(text)


def token_windows(df: DataFrame, tokens: str = "tokens", size: int = WINDOW_TOKENS, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """Overlapping token windows that cover the whole sequence: adds ``window_no`` and replaces the tokens by the window's."""
    stride = size - overlap
    n = F.size(tokens)
    windows = F.greatest(F.lit(0), F.ceil((n - size) / stride)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), windows), lambda i: F.slice(F.col(tokens), i * stride + 1, size))
    others = [c for c in df.columns if c != tokens]
    return df.select(*others, F.posexplode(starts).alias("window_no", tokens))


def encode_windows(df: DataFrame, text: str, load_encoder, size: int = WINDOW_TOKENS, overlap: int = WINDOW_OVERLAP, at_once: int = 32) -> DataFrame:
    """Adds ``vector``, the mean of the unit vectors of a text's token windows, and ``windows``, their number; a null text counts as empty.

    ``load_encoder()`` is called once per task. What it returns has ``tokenize(text) -> list``, ``join(tokens) -> text`` and
    ``encode(texts) -> matrix``. The windows of an Arrow batch are encoded in order of their length, ``at_once`` at a time, so that a
    model that pads its input wastes little; a text of one window is encoded as it is. A zero vector stays zero.
    """
    schema = StructType([*df.schema.fields, StructField("vector", ArrayType(DoubleType())), StructField("windows", IntegerType())])

    def run(batches):
        encoder = load_encoder()
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            owner, windows = [], []
            for row, whole in enumerate(texts):
                tokens = encoder.tokenize(whole)
                last = max(0, -(-(len(tokens) - size) // (size - overlap)))
                parts = [whole] if not last else [encoder.join(tokens[w * (size - overlap):w * (size - overlap) + size]) for w in range(last + 1)]
                owner += [row] * len(parts)
                windows += parts
            owner, order = np.array(owner, np.int64), sorted(range(len(windows)), key=lambda w: len(windows[w]))
            encoded = [None] * len(windows)
            for begin in range(0, len(order), at_once):
                some = order[begin:begin + at_once]
                vectors = np.asarray(encoder.encode([windows[w] for w in some]), float)
                length = np.sqrt(np.square(vectors).sum(axis=1, keepdims=True))
                for w, v in zip(some, vectors / np.where(length > 0, length, 1)):
                    encoded[w] = v
            counts = np.bincount(owner, minlength=len(texts))
            means = np.zeros((len(texts), len(encoded[0]) if encoded else 0))
            np.add.at(means, owner, np.array(encoded).reshape(len(owner), -1))
            means /= np.maximum(counts, 1)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * means.shape[1], pa.int32()), pa.array(means.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(counts, pa.int32())], names=[*batch.schema.names, "vector", "windows"])

    return df.mapInArrow(run, schema)


class TokenLengthEncoder:
    """A small encoder that needs no model: a text's vector counts its white-space tokens by their length modulo the width."""

    def __init__(self, width: int = 16):
        self.width = width

    def tokenize(self, text):
        return re.split(r"[ \t\n\f\r]+", text)

    def join(self, tokens):
        return " ".join(tokens)

    def encode(self, texts):
        return np.array([np.bincount([len(t) % self.width for t in self.tokenize(text)], minlength=self.width) for text in texts], float)


def hashed_embedding(df: DataFrame, text: str = "text", dimensions: int = 256) -> DataFrame:
    """Offline default encoder: hashed word counts scaled to unit length, all in the JVM."""
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"(?U)\w+", gaps=False, toLowercase=True).transform(df)
    counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions).transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
    return unit.withColumn("vector", vector_to_array("_unit")).drop("_words", "_tf", "_unit")


def pooled_vectors(steps: DataFrame, keys=("trajectory",), order: str = "step") -> DataFrame:
    """Trajectory vector: first, middle and last step, mean and population standard deviation over steps, concatenated.

    Only grouped aggregates are used, so a trajectory may have any number of steps: per dimension the mean and spread combine on
    the map side, and the three picked steps are selected by number.
    """
    keys = list(keys)
    bounds = steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    numbered = steps.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).join(bounds, keys)
    picked = numbered.groupBy(*keys).agg(
        F.first("_n").alias("steps"),
        F.max(F.when(F.col("_at") == 0, F.col("vector"))).alias("_first"),
        F.max(F.when(F.col("_at") == F.floor(F.col("_n") / 2), F.col("vector"))).alias("_middle"),
        F.max(F.when(F.col("_at") == F.col("_n") - 1, F.col("vector"))).alias("_last"))
    spread = (steps.select(*keys, F.posexplode("vector").alias("_d", "_x")).groupBy(*keys, "_d")
              .agg(F.avg("_x").alias("_mean"), F.stddev_pop("_x").alias("_std"))
              .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_d", "_mean", "_std"))).alias("_dims")))
    double = lambda c: F.col(c).cast("array<double>")
    return (picked.join(spread, keys)
            .select(*keys, "steps", F.concat(double("_first"), double("_middle"), double("_last"), F.col("_dims._mean"), F.col("_dims._std")).alias("vector")))


def resampled_vectors(steps: DataFrame, keys=("trajectory",), order: str = "step", length: int = SERIES_LENGTH) -> DataFrame:
    """Trajectories of any number of steps brought to ``length`` steps by linear interpolation, flattened.

    Every target position asks for its two neighbouring steps; a step answers the targets it is a neighbour of. Only the at most
    2 * length answers of a trajectory are shuffled together, not its steps.
    """
    keys = list(keys)
    numbered = (steps.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
                .join(steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys))
    place = F.col("_target") * (F.col("_n") - 1) / F.lit(float(length - 1))
    low = F.floor(place)
    high = F.least(low + 1, F.col("_n") - 1)
    weight = (F.when(F.col("_at") == low, 1.0 - (place - low)).otherwise(F.lit(0.0))
              + F.when((F.col("_at") == high), place - low).otherwise(F.lit(0.0)))
    answers = (numbered.withColumn("_target", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
               .where((F.col("_at") == low) | (F.col("_at") == high)).withColumn("_w", weight))
    parts = (answers.groupBy(*keys, "_target")
             .agg(F.collect_list(F.struct("_at", arrays.scale(F.col("vector"), F.col("_w")).alias("v"))).alias("_parts"))
             .withColumn("_v", F.aggregate(F.slice(F.array_sort("_parts"), 2, 2), F.array_sort("_parts")[0]["v"], lambda acc, p: arrays.add(acc, p["v"]))))
    return (parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_target", "_v"))).alias("_rows"))
            .select(*keys, F.flatten("_rows._v").alias("vector")))


def run_vector_arrays(run_vectors: DataFrame, n_runs: int) -> DataFrame:
    """One row per instance with its trajectory vectors in an array indexed by run (null where a run has none)."""
    cells = [F.max(F.when(F.col("run") == r, F.col("vector"))).cast("array<double>").alias(f"_{r}") for r in range(n_runs)]
    return (run_vectors.groupBy("instance").agg(*cells)
            .select("instance", F.array(*[F.col(f"_{r}") for r in range(n_runs)]).alias("vectors")))


def instance_vector(vectors: Column, train: Column) -> Column:
    """Instance vector: mean over the training runs that have one; null when none has."""
    present = F.filter(F.transform(train, lambda r: F.get(vectors, r)), lambda v: v.isNotNull())
    return arrays.mean_vector(present)


def compare_vectors(first: DataFrame, second: DataFrame, keys=("run", "trajectory", "step")) -> DataFrame:
    """Two vector sets side by side: presence, equal length, largest absolute difference and cosine per row."""
    joined = first.select(*keys, F.col("vector").alias("_a")).join(second.select(*keys, F.col("vector").alias("_b")), list(keys), "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.size("_a") == F.size("_b"))
    gap = F.array_max(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y)))
    return joined.select(*keys, F.col("_a").isNotNull().alias("in_first"), F.col("_b").isNotNull().alias("in_second"),
                         F.coalesce(both, F.lit(False)).alias("same_length"),
                         F.when(both, gap).alias("max_abs_difference"), F.when(both, arrays.cosine(F.col("_a"), F.col("_b"))).alias("cosine"))


def comparison_summary(compared: DataFrame, keys=("run", "trajectory")) -> DataFrame:
    """Per trajectory: steps on either side, equal shape, largest difference, lowest and mean step cosine."""
    return compared.groupBy(*keys).agg(
        F.sum(F.col("in_first").cast("long")).alias("steps_first"), F.sum(F.col("in_second").cast("long")).alias("steps_second"),
        F.min(F.col("same_length").cast("int")).cast("boolean").alias("same_shape"), F.max("max_abs_difference").alias("max_abs_difference"),
        F.min("cosine").alias("min_cosine"), F.avg("cosine").alias("mean_cosine"))
