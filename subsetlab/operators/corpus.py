"""Corpus statistics: vocabulary, frequency ranking, token shapes, outcome keyness, term scan and the outcome probe."""
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ranking import hash_key, ordered
from ..session import cut_lineage

# Word pattern, placeholder patterns, stop words, limits and scanned terms of the corpus reports.
WORD = r"([a-zA-Z0-9_\-\.]+)"
SHAPE_MIN_LENGTH, SHAPE_MIN_DISTINCT, SHAPE_EXAMPLES = 4, 6, 5
G2_CRITICAL, MIN_COUNT, MIN_LENGTH = 10.83, 20, 3
STRIPPED = ".,;:()[]'\""
CONTENT_PATTERNS = (
    (r"(?U)--randomly-seed=\d+", "[RANDOM_SEED]"), (r"(?U)\d{2}:\d{2}:\d{2}\.\d+", "[TIMESTAMP]"), (r"(?U)id='\d+'>", "[OBJ_ID]"),
    (r"(?U)#\d+", "[ISSUE_ID]"), (r"(?U)file_\d+\.txt", "[GEN_FILE]"),
    (r"(?U)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "[UUID]"),
    (r"(?U)\/[\w\-\.\/]+", "[PATH]"), (r"(?U)\b\d+\.\d+\b", "[FLOAT]"), (r"(?U)\b\d+\b", "[NUM]"))
CONTENT_STOP_WORDS = (
    "_", "=", "#", "-", "[", "]", "&&", "+", "==", "0]", "1", "execute_bash:", "[The", "[Python", "interpreter:", "[Command", "[Current",
    "/opt/conda/envs/testbed/bin/python]", "directory:", "command", "working", "cd", "completed", "finished", "result", "File", "str_replace_editor:",
    "0.]", "exit", "code", "the", "in", "with", "to", "of", "if", "is", "for", "and", "a", "not", "as", "on", "or", "be")
SCANNED_TERMS = ("passed", "failed", "dvc", "stix2", "beetbox", "scrapy", "xarray", "pylint", "tox")
ABLATION_TERMS = (
    "test", "tests", "testing", "tested", "pytest", "unittest", "mock", "fixture", "fixtures", "assert", "assertion", "assertions", "hypothesis", "bdd",
    "asyncio", "setup", "teardown", "database", "db_field", "import")


def trajectory_text(steps: DataFrame, keys=("run", "trajectory"), trajectories: DataFrame = None) -> DataFrame:
    """One text per trajectory: description, then action and observation of every step in order (a trajectory is one document).

    ``trajectories`` (keys, task_description) also holds those without a step; their text is the description alone.
    """
    parts = F.array_sort(F.collect_list(F.struct("step_index", F.concat_ws(" ", "action", "observation").alias("t"))))
    texts = steps.groupBy(*keys).agg(F.first("task_description").alias("_d"), parts.alias("_p"))
    if trajectories is not None:
        texts = trajectories.select(*keys, F.col("task_description").alias("_d")).join(texts.drop("_d"), list(keys), "left")
    return texts.select(*keys, F.concat_ws(" ", F.array_compact(F.concat(F.array("_d"), F.coalesce("_p.t", F.array().cast("array<string>"))))).alias("text"))


def white_space_tokens(text: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def token_type(token: Column) -> Column:
    """Rough type of a vocabulary token."""
    return (F.when(token.rlike(r"^\d+$"), "number").when(token.rlike(r"^[a-f0-9]{8,}$"), "hex/hash")
            .when(F.contains(token, F.lit(".")) | F.contains(token, F.lit("/")), "path/file")
            .when(F.contains(token, F.lit("_")), "snake_case_var").otherwise("word"))


def vocabulary(documents: DataFrame, text: str = "text") -> DataFrame:
    """Total count and document count per token, share of documents, signal strength and type guess.

    A document sends each token once for every occurrence and once more as "seen here"; both counts come out of one shuffle with
    partial sums, without a distinct aggregate.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), 1)
    both = F.concat(F.transform(words, lambda w: F.struct(w.alias("token"), F.lit(1).alias("tf"), F.lit(0).alias("df"))),
                    F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("token"), F.lit(0).alias("tf"), F.lit(1).alias("df"))))
    counts = documents.select(F.explode(both).alias("w")).groupBy("w.token").agg(F.sum("w.tf").alias("total_count"), F.sum("w.df").alias("doc_count"))
    size = documents.agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    joined = counts.withColumn("_one", F.lit(1)).join(F.broadcast(size), "_one")
    percent = 100.0 * F.col("doc_count") / F.col("_n")
    return joined.select("token", token_type(F.col("token")).alias("type_guess"), "total_count", "doc_count", F.round(percent, 4).alias("percent"),
                         F.when((percent > 10) & (percent < 90), "HIGH").otherwise("LOW (Stop/Rare)").alias("signal_strength"))


def token_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences per white-space token."""
    return documents.select(F.explode(white_space_tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("count"))


def frequency_ranking(counts: DataFrame) -> DataFrame:
    """Rank by count and cumulative share of the corpus; ranks and running sums are built over ranges of (count, token), not in one task."""
    table = cut_lineage(counts)
    summed = ordered(table, [], [F.desc("count"), F.asc("token")], rank="rank", value="count", total="_upto")
    total = table.agg(F.sum("count").alias("_all")).withColumn("_one", F.lit(1))
    return (summed.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
            .select("rank", "token", "count", F.round(100.0 * F.col("_upto") / F.col("_all"), 4).alias("cumulative_percent")))


def token_shape(token: Column) -> Column:
    """Shape of a token: lower-case letters c, upper-case C, digits d; private markers keep the classes apart while they are replaced."""
    lower, upper, digit = "\ue000", "\ue001", "\ue002"
    shaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, r"\p{Ll}", lower), r"\p{Lu}", upper), r"\p{Nd}", digit)
    return F.translate(shaped, lower + upper + digit, "cCd")


def shape_report(counts: DataFrame) -> DataFrame:
    """Shapes of at least six distinct tokens: distinct tokens, volume, variety and the five most frequent examples."""
    shaped = counts.where(F.length("token") >= SHAPE_MIN_LENGTH).withColumn("shape", token_shape(F.col("token")))
    sizes = (shaped.groupBy("shape").agg(F.count(F.lit(1)).alias("unique_tokens"), F.sum("count").alias("total_volume"))
             .where(F.col("unique_tokens") >= SHAPE_MIN_DISTINCT))
    top = (shaped.withColumn("_r", F.row_number().over(Window.partitionBy("shape").orderBy(F.desc("count"), "token")))
           .where(F.col("_r") <= SHAPE_EXAMPLES).groupBy("shape").agg(F.array_sort(F.collect_list(F.struct("_r", "token"))).alias("_e")))
    return (sizes.join(top, "shape")
            .select("shape", "unique_tokens", "total_volume", F.round(F.col("unique_tokens") / F.col("total_volume"), 4).alias("variety_ratio"),
                    F.array_join("_e.token", " ").alias("examples")))


def content_tokens(text: Column) -> Column:
    """White-space tokens after placeholders, without surrounding punctuation, stop words and short tokens."""
    for pattern, tag in CONTENT_PATTERNS:
        text = F.regexp_replace(text, pattern, tag)
    bare = F.transform(F.split(text, r"(?U)\s+"), lambda t: F.btrim(t, F.lit(STRIPPED)))
    return F.filter(bare, lambda t: (F.length(t) >= MIN_LENGTH) & ~t.isin(*CONTENT_STOP_WORDS))


def keyness(documents: DataFrame, text: str = "text", passed: str = "passed", min_count: int = MIN_COUNT) -> DataFrame:
    """Log-likelihood keyness of every frequent token between passing and failing documents."""
    tokens = documents.select(F.col(passed).cast("boolean").alias("_p"), F.explode(content_tokens(F.col(text))).alias("token"))
    counts = cut_lineage(tokens.groupBy("token").agg(F.sum(F.col("_p").cast("long")).alias("count_pass"), F.sum((~F.col("_p")).cast("long")).alias("count_fail")))
    totals = counts.agg(F.sum("count_pass").alias("_tp"), F.sum("count_fail").alias("_tf")).withColumn("_one", F.lit(1))
    joined = counts.where(F.col("count_pass") + F.col("count_fail") >= min_count).withColumn("_one", F.lit(1)).join(F.broadcast(totals), "_one")
    both, everything = F.col("count_pass") + F.col("count_fail"), F.col("_tp") + F.col("_tf")
    term = lambda n, total: F.when(n > 0, n * F.ln(n / (total * both / everything))).otherwise(F.lit(0.0))
    g2 = 2.0 * (term(F.col("count_pass"), F.col("_tp")) + term(F.col("count_fail"), F.col("_tf")))
    rate = lambda n, total: 10000.0 * F.col(n) / F.col(total)
    scored = joined.withColumn("_g2", g2).withColumn("_rp", rate("count_pass", "_tp")).withColumn("_rf", rate("count_fail", "_tf"))
    return scored.select("token", F.when(F.col("_g2") > G2_CRITICAL, "LEAKAGE_RISK").otherwise("NEUTRAL").alias("category"),
                         (F.round("_g2", 2) + F.lit(0.0)).alias("keyness_score"), F.when(F.col("_rf") > F.col("_rp"), "FAIL").otherwise("PASS").alias("skew_direction"),
                         "count_pass", "count_fail", F.round(F.abs(F.col("_rp") - F.col("_rf")), 4).alias("normalized_diff"))


def seeded_sample(rows: DataFrame, key: str, n: int, seed="42") -> DataFrame:
    """The ``n`` rows with the smallest seeded hash: a reproducible sample (top-n keeps n rows per task, not the whole table)."""
    return rows.withColumn("_h", hash_key(seed, F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def first_per_run(rows: DataFrame, key: str, n: int, seed=None) -> DataFrame:
    """The first ``n`` rows of every run by key, or a seeded random choice of ``n``."""
    order = F.col(key) if seed is None else hash_key(seed, F.col("run"), F.col(key))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("run").orderBy(order, key))).where(F.col("_r") <= n).drop("_r")


def term_scan(documents: DataFrame, terms=SCANNED_TERMS, text: str = "text") -> DataFrame:
    """Documents that contain each term as a whole word; the terms are exploded inside the row."""
    found = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.regexp_like(F.lower(text), F.concat(F.lit(r"(?U)\b"), t, F.lit(r"\b"))))
    marked = documents.withColumn("_found", found)
    hits = marked.select(F.explode("_found").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("documents"))
    summary = marked.agg(F.sum((F.size("_found") > 0).cast("long")).alias("documents")).select(F.lit("(any)").alias("term"), F.coalesce("documents", F.lit(0)).alias("documents"))
    return hits.unionByName(summary)


def outcome_probe(documents: DataFrame, text: str = "text", label: str = "passed", key: str = "doc", removed=(), seed="42", features: int = 10_000):
    """How well the words predict the outcome: TF-IDF and logistic regression on a hash split of 70 / 30.

    Returns (summary, coefficients): accuracy against the majority rate, and one row per word with its coefficient.
    """
    share = F.conv(F.substring(hash_key(seed, F.col(key)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = cut_lineage(documents.select(F.col(key), F.col(text).alias("_text"), F.col(label).cast("double").alias("label"), share.alias("_share")))
    stop = StopWordsRemover.loadDefaultStopWords("english") + list(removed)
    pipeline = Pipeline(stages=[
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"(?U)\b\w\w+\b", gaps=False), StopWordsRemover(inputCol="_words", outputCol="_kept", stopWords=stop),
        CountVectorizer(inputCol="_kept", outputCol="_tf", vocabSize=features), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="features")])
    fitted = pipeline.fit(rows)
    vectors = cut_lineage(fitted.transform(rows).select(key, "label", "_share", "features"))
    model = LogisticRegression(maxIter=100, regParam=1e-4).fit(vectors.where(F.col("_share") < 0.7))
    scored = model.transform(vectors.where(F.col("_share") >= 0.7))
    accuracy = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("tested"))
    whole = rows.agg(F.count(F.lit(1)).alias("documents"), F.avg("label").alias("_rate")).select(
        "documents", F.greatest("_rate", 1 - F.col("_rate")).alias("majority_rate"))
    summary = whole.withColumn("_one", F.lit(1)).join(accuracy.withColumn("_one", F.lit(1)), "_one").drop("_one")
    spark = documents.sparkSession
    words = fitted.stages[2].vocabulary   # at most `features` words
    coefficients = spark.createDataFrame([(w, float(c)) for w, c in zip(words, model.coefficients.toArray())], "word string, coefficient double")
    return summary, coefficients
