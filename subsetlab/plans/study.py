"""The study on the driver's tables: populations with outcomes, and the error tables of several methods on them."""
from pyspark.sql import functions as F

from ..operators import comparisons, errors, populations, selection, splits, strata, vectors
from ..session import partitions, settled
from . import inputs
from .inputs import COMPLETE, N_RUNS, OUTCOMES, splits_sql
from .queries_core import whole_population

N_POPULATIONS = 72
POPULATION_SIZE = 60
STUDY_WINDOWS = (1, 2)
STUDY_FRACTION = 0.10
STUDY_DRAWS = 20
KEYS = ["population", "window", "split", "method"]
BASELINES = strata.ONE_RUN_BASELINES + strata.TWO_RUN_BASELINES


_STAGES = {}


def stage(spark, folder, name, build, partition_by=()):
    """A stage table that several queries read: built once per session and data folder, kept as Parquet in the checkpoint folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STAGES:
        _STAGES[key] = settled(build(), partition_by)
    return _STAGES[key]


def clear_stages():
    """Forget all stage tables (benchmarks time queries from the start)."""
    _STAGES.clear()


def drawn_populations(spark, folder):
    """Populations drawn from run 0, with each member's repository and outcome array."""
    def build():
        whole = whole_population(spark, folder).drop("population")
        source = whole.select("instance", F.get("outcomes", F.lit(0)).alias("passed"))
        return populations.draw_populations(source, N_POPULATIONS, POPULATION_SIZE).join(whole, "instance")
    return stage(spark, folder, "members", build)


def _plan_sql():
    each, extra = divmod(N_POPULATIONS, 9)
    rows, position = [], 0
    for order, level in enumerate(populations.LEVELS):
        for i in range(each + (1 if order < extra else 0)):
            rows.append(f"({position}, {int(level * 100)}, 'rate_{int(level * 100)}_run_{i}')")
            position += 1
    return ", ".join(rows)


MEMBERS = f"""plan(population, level, name) AS (VALUES {_plan_sql()}),
pool AS (
  SELECT p.*, c.instance, c.repository, c.outcomes,
         row_number() OVER (PARTITION BY p.population, c.outcomes[1] ORDER BY md5('populations|' || p.population || '|' || c.instance), c.instance) AS place,
         CASE WHEN c.outcomes[1] = 1 THEN {POPULATION_SIZE} * p.level // 100 ELSE {POPULATION_SIZE} - {POPULATION_SIZE} * p.level // 100 END AS wanted
  FROM plan p, complete c),
members AS (
  SELECT population, level, name, instance, repository, outcomes,
         row_number() OVER (PARTITION BY population ORDER BY md5('populations|order|' || population || '|' || instance), instance) - 1 AS member_pos
  FROM pool WHERE place <= wanted)"""

STUDY_LABELLED = """labelled AS (
  SELECT i.population, i.level, i.instance, i.repository, i.outcomes, s."window", s.split, s.train, s.test,
         list_sum(list_transform(s.train, lambda r: i.outcomes[r + 1])) AS passes
  FROM members i, splits s)"""

STUDY_RATES = f"""rates AS (
  SELECT population, [{", ".join(f"avg(outcomes[{r + 1}])" for r in range(N_RUNS))}] AS population_rates FROM members GROUP BY population)"""

STUDY_BASE = (OUTCOMES, COMPLETE, MEMBERS)


def labelled_members(spark, folder, windows=STUDY_WINDOWS):
    """Members of all populations once per split, with pass counts."""
    return strata.label_instances(splits.explode_splits(drawn_populations(spark, folder), N_RUNS, windows))


def baseline_draws(spark, folder, windows=STUDY_WINDOWS, fractions=(STUDY_FRACTION,), n_draws=STUDY_DRAWS, seed="42", baselines=BASELINES):
    """Errors of every draw of every random baseline on every population and split."""
    placed = labelled_members(spark, folder, windows)
    members = strata.baseline_strata(placed.repartition(partitions(placed), "population", "instance"), baselines)
    quotas = strata.stratum_quotas(members, KEYS, fractions)
    drawn = selection.drawn_totals(members, quotas, n_draws, errors.run_totals(N_RUNS), seed, carried=("test",))
    rates = errors.population_rates(drawn_populations(spark, folder), N_RUNS)
    return errors.split_metrics(errors.drawn_errors(drawn, rates, N_RUNS))


def split_table(spark, folder, windows=STUDY_WINDOWS, fractions=(STUDY_FRACTION,), n_draws=STUDY_DRAWS):
    """Split-level metrics (population, window, split, method, subset, rmse, maxerr, maxerr_mean, p95): baselines, control and centroid."""
    stochastic = errors.stochastic_metrics(baseline_draws(spark, folder, windows, fractions, n_draws), KEYS + ["subset"]).drop("typical_draw")
    chosen = deterministic_selections(spark, folder, windows, fractions)
    rates = errors.population_rates(drawn_populations(spark, folder), N_RUNS)
    fixed = errors.deterministic_metrics(chosen, rates, KEYS + ["subset"], N_RUNS)
    named = stochastic.withColumn("method", F.concat(F.lit("baselines:"), F.col("method")))
    return named.unionByName(fixed.select(*named.columns))


def split_vectors(spark, folder, windows=STUDY_WINDOWS):
    """(window, split, instance, vector): the mean training vector, computed once per instance and split, not per population."""
    from .queries_vectors import run_vectors

    def build():
        by_run = splits.explode_splits(vectors.run_vector_arrays(run_vectors(spark, folder), N_RUNS), N_RUNS, windows)
        return by_run.select("window", "split", "instance", vectors.instance_vector(F.col("vectors"), F.col("train")).alias("vector"))
    return stage(spark, folder, f"vectors-{windows}", build)


def centroid_selections(spark, folder, windows=STUDY_WINDOWS, fractions=(STUDY_FRACTION,), strata_used=True):
    """Centroid inside outcome strata, or on whole populations, for every population and split."""
    rows = (labelled_members(spark, folder, windows).join(split_vectors(spark, folder, windows), ["window", "split", "instance"], "left")
            .withColumn("stratum", strata.outcome_stratum(F.col("passes"), F.col("window")) if strata_used else F.lit("")))
    keys = ["population", "window", "split"]
    return selection.nearest_to_centre(rows, strata.stratum_quotas(rows, keys, fractions), keys)


def deterministic_selections(spark, folder, windows=STUDY_WINDOWS, fractions=(STUDY_FRACTION,)):
    """Control and centroid selections in one table."""
    columns = [*KEYS, "subset", "instance", "outcomes", "test"]
    members = strata.baseline_strata(labelled_members(spark, folder, windows), (strata.CONTROL,))
    control = selection.stability_control(members, strata.stratum_quotas(members, KEYS, fractions))
    centroid = centroid_selections(spark, folder, windows, fractions).withColumn("method", F.lit("embedding_strata:centroid_pooled"))
    pure = centroid_selections(spark, folder, windows, fractions, strata_used=False).withColumn("method", F.lit("pure_embedding:centroid_pooled"))
    return (control.withColumn("method", F.concat(F.lit("baselines:"), F.col("method"))).select(*columns)
            .unionByName(centroid.select(*columns)).unionByName(pure.select(*columns)))


def split_stage(spark, folder):
    """Split-level metrics as a stage table."""
    return stage(spark, folder, "splits", lambda: split_table(spark, folder), ("window",))


def draw_stage(spark, folder, seed="determinism"):
    """Per-seed values (population, window, subset, method, draw, rmse, maxerr) from a stream of their own."""
    def build():
        draws = baseline_draws(spark, folder, seed=seed)
        return comparisons.per_seed(draws, ["population", "window", "subset", "method"])
    return stage(spark, folder, f"draws-{seed}", build, ("window",))


def population_stage(spark, folder):
    """Population-level metrics per window, method and subset, with the population's level."""
    def build():
        table = errors.population_metrics(split_stage(spark, folder), ["population", "window", "method", "subset"])
        levels = drawn_populations(spark, folder).groupBy("population").agg(F.max("level").alias("level"))
        return table.join(levels, "population")
    return stage(spark, folder, "populations", build, ("window",))
