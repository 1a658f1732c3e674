"""How far a subset's pass rate is from its population's on the test runs."""
from pyspark.sql import DataFrame, functions as F

from ..functions import arrays

SPLIT_KEYS = ("population", "window", "split")


def population_rates(members: DataFrame, n_runs: int) -> DataFrame:
    """Pass rate of every population in every run, as one short array per population (partial aggregation, one shuffle)."""
    rates = [F.avg(F.get("outcomes", F.lit(r))) for r in range(n_runs)]
    return members.groupBy("population").agg(F.array(*rates).alias("population_rates"))


def run_errors(selected: DataFrame, rates: DataFrame, keys, n_runs: int) -> DataFrame:
    """Signed error per test run of every selection: one row per selection with an ``errors`` array in run order.

    All run averages come out of a single grouped aggregate over the selected rows; nothing is exploded per run.
    """
    averages = [F.avg(F.get("outcomes", F.lit(r))) for r in range(n_runs)]
    picked = selected.groupBy(*keys).agg(F.array(*averages).alias("subset_rates"), F.first("test").alias("test"),
                                         F.count(F.lit(1)).alias("picked"))
    return _against(picked, rates)


def _against(picked: DataFrame, rates: DataFrame) -> DataFrame:
    """Errors of the selections' rates against their population's."""
    joined = picked.join(rates, "population")
    error = F.transform("test", lambda r: F.get("subset_rates", r) - F.get("population_rates", r))
    return joined.withColumn("errors", error).drop("subset_rates", "population_rates")


def run_totals(n_runs: int) -> dict:
    """Totals per run that ``drawn_errors`` needs (``selection.drawn_totals``)."""
    outcome = [F.get("outcomes", F.lit(r)) for r in range(n_runs)]
    return {f"_sum_{r}": (F.sum, F.sum, o) for r, o in enumerate(outcome)} | {f"_known_{r}": (F.count, F.sum, o) for r, o in enumerate(outcome)}


def drawn_errors(totals: DataFrame, rates: DataFrame, n_runs: int) -> DataFrame:
    """``run_errors`` of draws from their totals per run; the totals carry ``test``."""
    averages = F.array(*[F.when(F.col(f"_known_{r}") > 0, F.col(f"_sum_{r}") / F.col(f"_known_{r}")) for r in range(n_runs)])
    return _against(totals.withColumn("subset_rates", averages).drop(*run_totals(n_runs)), rates)


def split_metrics(errors: DataFrame) -> DataFrame:
    """RMSE, largest and 95th-percentile absolute error (in percentage points) of every selection."""
    points = F.transform("errors", lambda e: F.abs(e) * 100.0)
    return (errors.withColumn("rmse", F.sqrt(arrays.mean(F.transform("errors", lambda e: e * e))))
            .withColumn("maxerr", F.array_max(points))
            .withColumn("p95", arrays.quantile(points, 0.95)))


def deterministic_metrics(selected: DataFrame, rates: DataFrame, keys, n_runs: int) -> DataFrame:
    """Split metrics of selections without draws; the mean MaxErr equals the MaxErr."""
    measured = split_metrics(run_errors(selected, rates, keys, n_runs))
    return measured.select(*keys, "rmse", "maxerr", F.col("maxerr").alias("maxerr_mean"), "p95")


def stochastic_metrics(draws: DataFrame, keys) -> DataFrame:
    """Summary over draws: mean RMSE, largest and mean MaxErr, mean P95 and the draw whose RMSE is nearest the mean.

    Only (draw, RMSE) pairs are gathered, one per seed, so the array is as long as the number of seeds.
    """
    summary = draws.groupBy(*keys).agg(
        F.avg("rmse").alias("rmse"), F.max("maxerr").alias("maxerr"), F.avg("maxerr").alias("maxerr_mean"), F.avg("p95").alias("p95"),
        F.collect_list(F.struct("draw", F.col("rmse").alias("value"))).alias("_draws"))
    nearest = F.array_min(F.transform("_draws", lambda d: F.struct(F.round(F.abs(d["value"] - F.col("rmse")), 9).alias("gap"), d["draw"].alias("draw"))))
    return summary.withColumn("typical_draw", nearest["draw"]).drop("_draws")


def population_metrics(per_split: DataFrame, keys) -> DataFrame:
    """Population-level metrics over its splits: mean RMSE, largest MaxErr, largest mean MaxErr, mean P95."""
    return per_split.groupBy(*keys).agg(
        F.avg("rmse").alias("rmse"), F.max("maxerr").alias("maxerr"), F.max("maxerr_mean").alias("maxerr_mean"),
        F.avg("p95").alias("p95"), F.count(F.lit(1)).alias("splits"))
