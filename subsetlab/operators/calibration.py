"""Calibration of a subset: swaps until its training passes match the population's share."""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType


def swap_plan(gap, inside, outside):
    """Instances that leave and enter for one selection.

    ``inside`` / ``outside``: pass count -> instances in order. A swap must bring the total nearer to the target, which reduces the
    distance to it every time; swaps go on until the gap is closed or none helps.
    """
    inside = {c: list(v) for c, v in inside.items()}
    outside = {c: list(v) for c, v in outside.items()}
    start = {i for v in inside.values() for i in v}
    while gap:
        sign = 1 if gap > 0 else -1
        leaving = sorted((c for c, v in inside.items() if v), key=lambda c: sign * c)
        entering = sorted((c for c, v in outside.items() if v), key=lambda c: -sign * c)
        step = next(((a, b) for a in leaving for b in entering if 0 < sign * (b - a) < 2 * abs(gap)), None)
        if step is None:
            break
        out, back = inside[step[0]].pop(0), outside[step[1]].pop(0)
        inside.setdefault(step[1], []).append(back)
        outside.setdefault(step[0], []).append(out)
        gap -= step[1] - step[0]
    end = {i for v in inside.values() for i in v}
    return sorted(start - end), sorted(end - start)


def calibrate(selected: DataFrame, members: DataFrame, keys) -> DataFrame:
    """Calibrated selections (keys, instance).

    ``selected``: keys, instance, pick (its order); ``members``: keys without subset/method columns, instance, passes. Per selection
    and pass count as many instances of either side are gathered as the gap is wide: every swap but the last narrows it by one at least,
    so no more can be touched. The totals come from grouped sums. Selections are independent rows, so all of them are calibrated in one job.
    """
    keys = list(keys)
    shared = [k for k in keys if k in members.columns]
    sides = (members.select(*shared, "instance", "passes").join(selected.select(*keys).distinct(), shared)
             .join(selected.select(*keys, "instance", "pick"), [*keys, "instance"], "left"))
    chosen = F.col("pick").isNotNull()
    totals = sides.groupBy(*keys).agg(F.sum("passes").alias("_all"), F.count(F.lit(1)).alias("_n"), F.sum(chosen.cast("long")).alias("_k"),
                                      F.coalesce(F.sum(F.when(chosen, F.col("passes"))), F.lit(0)).alias("_inside"))
    gap = totals.select(*keys, (F.bround(F.col("_all") * F.col("_k") / F.col("_n")) - F.col("_inside")).cast("long").alias("_gap")).where(F.col("_gap") != 0)
    order = Window.partitionBy(*keys, "_in", "passes").orderBy(F.col("pick").asc_nulls_last(), "instance")
    front = (sides.join(gap, keys).withColumn("_in", chosen.cast("int")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.abs("_gap") + 1))
    queues = (front.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_in", "passes", "_r", "instance"))).alias("_q"))
              .withColumn("_side", F.col("_q._in")).withColumn("_level", F.col("_q.passes")).withColumn("_ids", F.col("_q.instance")).drop("_q").join(gap, keys))
    fields = [selected.schema[k] for k in keys]
    schema = StructType(fields + [selected.schema["instance"], StructField("enters", LongType())])

    def plan(batches):
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False, name=None):
                values = dict(zip(batch.columns, row))
                inside, outside = {}, {}
                for side, level, instance in zip(values["_side"], values["_level"], values["_ids"]):
                    (inside if side else outside).setdefault(int(level), []).append(instance)
                leave, enter = swap_plan(int(values["_gap"]), inside, outside)
                head = [values[k] for k in keys]
                rows += [[*head, i, 0] for i in leave] + [[*head, i, 1] for i in enter]
            yield pd.DataFrame(rows, columns=schema.fieldNames()) if rows else pd.DataFrame({n: np.array([], dtype=object) for n in schema.fieldNames()})

    changes = queues.select(*keys, "_side", "_level", "_ids", "_gap").mapInPandas(plan, schema)
    kept = selected.select(*keys, "instance").join(changes.where(F.col("enters") == 0), [*keys, "instance"], "left_anti")
    return kept.unionByName(changes.where(F.col("enters") == 1).select(*keys, "instance"))
