"""SQL of the study's error tables (the counterpart of ``study``)."""
from .inputs import splits_sql
from .queries_core import metrics_sql, quotas_sql
from .queries_vectors import RUN_VECTORS
from .study import STUDY_BASE, STUDY_DRAWS, STUDY_FRACTION, STUDY_LABELLED, STUDY_RATES, STUDY_WINDOWS

P = ("population", '"window"', "split")


def _renamed(text, **names):
    """CTE text with other CTE names."""
    for old, new in names.items():
        text = text.replace(f"{old} AS (", f"{new} AS (").replace(f"FROM {old} ", f"FROM {new} ").replace(f"FROM {old})", f"FROM {new})").replace(f"\n  FROM {old})", f"\n  FROM {new})")
    return text


STUDY_CENTROID = ("""by_run AS (SELECT instance, list(v ORDER BY run) AS vs FROM run_vectors GROUP BY instance),
vectors AS (
  SELECT l.*, CASE WHEN "window" = 1 THEN CAST(CASE WHEN passes >= ceil("window" / 2.0) THEN 1 ELSE 0 END AS VARCHAR)
                   ELSE CAST(CAST(passes AS BIGINT) AS VARCHAR) END AS stratum,
         list_transform(range(len(b.vs[1])), lambda i: list_avg(list_transform(l.train, lambda r: b.vs[r + 1][i + 1]))) AS v
  FROM labelled l JOIN by_run b USING (instance))""",
                  _renamed(quotas_sql((STUDY_FRACTION,), "vectors", P), sizes="v_sizes", slotted="v_slotted", shared="v_shared", ordered="v_ordered", quotas="v_quotas"),
                  """centres AS (
  SELECT population, "window", split, stratum, list(m ORDER BY i) AS centre FROM (
    SELECT population, "window", split, stratum, i, avg(x) AS m FROM (SELECT population, "window", split, stratum, unnest(v) AS x, unnest(range(len(v))) AS i FROM vectors) GROUP BY ALL)
  GROUP BY ALL),
centroid_chosen AS (
  SELECT * FROM (
    SELECT v.*, q.subset, q.quota, 'embedding_strata:centroid_pooled' AS method, row_number() OVER (PARTITION BY v.population, v."window", v.split, v.stratum, q.subset
             ORDER BY round(list_distance(v.v, c.centre), 9), v.instance) AS pick
    FROM vectors v JOIN v_quotas q USING (population, "window", split, stratum) JOIN centres c USING (population, "window", split, stratum))
  WHERE pick <= quota)""")


STUDY_STRATA = """strata AS (
  SELECT l.*, b.method, CASE b.method
      WHEN 'random' THEN '' WHEN 'repo_stratified' THEN repository
      WHEN 'difficulty_stratified' THEN CAST(difficulty AS VARCHAR) WHEN 'stability_stratified' THEN CAST(difficulty AS VARCHAR)
      WHEN 'repo_difficulty_stratified' THEN repository || '_' || CAST(difficulty AS VARCHAR)
      WHEN 'consistency_stratified' THEN CAST(CAST(passes AS BIGINT) AS VARCHAR)
      ELSE repository || '_' || CAST(CAST(passes AS BIGINT) AS VARCHAR) END AS stratum
  FROM (SELECT *, CASE WHEN passes >= ceil("window" / 2.0) THEN 1 ELSE 0 END AS difficulty FROM labelled) l,
       (VALUES ('random'), ('repo_stratified'), ('difficulty_stratified'), ('repo_difficulty_stratified'),
               ('consistency_stratified'), ('repo_consistency_stratified'), ('stability_stratified')) b(method)
  WHERE "window" >= 2 OR b.method NOT IN ('consistency_stratified', 'repo_consistency_stratified'))"""

DRAW_KEYS = ("population", '"window"', "split", "method", "subset", "draw")


def drawn_sql(name, seed):
    """CTE of the random selections of one seed stream."""
    return f"""{name} AS (
  SELECT * FROM (
    SELECT s.*, q.subset, q.quota, d.draw,
           row_number() OVER (PARTITION BY s.population, s."window", s.split, s.method, s.stratum, q.subset, d.draw
             ORDER BY md5('{seed}|' || s.population || '|' || s."window" || '|' || s.split || '|' || q.subset || '|' || s.method || '|' || d.draw || '|' || s.instance), s.instance) AS pick
    FROM strata s JOIN quotas q USING (population, "window", split, method, stratum), (SELECT unnest(range({STUDY_DRAWS})) AS draw) d
    WHERE s.method <> 'stability_stratified')
  WHERE pick <= quota)"""


def population_metrics_sql(selected, keys, prefix):
    """Error metrics of selections on populations (their rates joined by population), CTE ``<prefix>metrics``."""
    text = metrics_sql(selected, keys).replace("FROM picked p, rates q)", "FROM picked p JOIN rates q USING (population))")
    for name in ("picked", "erred", "metrics"):
        text = text.replace(f"{name} AS (", f"{prefix}{name} AS (").replace(f"FROM {name} ", f"FROM {prefix}{name} ").replace(f"FROM {name})", f"FROM {prefix}{name})")
    return text


PURE = STUDY_CENTROID[2].replace("centres AS (", "pure_centres AS (").replace("centroid_chosen AS (", "pure_chosen AS (").replace("JOIN centres c", "JOIN pure_centres c").replace(
    "embedding_strata:", "pure_embedding:").replace("FROM vectors)", "FROM pure_vectors)").replace("FROM vectors v", "FROM pure_vectors v").replace("v_quotas", "u_quotas")
PURE_QUOTAS = _renamed(quotas_sql((STUDY_FRACTION,), "pure_vectors", P), sizes="u_sizes", slotted="u_slotted", shared="u_shared", ordered="u_ordered", quotas="u_quotas")

COMMON = (*STUDY_BASE, splits_sql(STUDY_WINDOWS), STUDY_LABELLED, STUDY_STRATA, quotas_sql((STUDY_FRACTION,), "strata", ("population", '"window"', "split", "method")), STUDY_RATES)

SPLIT_TABLE = (*COMMON, RUN_VECTORS, *STUDY_CENTROID,
               """pure_vectors AS (SELECT * REPLACE ('' AS stratum) FROM vectors)""", PURE_QUOTAS, PURE,
               drawn_sql("drawn", "42"), population_metrics_sql("drawn", DRAW_KEYS, "b_"),
               """control AS (
  SELECT * FROM (
    SELECT s.*, q.subset, q.quota, row_number() OVER (PARTITION BY s.population, s."window", s.split, s.stratum, q.subset
             ORDER BY round((passes / s."window") * (1 - passes / s."window"), 9), s.instance) AS pick
    FROM strata s JOIN quotas q USING (population, "window", split, method, stratum) WHERE s.method = 'stability_stratified')
  WHERE pick <= quota)""",
               """fixed AS (
  SELECT population, "window", split, 'baselines:' || method AS method, subset, outcomes, test FROM control
  UNION ALL SELECT population, "window", split, method, subset, outcomes, test FROM centroid_chosen
  UNION ALL SELECT population, "window", split, method, subset, outcomes, test FROM pure_chosen)""",
               population_metrics_sql("fixed", ("population", '"window"', "split", "method", "subset"), "f_"),
               """split_table AS (
  SELECT population, "window", split, 'baselines:' || method AS method, subset, avg(rmse) AS rmse, max(maxerr) AS maxerr, avg(maxerr) AS maxerr_mean, avg(p95) AS p95
  FROM b_metrics GROUP BY population, "window", split, method, subset
  UNION ALL SELECT population, "window", split, method, subset, rmse, maxerr, maxerr, p95 FROM f_metrics)""")

POPULATION_TABLE = (*SPLIT_TABLE, """population_table AS (
  SELECT s.population, any_value(m.level) AS level, "window", method, subset, avg(rmse) AS rmse, max(maxerr) AS maxerr, max(maxerr_mean) AS maxerr_mean, avg(p95) AS p95
  FROM split_table s JOIN (SELECT population, max(level) AS level FROM members GROUP BY population) m USING (population) GROUP BY s.population, "window", method, subset)""")

DRAWS_TABLE = (drawn_sql("seeded", "determinism"), population_metrics_sql("seeded", DRAW_KEYS, "s_"), """draws AS (
  SELECT population, "window", subset, method, draw, avg(rmse) AS rmse, max(maxerr) AS maxerr FROM s_metrics GROUP BY population, "window", subset, method, draw)""")

WITH_OVERALL = """with_overall AS (
  SELECT population, level, "window", method, subset, rmse, maxerr, p95 FROM population_table
  UNION ALL SELECT population, any_value(level), 0, method, subset, avg(rmse), avg(maxerr), avg(p95) FROM population_table GROUP BY population, method, subset)"""
