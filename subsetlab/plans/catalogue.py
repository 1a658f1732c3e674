"""All registered queries."""
from . import queries_core, queries_cost, queries_logs, queries_populations, queries_reports, queries_results, queries_sources, queries_stats, queries_text, queries_vectors

MODULES = (queries_core, queries_vectors, queries_populations, queries_cost, queries_logs, queries_text, queries_sources, queries_stats, queries_reports, queries_results)
QUERIES, ORACLE = {}, {}
for module in MODULES:
    QUERIES.update(module.QUERIES)
    ORACLE.update(module.ORACLE)

FLAGSHIP = "reference_comparison"
