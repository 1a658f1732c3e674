"""All queries of the operators and the SQL for those that SQL can state."""
from subsetlab.llm import queries_alignment, queries_chat, queries_pairs, queries_periods, queries_quality, queries_search, queries_text, queries_tokens

MODULES = (queries_pairs, queries_quality, queries_search, queries_text, queries_tokens, queries_chat, queries_search, queries_alignment, queries_periods)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
