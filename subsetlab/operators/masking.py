"""Masking of trajectory texts: repository names, outcome words, identifiers, noise; error words become tags."""
import re

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from ..sources.rules import ERROR_TAGS, RULE_SETS, RuleSet

TOKEN = r"(?U)(\[[A-Z_]+\]|\w+)"


def name_parts(repository: Column) -> Column:
    """Lower-case parts of a repository name."""
    return F.split(F.lower(repository), "[/_-]")


def repository_terms(repositories: DataFrame, rules: RuleSet) -> DataFrame:
    """Distinct name parts of all repositories that are long enough and not protected."""
    parts = repositories.select("repository").distinct().select(F.explode(name_parts(F.col("repository"))).alias("term"))
    return parts.where((F.length("term") >= rules.term_min) & ~F.col("term").isin(*rules.protected)).distinct()


def compound_pattern(repository: Column, rules: RuleSet) -> Column:
    """Row-dependent pattern of words that contain a part of the row's own repository; null when there is no such part."""
    parts = F.filter(name_parts(F.coalesce(repository, F.lit(""))), lambda p: (F.length(p) >= rules.compound_min) & ~p.isin(*rules.protected))
    quoted = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("\\Q"), p, F.lit("\\E"))), "|")
    return F.when(F.size(parts) > 0, F.concat(F.lit(r"(?iU)\b\w*("), quoted, F.lit(r")\w*\b")))


def leakage_pattern(rules: RuleSet) -> str:
    """One alternation of all outcome words, longest first."""
    terms = sorted(rules.leakage, key=len, reverse=True)
    return r"(?iU)\b(" + "|".join(re.escape(t) for t in terms) + r")\b"


def placeholders(text: Column, rules: RuleSet) -> Column:
    """Outcome words deleted and identifier shapes replaced, in the rule set's order."""
    if rules.progress_bar:
        text = F.regexp_replace(text, rules.progress_bar, " ")
    text = F.regexp_replace(text, leakage_pattern(rules), " ")
    for pattern, tag in rules.patterns:
        text = F.regexp_replace(text, pattern, tag)
    return text


def tokens_of(text: Column) -> Column:
    """Placeholders and words."""
    return F.regexp_extract_all(text, F.lit(TOKEN), 1)


def tag_and_collapse(tokens: Column) -> Column:
    """Error words → tags; a bracketed placeholder that repeats the token before it is dropped."""
    tags = F.create_map(*[F.lit(x) for pair in ERROR_TAGS.items() for x in pair])
    marked = F.transform(tokens, lambda t: F.struct(t.alias("raw"), F.try_element_at(tags, F.lower(t)).alias("tag")))
    shown = F.transform(marked, lambda e: F.struct(F.coalesce(e["tag"], e["raw"]).alias("token"), (e["tag"].isNull() & F.startswith(e["raw"], F.lit("["))).alias("loose")))
    return shown


def _kept(df: DataFrame, source: str, target: str) -> DataFrame:
    """Final text of a column of (token, loose) entries: each entry looks at the one before it, so the pass is linear."""
    repeated = lambda e, i: e["loose"] & (i > 0) & F.get(F.col(source), i - 1)["token"].eqNullSafe(e["token"])
    return df.withColumn(target, F.array_join(F.transform(F.filter(source, lambda e, i: ~F.coalesce(repeated(e, i), F.lit(False))), lambda e: e["token"]), " "))


def mask_texts(df: DataFrame, columns, rules: RuleSet, repositories: DataFrame, repository: str = "repository") -> DataFrame:
    """Masked versions of text columns; the name parts of all repositories are removed as tokens, by an anti join of any size."""
    fixed = sorted({*rules.stop_words, *rules.noise})
    masked = df.withColumn("_pattern", compound_pattern(F.col(repository), rules)) if rules.mask_compounds else df
    for name in columns:
        text = F.coalesce(F.col(name), F.lit(""))
        if rules.mask_compounds:
            text = F.when(F.col("_pattern").isNull(), text).otherwise(F.regexp_replace(text, F.col("_pattern"), F.lit("[REPO_VAR]")))
        masked = masked.withColumn(f"_t_{name}", F.filter(tokens_of(placeholders(text, rules)), lambda t: ~F.lower(t).isin(fixed)))
    masked = _without_terms(masked.drop("_pattern"), [f"_t_{name}" for name in columns], repository_terms(repositories, rules))
    for name in columns:
        masked = masked.withColumn(f"_e_{name}", tag_and_collapse(F.col(f"_t_{name}")))
        masked = _kept(masked, f"_e_{name}", name).drop(f"_t_{name}", f"_e_{name}")
    return masked


def _without_terms(df: DataFrame, columns, terms: DataFrame) -> DataFrame:
    """Token arrays without the given terms: the distinct tokens of a row meet the terms, only the hits return to the row and are filtered in place.

    The rows are written once with a number each, so that numbers and tokens stay together whatever is lost and redone.
    """
    keyed = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    distinct = F.array_distinct(F.flatten(F.array(*[F.transform(c, F.lower) for c in columns])))
    hits = (keyed.select("_row", F.explode(distinct).alias("term")).join(terms.select("term"), "term", "left_semi")
            .groupBy("_row").agg(F.collect_set("term").alias("_hits")))
    joined = keyed.join(hits, "_row", "left")
    for c in columns:
        joined = joined.withColumn(c, F.when(F.col("_hits").isNull(), F.col(c)).otherwise(F.filter(c, lambda t: ~F.array_contains("_hits", F.lower(t)))))
    return joined.drop("_row", "_hits")


def mask_records(records: DataFrame, rules_of_run: dict, default: str, repositories: DataFrame) -> DataFrame:
    """Mask description, action and observation of step records; every run uses its own rule set, other columns pass through."""
    parts = []
    for name in sorted({default, *rules_of_run.values()}):
        runs = [run for run, chosen in rules_of_run.items() if chosen == name]
        chosen = F.col("run").isin(runs) if runs else F.lit(False)
        if name == default:
            others = [run for run, other in rules_of_run.items() if other != name]
            chosen = ~F.col("run").isin(others) if others else F.lit(True)
        texts = [c for c in ("task_description", "action", "observation", "text") if c in records.columns]
        parts.append(mask_texts(records.where(chosen), texts, RULE_SETS[name], repositories))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
