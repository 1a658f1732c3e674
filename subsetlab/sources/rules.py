"""Masking rule sets: plain word lists and ordered patterns per dataset kind.

Only entries that can match are listed: tokens are words or upper-case placeholders in brackets, compared in lower case.
"""
from dataclasses import dataclass

# Fixed values of the masking rules.
FUNCTION_WORDS = ("the", "in", "with", "to", "of", "if", "is", "for", "and", "a", "not", "as", "on", "or", "be")
MONTHS = ("apr", "may", "jun", "jul", "aug")
HARNESS_WORDS = ("_", "1", "command", "working", "cd", "completed", "finished", "result", "exit")
PROTECTED = (
    "python", "java", "cpp", "asyncio", "test", "tests", "testing", "hypothesis", "fixture", "mock", "pytest", "unittest", "doc", "docs", "bug", "issue",
    "error", "fix", "patch", "code", "run", "profile", "loop")
PROTECTED_MORE = ("creating", "cloning", "destroying", "default", "database", "alias")

REPO_ID = (r"(?iU)\b\w+__\w+__\d+\b", "[REPO_ID]")
HASH_SEED = (r"(?iU)PYTHONHASHSEED=\d+", "[RANDOM_SEED]")
RANDOM_SEED = (r"(?U)--randomly-seed=\d+", "[RANDOM_SEED]")
TIMESTAMP = (r"(?U)\d{2}:\d{2}:\d{2}\.\d+", "[TIMESTAMP]")
DATETIME = (r"(?U)\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "[DATETIME]")
OBJECT_ID = (r"(?U)id='\d+'>", "[OBJ_ID]")
ISSUE_ID = (r"(?U)#\d+", "[ISSUE_ID]")
GENERATED_FILE = (r"(?U)file_\d+\.txt", "[GEN_FILE]")
UUID = (r"(?U)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "[UUID]")
ADDRESS = (r"(?U)\b\d{12,16}\b", "[MEM_ADDR]")
LINE_RANGE = (r"(?U)\b\d+~\d+\b", "[LINE_RANGE]")
STEP_MARKER = (r"(?U)【\d+】", "[STEP_MARKER]")
ENV_PATH = (r"(?U)/(?:opt|tmp|home|root|usr|var|etc|testbed|workspace)/[\w\-\.\/]+", "[ENV_PATH]")
PATH = (r"(?U)\/[\w\-\.\/]+", "[PATH]")
FLOAT = (r"(?U)\b\d+\.\d+\b", "[FLOAT]")
NUMBER = (r"(?U)\b\d+\b", "[NUM]")
PROGRESS_BAR = r"(?U)[\d\[\]]*\*\([\d\[\]a\*\(\)]+"

OUTCOME_TERMS = (
    "passed", "failed", "failures", "errors", "skipped", "xfailed", "xpassed", "fail", "pass", "success", "resolved", "successfully", "fixed", "tox",
    "pylint")
LIBRARY_TERMS = ("xarray", "dvc", "stix2", "scrapy", "beetbox")
ERROR_TAGS = {
    "traceback": "[LOG_TRACE]", "assertionerror": "[ERR_ASSERT]", "keyerror": "[ERR_KEY]", "valueerror": "[ERR_VALUE]",
    "attributeerror": "[ERR_ATTR]", "modulenotfounderror": "[ERR_IMPORT]", "importerror": "[ERR_IMPORT]", "typeerror": "[ERR_TYPE]",
    "nameerror": "[ERR_NAME]", "indexerror": "[ERR_INDEX]", "syntaxerror": "[ERR_SYNTAX]", "indentationerror": "[ERR_INDENT]",
    "timeouterror": "[ERR_TIMEOUT]", "exception": "[ERR_GENERIC]", "fatal": "[ERR_FATAL]", "error": "[ERR_GENERIC]",
}
NOISE = (
    "benchmark", "benchmarks", "timer", "calibration_precision", "min_rounds", "min_time", "max_time", "mean", "stddev", "rounds", "iterations", "warmup",
    "warmup_iterations", "disable_gc", "cpu", "msec", "pytestdeprecationwarning", "warnings", "warn", "default_loop_scope",
    "asyncio_default_fixture_loop_scope", "collected", "items", "session", "starts", "most", "recent", "call", "last", "randomly", "random_seed",
    "random", "seed", "assertequal", "assertequals", "assert_equal")
FIXTURES = ("fixture", "fixtures")
PERMISSION_TERMS = ("permission", "auth", "azimuth_time")


@dataclass(frozen=True)
class RuleSet:
    """One set of masking rules."""
    protected: tuple
    stop_words: tuple
    patterns: tuple
    leakage: tuple
    noise: tuple
    mask_compounds: bool
    progress_bar: str | None = None
    compound_min: int = 4
    term_min: int = 3


# Which rules each dataset kind uses.
RULE_SETS = {
    "multi_model": RuleSet(
        protected=PROTECTED + PROTECTED_MORE, stop_words=HARNESS_WORDS + ("code", "root") + FUNCTION_WORDS + MONTHS,
        patterns=(REPO_ID, HASH_SEED, RANDOM_SEED, TIMESTAMP, OBJECT_ID, ISSUE_ID, GENERATED_FILE, UUID, PATH, FLOAT, NUMBER),
        leakage=OUTCOME_TERMS + LIBRARY_TERMS + ("execution", "result", "observation", "antlr", "w0201", "attribute-defined-outside-init", "noqa", "f811", "a*([num]*a"),
        noise=NOISE + FIXTURES + PERMISSION_TERMS, mask_compounds=True),
    "single_setup": RuleSet(
        protected=PROTECTED, stop_words=HARNESS_WORDS + ("code",) + FUNCTION_WORDS,
        patterns=(REPO_ID, RANDOM_SEED, TIMESTAMP, OBJECT_ID, ISSUE_ID, GENERATED_FILE, UUID, PATH, FLOAT, NUMBER),
        leakage=OUTCOME_TERMS + LIBRARY_TERMS, noise=NOISE + FIXTURES, mask_compounds=False),
    "multi_agent": RuleSet(
        protected=PROTECTED + PROTECTED_MORE, stop_words=HARNESS_WORDS + ("root",) + FUNCTION_WORDS + MONTHS,
        patterns=(REPO_ID, HASH_SEED, RANDOM_SEED, TIMESTAMP, DATETIME, OBJECT_ID, ISSUE_ID, GENERATED_FILE, UUID, ADDRESS, LINE_RANGE, STEP_MARKER, ENV_PATH, FLOAT, NUMBER),
        leakage=OUTCOME_TERMS + ("noqa", "f811", "w0201", "attribute-defined-outside-init"),
        noise=NOISE + PERMISSION_TERMS + LIBRARY_TERMS + ("findfont", "scalable", "running", "creating", "table", "root"),
        mask_compounds=True, progress_bar=PROGRESS_BAR),
}
