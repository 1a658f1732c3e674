"""Queries on masking, corpus statistics and leakage.

RE2 (DuckDB) knows only ASCII word characters. The SQL therefore spells every accented letter as a short ASCII code before
patterns with word boundaries are applied and turns the codes back afterwards; Spark works on the text as it is.
"""
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.arrays import clean
from ..operators import corpus, masking, vectors
from ..session import spread
from ..sources import rules
from . import inputs
from .inputs import sql
from .queries_logs import LINES, _expected, parsed

QUERIES, ORACLE = {}, {}
ACCENTED = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü¡¿"
SAMPLE = 200


def register(name, oracle=None):
    """Decorator: add a query, and its SQL when there is one."""
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function
    return add


def _codes():
    return [(letter, f"qz{chr(ord('a') + i)}zq") for i, letter in enumerate(ACCENTED) if letter.isalpha()]


def encoded(text: str) -> str:
    """SQL: accented letters → codes."""
    for letter, code in _codes():
        text = f"replace({text}, '{letter}', '{code}')"
    return text


def decoded(text: str) -> str:
    """SQL: codes → accented letters."""
    for letter, code in _codes():
        text = f"replace({text}, '{code}', '{letter}')"
    return text


FOOTER = ("concat(text, '\\n acme__proj__', doc_id, ' PYTHONHASHSEED=', doc_id, ' --randomly-seed=7 12:00:01.5 2024-01-02T03:04:05 id=\\'', doc_id, '\\'> #', doc_id, ' file_', doc_id, "
          "'.txt 123e4567-e89b-12d3-a456-426614174000 123456789012 3~5 /tmp/a/b.py /x/y 1.5 2.5 7 8 9 passed failed KeyError keyerror Traceback error error the benchmark src1 xarray *([1]a* fixed')")
REPOSITORY = "concat(CASE lang WHEN 'en' THEN 'tion_kit/' WHEN 'fr' THEN 'ment-lab/' WHEN 'de' THEN 'heit/' ELSE 'ente/' END, source)"


def raw_documents(spark, folder):
    """Documents with a repository name and a harness-like last line, so that every masking rule has something to do."""
    return spread(inputs.table(spark, folder, "documents")).select(F.col("doc_id").alias("doc"), F.expr(FOOTER).alias("text"), F.expr(REPOSITORY).alias("repository"), "lang")


RAW = ("raw AS (SELECT doc_id AS doc, " + FOOTER.replace("\\n", "' || chr(10) || '").replace("\\'", "''") + " AS text, " + REPOSITORY + " AS repository, lang FROM documents)")


def _literal(pattern: str) -> str:
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''")


def mask_sql(rule_set: rules.RuleSet) -> str:
    """CTEs terms and masked(doc, text) for one rule set over ``raw``."""
    protected = ", ".join(f"'{w}'" for w in rule_set.protected)
    removed = ", ".join(f"'{w}'" for w in sorted({*rule_set.stop_words, *rule_set.noise}))
    tags = ", ".join(f"'{k}': '{v}'" for k, v in rules.ERROR_TAGS.items())
    text = "coded"
    if rule_set.mask_compounds:
        parts = f"list_filter(regexp_split_to_array(lower(repository), '[/_-]'), lambda p: length(p) >= {rule_set.compound_min} AND p NOT IN ({protected}))"
        text = f"regexp_replace({text}, '(?i)\\b\\w*(' || array_to_string({parts}, '|') || ')\\w*\\b', '[REPO_VAR]', 'g')"
    if rule_set.progress_bar:
        text = f"regexp_replace({text}, '{_literal(rule_set.progress_bar)}', ' ', 'g')"
    text = f"regexp_replace({text}, '{_literal(masking.leakage_pattern(rule_set))}', ' ', 'g')"
    for pattern, tag in rule_set.patterns:
        text = f"regexp_replace({text}, '{_literal(pattern)}', '{tag}', 'g')"
    return f"""terms AS (
  SELECT list(DISTINCT term) AS terms FROM (SELECT unnest(regexp_split_to_array(lower(repository), '[/_-]')) AS term FROM raw) WHERE length(term) >= {rule_set.term_min} AND term NOT IN ({protected})),
tokenised AS (
  SELECT doc, list_filter(regexp_extract_all({text}, '\\[[A-Z_]+\\]|\\w+'), lambda t: lower(t) NOT IN ({removed})) AS tokens
  FROM (SELECT doc, repository, {encoded("text")} AS coded FROM raw)),
filtered AS (
  SELECT doc, list_filter(tokens, lambda t: NOT list_contains(terms, lower(t))) AS tokens FROM tokenised, terms),
marked AS (
  SELECT doc, tokens, list_transform(tokens, lambda t: coalesce(MAP {{{tags}}}[lower(t)], t)) AS shown FROM filtered),
masked AS (
  SELECT doc, {decoded("array_to_string(list_transform(list_filter(list_zip(tokens, shown, list_concat(['']::VARCHAR[], shown[:-2])), lambda e: NOT (e[1] = e[2] AND e[1][1] = '[' AND e[3] = e[2])), lambda e: e[2]), ' ')")} AS text FROM marked)"""


def masked(spark, folder, rule_set="multi_model"):
    """Masked documents under one rule set."""
    raw = raw_documents(spark, folder)
    return masking.mask_texts(raw, ["text"], rules.RULE_SETS[rule_set], raw)


for _name in rules.RULE_SETS:
    @register(f"masked_texts_{_name}", sql(RAW, mask_sql(rules.RULE_SETS[_name]), query="SELECT doc, text FROM masked"))
    def masked_texts(spark, folder, rule_set=_name):
        """Masked text of every document."""
        return masked(spark, folder, rule_set).select("doc", "text")


@register("repository_terms", sql(RAW, query="""
SELECT DISTINCT term FROM (SELECT unnest(regexp_split_to_array(lower(repository), '[/_-]')) AS term FROM raw) WHERE length(term) >= 3 AND term NOT IN ('test', 'tests', 'docs', 'doc', 'code', 'run', 'fix', 'bug')"""))
def repository_terms(spark, folder):
    """Name parts of all repositories."""
    return masking.repository_terms(raw_documents(spark, folder), rules.RULE_SETS["multi_model"])


@register("masked_records", sql(RAW, mask_sql(rules.RULE_SETS["multi_agent"]).replace("masked AS (", "agent AS ("),
                                mask_sql(rules.RULE_SETS["single_setup"]).replace("terms AS (", "terms2 AS (", 1).replace(" tokenised, terms)", " tokenised2, terms2)").replace("tokenised AS (", "tokenised2 AS (").replace("filtered AS (", "filtered2 AS (").replace("FROM filtered)", "FROM filtered2)").replace("marked AS (", "marked2 AS (").replace("FROM marked)", "FROM marked2)").replace("masked AS (", "setup AS ("),
                                query="""
SELECT r.lang AS run, r.doc AS trajectory, CASE WHEN r.lang = 'en' THEN s.text ELSE a.text END AS observation, r.repository FROM raw r JOIN agent a USING (doc) JOIN setup s USING (doc)"""))
def masked_records(spark, folder):
    """Records masked with the rule set of their run."""
    raw = raw_documents(spark, folder).select(F.col("lang").alias("run"), F.col("doc").alias("trajectory"), F.col("text").alias("observation"), "repository")
    return masking.mask_records(raw, {"en": "single_setup"}, "multi_agent", raw)


def labelled_documents(spark, folder):
    """corpus(doc, text, repository, passed)."""
    labels = inputs.table(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("passed"))
    return spread(inputs.table(spark, folder, "documents")).join(labels, "doc_id").select(F.col("doc_id").alias("doc"), "text", F.col("source").alias("repository"), "passed")


@register("trajectory_texts", sql(LINES, _expected("openhands"), query="""
SELECT run, trajectory, md5('Order ' || trajectory || ' ' || array_to_string(list(action || ' ' || observation ORDER BY n), ' ')) AS text_md5 FROM steps GROUP BY run, trajectory"""))
def trajectory_texts(spark, folder):
    """V1: description, actions and observations of a trajectory as one text."""
    return corpus.trajectory_text(parsed(spark, folder, "openhands"), ("run", "instance", "trajectory")).select("run", "trajectory", F.md5("text").alias("text_md5"))


@register("vocabulary", sql("""words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9_\\-\\.]+')) AS token FROM documents),
counted AS (SELECT token, count(*) AS tf, count(DISTINCT doc_id) AS df, 100.0::DOUBLE * count(DISTINCT doc_id) / (SELECT count(*) FROM documents) AS pct FROM words GROUP BY token)""", query="""
SELECT token, CASE WHEN regexp_full_match(token, '\\d+') THEN 'number' WHEN regexp_full_match(token, '[a-f0-9]{8,}') THEN 'hex/hash' WHEN contains(token, '.') THEN 'path/file' WHEN contains(token, '_') THEN 'snake_case_var' ELSE 'word' END AS type_guess,
       tf AS total_count, df AS doc_count, round(pct, 4) AS percent, CASE WHEN pct > 10 AND pct < 90 THEN 'HIGH' ELSE 'LOW (Stop/Rare)' END AS signal_strength FROM counted"""))
def vocabulary(spark, folder):
    """V2: term and document counts."""
    return corpus.vocabulary(spread(inputs.table(spark, folder, "documents")))


TOKENS = """tokens AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS token FROM documents) WHERE token <> '' GROUP BY token)"""


@register("token_ranking", sql(TOKENS, query="""
SELECT row_number() OVER (ORDER BY n DESC, token) AS rank, token, n AS count, round(100.0::DOUBLE * sum(n) OVER (ORDER BY n DESC, token ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 4) AS cumulative_percent FROM tokens"""))
def token_ranking(spark, folder):
    """V3: tokens by frequency with the cumulative share."""
    return corpus.frequency_ranking(corpus.token_counts(spread(inputs.table(spark, folder, "documents"))))


@register("token_shapes", sql(TOKENS, """shaped AS (
  SELECT translate(regexp_replace(regexp_replace(regexp_replace(token, '\\p{Ll}', chr(57344), 'g'), '\\p{Lu}', chr(57345), 'g'), '\\p{Nd}', chr(57346), 'g'), chr(57344) || chr(57345) || chr(57346), 'cCd') AS shape, token, n
  FROM tokens WHERE length(token) >= 4)""", query="""
SELECT shape, count(*) AS unique_tokens, CAST(sum(n) AS BIGINT) AS total_volume, round(count(*) / sum(n), 4) AS variety_ratio, array_to_string(list(token ORDER BY n DESC, token)[1:5], ' ') AS examples
FROM shaped GROUP BY shape HAVING count(*) >= 6"""))
def token_shapes(spark, folder):
    """V4: character shapes of frequent tokens."""
    return corpus.shape_report(corpus.token_counts(spread(inputs.table(spark, folder, "documents"))))


def _content_sql():
    text = encoded("text")
    for pattern, tag in corpus.CONTENT_PATTERNS:
        text = f"regexp_replace({text}, '{_literal(pattern)}', '{tag}', 'g')"
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in corpus.CONTENT_STOP_WORDS)
    strip = corpus.STRIPPED.replace("'", "''")
    return f"""content AS (
  SELECT doc, passed, token FROM (
    SELECT doc_id AS doc, quality = 1 AS passed, trim(unnest(regexp_split_to_array({decoded("t")}, '\\s+')), '{strip}') AS token
    FROM (SELECT doc_id, quality, {text} AS t FROM documents JOIN labels USING (doc_id)))
  WHERE length(token) >= 3 AND token NOT IN ({stop}))"""


@register("content_tokens", sql(_content_sql(), query="SELECT token, count(*) AS n FROM content GROUP BY token"))
def content_tokens(spark, folder):
    """V5: content tokens of the labelled documents."""
    return labelled_documents(spark, folder).select(F.explode(corpus.content_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@register("outcome_keyness", sql(_content_sql(), """counted AS (
  SELECT token, count(*) FILTER (passed) AS a, count(*) FILTER (NOT passed) AS b FROM content GROUP BY token),
totals AS (SELECT sum(a)::DOUBLE AS ta, sum(b)::DOUBLE AS tb FROM counted),
scored AS (
  SELECT *, 2 * ((CASE WHEN a > 0 THEN a * ln(a / (ta * (a + b) / (ta + tb))) ELSE 0 END) + (CASE WHEN b > 0 THEN b * ln(b / (tb * (a + b) / (ta + tb))) ELSE 0 END)) AS g2,
         10000.0::DOUBLE * a / ta AS ra, 10000.0::DOUBLE * b / tb AS rb FROM counted, totals WHERE a + b >= 20)""", query="""
SELECT token, CASE WHEN g2 > 10.83 THEN 'LEAKAGE_RISK' ELSE 'NEUTRAL' END AS category, round(g2, 2) + 0.0 AS keyness_score, CASE WHEN rb > ra THEN 'FAIL' ELSE 'PASS' END AS skew_direction,
       a AS count_pass, b AS count_fail, round(abs(ra - rb), 4) AS normalized_diff FROM scored"""))
def outcome_keyness(spark, folder):
    """V6: keyness of every frequent token between good and bad documents."""
    return corpus.keyness(labelled_documents(spark, folder))


@register("seeded_sample", sql(query=f"SELECT doc_id AS doc, length(text) AS characters FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT {SAMPLE}"))
def seeded_sample(spark, folder):
    """Seeded sample of documents."""
    docs = inputs.table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), F.length("text").cast("long").alias("characters"))
    return corpus.seeded_sample(docs, "doc", SAMPLE)


@register("sample_per_run", sql(query="""SELECT run, doc FROM (
  SELECT lang AS run, doc_id AS doc, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || lang || '|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5"""))
def sample_per_run(spark, folder):
    """Seeded sample of five documents per run."""
    docs = inputs.table(spark, folder, "documents").select(F.col("lang").alias("run"), F.col("doc_id").alias("doc"))
    return corpus.first_per_run(docs, "doc", 5, "7")


SCAN_TERMS = ("the", "with", "les", "die", "passed", "sch", "que", "tion", "tox")


@register("term_scan", sql(f"found AS (SELECT doc_id, term, regexp_matches(lower({encoded('text')}), '\\b' || term || '\\b') AS hit FROM documents, (VALUES {', '.join(f'({chr(39)}{t}{chr(39)})' for t in SCAN_TERMS)}) v(term))", query="""
SELECT term, count(*) AS documents FROM found WHERE hit GROUP BY term UNION ALL SELECT '(any)', count(DISTINCT doc_id) FROM found WHERE hit"""))
def term_scan(spark, folder):
    """V8: documents that contain each term as a whole word."""
    return corpus.term_scan(spread(inputs.table(spark, folder, "documents")), SCAN_TERMS)


@register("outcome_probe")
def outcome_probe(spark, folder):
    """V7: accuracy of the outcome probe (fitted model: bounds are tested, values are not compared)."""
    summary, _ = corpus.outcome_probe(labelled_documents(spark, folder))
    return summary


@register("step_texts", sql(LINES, _expected("openhands"), query="""
SELECT run, trajectory, n AS step_index, length('Action: ' || coalesce(action, '') || ' | Result: ' || observation) AS characters FROM steps"""))
def step_texts(spark, folder):
    """Embedding input of every step."""
    steps = parsed(spark, folder, "openhands")
    text = vectors.embedding_input(vectors.step_text(F.col("action"), F.col("observation")))
    return steps.select("run", "trajectory", F.col("step_index").cast("long").alias("step_index"), F.length(text).cast("long").alias("characters"))


@register("token_windows", sql("""toks AS (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS t FROM documents)""", query="""
SELECT doc_id, w AS window_no, least(400, len(t) - w * 350) AS tokens, t[w * 350 + 1] AS first_token FROM (
  SELECT doc_id, t, unnest(range(greatest(0, CAST(ceil((len(t) - 400) / 350.0) AS BIGINT)) + 1)) AS w FROM toks)"""))
def token_windows(spark, folder):
    """Overlapping windows of 400 tokens, overlap 50, over whole documents."""
    docs = inputs.table(spark, folder, "documents").select("doc_id", F.split("text", r"\s+").alias("tokens"))
    windows = vectors.token_windows(docs, size=400, overlap=50)
    return windows.select("doc_id", F.col("window_no").cast("long").alias("window_no"), F.size("tokens").cast("long").alias("tokens"), F.get("tokens", F.lit(0)).alias("first_token"))


@register("encoded_windows", sql("""toks AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\f\\r]+') AS t FROM documents)""",
"""windows AS (SELECT doc_id, w, t[w * 350 + 1 : w * 350 + 400] AS part FROM (SELECT doc_id, t, unnest(range(greatest(0, CAST(ceil((len(t) - 400) / 350.0) AS BIGINT)) + 1)) AS w FROM toks)),
counts AS (SELECT doc_id, w, list_transform(range(16), lambda i: len(list_filter(part, lambda x: length(x) % 16 = i))::DOUBLE) AS c FROM windows),
units AS (SELECT doc_id, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS u FROM counts)""", query="""
SELECT doc_id, n AS windows, CAST(16 AS BIGINT) AS width, round(sqrt(list_sum(list_transform(m, lambda x: x * x))), 6) AS norm, round(m[5], 6) AS fifth
FROM (SELECT doc_id, n, list_transform(range(16), lambda i: list_avg(list_transform(us, lambda u: u[i + 1]))) AS m FROM (SELECT doc_id, count(*) AS n, list(u) AS us FROM units GROUP BY doc_id))"""))
def encoded_windows(spark, folder):
    """A caller's encoder over windows of 400 tokens, overlap 50, of whole documents, averaged per document."""
    docs = vectors.encode_windows(inputs.table(spark, folder, "documents").select("doc_id", "text"), "text", vectors.TokenLengthEncoder, size=400, overlap=50)
    return docs.select("doc_id", F.col("windows").cast("long").alias("windows"), F.size("vector").cast("long").alias("width"), clean(arrays.norm(F.col("vector"))).alias("norm"),
                       clean(F.get("vector", F.lit(4))).alias("fifth"))


@register("hashed_embeddings")
def hashed_embeddings(spark, folder):
    """Offline default encoder; length and norm of every document's vector."""
    docs = vectors.hashed_embedding(inputs.table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.size("vector").alias("dimensions"), clean(arrays.norm(F.col("vector"))).alias("norm"))
