"""Registered queries against SQL, and the pipeline's stages against plain versions."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import rows_of
from subsetlab.llm import queries, simhash
from tests.conftest import FOLDER
from tests.llm import edge


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns, got = rows_of(df.columns, df.collect())
    result = duck.execute(queries.ORACLE[name])
    assert (columns, got) == rows_of([d[0] for d in result.description], result.fetchall())


def test_stages_on_awkward_rows(spark):
    docs = edge.frame(spark, edge.awkward_rows())
    texts = {d: t for d, t in edge.awkward_rows()}
    stages = dict(corpus_pipeline.STAGES)
    spoken = stages["language_id"](spark, docs, None)
    assert spoken.columns == list(corpus_pipeline.COLUMNS)
    assert {r.doc_id for r in spoken.collect()} <= {d for d, t in texts.items() if t and any(map(str.isalpha, t))} | {None}
    lines = stages["line_dedup"](spark, docs, None).collect()
    want = edge.line_dedup({(d, t or "") for d, t in edge.awkward_rows()})
    assert sorted((r.doc_id is None, r.doc_id, r.text, r.n_chars) for r in lines) == sorted((d is None, d, want[d, t or ""][0], len(want[d, t or ""][0])) for d, t in edge.awkward_rows())
    clean = {r.doc_id: r.text for r in stages["sanitise"](spark, docs, None).collect()}
    assert "[EMAIL]" in clean[13] and clean[5] == edge.BODY
    assert stages["best_fit_packing"](spark, docs, None).agg(F.sum("length")).first()[0] > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, edge.empty(spark), None).count() == 0, name


def test_near_dedup_keeps_one_of_each_group(spark):
    words = [f"w{k * k % 997}" for k in range(300)]
    near = list(words)
    near[150] = "changed"
    other = [f"x{k * k % 991}" for k in range(300)]
    rows = [(4, " ".join(words)), (2, " ".join(words)), (9, " ".join(near)), (7, " ".join(other)), (7, " ".join(other)), (11, None), (12, "")]
    kept = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, edge.frame(spark, rows), None).collect())
    assert kept == [2, 7, 11]


def test_near_dedup_finds_similar_documents_and_spares_others(spark):
    """All pairs with a similarity of five-word shingles of 0.85 or more are in one group; none below 0.6 is linked."""
    docs = spark.read.parquet(FOLDER + "/documents.parquet")
    rows = docs.collect()
    shingles = {r.doc_id: set(simhash.shingle_hashes((r.text or "").encode(), 5).tolist()) for r in rows}
    holders = {}
    for d, s in shingles.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    near, close = edge.Groups(), edge.Groups()
    for d in shingles:
        near.find(d), close.find(d)
    for d, s in shingles.items():
        for e in {e for x in s for e in holders[x] if e < d}:
            j = len(s & shingles[e]) / len(s | shingles[e])
            if j >= 0.85:
                close.join(d, e)
            if j >= 0.6:
                near.join(d, e)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.RADIUS, corpus_pipeline.FINGERPRINT_WORDS).collect()}
    assert all(got[d] == got[close.find(d)] for d in got)
    assert all(near.find(d) == near.find(got[d]) for d in got)


def test_whole_pipeline_is_its_stages(spark):
    placed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert placed.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
    assert placed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert 150 < placed.select("doc_id").distinct().count() <= docs.select("text").distinct().count()


def test_near_dedup_links_isolated_pairs_at_the_similarity_and_no_others(spark):
    """Pairs of texts with a shingle similarity of exactly 0.8 are linked, pairs just below it are not; lengths from 8 words on."""
    rows, want = [], []
    for k, n in enumerate([4, 8, 12, 40, 80, 120, 200] * 40):   # common shingles; n / 4 more make 0.8, one more than that makes less
        words = [f"p{k}w{i}" for i in range(n + 4 + n // 4)]
        rows += [(10 * k, " ".join(words[:n + 4])), (10 * k + 1, " ".join(words))]
        words = [f"q{k}w{i}" for i in range(n + 5 + n // 4)]
        rows += [(10 * k + 2, " ".join(words[:n + 4])), (10 * k + 3, " ".join(words))]
        want += [10 * k, 10 * k + 2, 10 * k + 3]
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, edge.frame(spark, rows), None).collect()}
    assert set(want) <= kept
    assert len(kept - set(want)) <= 0.01 * 280


def test_near_dedup_tells_rows_without_or_with_a_repeated_id_apart(spark):
    text = {name: " ".join(f"{name}{k}" for k in range(40)) for name in "abcde"}
    rows = [(None, text["a"]), (None, text["b"]), (None, text["b"]), (None, text["c"]), (3, text["c"]), (5, text["c"]), (5, text["d"]), (5, text["e"])]
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, edge.frame(spark, rows), None).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in kept) == sorted((d is None, d, text[t]) for d, t in [(None, "a"), (None, "b"), (3, "c"), (5, "d"), (5, "e")])
