"""Line dedup, repeated passages, personal data and quality against brute force."""
import math
import random

import pytest

from subsetlab.llm import lines, passages, pii, quality
from tests.llm import edge


def test_line_dedup_on_awkward_rows(spark):
    rows = edge.awkward_rows()
    want = edge.line_dedup({(d, t or "") for d, t in rows})
    got = lines.keep_lines(edge.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all((r.kept_text, r.n_lines, r.n_dropped) == want[r.doc_id, r.text or ""] for r in got)
    assert sum(r.n_dropped for r in got) == 6   # the body in three rows, the shared line twice and once
    assert "key" in got[0].asDict() and got[0]["key"] == "k"


def test_line_dedup_of_many_lines_uses_all_bitmap_words(spark):
    text = "\n".join(edge.LINE if k % 3 else f"{k}" for k in range(500))
    got = {r.doc_id: r for r in lines.keep_lines(edge.frame(spark, [(k, text) for k in range(3)])).collect()}
    assert got[2].n_dropped == 0 and got[0].n_dropped == 333 and got[0].kept_text == "\n".join(str(k) for k in range(0, 500, 3))


@pytest.mark.parametrize("hot", [False, True])
def test_passages_against_all_windows(spark, monkeypatch, hot):
    pick = random.Random(3)
    shared = ["".join(pick.choice("abcde ") for _ in range(pick.randint(60, 400))) for _ in range(5)]
    rows = [(k, "".join(pick.choice([*shared, "".join(pick.choice("abcdefgh") for _ in range(80))]) for _ in range(6))) for k in range(40)]
    rows += [(100, "z" * 700), (101, "é" * 300), (102, None), (103, rows[3][1]), (103, rows[3][1]), (None, rows[4][1]), (None, None), (104, rows[5][1]), (104, "other " + rows[6][1])]
    if hot:
        monkeypatch.setattr(passages, "MANY_RUNS", 2)
    monkeypatch.setattr(passages, "SEGMENT", 500)
    distinct = sorted({(-1 if d is None else d, t or "") for d, t in rows}, key=lambda r: r)
    got = passages.remove_repeats(edge.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    ordered = [(d, t.encode()) for d, t in distinct if d != 104 and not (d == -1 and not t)]
    want = {d: w for (d, _), w in zip(ordered, edge.repeats(ordered, 100))}
    for r in got:
        d = -1 if r.doc_id is None else r.doc_id
        if d in want and d < 104 and r.n_bytes:
            assert (sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) == want[d], d
    assert all(len(r.kept) + sum(s.end - s.start for s in r.spans) == r.n_bytes for r in got)


def test_base_spans_and_sanitised_text(spark):
    rows = edge.awkward_rows() + [(200, "a.b@c.de_f@g.hi 1.2.3.4.5 +1-234-567-8901 +12 345"), (201, "9" * 5000 + "@" + "a" * 3000 + ".com"), (202, ".".join("1234"))]
    got = pii.with_spans(edge.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [(s.start, s.kind_no, s.end) for s in r.pii_spans if s.kind_no < 4] == edge.base_spans(r.text or "")
    clean = {r.doc_id: r.text for r in pii.sanitise(edge.frame(spark, rows)).collect()}
    assert clean[13] == "Écrire à [EMAIL] ou [PHONE], carte [CARD], [IP] et 300.1.1.1"
    assert clean[0] is None and clean[1] == ""


def test_terms_that_reveal_an_entity_and_only_those(spark):
    filler = ["the report was long", "we met again today", "nothing else was said", "some other words here", "and the weather was fine"]
    rows = [(k, f"{filler[k % 5]} the Zanzibaroni office a{k} wrote mail@secret.org about the work and {filler[(k + 1) % 5]}") for k in range(8)]
    rows += [(100 + k, f"{filler[k % 5]} the office wrote about the work and {filler[(k + 2) % 5]}") for k in range(200)]
    df = edge.frame(spark, rows)
    got = pii.with_spans(df).collect()
    terms = {r.text[s.start:s.end] for r in got for s in r.pii_spans if s.kind_no == 4}
    assert terms == {"Zanzibaroni"}
    assert all(not r.pii_spans for r in got if r.doc_id >= 100)
    assert "Zanzibaroni" not in pii.sanitise(df).filter("doc_id = 1").first().text


def test_quality_counts_and_guarantee(spark):
    rows = edge.awkward_rows() + [(300, "a b c a b c\na b c\n\na b c # *")]
    got = quality.features(edge.frame(spark, rows)).collect()
    texts = sorted((edge.quality_counts(t or ""), d is None, d) for d, t in rows)
    assert sorted(((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.doc_id is None, r.doc_id) for r in got) == texts


def test_exact_binomial_tail(spark):
    df = spark.createDataFrame([(0, 10, 0.1), (3, 10, 0.1), (200, 10_000, 0.02), (5, 5, 0.3)], "k int, n int, p double")
    want = [sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1)) for k, n, p in ((0, 10, 0.1), (3, 10, 0.1))]
    got = [r[0] for r in df.select(quality.at_most("k", "n", "p")).collect()]
    assert got[:2] == pytest.approx(want) and 0.45 < got[2] < 0.55 and got[3] == pytest.approx(1)


def test_cutoffs_reject_bad_and_spare_good(spark):
    pick = random.Random(1)
    rows, labels = [], []
    for k in range(3000):
        bad = k % 4 == 0
        words = [("word" if not bad else "extraordinarily") + str(pick.randint(0, 10 ** 6)) for _ in range(60)]
        rows.append((k, " ".join(words)))
        labels.append((k, 0 if bad else 1, 0))
    df = edge.frame(spark, rows).selectExpr("doc_id", "text", "'xx' AS lang")
    counts = quality.features(df)
    cutoffs = quality.choose_cutoffs(counts, spark.createDataFrame(labels + [(1, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int"))
    kept = {r.doc_id: r.kept for r in quality.judge(counts, cutoffs).collect()}
    assert sum(kept[k] for k in kept if k % 4) >= 0.98 * 2250 and sum(kept[k] for k in kept if k % 4 == 0) < 10
    none = quality.choose_cutoffs(counts, spark.createDataFrame(labels[:20], "doc_id bigint, quality int, toxic int"))
    assert none.count() == 0 and all(r.kept for r in quality.judge(counts, none).collect())


def test_empty_tables(spark):
    df = edge.empty(spark)
    assert lines.keep_lines(df).count() == passages.remove_repeats(df).count() == pii.sanitise(df).count() == 0
    counts = quality.features(df)
    assert quality.judge(counts, quality.choose_cutoffs(counts, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))).count() == 0


def test_words_at_the_ends_of_a_text_and_beside_failing_matches_are_near(spark):
    filler = ["the report was long", "we met again today", "nothing else was said", "some other words here", "and the weather was fine"]
    mail = [(k, t) for k, t in enumerate(["Janeroe <jane@x.org> wrote", "so said jane@x.org Janeroe", "Janeroe <jane@x.org>", "today jane@x.org Janeroe"])]
    card = [(10 + k, f"{filler[k]} Zoltanov, flat {42 + k}, card 4111 1111 1111 1111, {filler[k + 1]}") for k in range(4)]
    rest = [(100 + k, f"{filler[k % 5]} flat card so said wrote today and {filler[(k + 2) % 5]}") for k in range(200)]
    got = pii.with_spans(edge.frame(spark, mail + card + rest)).collect()
    terms = {(r.doc_id, r.text[s.start:s.end]) for r in got for s in r.pii_spans if s.kind_no == 4}
    assert terms == {(k, "Janeroe") for k in range(4)} | {(10 + k, "Zoltanov") for k in range(4)}


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_every_occurrence_of_a_disclosing_term_is_replaced(spark, monkeypatch, broadcast):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", broadcast)
    filler = ["the report was long", "we met again today", "nothing else was said", "some other words here", "and the weather was fine"]
    far = " ".join(f"far{k}" for k in range(40))
    rows = [(k, f"{filler[k % 5]} the Zanzibaroni office wrote mail@secret.org about the work and {filler[(k + 1) % 5]} {far} ZANZIBARONI, at last") for k in range(8)]
    rows += [(50, f"{far} zanzibaroni"), (50, f"{far} zanzibaroni"), (50, "Zanzibaroni, zanzibaroni"), (None, "Zanzibaroni")]
    rows += [(100 + k, f"{filler[k % 5]} the office wrote about the work and {filler[(k + 2) % 5]} {far}") for k in range(200)]
    found = pii.with_spans(edge.frame(spark, rows), threshold=0.6).collect()
    assert len(found) == len(rows)
    terms = [r.text[s.start:s.end].lower() for r in found for s in r.pii_spans if s.kind_no == 4]
    assert terms == ["zanzibaroni"] * 21
    clean = pii.sanitise(edge.frame(spark, rows), threshold=0.6).collect()
    assert not any("zanzibaroni" in r.text.lower() for r in clean)
