"""Alignment against whole-text encoding, byte offsets and all overlapping pairs."""
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from subsetlab.llm import alignment, queries_alignment
from tests.llm import edge

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORDS = ["a", "the", "naïve", "日本語", "don't", "x=1;", "1,234.5", "Grüße", "—", "é", " ", "\x1c", "\x85", "\xa0", "\0", "<|endoftext|>", "<s>", "<0x0A>", "unbelievable", "));\r", "\U0001f600", "aaaaaaaaa", "'s", "_a"]
GAPS = [" ", " ", " ", "  ", "\n", "\n", "\n\n", "\t", " \n", "\n ", "   ", "", "\r\n"]


@pytest.fixture(scope="module")
def pair():
    return alignment.TokenizerPair(JSON, MODEL)


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    return a, b


def tokens_of(plain, pair, text):
    """(ids, byte ranges) of both sides over the whole text, or None."""
    if not text:
        return None
    a, b = plain[0].encode(" " + text, add_special_tokens=False).ids, plain[1].encode(text)
    raw, sides = (" " + text).encode(), []
    for ids, of in ((a, pair.bytes_a), (b, pair.bytes_b)):
        if b"".join(of[t] for t in ids) != raw:
            return None
        ends = [0]
        for t in ids:
            ends.append(ends[-1] + len(of[t]))
        sides.append((ids, list(zip(ends, ends[1:]))))
    return sides


def plain_alignment(plain, pair, text):
    """(n_a, n_b, n_groups, n_links, groups, Counter of linked id pairs)."""
    sides = tokens_of(plain, pair, text)
    if sides is None:
        return 0, 0, 0, 0, "", Counter()
    (a, at), (b, bt) = sides
    links = Counter((x, y) for x, (s, e) in zip(a, at) for y, (t, u) in zip(b, bt) if s < u and t < e)
    cuts = sorted({e for _, e in at} & {e for _, e in bt})
    groups = []
    for low, high in zip([0, *cuts], cuts):
        groups.append("|".join(",".join(str(t) for t, (s, e) in zip(ids, ranges) if low <= s and e <= high) for ids, ranges in sides))
    return len(a), len(b), len(groups), sum(links.values()), ";".join(groups), links


def plain_rows(plain, pair, texts):
    """The operator's rows for texts that are all documents of the corpus."""
    found = [plain_alignment(plain, pair, t) for t in texts]
    holds = Counter(p for *_, links in found for p in links)
    best = {}
    for (a, _), n in holds.items():
        best[a] = max(best.get(a, 0), n)
    return [(*head, sum(n for p, n in links.items() if holds[p] == best[p[0]]), sum(n * holds[p] for p, n in links.items())) for *head, links in found]


def odd_texts(number, seed):
    pick = random.Random(seed)
    return ["".join(pick.choice(WORDS) + pick.choice(GAPS) for _ in range(pick.randint(1, 25))) for _ in range(number)]


def test_bytes_of_ids_and_the_identity_map(pair):
    assert pair.bytes_a[pair.a.token_to_id("Ġthe")] == b" the" and pair.bytes_b[pair.b.piece_to_id("▁the")] == b" the"
    known = [(a, b) for a, b in enumerate(pair.same.tolist()) if b >= 0]
    assert len(known) > 10_000 and all(pair.bytes_a[a] == pair.bytes_b[b] for a, b in known)
    assert pair.bytes_b[pair.same[pair.bytes_a.index(b"A")]] == b"A" and not pair.b.is_byte(int(pair.same[pair.bytes_a.index(b"A")]))


def test_chunks_give_the_tokens_of_whole_texts(plain, pair):
    texts = odd_texts(1500, 3) + [" ", "  ", "\n", " a", "a ", "a\n", "▁", "a▁ b", "é" * 300, "ab" * 2000]
    aligner = alignment.Aligner(pair)
    for text, got in zip(texts, aligner.aligned(texts)):
        *head, links = plain_alignment(plain, pair, text)
        if got is None:
            assert head[0] == 0, text
            continue
        *found, codes, n = got
        assert found == head, text
        assert {(c >> 32, c & alignment.B_MASK): k for c, k in zip(codes.tolist(), n.tolist())} == links


def test_a_full_cache_changes_nothing(pair, monkeypatch):
    texts = odd_texts(60, 5)
    want = [None if r is None else (r[:5], r[5].tolist()) for r in alignment.Aligner(pair).aligned(texts)]
    monkeypatch.setattr(alignment, "CACHE_CHUNKS", 20)
    small = alignment.Aligner(pair)
    got = [None if r is None else (r[:5], r[5].tolist()) for t in texts for r in small.aligned([t])]
    assert got == want


@pytest.mark.parametrize("frequent", [1 << 18, 40, 0])
def test_counts_of_all_documents(spark, plain, pair, monkeypatch, frequent):
    """With a table of all pairs, of some and of none."""
    monkeypatch.setattr(alignment, "PAIRS_AT_ONCE", 50)
    rows = [*edge.awkward_rows(), *((200 + k, t) for k, t in enumerate(odd_texts(40, 7))), (300, "▁ gone"), (None, "don't")]
    aligned = alignment.align_documents(edge.frame(spark, rows).repartition(3), JSON, MODEL)
    got = alignment.with_link_counts(aligned, alignment.vocabulary_size(JSON), frequent)
    assert got.columns == ["doc_id", *alignment.COUNTS, "groups", "n_best", "count_sum"]
    want = [(d, *r) for (d, _), r in zip(rows, plain_rows(plain, pair, [t for _, t in rows]))]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_an_empty_table(spark):
    assert alignment.with_link_counts(alignment.align_documents(edge.empty(spark), JSON, MODEL), alignment.vocabulary_size(JSON)).count() == 0


def test_query_on_whole_documents(spark, plain, pair):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {}
    for (d, _), (*head, groups, n_best, count_sum) in zip(docs, sweep_rows(pair, plain, [t for _, t in docs])):
        want[d] = (*head, n_best, count_sum, edge.sha(groups) if head[0] else "")
    assert {r.doc_id: tuple(r)[1:] for r in queries_alignment.op12_tokenizer_alignment(spark, folder).collect()} == want


def sweep_rows(pair, plain, texts):
    """``plain_rows`` for longer texts: links from a sweep over both sides' ends."""
    found = []
    for text in texts:
        sides = tokens_of(plain, pair, text)
        if sides is None:
            found.append((0, 0, 0, 0, "", Counter()))
            continue
        (a, at), (b, bt) = sides
        links, j = Counter(), 0
        for x, (s, e) in zip(a, at):
            while bt[j][1] <= s:
                j += 1
            k = j
            while k < len(b) and bt[k][0] < e:
                links[x, b[k]] += 1
                k += 1
        cuts = {e for _, e in at} & {e for _, e in bt}
        side = []
        for ids, ranges in sides:
            parts = [[]]
            for t, (_, e) in zip(ids, ranges):
                parts[-1].append(str(t))
                if e in cuts:
                    parts.append([])
            side.append([",".join(p) for p in parts[:-1]])
        found.append((len(a), len(b), len(cuts), sum(links.values()), ";".join(f"{x}|{y}" for x, y in zip(*side)), links))
    holds, best = Counter(p for *_, links in found for p in links), {}
    for (x, _), n in holds.items():
        best[x] = max(best.get(x, 0), n)
    return [(*head, sum(n for p, n in links.items() if holds[p] == best[p[0]]), sum(n * holds[p] for p, n in links.items())) for *head, links in found]
