"""Packing, byte-level BPE, chat formatting and language ID."""
import zlib

import numpy as np
import public_tokenizers
import pytest

from subsetlab.llm import bpe, chat, langid, packing
from tests.llm import edge

JSON, RANKS, MULTI, PATTERN = (*map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
ODD = ["a\x1cb \x85c \xa0d　e", "  lead", "trail  ", "a\n\nb\n c\t\td", "'s it's 'll x", "日本語 テスト 123４５", "ab" * 1000, "<|endoftext|> hi", "é ٠١", "a\rb\r\nc", "½ ²x_y", "  x\x0b\x0c", "a\0b c", "\U0001F600 smile"]


def test_bpe_equals_the_library_and_decodes_to_the_text(spark):
    import tiktoken
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})
    rows = edge.awkward_rows() + [(500 + k, t) for k, t in enumerate(ODD)]
    got = bpe.decode_documents(bpe.encode_documents(edge.frame(spark, rows), MULTI, PATTERN), MULTI).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.ids, bytes(r.decoded)) for r in got) == sorted((d is None, d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows)
    assert bpe.encode_documents(edge.empty(spark), MULTI, PATTERN).count() == 0


def test_one_by_one_merge_equals_merges_side_by_side():
    ranks = bpe.read_ranks(MULTI)
    pick = np.random.default_rng(4)
    words = [bytes(pick.choice(list(b"abcdeint \xc3\xa9"), pick.integers(1, 70))) for _ in range(3000)]
    merger = bpe.Merger(ranks)
    texts = [w.decode("latin-1") for w in words]
    assert [np.frombuffer(p, np.uint32).tolist() for p in merger(texts)] == [bpe.merge(t.encode(), ranks) for t in texts]


def test_packed_pieces_hold_every_id_once(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    rows = [(k, t) for k, t in edge.awkward_rows() if k is not None][:-1] + [(500 + k, t) for k, t in enumerate(ODD)]
    placed = packing.pack(packing.document_pieces(edge.frame(spark, rows), JSON, RANKS, PATTERN)).collect()
    for d, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], np.uint32)
        pieces = sorted((r for r in placed if r.doc_id == d), key=lambda r: r.piece)
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in pieces] == [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    check_sequences(placed)


def check_sequences(placed, capacity=2048):
    by_sequence = {}
    for r in placed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= capacity
    return len(by_sequence)


def test_exchanges_close_the_gap_of_small_parts(spark):
    pick = np.random.default_rng(1)
    lengths = pick.integers(100, 1200, 400).tolist()
    pieces = spark.createDataFrame([(k, 0, 0, int(n), 0) for k, n in enumerate(lengths)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    once = check_sequences(packing.pack(pieces, pieces_per_part=10, rounds=0).collect())
    more = packing.pack(pieces, pieces_per_part=10, rounds=4).collect()
    assert len(more) == 400 and packing.lower_bound(lengths) <= check_sequences(more) < once


def test_lower_bound_and_best_fit():
    assert packing.lower_bound([]) == 0 and packing.lower_bound([2048] * 3) == 3
    assert packing.lower_bound([1025] * 10) == 10                     # no two fit together
    assert packing.lower_bound([683] * 10) == 5                       # two fit, three do not
    bins, offsets = packing.best_fit_decreasing([1000, 1048, 2048, 500, 548, 1000])
    assert len(set(bins)) == 3 and packing.lower_bound([1000, 1048, 2048, 500, 548, 1000]) == 3
    assert min(offsets) == 0


def test_sequences_are_the_ids_of_their_pieces(spark):
    pieces = packing.document_pieces(edge.frame(spark, [(1, "one two three"), (2, "four"), (3, None)]), JSON, RANKS, PATTERN, with_ids=True)
    rows = packing.sequences(packing.pack(pieces), pieces).collect()
    assert len(rows) == 1 and len(rows[0].ids) // 4 == rows[0].ends[-1]
    assert packing.pack(packing.document_pieces(edge.empty(spark), JSON, RANKS, PATTERN)).count() == 0


def test_chat_round_trip_order_and_loss(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "user", None), (1, 2, "assistant", "<turn user>\n</turn>\n\\"), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, None, "user", "first"), (2, 1, "assistant", "a"),
            (3, 0, None, "x"), (4, 0, "we>ird\\", "<<turn </turn></turn>"), (None, 0, "user", "no id"), (5, 0, "user", "y" * 50_000), (5, 1, "assistant", "")]
    df = spark.createDataFrame([(*r, "clash", True) for r in rows], "conv_id bigint, turn bigint, role string, text string, content string, loss boolean")
    segments = chat.format_conversations(df)
    read = {r.conv_id: r for r in chat.read_back(chat.assemble(segments)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(t.role, t.text) for t in read[conv].turns] == [(role, text) for _, _, role, text in own]
        loss = [read[conv].formatted[s.start:s.end] for s in read[conv].loss_spans]
        assert len(loss) == sum(role == "assistant" for _, _, role, _ in own)
    assert "<turn user>" not in read[1].formatted[read[1].formatted.index("<turn assistant>") + 5:]
    invalid = {r.conv_id for r in chat.invalid_conversations(segments).collect()}
    assert invalid == {2, 3, 4, None}
    assert chat.assemble(chat.format_conversations(df.limit(0))).count() == 0


def test_language_of_single_and_mixed_texts(spark):
    pick = np.random.default_rng(0)
    syllables = {"aa": ["ba", "ko", "mi", "ta"], "bb": ["schu", "ver", "ung", "ich"], "cc": ["eau", "ier", "oi", "tion"]}

    def prose(lang, words=80):
        return " ".join("".join(pick.choice(syllables[lang], 3)) for _ in range(words))

    rows = [(k, prose(lang), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 40)]
    train = spark.createDataFrame(rows + [(900, None, "aa"), (901, "x", None)], "doc_id bigint, text string, lang string")
    model = langid.learn(train)
    assert model[0] == ["aa", "bb", "cc"]
    mixed = prose("aa", 120) + " " + prose("cc", 60)
    asked = [(k, prose(lang), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 10)] + [(100, None, "bb"), (101, "", "bb"), (102, "123 !?", "bb"), (103, mixed, "aa"), (None, prose("bb"), None), (0, "ba", "aa")]
    df = spark.createDataFrame([(*r, "clash") for r in asked], "doc_id bigint, text string, lang string, score string")
    got = langid.predict(df, model, keep=("lang",)).collect()
    assert len(got) == len(asked)
    assert all(r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 100)
    by_id = {r.doc_id: r for r in got}
    assert {by_id[k].lang_pred for k in (100, 101, 102)} == {"und"} and by_id[None].lang_pred == "bb"
    assert by_id[103].langs == ["aa", "cc"] and by_id[103].proportions[0] == pytest.approx(2 / 3, abs=0.12)
    assert langid.learn(train.limit(0))[0] == [] and {r.lang_pred for r in langid.predict(df, langid.learn(train.limit(0))).collect()} == {"und"}


def test_held_out_accuracy_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs.filter(langid.fold() != 0))
    held = langid.predict(docs.filter(langid.fold() == 0), model, keep=("lang",))
    assert held.filter("lang_pred = lang").count() >= 0.97 * held.count() > 100


def test_white_space_that_offsets_other_white_space(spark):
    import tiktoken
    from subsetlab.llm.tokens import TextEncoder
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})
    texts = ["foo\tbar\n", " foo\tbar", "a\n\nb\tc", "a b\tc\td", "x \t a\tb", "a\xa0b\n"]
    got = bpe.encode_documents(edge.frame(spark, list(enumerate(texts))), MULTI, PATTERN).collect()
    assert {r.doc_id: r.ids for r in got} == {k: library.encode_ordinary(t) for k, t in enumerate(texts)}
    encoder = TextEncoder(lambda text: [text], None)
    assert all(encoder.chunks(t) == [t] for t in texts) and encoder.chunks("a b\nc") == ["a", " b", "\n", "c"]
