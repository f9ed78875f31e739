"""Token counts and packing against the tokenizer libraries."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenq.llm import packing, token_counts

SCHEMA = "doc_id bigint, text string, length string, n_tokens string"
BYTE, RANKS, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
TEXTS = [None, "", " ", "<|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|>", "it's 'll x'll a b", "\x1cq\x1cw \x1f", "İstanbul ΣΑΣ ﬁx ½ á", "don't. . . ..", "日本語 テスト 한국어", "😀 👩‍👩‍👧 ‍", "word " * 9000, "x" * 30_000, " " * 20_000 + "end", "\n\n\t x\r\n", "don't. . . .."]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)


def brute(path, texts):
    t = Tokenizer.from_file(path)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_counts(spark, path, tmp_path):
    got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark), path, f"file://{tmp_path}/cache").collect()}
    for i, n in enumerate(brute(path, TEXTS)):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((TEXTS[i] or "").encode()), n > 2048), TEXTS[i]


def test_sentencepiece_counts(spark, tmp_path):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame(spark), path, f"file://{tmp_path}/cache").collect()}
    assert got == {i: len(p.encode(t or "")) for i, t in enumerate(TEXTS)}


def test_cache_is_appended_to_and_used(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    token_counts.count_tokens(frame(spark, ["a b", "a  b", "c d e"]), WORD, cache).collect()
    assert spark.read.parquet(cache).count() == 2  # "a b" and "a  b" are one content
    spark.createDataFrame([(token_counts_digest("zz"), token_counts.tokenizer_digest(WORD), 99)], token_counts.CACHE_SCHEMA).write.mode("append").parquet(cache)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame(spark, ["zz", "c d e", "new"]), WORD, cache).collect()}
    assert got[0] == 99 and got[1] == 3  # a stored count is taken, not made again
    assert spark.read.parquet(cache).count() == 4


def token_counts_digest(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def test_a_warm_cache_and_a_shuffled_join(spark, tmp_path, monkeypatch):
    """Contents all known, half known, and tables too large to be broadcast; very long texts and many copies."""
    from lumenq.llm import _shared

    random.seed(2)
    texts = [" ".join(random.choice(["a", "be", "sea", "Dé"]) for _ in range(random.randrange(1, 9))) for _ in range(200)] + ["hot  copy"] * 300 + ["long text " * 100_000]
    want = dict(enumerate(brute(WORD, texts)))
    for rows in (_shared.BROADCAST_ROWS, 0):
        monkeypatch.setattr(_shared, "BROADCAST_ROWS", rows)
        cache = f"file://{tmp_path}/cache{rows}"
        for part in (texts[:80], texts, texts):
            assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame(spark, part), WORD, cache).collect()} == {i: want[i] for i in range(len(part))}
        assert spark.read.parquet(cache).count() == len({" ".join(t.split()) for t in texts})


def test_counts_of_nothing(spark, tmp_path):
    assert token_counts.count_tokens(frame(spark, []), WORD, f"file://{tmp_path}/cache").count() == 0
    repeated = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b")], "doc_id bigint, text string")
    assert [r.n_tokens for r in token_counts.count_tokens(repeated, WORD, f"file://{tmp_path}/c2").collect()] == [2, 2, 2]


def test_fast_encoder_agrees_on_every_common_character():
    encode = packing.Encoder(BYTE, RANKS)
    slow = Tokenizer.from_file(BYTE)
    characters = [chr(c) for c in range(0x10000) if packing.COMMON.fullmatch(chr(c)) and not 0xD800 <= c < 0xE000]
    for k in range(0, len(characters), 50):
        text = "".join(f"a{c}1 {c}{c} 'l{c}\n" for c in characters[k : k + 50])
        assert packing.COMMON.fullmatch(text)
        assert encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def check_packing(rows, texts, size):
    slow = Tokenizer.from_file(BYTE)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = slow.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(-(-len(ids) // size)))
        at = 0
        for p in pieces:
            assert p.start == at and (p.piece == 0 or p.length == size)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(by_sequence), sum(r.length for r in rows)


def test_packing_whole(spark):
    random.seed(3)
    texts = [*TEXTS, *(" ".join(random.choice(["the", "of", "qz", "ing"]) for _ in range(random.randrange(1, 3000))) for _ in range(120))]
    rows = packing.pack_documents(frame(spark, texts).repartition(3), BYTE, RANKS).collect()
    used, total = check_packing(rows, texts, 2048)
    assert used <= 1.05 * total / 2048 + 2


def test_packing_edges(spark):
    assert packing.pack_documents(frame(spark, []), BYTE, RANKS).count() == 0
    same = spark.createDataFrame([(1, "a b c")] * 700 + [(None, "a")], "doc_id bigint, text string")
    rows = packing.pack_documents(same, BYTE, RANKS).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 701 and len({r.sequence_id for r in rows}) == 2


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece(seed):
    rng = np.random.default_rng(seed)
    size = 64
    histogram = np.bincount(np.minimum(size, rng.geometric([0.02, 0.1, 0.3, 0.05, 0.5, 0.01][seed], 500 * (seed + 1))), minlength=size + 1)
    if seed == 3:
        histogram[:] = 0
        histogram[40] = 1000  # a single hot length
    used = Counter()
    runs = packing.plan_runs(histogram)
    for lengths, times in runs:
        assert sum(lengths) <= size and times > 0
        for v in lengths:
            used[v] += times
    assert used == Counter({i: int(n) for i, n in enumerate(histogram) if n})
    bound = -(-int((np.arange(size + 1) * histogram).sum()) // size)
    big = int(histogram[size // 2 + 1 :].sum())
    assert sum(t for _, t in runs) <= max(bound, big) * 1.03 + 2


def test_patterns_fill_exactly():
    got = {tuple(sorted(v for v in r if v)) for r in packing.patterns(12, np.arange(1, 13)).tolist()}
    want = {(12,)} | {(a, 12 - a) for a in range(1, 7)} | {(a, b, 12 - a - b) for a in range(1, 13) for b in range(a, 13) if 12 - a - b >= b}
    assert got == want
