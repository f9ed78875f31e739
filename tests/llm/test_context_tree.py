"""Context-tree weighting against a tree kept in dictionaries, and against the definition of the base score."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenq.llm import context_tree

SCHEMA = "doc_id bigint, text string, at string, sizes string, held_out string"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def coded(text):
    return " ".join(tokens(text)).encode() + b"\n"


def choices(text, depth):
    """(context of depth bytes, choices made before, bit) of every choice of the text."""
    code = b"\n" * depth + coded(text)
    for i in range(depth, len(code)):
        bits = f"{code[i]:08b}"
        for j in range(8):
            yield code[i - depth : i], bits[:j], int(bits[j])


def brute(rows, depth, held):
    """score of each row: the whole tree of the training rows, weighed from the leaves up."""
    counts = defaultdict(lambda: [0, 0])
    below = defaultdict(set)
    for i, text in rows:
        if not held(i):
            for context, before, bit in choices(text, depth):
                for d in range(depth + 1):
                    counts[context[depth - d :], before][bit] += 1
                    if d:
                        below[context[depth - d + 1 :], before].add(context[depth - d :])
    estimate = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    block, weight = {}, {}
    for d in range(depth, -1, -1):
        for (context, before), (a, b) in counts.items():
            if len(context) == d:
                own = estimate(a, b)
                if d == depth:
                    block[context, before] = own
                    continue
                longer = sum(block[c, before] for c in below[context, before])
                block[context, before] = np.logaddexp(own, longer) - math.log(2)
                weight[context, before] = math.exp(own - block[context, before]) / 2

    def choice(context, before, bit):
        p = 0.5
        for d in range(depth, -1, -1):
            node = context[depth - d :], before
            if node in counts:
                own = (counts[node][bit] + 0.5) / (sum(counts[node]) + 1)
                w = weight.get(node, 1.0)
                p = w * own + (1 - w) * p
        return p

    return [sum(math.log10(choice(*c)) for c in choices(text, depth)) for _, text in rows]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


TEXTS = ["the cat sat on the mat", "The CAT sat\ton  the mat", None, "", " \n", "Été ß 日本 the", "a " * 300 + "b", "x" * 900, "the dog sat on a log", "new words 😀 here", "the cat", "the cat", "É é A-Z\x1c\x85z"] * 3


@pytest.mark.parametrize("depth", [3, 4, 6, 7])
def test_scores_are_those_of_the_whole_tree(spark, depth, monkeypatch):
    monkeypatch.setattr(context_tree, "TREE_GRAMS", 50)  # the tree is computed in parts
    rows = list(enumerate(TEXTS)) + [(None, "the cat sat"), (3, "the cat"), (3, "the cat")]
    frame = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)
    got = context_tree.score_texts(frame, depth=depth).collect()
    want = brute(rows, depth, held)
    assert [(r.doc_id, round(r.score, 3)) for r in sorted(got, key=lambda r: (str(r.doc_id), r.score))] == [(i, round(s, 3)) for (i, _), s in sorted(zip(rows, want, strict=True), key=lambda x: (str(x[0][0]), x[1]))]


def test_base_scores(spark):
    rows = list(enumerate(TEXTS))
    words = Counter(w for i, t in rows if not held(i) for w in [*tokens(t), None])
    n, v = sum(words.values()), len(words)
    for r in context_tree.score_texts(spark.createDataFrame([(i, t, "", "", "") for i, t in rows], SCHEMA)).collect():
        own = [*tokens(TEXTS[r.doc_id]), None]
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(words[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(base, rel=1e-12)


def test_probabilities_of_a_byte_sum_to_one(spark):
    """Of all bytes after a context, seen in training or not."""
    training = ["abc abd abc", "abcab"]
    ends = [bytes([c]).decode("latin-1") for c in range(0x21, 0x7F) if not 0x41 <= c <= 0x5A]
    frame = spark.createDataFrame([(0, t, True) for t in training] + [(i + 1, "ab" + e, False) for i, e in enumerate(ends)] + [(-1, "ab", False)], "doc_id int, text string, trains boolean")
    got = {r.doc_id: r.score for r in context_tree.score_texts(frame, ~F.col("trains")).collect()}
    assert all(p < 0 for p in got.values())
    # what goes on after "ab" takes less than all that is left
    assert sum(10 ** s for i, s in got.items() if i) < 1


def test_no_training_rows_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "ab c"), (2, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in context_tree.score_texts(frame, F.lit(True)).collect()}
    assert got[1].score == pytest.approx(5 * 8 * math.log10(0.5)) and got[1].base_score == 0 and got[1].train_tokens == 0
    assert got[2].score == pytest.approx(8 * math.log10(0.5)) and (got[2].n_tokens, got[2].n_known) == (1, 0)
    assert context_tree.score_texts(frame.limit(0)).collect() == []


def test_long_texts_are_read_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(1)
    codes = [coded("".join(rng.choice(list("ab c"), n))) for n in (5_000, 10, 2_999, 30_000, 1, 999, 1_000, 1_001, 0)]
    sizes = np.array(list(map(len, codes)))
    want = [[k for i in range(len(c)) for k in [int.from_bytes((b"\n" * 6 + c)[i : i + 6][::-1] + c[i : i + 1], "big")]] for c in codes]
    for size in (1 << 20, 1000, 7):
        monkeypatch.setattr(context_tree, "SLICE", size)
        got = [[] for _ in codes]
        for first, keys, starts in context_tree.gram_slices(b"".join(codes), sizes, 6):
            for k, part in enumerate(np.split(keys, starts[1:])):
                got[first + k] += part.tolist()
        assert got == want


def test_blocks_and_pieces_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(context_tree, "PIECE_BYTES", 300)
    monkeypatch.setattr(context_tree, "BLOCK_BYTES", 900)
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(list("ab c"), n))) for i, n in enumerate([500, 10, 299, 3_000, 1, 99, 100, 101] * 3)]
    got = {r.doc_id: r.score for r in context_tree.score_texts(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [round(got[i], 2) for i, _ in rows] == [round(w, 2) for w in brute(rows, context_tree.DEPTH, held)]


def test_lookup_finds_every_key():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 60, 5_000, dtype=np.uint64))
    asked = np.random.default_rng(1).integers(0, len(keys), 20_000)
    assert (context_tree.Lookup(keys, np.arange(len(keys)))(keys[asked]) == asked).all()


def test_held_out_texts_are_told_better_than_by_their_words(spark, data):
    rows = context_tree.op11_context_tree(spark, data.replace("sf0.001", "sf0.01")).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert rows.s > rows.b
