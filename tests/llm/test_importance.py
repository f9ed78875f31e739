"""Importance resampling and vector codes against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenq.llm import importance, vector_codes

SCHEMA = "doc_id bigint, text string, words string, stream string, part string"
WORDS = "the cat Sat on a-b mat é日本 x9 Ünder q" + "w" * 62 + " " + "z" * 63 + " " + "y" * 64 + " " + "v" * 400


def features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return words, words + [a + b" " + b for a, b in zip(words, words[1:], strict=False)]


def brute_resample(rows, target, percent=25, least=20, buckets=10_000):
    s, t = (Counter(zlib.crc32(f) % buckets for x in texts for f in features(x)[1]) for texts in ([x for _, x in rows], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        words, found = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in (zlib.crc32(f) % buckets for f in found)]
        weight = sum(gain) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    fits = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    drawn = fits[: percent * len(fits) // 100]
    return Counter((*r[:4], None) for r in out if not any(r is d for d in drawn)) + Counter((*d[:4], k + 1) for k, d in enumerate(drawn))


def test_resampling(spark):
    rng = np.random.default_rng(3)
    pool = WORDS.split()
    texts = [" ".join(rng.choice(pool, n)) for n in rng.integers(0, 60, 120)] + [None, "", " \n", "?! ..", "word " * 40_000, "one"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 4 + [(5, "the cat " * 30), (None, texts[7]), (None, texts[8])]
    target = [None, "", "the cat sat on the mat", "é日本 Ünder " * 9]
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA).repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, aim).collect()
    assert Counter(tuple(r) for r in got) == brute_resample(rows, target)
    assert Counter(tuple(r) for r in importance.resample(docs, aim, percent=100, min_words=0, buckets=300).collect()) == brute_resample(rows, target, 100, 0, 300)
    assert importance.resample(docs.limit(0), aim).collect() == []
    assert Counter(tuple(r) for r in importance.resample(docs, aim.limit(0)).collect()) == brute_resample(rows, [])


def test_pairs_are_hashed_without_being_joined(monkeypatch):
    monkeypatch.setattr(importance, "MEMO_WORDS", 3)  # the memory is emptied on the way
    f = importance.Features(10_000)
    for text in (WORDS, WORDS[::-1], "", "one"):
        words = importance.words_of(text.encode())
        pairs = [a + b" " + b for a, b in zip(words, words[1:], strict=False)]
        want = [zlib.crc32(x) % 10_000 for k, w in enumerate(words) for x in (w, *pairs[k : k + 1])]
        assert f([[], words, []]).tolist() == want


def brute_codes(rows):
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return Counter()
    size = len(kept[0][2]) // 4
    parts = [[tuple(v[p * size : p * size + size]) for _, _, v in kept] for p in range(4)]
    books = [[x for x in ps[:256]] for ps in parts]
    square = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e, strict=True))
    assign = lambda: [[min(range(len(b)), key=lambda k: (square(x, b[k]), k)) for x in ps] for ps, b in zip(parts, books, strict=True)]
    for _ in range(4):
        for ps, b, at in zip(parts, books, assign(), strict=True):
            for k in set(at):
                mine = [x for x, a in zip(ps, at, strict=True) if a == k]
                b[k] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    at = assign()
    errors = [sum(square(parts[p][n], books[p][at[p][n]]) for p in range(4)) for n in range(len(kept))]
    by_label = Counter()
    for (_, label, _), e in zip(kept, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    long = lambda e: e if e < 1 << 63 else None
    return Counter((i, "".join(f"{at[p][n]:02x}" for p in range(4)), long(errors[n]), long(by_label[label]), digest) for n, (i, label, _) in enumerate(kept))


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], f"vec_id bigint, embedding array<{kind}>, label int, codes string, n string")


@pytest.mark.parametrize(("count", "scale", "kind"), [(700, 0.3, "float"), (90, 1.0, "float"), (300, 0.002, "float"), (270, 1e5, "double"), (260, 3e8, "double")])
def test_codes(spark, count, scale, kind):
    rng = np.random.default_rng(count)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, scale, 8)], None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(count)]
    rows += rows[:9] + [(rows[0][0], rows[1][1], 1), (None, rows[2][1], 2), (-1, None, 1), (-2, [None] * 8, 1), (-3, [float("nan")] + [0.0] * 7, 1), (-4, [float("-inf")] + [0.0] * 7, None)]
    got = vector_codes.compress(vectors(spark, rows, kind).repartition(3)).collect()
    assert Counter(tuple(r) for r in got) == brute_codes(rows)


def test_codes_of_nothing(spark):
    assert vector_codes.compress(vectors(spark, [(1, None, 1)])).collect() == []
    assert vector_codes.compress(vectors(spark, [(1, None, 1)]).limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError, match="one length"):
        vector_codes.compress(vectors(spark, [(1, [0.0] * 8, 1), (2, [0.0] * 4, 1)]))


@pytest.mark.parametrize("scale", [3, 40, 1 << 40])
def test_exponion_search_finds_the_nearest(scale):
    rng = np.random.default_rng(scale % 97)
    values, book = (rng.integers(-scale, scale, (n, 4)).astype(float) for n in (500, 60))
    index, distance = vector_codes.nearest(values, book, rng.integers(0, 60, 500))
    for x, i, d in zip(values.tolist(), index, distance, strict=True):
        want = min((sum(int(a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book.tolist()))
        assert (int(d), i) == want
