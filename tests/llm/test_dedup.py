"""Exact and near duplicates against brute force, with nulls, ties, repeats, collisions and clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from lumenq.llm import exact_dedup, near_dedup
from lumenq.llm._shared import keep_rows
from lumenq.llm.components import connected_components
from lumenq.llm.exact_dedup import Directory

SCHEMA = "doc_id bigint, text string, kept string, digest string, n string"


def rows_of(texts, start=0):
    return [(start + i, t, "x", None, "n") for i, t in enumerate(texts)]


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc_id))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, doc_id in members:
            out[doc_id] = (keep, len(members), doc_id == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


TEXTS = ["a b", "ab", "a  b", None, "", " \t\n", " ", "é è", "éè", "x" * 300_000, "x" * 300_000 + " ", "A b", "c", "d", "c"]


@pytest.mark.parametrize("bits,capacity,depth", [(256, 50_000, 14), (8, 2, 4), (1, 1, 3)])
def test_exact_against_brute_force(spark, bits, capacity, depth):
    rows = rows_of(TEXTS)
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, SCHEMA), digest_bits=bits, capacity=capacity, max_depth=depth).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == brute_exact(rows)


def test_exact_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    null_id = spark.createDataFrame([(None, "a", None, None, None), (3, "a", None, None, None), (4, None, None, None, None)], SCHEMA)
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(null_id).collect()}
    assert got == {None: (None, True), 3: (None, False), 4: (4, True)}
    repeated = spark.createDataFrame(rows_of(["a", "b"]) * 3, SCHEMA)
    kept = keep_rows(repeated, exact_dedup.exact_duplicates(repeated))
    assert kept.columns == repeated.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1]


def test_directory_doubles_and_splits():
    random.seed(1)
    counts = defaultdict(int)
    for _ in range(5000):
        counts[min(int(random.expovariate(0.01)), 1023)] += 1
    directory = Directory(100, 10, counts).grow()
    assert len(directory.entries) == 1 << directory.depth
    by_bucket = defaultdict(int)
    pages = {}
    for entry, bucket, page in directory.rows():
        by_bucket[bucket] += counts.get(entry, 0)
        pages[bucket] = page
    distinct = {id(b): b for b in directory.entries}
    for b in distinct.values():
        assert by_bucket[b.number] == b.records and pages[b.number] == max(1, -(-b.records // 100))
        assert b.records <= 100 or b.depth == 10
    assert sum(by_bucket.values()) == 5000


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_near(rows, percent=85):
    sets = {d: shingles(t) for d, t, *_ in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def near_corpus(seed=0):
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefg") for _ in range(4))
    base = [word() for _ in range(150)]
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(60):  # one large group of near copies, at all distances
        copy = list(base)
        for _ in range(random.choice([0, 1, 2, 3, 5, 8])):
            copy[random.randrange(150)] = word()
        texts.append(" ".join(copy))
    for _ in range(40):  # documents that share a passage
        texts.append(" ".join([word() for _ in range(random.choice([5, 20, 80]))] + passage))
    texts += [None, "", " \n", "one two", "ONE  two", "one two three", texts[0], texts[0].upper()]
    return texts


@pytest.mark.parametrize("group_shingles", [near_dedup.GROUP_SHINGLES, 2_000])
def test_near_against_brute_force(spark, group_shingles):
    rows = rows_of(near_corpus())
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), group_shingles=group_shingles).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_near(rows)


def test_near_edges(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    same = "v w x y z " * 4
    rows = [(None, same, None, None, None), (5, same, None, None, None), (2, same, None, None, None), (2, same, None, None, None), (None, "q r s", None, None, None)]
    got = [(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(None, 2, False), (5, 2, False), (2, 2, True), (2, 2, True), (None, None, True)], key=str)


def test_components_against_brute_force(spark):
    random.seed(4)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert {(r.node, r.component) for r in got} == {(x, find(x)) for x in list(root)} and len(got) == len(root)
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_bands_hold_the_chance_of_a_miss_at_lower_thresholds(spark):
    assert near_dedup.bands_for(85) == near_dedup.BANDS
    assert all((1 - (p / 100) ** near_dedup.ROWS) ** near_dedup.bands_for(p) <= 1e-6 for p in (70, 80, 85, 95, 100))
    rows = rows_of(near_corpus())
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {len(r.bands) for r in near_dedup.signed(docs, n_bands=near_dedup.bands_for(80)).where("n_shingles > 0").collect()} == {near_dedup.bands_for(80)}
    got = near_dedup.near_duplicates(docs, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_near(rows, 80)


def test_an_unrelated_repeat_folds_no_other_documents(spark):
    texts = [(1, "a b"), (1, "a b"), (2, "c d"), (2, "e f"), (None, "g h"), (None, "i j"), (3, "k l")]
    docs = spark.createDataFrame([(d, t, "x", None, "n") for d, t in texts], SCHEMA)
    for verdicts in (exact_dedup.exact_duplicates(docs), near_dedup.near_duplicates(docs)):
        kept = keep_rows(docs, verdicts)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(set(texts), key=str)


def test_rows_that_share_an_id_are_judged_apart(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(7, long), (7, "another text of more than five words"), (8, long + " more"), (9, "another text of more than five words"), (7, "Another text of more than five words"), (None, long), (None, "no id and no copy of it"), (None, None), (None, ""), (10, None)]
    docs = spark.createDataFrame([(d, t, "x", None, "n") for d, t in rows], SCHEMA)
    near = keep_rows(docs, near_dedup.near_duplicates(docs))
    texts = sorted(((r.doc_id, r.text) for r in near.collect()), key=str)
    assert [t for t in texts if t[1]] in [sorted([(7, long), (7, a), (None, rows[6][1])], key=str) for a in (rows[1][1], rows[4][1])]
    assert sum(not t for _, t in texts) == 2  # wordless texts are nobody's copies; the two rows without id are equal
    exact = sorted(((r.doc_id, r.text) for r in keep_rows(docs, exact_dedup.exact_duplicates(docs)).collect()), key=str)
    want = [(7, rows[1][1]), (7, rows[4][1]), (8, rows[2][1]), (None, long), (None, rows[6][1])]
    assert sorted((e for e in exact if e[1]), key=str) == sorted(want, key=str) and sum(not t for _, t in exact) == 1


def test_every_row_of_one_id_may_stay(spark):
    docs = spark.createDataFrame([(1, f"text number {i} of this one id", "x", None, "n") for i in range(40)] * 2, SCHEMA)
    for verdicts in (exact_dedup.exact_duplicates(docs), near_dedup.near_duplicates(docs)):
        assert sorted(r.text for r in keep_rows(docs, verdicts).collect()) == sorted(f"text number {i} of this one id" for i in range(40))


def test_keep_rows_by_a_shuffle(spark, monkeypatch):
    from lumenq.llm import _shared

    docs = spark.createDataFrame(rows_of(TEXTS) * 2, SCHEMA)
    few = sorted(keep_rows(docs, exact_dedup.exact_duplicates(docs)).collect(), key=str)
    monkeypatch.setattr(_shared, "BROADCAST_ROWS", 0)
    assert sorted(keep_rows(docs, exact_dedup.exact_duplicates(docs)).collect(), key=str) == few


def test_a_large_group_takes_the_pivot_and_the_rest_takes_bounded_tasks(spark):
    """Copies at all distances, so that many members are not linked to the pivot but to each other."""
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefg") for _ in range(5))
    chain, texts = [word() for _ in range(120)], []
    for _ in range(150):
        for _ in range(random.choice([1, 1, 2])):
            chain[random.randrange(120)] = word()
        texts.append(" ".join(chain))
    texts.append(" ".join(word() for _ in range(30_000)))  # a very long text alone
    rows = rows_of(texts)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for size in (500, 5_000, near_dedup.GROUP_SHINGLES):
        got = near_dedup.near_duplicates(docs, group_shingles=size).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_near(rows)


def test_staged_tables_go(spark):
    from lumenq.llm import _shared

    before = len(_shared._STAGED)
    with _shared.scratch():
        _shared.staged(spark.range(3), "a-table")
        got = near_dedup.near_duplicates(spark.createDataFrame(rows_of(TEXTS), SCHEMA)).collect()
        left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for _, p in _shared._STAGED[before:]]
        assert len(got) == len(TEXTS) and left.count("stars") <= 1 and "pivot-sets" not in left
        paths = [p for _, p in _shared._STAGED[before:]]
    where = spark._jvm.org.apache.hadoop.fs.Path(paths[0])
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
