"""Quality and toxicity: held-out accuracy on made rows, the solver against its optimality conditions, edge cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from lumenq.llm import quality, toxicity

SCHEMA = "doc_id bigint, text string, score string, held_out string"


def corpus(n=400, seed=0):
    random.seed(seed)
    word = lambda: "".join(random.choice(["ba", "re", "ti", "on", "ed", "s"]) for _ in range(random.randrange(1, 5)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(random.randrange(20, 120))]
        bad = i % 3 == 0
        if bad:
            kind = i // 3 % 3
            words = [w + random.choice(["***", "%%%"]) for w in words] if kind == 0 else [w for w in words[:10] for _ in range(9)] if kind == 1 else [w.upper() + "!!" for w in words]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(random.randrange(len(words)), random.choice(["lumpface", "gritzhead", "zorkelan", "zorkelei", "zorkelu"]))
        docs.append((i, " ".join(words), "x", "y"))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy(spark, kind):
    docs, labels = corpus()
    d, l = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = (quality.score_quality if kind == "quality" else toxicity.score_toxicity)(d, l).collect()
    assert len(got) == len(docs)
    truth = {r[0]: r[1 if kind == "quality" else 2] for r in labels}
    modulus, rest, threshold = (4, 2, 0.7) if kind == "quality" else (5, 0, 0.5)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_edges(spark, score):
    labels = "doc_id bigint, quality int, toxic int"
    nothing = spark.createDataFrame([], labels)
    odd = spark.createDataFrame([(None, "a b"), (1, None), (1, None), (2, ""), (3, "x " * 100_000)], "doc_id bigint, text string")
    got = score(odd, nothing).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert len({r.score for r in got}) == 1  # without labels nothing is known
    assert score(spark.createDataFrame([], SCHEMA), nothing).count() == 0
    one_class = spark.createDataFrame([(1, 1, 1), (3, 1, 1), (None, 0, 0), (2, None, None), (2, 7, 7)], labels)
    assert all(r.score > 0.9 for r in score(odd, one_class).collect())


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = corpus(120)
    d = spark.createDataFrame(docs, SCHEMA)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    for score in (quality.score_quality, toxicity.score_toxicity):
        a, b = ({r.doc_id: r.score for r in score(d, spark.createDataFrame(x, "doc_id bigint, quality int, toxic int")).collect()} for x in (labels, flipped))
        assert a == b


def plain_indicators(text):
    """The indicators of one text, step by step."""
    words = text.split()
    if not words:
        return [0]
    mix = lambda x: int(quality.mix(np.array([x % 2**64], np.uint64))[0])
    hashes = [xxhash.xxh3_64_intdigest(w.encode().lower()) for w in words]
    lines = [line for line in text.split("\n") if line.strip()]
    out = {mix(h) for h in hashes} | {mix(b * 31 + a) for a, b in zip(hashes, hashes[1:], strict=False)}
    out |= {mix(1000 + int(10 * (1 - len(set(lines)) / len(lines)))), mix(2000 + int(10 * len(set(words)) / len(words)))}
    out |= {mix(3000 + min(12, len(words).bit_length())), mix(4000 + min(12, int(4 * np.log2(1 + len(words) / len(lines))) // 4))}
    shapes = [2 * quality._shape(w) + (i > 0 and words[i - 1] == w) for i, w in enumerate(words)]
    for n in (1, 2, 3):
        grams = [tuple(shapes[i : i + n]) for i in range(len(shapes) - n + 1)]
        for gram, count in Counter(grams).items():
            value = n
            for s in gram:
                value = value * 1009 + s
            out |= {mix(value * 64 + level + 7) for level, share in enumerate(quality.SHARES) if count / len(grams) > share}
    return sorted({v % quality.BUCKETS for v in out})


def test_indicators_and_scores_against_plain_ones():
    texts = [d[1] for d in corpus(60)[0]] + ["", " \n", "one", "one two", "a\na\nb\n\na", "É é ü 12 3! !!! x", "same same same", "q " * 5_000]
    known = quality.Words()
    for part in (texts, texts[::-1], [texts[-1]], [""]):
        buckets, ends = quality.indicators(part, known)
        assert [b.tolist() for b in np.split(buckets, ends[:-1])] == [plain_indicators(t) for t in part]
    model = quality.Model(np.random.default_rng(1).normal(size=quality.BUCKETS), 0.1, 1.5, -0.2)
    for text, score in zip(texts, model.scores(texts, known), strict=True):
        own = plain_indicators(text)
        margin = sum(model.weights[b] for b in own) / len(own) ** 0.5 + 0.1
        assert abs(score - 1 / (1 + np.exp(-(1.5 * margin - 0.2)))) < 1e-9
    assert len(model.scores([], known)) == 0


def test_words_are_forgotten_beyond_the_bound(monkeypatch):
    monkeypatch.setattr(quality, "MEMO_WORDS", 5)
    known = quality.Words()
    for text in ("a b c d e f g", "h a b", "g h a"):
        buckets, _ = quality.indicators([text], known)
        assert buckets.tolist() == plain_indicators(text)


def test_the_sample_ends_with_its_indicators(spark, monkeypatch):
    docs, labels = corpus(60)
    monkeypatch.setattr(quality, "TRAINING_INDICATORS", 6_000)
    got = quality.score_quality(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert got.count() == 60


def test_dual_coordinate_descent_is_optimal():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(60)]
    labels = np.array([int(5 in r or rng.random() < 0.3) for r in rows])
    ratios = np.zeros(quality.BUCKETS)
    ratios[:30] = rng.normal(size=30)
    w, bias = quality.dual_coordinate_descent(rows, labels, ratios, epochs=3000)
    sign = np.where(labels > 0, 1, -1)
    share = np.array([np.mean(labels == 0), np.mean(labels == 1)])
    cost = 0.5 / share[labels]
    safe = np.where(ratios == 0, 1, ratios)

    def objective(weights, b):
        margins = np.array([(weights[r] * ratios[r]).sum() / np.sqrt(len(r)) + b for r in rows])
        return 0.5 * (weights @ weights + b * b) + (cost * np.maximum(0, 1 - sign * margins)).sum()

    best = objective(w / safe, bias)
    for _ in range(200):
        step = rng.normal(size=31) * 0.01
        moved = w / safe
        moved[:30] += step[:30]
        assert objective(moved, bias + step[30]) >= best - 1e-4


def test_log_count_ratios_point_to_their_class():
    r = quality.log_count_ratios([np.array([1, 2]), np.array([2, 3])], np.array([1, 0]))
    assert r[1] > 0 > r[3] and abs(r[2]) < 1e-12


def weight(text, words=("idiot",), stems=()):
    return toxicity.Model(set(words), set(stems)).reader()(text)[0]


def test_grammar_scores_clauses():
    plain = weight("what an idiot this is")
    assert plain == 1.0
    assert weight("you are an idiot") > plain  # a target near it
    assert weight("the idiot told you") > plain
    assert weight("he is not an idiot") == 0.0 or weight("not an idiot") == 0.0  # negated
    assert weight("not here. an idiot") == plain  # a negation ends with its clause
    assert 0 < weight("the paper said an idiot") < plain  # reported
    assert weight("nothing here") == 0.0 == weight("")
    assert weight("an idiot. an idiot") == 2 * plain
    assert weight("i will kill you") > 0
    assert weight("some zorkelei there", stems=("zork",)) == plain


def test_threats_are_inflected():
    for text in ("He murdered them and stabbed her", "they were killed", "she is strangling you", "je te tuerai", "ils t'ont tuée", "ich töte dich", "er wurde umgebracht", "voy a matarte", "lo mataron"):
        assert weight(text) > 0, text
    assert weight("you will be killed") > weight("killed") > 0
    assert weight("he did not kill anyone") == 0.0 and weight("nobody was never killed") == 0.0
    for text in ("a shot of coffee", "la mata verde", "the skill of it", "tu es ici", "tout est tôt", "matt and material"):
        assert weight(text) == 0.0, text
    assert len(set(toxicity.THREATS)) == len(toxicity.THREATS) and not set(toxicity.THREATS) & set(toxicity.TARGETS + toxicity.NEGATIONS + toxicity.REPORTS)


def test_parts_of_the_grammar_can_be_left_out():
    read = lambda text, parts: toxicity.Model({"idiot"}, set(), parts=parts).reader()(text)[0]
    for part, text in (("report", "the paper said an idiot"), ("negation", "not an idiot"), ("target", "you are an idiot")):
        rest = tuple(p for p in toxicity.PARTS if p != part)
        assert read(text, toxicity.PARTS) != read(text, rest) == read("an idiot", rest)


def test_doubtful_stems_count_apart():
    reader = toxicity.Model(set(), {"zork"}, {"zo", "blah"}).reader()
    assert reader("a zorker and a blahser") == (1.0, 1.0, 5)
    assert reader("a zoo, no blahser") == (0.0, 1.0, 4)


def test_composed_machine_equals_the_cascade():
    random.seed(2)
    step, start = toxicity.grammar()
    machines = [c.cell_contents for c in step.__closure__ if isinstance(c.cell_contents, tuple) and c.cell_contents and isinstance(c.cell_contents[0], toxicity.Transducer)][0]
    for _ in range(300):
        text = "".join(random.choice("oooitpnrw") for _ in range(12))
        states, total = start, 0.0
        for s in text:
            w, states = step(states, s)
            total += w[0] + 10 * w[1]
        run, expected = list(text), 0.0
        for m in machines:
            state, out = 0, []
            for s in run:
                o, w, state = m.step(state, s)
                out.append(o)
                expected += w[0] + 10 * w[1]
            run = out
        assert abs(total - expected) < 1e-9


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
@pytest.mark.parametrize("text", [None, "", " \n\t", "...", "no", "absent"])
def test_labels_of_both_classes_over_wordless_documents(spark, score, text):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame([] if text == "absent" else [(i, text, "x", "y") for i in range(20)], SCHEMA)
    got = score(docs, labels).collect()
    assert len(got) == docs.count() and len({r.score for r in got}) <= 1
    assert all(0.2 <= r.score <= 0.8 for r in got)  # equal texts tell nothing: about the share of label 1


def test_repeated_rows_train_once(spark):
    docs, labels = corpus(120)
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    for score in (quality.score_quality, toxicity.score_toxicity):
        once, many = ({r.doc_id: r.score for r in score(spark.createDataFrame(docs * k, SCHEMA), labels).collect()} for k in (1, 3))
        assert once == many


def plain_totals(text, words, stems, doubtful):
    """Sure and doubtful weight and words, by applying the grammar's rules one after the other to lists of words."""
    sure = unsure = 0.0
    clauses, count = [[]], 0
    for raw in text.split():
        count += 1
        word = raw.lower().strip(toxicity._MARKS)
        kinds = [("i", words), ("t", toxicity.THREATS), ("p", toxicity.TARGETS), ("n", toxicity.NEGATIONS), ("r", toxicity.REPORTS)]
        kind = next((k for k, fixed in kinds if word in fixed), None)
        if kind is None:
            match = max((s for s in stems | doubtful if word.startswith(s)), key=len, default=None)
            kind = "o" if match is None else "i" if match in stems else "w"
        clauses[-1].append(kind)
        if toxicity._END.search(raw):
            clauses.append([])
    for clause in clauses:
        after = lambda i, mark, reach, clause=clause: any(k == mark for k in clause[max(0, i - reach) : i])
        out = []
        for i, k in enumerate(clause):
            if k in "itw" and after(i, "r", 8):
                k = "q" if k != "w" else "o"
            if k in "itwq" and after(i, "n", 3):
                k = "o"
            if k in "itw" and after(i, "p", 4):
                k = {"i": "I", "t": "T", "w": "D"}[k]
            out.append(k)
        armed = 0
        for k in out:
            sure += {"i": 1.0, "I": 1.5, "t": 0.5, "T": 2.0, "q": 0.4}.get(k, 0.0) + (0.5 if k == "p" and armed else 0.0)
            unsure += {"w": 1.0, "D": 1.25}.get(k, 0.0)
            armed = 3 if k == "i" else 0 if k in "ItTqwDp" and (k != "p" or armed) else max(0, armed - 1)
    return sure, unsure, count


def test_scores_against_plain_rules(spark):
    """Whole documents scored by a model, and by the rules applied one after the other."""
    random.seed(7)
    model = toxicity.Model({"idiot"}, {"zork"}, {"blah"}, (1.3, 0.4, -0.2, -1.1))
    pool = ["idiot", "zorker", "blahs", "kill", "you", "not", "said", "stone", "river", "the", "they", "word."]
    texts = ["", "idiot", "word " * 20_000 + "you idiot"] + [" ".join(random.choice(pool) + random.choice(["", "", "", ".", ",", "!"]) for _ in range(random.randrange(1, 60))) for _ in range(400)]
    totals = model.reader()
    for t in texts:
        got, want = totals(t), plain_totals(t, model.words, model.stems, model.doubtful)
        assert got[2] == want[2] and abs(got[0] - want[0]) < 1e-9 and abs(got[1] - want[1]) < 1e-9, t
        x = sum(w * np.log1p(v) for w, v in zip(model.weights, want, strict=False)) + model.weights[3]
        assert abs(model.score(got) - 1 / (1 + np.exp(-x))) < 1e-12
