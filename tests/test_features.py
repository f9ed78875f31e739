"""Token, graph and trajectory features against closed forms and sequential brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenq.backends import JaccardScorer, ModelScorer
from lumenq.functions import arrays
from lumenq.operators import denoise, features, graph, tokens, trajectory


def lp_frame(spark, *samples):
    return spark.createDataFrame([(0, s, p, float(v)) for s, row in enumerate(samples) for p, v in enumerate(row)], "prompt_id int, sample_id int, pos int, lp double")


def test_visible_positions(spark):
    rows = spark.createDataFrame([([10, 99, 20, 30],), ([10, 20, 50, 40],), ([50],), ([],), ([10, None, 20],)], "ids array<int>")
    got = [r[0] for r in rows.select(tokens.visible_positions(F.col("ids"), [99], [50])).collect()]
    assert got == [[0, 2, 3], [0, 1], [], [], [0, 2]]


def test_token_features(spark):
    ln = math.log
    one = lambda f, *lp: f(lp_frame(spark, lp)).first()[1]
    assert abs(one(tokens.msp, ln(0.9), ln(0.8), ln(0.7)) - 0.504) < 1e-12
    assert abs(one(tokens.msp, -math.inf, ln(0.5)) - 0.5) < 1e-12 and one(tokens.msp, -math.inf) is None
    assert one(tokens.msp, *[-100.0] * 10) == 0.0
    assert abs(one(tokens.perplexity, ln(0.1), ln(0.1), ln(0.1)) - 10) < 1e-9 and one(tokens.perplexity, -800.0) == math.inf
    flat = spark.createDataFrame([(0, p, [0.0] * 4) for p in range(3)], "sample_id int, pos int, top_lp array<double>")
    assert abs(tokens.mean_token_entropy(flat).first().mte - ln(4)) < 1e-12
    two = tokens.negative_log_likelihood(lp_frame(spark, [ln(0.9)], [ln(0.1)], [-math.inf])).first().mcnse
    assert abs(two + (ln(0.9) + ln(0.1)) / 2) < 1e-12
    sharp = spark.createDataFrame([([0.0, -2000.0],)], "x array<double>").select(arrays.softmax_entropy(F.col("x"))).first()[0]
    assert sharp == 0.0


def test_visible_tokens_and_last_pass(spark):
    tensor = spark.createDataFrame([(0, p, r, 10 * p + r, -float(r)) for p in range(3) for r in (1, 0)], "sample_id int, pos int, rank int, token_id int, logprob float")
    got = {r.pos: r for r in tokens.last_pass(tensor).collect()}
    assert got[2].token_id == 20 and got[2].lp == 0.0 and got[2].top_lp == [0.0, -1.0]
    seen = tokens.visible_tokens(tokens.last_pass(tensor), F.col("token_id") == 20, F.col("token_id") == 0)
    assert [r.pos for r in seen.collect()] == [1]


def edges_of(spark, m):
    n = len(m)
    return spark.createDataFrame([("p", n, i, j, float(m[i][j])) for i in range(n) for j in range(n)], "prompt_id string, n int, i int, j int, w double")


def greedy(m, t=0.5):
    heads, out = [], []
    for j in range(len(m)):
        c = next((k for k, h in enumerate(heads) if m[h][j] >= t), None)
        if c is None:
            heads.append(j)
            c = len(heads) - 1
        out.append(c)
    return out


def test_clusters_and_spectra(spark):
    rng = np.random.default_rng(0)
    for n in (2, 3, 9):
        m = rng.random((n, n))
        m = (m + m.T) / 2
        np.fill_diagonal(m, 1)
        e = edges_of(spark, m)
        assert [r.cluster for r in graph.clusters(e).orderBy("i").collect()] == greedy(m)
        w = np.maximum(m, 0) - np.eye(n)
        lap = np.diag(w.sum(1)) - w
        v = np.linalg.eigvalsh(lap)
        got = graph.graph_features(e).first()
        assert abs(got.ecc - max(0, v[1])) < 1e-9 and abs(got.eigval - (n - v.sum()) / n) < 1e-9
        for name, f in (("kle_heat", np.exp(-0.3 * v)), ("kle_matern", 1 / (2 + v))):
            p = f / f.sum()
            assert abs(got[name] + (p * np.log(p)).sum()) < 1e-9
        c = np.bincount(greedy(m))
        assert abs(got.se_marginal + (c / n * np.log(c / n)).sum()) < 1e-9
        assert abs(got.se_conditional - (c[c > 1] / n * np.log(c[c > 1])).sum() / np.log(n)) < 1e-9


def test_sampling_features_edges(spark):
    rows = [("same", i, "a b c") for i in range(5)] + [("one", 0, "x")] + [("two", 0, "x y"), ("two", 1, "z")]
    got = {r.prompt_id: r for r in graph.sampling_features(spark.createDataFrame(rows, "prompt_id string, sample_id int, text string")).collect()}
    assert abs(got["same"].se_conditional - 1) < 1e-12 and got["same"].se_marginal == 0.0
    assert all(got["one"][c] is None for c in ("se_marginal", "se_conditional", "ecc", "eigval", "kle_heat", "kle_matern"))
    assert abs(got["two"].se_marginal - math.log(2)) < 1e-12
    assert graph.entropy_of(np.ones(4)) == pytest.approx(math.log(4)) and graph.entropy_of(np.array([])) == 0


@pytest.mark.parametrize("n,most", [(5, 20), (20, 20), (47, 20), (100, 1), (7, 3), (1, 1)])
def test_subsample(spark, n, most):
    items = spark.createDataFrame([("p", i * 3) for i in range(n)], "prompt_id string, sample_id int")
    got = graph.subsample(items, most).orderBy("i").collect()
    want = sorted({int(round(x)) for x in np.linspace(0, n - 1, most)}) if n > most and most > 1 else [0] if most == 1 and n > 1 else list(range(min(n, n)))
    assert [r.sample_id // 3 for r in got] == want and [r.i for r in got] == list(range(len(want))) and all(r.n == len(want) for r in got)


def test_pairs_are_scored_once_and_cached(spark):
    asked = spark.createDataFrame([("a b", "a"), ("a b", "a"), ("a", "a b"), ("x", "x")], "premise string, hypothesis string")
    calls = spark.sparkContext.accumulator(0)

    def load():
        def model(p, h):
            calls.add(len(p))
            return [(0.1, 0.2, 0.7)] * len(p)

        return model

    cache = spark.createDataFrame([("x", "x", 0.0, 0.0, 1.0, 2)], "premise string, hypothesis string, p_contradiction double, p_neutral double, p_entailment double, cls int")
    got = graph.scored_pairs(asked, ModelScorer(load, batch_size=1), cache).collect()
    assert len(got) == 4 and calls.value == 2
    assert {round(r.p_entailment, 6) for r in got} == {0.7, 1.0} and {r.cls for r in got} == {2}
    plain = {(r.premise, r.hypothesis): r.p_entailment for r in JaccardScorer().score(asked.distinct()).collect()}
    assert plain[("a b", "a")] == 0.5 and plain[("x", "x")] == 1.0


def test_trajectory_distance(spark):
    def load():
        return lambda p, h: [(0.0, 0.9, 0.1) if a != b else (0.0, 0.0, 1.0) for a, b in zip(p, h, strict=True)]

    rows = [("p", ["answer", "wrong", "answer"], "answer"), ("q", ["a", ""], "None"), ("r", ["None", "b"], "c")]
    steps = trajectory.steps_of(spark.createDataFrame(rows, "prompt_id string, step_answers array<string>, final_answer string"))
    d = trajectory.step_dissimilarities(steps, ModelScorer(load))
    got = {(r.prompt_id, r.step): r.d for r in d.collect()}
    assert got[("p", 0)] == 0 and abs(got[("p", 1)] - 0.9) < 1e-6 and got[("q", 0)] == 0 and got[("r", 0)] == 0 and abs(got[("r", 1)] - 0.9) < 1e-6
    ad = {r.prompt_id: r.ad for r in trajectory.averaged_dissimilarity(d).collect()}
    assert abs(ad["p"] - 0.3) < 1e-6 and ad["q"] is None
    w = spark.createDataFrame([(0, 0.5), (1, 0.3), (2, 0.2)], "step int, weight double")
    weighted = {r.prompt_id: r.ad for r in trajectory.averaged_dissimilarity(d, weights=w).collect()}
    assert abs(weighted["p"] - 0.27) < 1e-6 and weighted["r"] is None


def test_step_selection():
    t = trajectory
    assert t.last_steps(10, 3) == [6, 7, 8] and t.top_steps([0, 0.5, 0.1, 0.3, 0.05, 0], 3) == [1, 2, 3]
    assert 9 not in t.uniform_steps(10, 4) and t.uniform_steps(10, 4) == sorted(t.uniform_steps(10, 4))
    scopes = t.build_scopes(20, 5, ranges=3, random_scopes=2)
    assert scopes["full"] == list(range(20)) and scopes["range-0"] == [0, 1, 2, 3, 4] and scopes["range-2"] == [15, 16, 17, 18, 19]
    assert len(scopes["random-0"]) == 5 and t.random_steps(20, 5, 3) == t.random_steps(20, 5, 3)
    assert t.binarized_weights([1, 3], 5, 2) == [0, 0.5, 0, 0.5, 0] and t.select_steps(4, "full") == [0, 1, 2, 3]
    assert t.load_weights([0.1, 0.5, 0.9], 2) == [0, 1] and t.discretize([0, 1, 2], 1) == [2] and t.range_steps(3, 9, 0, 2) == [0, 1, 2]
    for bad in (lambda: t.select_steps(5, "odd", 2), lambda: t.select_steps(5, "last"), lambda: t.discretize([1], 1, "odd")):
        with pytest.raises(ValueError):
            bad()


def test_random_scope_draws_are_numpys(spark):
    got = trajectory.random_scope_steps(spark.createDataFrame([("a", 4, 30)], "prompt_id string, idx int, num_steps int"), 42, 5, 2).collect()
    for rep in (0, 1):
        want = sorted(np.random.default_rng(42 * 100_000 + 4_000 + rep).choice(30, 5, replace=False).tolist())
        assert sorted(r.step for r in got if r.rep == rep) == want


def test_mmd(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(6, 3)), rng.normal(size=(5, 3))
    owner = [0, 0, 1, 1, 2, 2]
    rows = [("x", o, v.tolist()) for o, v in zip(owner, x, strict=True)] + [("y", 10 + i, v.tolist()) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "side string, owner int, embedding array<double>")
    for gamma, k in ((None, lambda a, b: a @ b), (0.3, lambda a, b: math.exp(-0.3 * ((a - b) ** 2).sum()))):
        block = lambda p, q, keep=lambda i, j: True: np.mean([k(a, b) for i, a in enumerate(p) for j, b in enumerate(q) if keep(i, j)])
        biased = block(x, x) + block(y, y) - 2 * block(x, y)
        unbiased = block(x, x, lambda i, j: owner[i] != owner[j]) + block(y, y, lambda i, j: i != j) - 2 * block(x, y)
        assert abs(trajectory.mmd2(df, False, gamma).first()[0] - biased) < 1e-9 and abs(trajectory.mmd2(df, True, gamma).first()[0] - unbiased) < 1e-9
    assert math.isnan(trajectory.mmd2(df.where("side = 'x'")).first()[0])
    assert math.isnan(trajectory.mmd2(df.where("side = 'y' or owner = 0"), True).first()[0])
    assert trajectory.finite_mean_std([1, 3, math.nan]) == (2.0, 1.0, 2) and math.isnan(trajectory.finite_mean_std([])[0])


def test_mmd_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(trajectory, "BLOCK_POINTS", 7)
    rng = np.random.default_rng(8)
    points = [("x" if i % 3 else "y", i // 4, rng.normal(size=4).tolist()) for i in range(60)] + [("x", 1, [0.0] * 4)] * 3
    df = spark.createDataFrame(points, "side string, owner int, embedding array<double>")
    kernel = lambda a, b: np.exp(-0.3 * sum((p - q) ** 2 for p, q in zip(a, b, strict=True)))
    for unbiased in (False, True):
        mean = lambda g, h, u=unbiased: np.mean([kernel(a, b) for s, o, a in points if s == g for t, p, b in points if t == h and not (u and g == h and o == p)])
        want = mean("x", "x") + mean("y", "y") - 2 * mean("x", "y")
        assert abs(trajectory.mmd2(df, unbiased, 0.3).first()[0] - want) < 1e-9
    assert math.isnan(trajectory.mmd2(df.where("side = 'x'"), False, 0.3).first()[0])
    assert math.isnan(trajectory.mmd2(df.where("side = 'y'"), False, 0.3).first()[0])


def test_kernel_matrices_against_whole_kernels():
    e = np.random.default_rng(2).normal(size=(5, 3, 4))
    flat = e.reshape(15, 4)
    for kernel, k in (("linear", flat @ flat.T), ("rbf", np.exp(-((flat[:, None] - flat[None]) ** 2).sum(2)))):
        blocks = k.reshape(5, 3, 5, 3)
        own = sum(blocks[i, :, i] for i in range(5)) / 5
        other = sum(blocks[i, :, j] for i in range(5) for j in range(5) if i != j) / 20
        v, u, c = trajectory.kernel_matrices(e, kernel)
        assert np.allclose(u, (other + other.T) / 2) and np.allclose(c, own) and np.allclose(v, c - u)


def test_kernel_matrices_and_weights():
    rng = np.random.default_rng(2)
    v, u, c = trajectory.kernel_matrices(rng.normal(size=(4, 3, 5)), "rbf")
    for m in (v, u, c):
        assert m.shape == (3, 3) and np.allclose(m, m.T)
    assert np.allclose(trajectory.kernel_matrices(rng.normal(size=(1, 3, 5)))[0], 0)
    assert trajectory.verify_psd(np.eye(3))["is_psd"] and not trajectory.verify_psd(-np.eye(3))["is_psd"]
    w = trajectory.quadratic_weights(np.eye(4), np.zeros(4), 0.1)
    assert np.allclose(w, 0.25) and abs(trajectory.search_weights(c, np.arange(3.0), lambda w: -w[0])[1].sum() - 1) < 1e-9


def test_kernel_matrices_by_group_take_all_vectors(spark, data):
    rng = np.random.default_rng(5)
    whole = rng.normal(size=(13, 4, 6))
    lone, ragged = rng.normal(size=(1, 4, 6)), [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0)]
    loose = {p: rng.normal(size=6) for p in ragged}
    rows = [(g, i, s, m[i, s].tolist()) for g, m in (("a", whole), ("b", lone)) for i in range(len(m)) for s in range(4)] + [("c", i, s, v.tolist()) for (i, s), v in loose.items()]
    got = {r.g: r for r in trajectory.kernel_matrices_by_group(spark.createDataFrame(rows, "g string, trajectory int, step int, embedding array<float>"), "g").collect()}
    for g, m in (("a", whole), ("b", lone)):
        v = trajectory.kernel_matrices(m.astype(np.float32))[0]
        assert abs(got[g].trace - np.trace(v)) < 1e-5 and abs(got[g].min_eigenvalue - trajectory.verify_psd(v)["min_eigenvalue"]) < 1e-5
    mean = lambda s, t, own: [float(loose[i, s] @ loose[j, t]) for i, a in ragged for j, b in ragged if a == s and b == t and (i == j) == own]
    diff = np.array([[np.mean(mean(s, t, True)) - np.mean(mean(s, t, False) or mean(s, t, True)) for t in range(3)] for s in range(3)])
    assert abs(got["c"].trace - np.trace(diff)) < 1e-5 and abs(got["c"].min_eigenvalue - trajectory.verify_psd(diff)["min_eigenvalue"]) < 1e-5

    from lumenq import queries

    labels = {}
    for r in spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect():
        labels.setdefault(r.label, []).append(r.embedding)
    assert max(map(len, labels.values())) > 40  # a prefix of 40 gives other figures
    for r in queries.kernel_psd(spark, data).collect():
        vectors = np.array(labels[r.label], float)
        full = vectors[: len(vectors) // 4 * 4].reshape(-1, 4, vectors.shape[1])
        if len(vectors) % 4 == 0:
            assert abs(r.trace - np.trace(trajectory.kernel_matrices(full)[0])) < 2e-6


def test_directions(spark):
    names = features.all_feature_names()
    assert len(names) == len(set(names)) == 31
    got = {r.feature: r.direction for r in features.directions(spark).collect()}
    assert got["msp"] == got["full-ecc"] == got["random-se-conditional"] == "confidence" and got["mte"] == got["selected-eigval"] == "uncertainty"


def test_denoise_kernel():
    table = np.random.default_rng(3).normal(size=(12, 6))

    def model(x):
        return np.stack([table[: x.shape[1]]] * len(x))

    x, lp, ids = denoise.generate([[1, 2], [3]], model, mask_id=9, length=8, steps=8, block=4, keep=3)
    assert (x == table[2:10].argmax(-1)).all() and lp.shape == (2, 8, 3)
    want = table[2:10] - np.log(np.exp(table[2:10]).sum(-1, keepdims=True))
    assert np.allclose(lp[0], np.sort(want, -1)[:, ::-1][:, :3], atol=1e-6) and (ids[0, :, 0] == want.argmax(-1)).all()
    left, _, _ = denoise.generate([[1]], model, mask_id=9, length=4, steps=2, block=4, strategy="random")
    assert (left != 9).all()
    none, _, _ = denoise.generate([[1]], model, mask_id=9, length=8, steps=1, block=4)
    assert (none == 9).all()  # no step is left for a block
    assert denoise.block_schedule(8, None, 4) == (1, 4)
    for bad in (lambda: denoise.block_schedule(8, 3, 4), lambda: denoise.generate([[1]], model, 9, strategy="odd")):
        with pytest.raises(ValueError):
            bad()
    assert denoise.largest_batch(lambda n: n <= 37) == 33 and denoise.largest_batch(lambda n: False) == 1 and denoise.largest_batch(lambda n: True, 8, accelerated=False) == 8
    assert denoise.eos_ids(5, [7, 5], None) == [5, 7]
    assert [m[0] for m in denoise.generation_modes(1.0, True, 20, 42)] == ["greedy", "sampled"] and denoise.generation_modes(0.0, True, 20, 42) == [("greedy", 0.0, 1, 42)]


def test_denoise_frame(spark):
    def load():
        return lambda x: np.tile(np.arange(6.0), (*x.shape, 1))

    got = denoise.generate_frame(spark.createDataFrame([(0, [1, 2]), (1, [3])], "sample_id bigint, ids array<int>"), load, mask_id=9, length=2, steps=2, keep=2).orderBy("sample_id").collect()
    assert [r.tokens for r in got] == [[5, 5], [5, 5]] and got[0].topk_token_ids == [[5, 4], [5, 4]]


def test_kernels_are_summed_strip_by_strip(spark):
    rng = np.random.default_rng(9)
    n = 700  # of one block and one group, more than two strips
    assert 2 * trajectory.STRIP < n < trajectory.BLOCK_POINTS
    v = rng.normal(size=(n, 4))
    assert max(k.size for _, k in trajectory._strips(v, v, 0.3)) == trajectory.STRIP * n
    whole = np.exp(-0.3 * ((v[:, None] - v[None]) ** 2).sum(2))
    owner, step, x, y = np.arange(n) // 5, np.arange(n) % 5, np.arange(n) % 2 == 0, np.arange(n) % 2 == 1
    df = spark.createDataFrame([("x" if x[i] else "y", int(owner[i]), v[i].tolist()) for i in range(n)], "side string, owner int, embedding array<double>").repartition(3)
    apart = owner[:, None] != owner[None]
    for unbiased in (False, True):
        mean = lambda a, b, u=unbiased: whole[np.ix_(a, b)][apart[np.ix_(a, b)] if u and a is b else slice(None)].mean()
        assert abs(trajectory.mmd2(df, unbiased, 0.3).first()[0] - (mean(x, x) + mean(y, y) - 2 * mean(x, y))) < 1e-9
    points = spark.createDataFrame([("g", int(owner[i]), int(step[i]), v[i].tolist()) for i in range(n)], "g string, trajectory int, step int, embedding array<double>").repartition(3)
    for r in trajectory.kernel_sums(points, "g", "rbf", 0.3).collect():
        at = (step[:, None] == r.step) & (step[None] == r.other)
        assert abs(r.c - whole[at & ~apart].mean()) < 1e-9 and abs(r.a_u - whole[at & apart].mean()) < 1e-9


def test_vectors_of_different_lengths_are_an_error(spark):
    df = spark.createDataFrame([("x", 1, [1.0, 2.0]), ("y", 2, [1.0]), ("x", 3, [1.0]), ("y", 4, [1.0, 2.0])], "side string, owner int, embedding array<double>")
    with pytest.raises(Exception, match="lengths"):
        trajectory.mmd2(df, False, 0.3).first()
