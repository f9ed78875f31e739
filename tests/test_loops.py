"""Loops and sums over tables against plain arrays: denoising, tiles of kernels, step weights, spectral moments."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenq.operators import denoise, graph, trajectory
from lumenq.plans import pipeline

TABLE = np.random.default_rng(4).normal(size=(3, 11, 6)).round(4)  # sample, position, token
MASK, PAD = 6, 7


def table_model(spark):
    rows = [(s, p, t, float(TABLE[s, p, t])) for s, p, t in itertools.product(*map(range, TABLE.shape))]
    own = spark.createDataFrame(rows, "sample_id bigint, pos int, token_id int, own double").persist()

    def model(state, asked):
        before = state.select("sample_id", "pos", F.lag("token_id").over(Window.partitionBy("sample_id").orderBy("pos")).alias("before"))
        return asked.join(before, ["sample_id", "pos"]).join(own, ["sample_id", "pos"]).select("sample_id", "pos", "token_id", (F.col("own") + F.when(F.col("before") == F.col("token_id"), 1.5).otherwise(0.0)).alias("logit"))

    return model


def array_model(x):
    logits = TABLE[: len(x)].copy()
    for s, p in itertools.product(range(len(x)), range(1, x.shape[1])):
        if x[s, p - 1] < 6:
            logits[s, p, x[s, p - 1]] += 1.5
    return logits


@pytest.mark.parametrize(("steps", "block", "scale", "eos", "logits_inf", "sure_inf"), [(8, 4, 0.0, (), False, False), (4, 8, 0.7, (2,), True, False), (5, 4, 0.7, (1, 4), False, True), (1, 4, 0.0, (), False, False)])
def test_denoising_as_joins_is_the_loop_over_arrays(spark, steps, block, scale, eos, logits_inf, sure_inf):
    prompts = [[1, 2, 3], [4], [5, 0]]
    model = table_model(spark)
    sequences = denoise.masked_sequences(spark.createDataFrame(list(enumerate(prompts)), "sample_id bigint, ids array<int>"), 8, MASK, PAD)
    made = denoise.denoised(sequences, model, MASK, 8, steps, block, scale=scale, eos=eos, logits_eos_inf=logits_inf, confidence_eos_inf=sure_inf)
    tokens, logs, ids = denoise.generate(prompts, array_model, MASK, PAD, 8, steps, block, scale=scale, eos=eos, logits_eos_inf=logits_inf, confidence_eos_inf=sure_inf, keep=2)
    got = made.where("not is_prompt").orderBy("sample_id", "pos").collect()
    assert [r.token_id for r in got] == tokens.ravel().tolist()
    top = denoise.final_log_probabilities(made, model, 2).orderBy("sample_id", "pos", "rank").collect()
    assert [r.token_id for r in top] == ids.ravel().tolist() and np.allclose([r.logprob for r in top], logs.ravel(), atol=1e-5)


def test_denoising_at_random_does_not_depend_on_partitions(spark):
    model = table_model(spark)
    sequences = denoise.masked_sequences(spark.createDataFrame([(0, [1]), (1, [2]), (2, [3])], "sample_id bigint, ids array<int>"), 8, MASK, PAD)
    runs = [denoise.denoised(sequences.repartition(n), model, MASK, 8, 4, 4, temperature=0.7, strategy="random", seed=s).orderBy("sample_id", "pos").collect() for n, s in ((1, 3), (5, 3), (1, 4))]
    assert runs[0] == runs[1] != runs[2] and all(r.token_id != MASK for r in runs[0])
    assert denoise.denoised(sequences.limit(0), model, MASK, 8, 4).count() == 0
    with pytest.raises(ValueError, match="strategy"):
        denoise.denoised(sequences, model, MASK, 8, 4, strategy="x")


def test_tiles_give_the_sums_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(trajectory, "BLOCK_POINTS", 7)
    rng = np.random.default_rng(6)
    points = [(g, i, s, rng.normal(size=3).tolist()) for g, n in (("a", 15), (None, 4), ("c", 1)) for i in range(n) for s in range(3) if not (g == "a" and i == 2 and s == 1)]
    got = {(r.g, r.step, r.other): r for r in trajectory.kernel_sums(spark.createDataFrame(points, "g string, trajectory int, step int, embedding array<double>"), "g", "rbf", 0.3).collect()}
    assert len(got) == 27
    for (g, s, t), r in got.items():
        pairs = [(i == j, np.exp(-0.3 * ((np.array(v) - w) ** 2).sum())) for (h, i, a, v), (k, j, b, w) in itertools.product(points, points) if h == k == g and (a, b) == (s, t)]
        own, other = ([k for same, k in pairs if same == want] for want in (True, False))
        assert r.c == pytest.approx(np.mean(own)) and r.a_u == pytest.approx(np.mean(other or own))
    whole = rng.normal(size=(9, 3, 4))
    rows = [("x", i, s, whole[i, s].tolist()) for i in range(9) for s in range(3)]
    found = trajectory.kernel_matrices_by_group(spark.createDataFrame(rows, "g string, trajectory int, step int, embedding array<double>"), "g", "rbf", 0.5).first()
    v = trajectory.kernel_matrices(whole, "rbf", 0.5)[0]
    assert found.trace == pytest.approx(np.trace(v)) and found.min_eigenvalue == pytest.approx(np.linalg.eigvalsh(v).min())


def test_step_weights_are_certified(spark):
    rng = np.random.default_rng(7)
    for _ in range(40):
        t = int(rng.integers(2, 9))
        m = rng.normal(size=(t, t))
        a, gain, ridge = m @ m.T, rng.normal(size=t) * rng.integers(0, 2), float(rng.choice([0.0, 0.1, 5]))
        w = trajectory.quadratic_weights(a, gain, ridge)
        objective, gap, residual = trajectory.certificate(a, gain, ridge, w)
        assert w.min() >= 0 and abs(w.sum() - 1) < 1e-9 and gap < 1e-6 * max(1, np.abs(a).max()) and residual < 1e-4
        others = rng.dirichlet(np.ones(t), 300)
        assert (np.einsum("ij,jk,ik->i", others, a + ridge * np.eye(t), others) - others @ gain).min() >= objective - gap - 1e-9
    # the last step is the same in all trajectories, the others are not: it takes nearly all the weight
    rows = [(0, i, s, ([1.0, 0.0] if s == 2 else rng.normal(size=2).tolist())) for i in range(30) for s in range(3)]
    got = trajectory.step_weights(spark.createDataFrame(rows, "k int, trajectory int, step int, embedding array<double>"), "k", ridge=0.01).orderBy("step").collect()
    assert got[2].weight > 0.9 and sum(r.weight for r in got) == pytest.approx(1) and got[0].gap < 1e-8 and got[0].shift == 0


def test_weights_are_used_by_the_plan_and_the_command(spark, tmp_path):
    from lumenq import cli

    texts = lambda p, k: ["a b", f"x{p} y{k}", f"answer {p}"]
    talks = [{"prompt_id": p, "num_steps": 3, "response_sample_id": k, "step_answers": texts(p, k), "final_answer": f"answer {p}"} for p in range(6) for k in range(2)]
    (tmp_path / "trajectories.jsonl").write_text("\n".join(json.dumps(t) for t in talks))
    (tmp_path / "features.jsonl").write_text("\n".join(json.dumps({"prompt_id": p, "is_correct": p % 2 == 0, "msp": 0.1}) for p in range(7)))
    cli.main(["weights", str(tmp_path / "features.jsonl"), str(tmp_path / "trajectories.jsonl"), str(tmp_path / "out.jsonl"), "--weights", str(tmp_path / "w.json")])
    weights = json.loads((tmp_path / "w.json").read_text())
    assert [w["step"] for w in weights] == [0, 1, 2] and sum(w["weight"] for w in weights) == pytest.approx(1) and weights[0]["gap"] < 1e-6
    assert weights[0]["weight"] > 0.6  # all trajectories begin alike
    rows = {r["prompt_id"]: r for r in map(json.loads, (tmp_path / "out.jsonl").read_text().splitlines())} if (tmp_path / "out.jsonl").is_file() else {r.prompt_id: r.asDict() for r in spark.read.json(str(tmp_path / "out.jsonl")).collect()}
    assert len(rows) == 7 and rows[6].get("weighted-ad") is None
    d = {r.step: r.d for r in trajectory.step_dissimilarities(trajectory.steps_of(spark.createDataFrame([("z", texts(1, 0), "answer 1")], "prompt_id string, step_answers array<string>, final_answer string"))).collect()}
    assert rows[1]["weighted-ad"] == pytest.approx(sum(w["weight"] * d[w["step"]] for w in weights), abs=1e-6)


def test_hashed_vectors(spark):
    got = trajectory.hashed_vectors(spark.createDataFrame([(0, "A b"), (1, "b, a!"), (2, None), (3, "a b b")], "i int, text string"), ["i"]).orderBy("i").collect()
    v = [np.array(r.embedding) for r in got]
    assert np.allclose(v[0], v[1]) and not v[2].any() and [round(float((x**2).sum()), 9) for x in v] == [1, 1, 0, 1] and not np.allclose(v[0], v[3])


def test_power_sums_certify_eigenvalues(spark):
    rng = np.random.default_rng(8)
    edges = [(p, n, i, j, float(w[i, j])) for p, n in ((0, 2), (1, 7), (2, 1)) for w in [(lambda x: (x + x.T) / 2)(rng.normal(size=(n, n)))] for i in range(n) for j in range(n)]
    for r in graph.spectral_moments(spark.createDataFrame(edges, "prompt_id int, n int, i int, j int, w double"), 3).collect():
        lap = np.zeros((r.n, r.n))
        for p, _, i, j, x in edges:
            if p == r.prompt_id and i != j:
                lap[i, j] -= max(x, 0)
                lap[i, i] += max(x, 0)
        assert [r.power_1, r.power_2, r.power_3] == pytest.approx([np.trace(np.linalg.matrix_power(lap, k)) for k in (1, 2, 3)]) and r.residual < 1e-9


def test_fourier_features_come_near_the_kernel(spark):
    rng = np.random.default_rng(9)
    rows = [("x" if i % 2 else "y", i // 4, rng.normal(i % 2, 1, 3).tolist()) for i in range(120)] + [("z", 0, [0.0] * 3)]
    points = spark.createDataFrame(rows, "side string, owner int, embedding array<double>")
    for unbiased in (False, True):
        exact = trajectory.mmd2(points, unbiased, 0.2).first().mmd2
        near = trajectory.mmd2_fourier(points, 0.2, unbiased, 128, 4).first()
        again = trajectory.mmd2_fourier(points.repartition(5), 0.2, unbiased, 128, 4).first()
        assert abs(near.mmd2 - exact) <= near.bound and abs(near.mmd2 - exact) < 0.1 and abs(again.mmd2 - near.mmd2) < 1e-9
    v = [np.array(r.embedding) for r in trajectory.fourier_features(points.limit(2), 0.2, 20_000).collect()]
    raw = [np.array(r.embedding) for r in points.limit(2).collect()]
    assert abs(v[0] @ v[1] - np.exp(-0.2 * ((raw[0] - raw[1]) ** 2).sum())) < 0.05 and abs(v[0] @ v[0] - 1) < 1e-9
    assert np.isnan(trajectory.mmd2_fourier(points.where("side = 'z'"), 0.2, repeats=1).first().mmd2)
