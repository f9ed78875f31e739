"""Metrics against brute force in numpy, with ties, single classes and nulls."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenq.operators import metrics, resample
from lumenq.operators import prefix, report
from lumenq.operators.prefix import prefix_sums


def brute(s, y):
    n, p = len(y), int(sum(y))
    out = dict.fromkeys(metrics.METRICS)
    if n < 2 or p in (0, n):
        return out
    s, y = np.asarray(s, float), np.asarray(y)
    pos, neg = s[y == 1], s[y == 0]
    out["auroc"] = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    out["auprc"] = sum(((s >= v) & (y == 1)).sum() / (s >= v).sum() * ((s == v) & (y == 1)).sum() / p for v in np.unique(s))
    u = np.full(n, 0.5) if s.max() - s.min() < 1e-12 else (s - s.min()) / (s.max() - s.min())
    out["brier"] = np.mean((u - y) ** 2)
    edges = [i * 0.1 for i in range(10)]
    bins = np.array([max(i for i, e in enumerate(edges) if v >= e) for v in u])
    out["ece"] = sum((bins == b).mean() * abs(y[bins == b].mean() - u[bins == b].mean()) for b in set(bins.tolist()))
    order, best = sorted(range(n), key=lambda i: (s[i], i)), sorted(range(n), key=lambda i: (y[i], i))
    ks = [max(1, round(c * n)) for c in metrics.COVERAGES]
    curve = lambda o: [np.mean([y[i] for i in o[:k]]) for k in ks]
    area = lambda r: sum((a - b) * (x + z) / 2 for (a, x), (b, z) in itertools.pairwise(zip(metrics.COVERAGES, r, strict=True)))
    flat = area([p / n] * 6)
    if abs(flat - area(curve(best))) >= 1e-12:
        out["prr"] = (flat - area(curve(order))) / (flat - area(curve(best)))
    if n >= 3:
        rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
        if len(set(s.tolist())) > 1:
            out["spearman_rho"] = np.corrcoef(rank(s), rank(y))[0, 1]
            c = sum(np.sign(s[i] - s[j]) * np.sign(y[i] - y[j]) for i in range(n) for j in range(i))
            ts = n * (n - 1) / 2 - sum(s[i] == s[j] for i in range(n) for j in range(i))
            out["kendall_tau"] = c / np.sqrt(ts * p * (n - p))
    return out


CASES = {
    "random": lambda r: (r.normal(size=60), r.integers(0, 2, 60)),
    "ties": lambda r: (r.integers(0, 4, 80), (r.random(80) < 0.3).astype(int)),
    "constant": lambda r: (np.ones(10), np.array([0, 1] * 5)),
    "one class": lambda r: (r.normal(size=6), np.zeros(6, int)),
    "all wrong": lambda r: (r.normal(size=6), np.ones(6, int)),
    "two rows": lambda r: (np.array([0.0, 1.0]), np.array([0, 1])),
    "one row": lambda r: (np.array([1.0]), np.array([1])),
    "perfect": lambda r: (np.arange(20), (np.arange(20) >= 12).astype(int)),
    "worst": lambda r: (-np.arange(20), (np.arange(20) >= 12).astype(int)),
}


def test_all_metrics_against_brute_force(spark):
    rng = np.random.default_rng(0)
    made = {k: f(rng) for k, f in CASES.items()}
    rows = [(k, i, int(y), float(s)) for k, (ss, ys) in made.items() for i, (s, y) in enumerate(zip(ss, ys, strict=True))]
    got = {r.feature: r for r in metrics.evaluate_scores(spark.createDataFrame(rows, "feature string, id bigint, y int, s double")).collect()}
    assert set(got) == set(made)
    for k, (s, y) in made.items():
        for m, v in brute(s, y).items():
            assert (got[k][m] is None) == (v is None) and (v is None or abs(got[k][m] - v) < 1e-9), (k, m, got[k][m], v)
    assert abs(got["perfect"].prr - 1) < 1e-12 and got["perfect"].auroc == 1 and got["worst"].auroc == 0


def test_symmetry_and_bounds(spark):
    rng = np.random.default_rng(1)
    rows = [(f, i, int(y), float(sign * s)) for f, sign in (("a", 1), ("b", -1)) for i, (s, y) in enumerate(zip(rng.normal(size=200), np.random.default_rng(2).integers(0, 2, 200), strict=True))]
    half = len(rows) // 2
    rows = rows[:half] + [("b", i, y, -s) for _, i, y, s in rows[:half]]
    got = {r.feature: r for r in metrics.evaluate_scores(spark.createDataFrame(rows, "feature string, id bigint, y int, s double")).collect()}
    assert abs(got["a"].auroc + got["b"].auroc - 1) < 1e-9 and abs(got["a"].kendall_tau + got["b"].kendall_tau) < 1e-9
    assert all(0 <= r.ece <= 1 and 0 <= r.brier <= 1 for r in got.values())


@pytest.mark.parametrize("blocks", [1, 2, 32, None])
def test_prefix_sums(spark, blocks, monkeypatch):
    monkeypatch.setattr(prefix, "ROWS_A_BLOCK", 70)
    rng = np.random.default_rng(3)
    rows = [(k, int(o), int(v)) for k in ("x", None) for o, v in zip(rng.permutation(300), rng.integers(0, 9, 300), strict=True)]
    got = prefix_sums(spark.createDataFrame(rows, "k string, o bigint, v bigint"), ["k"], "o", ["v"], blocks).collect()
    for k in ("x", None):
        own = sorted((r for r in got if r.k == k), key=lambda r: r.o)
        assert [r.v_before for r in own] == [0, *itertools.accumulate(r.v for r in own)][:-1]


@pytest.mark.parametrize("keys", [["k"], []])
def test_prefix_max_and_fronts(spark, keys, monkeypatch):
    monkeypatch.setattr(prefix, "ROWS_A_BLOCK", 40)
    rng = np.random.default_rng(5)
    rows = [(k, int(i) + 500 * (k == "y"), float(x), int(y)) for k in ("x", "y") for i, x, y in zip(range(300), rng.integers(0, 90, 300), rng.integers(0, 50, 300), strict=True)]
    df = spark.createDataFrame(rows, "k string, id bigint, x double, y int")
    front = {r.id for r in report.pareto(df, group=keys).where("on_front").collect()}
    want = set()
    for part in ([[r for r in rows if r[0] == k] for k in ("x", "y")] if keys else [rows]):
        best = None
        for _, i, _, y in sorted(part, key=lambda r: (r[2], -r[3], r[1])):
            if best is None or y > best:
                want.add(i)
                best = y
    assert front == want
    distinct = df.dropDuplicates(["x", *keys])
    got = prefix.prefix_max(distinct, keys, "x", "y").collect()
    for r in got:
        before = [o.y for o in got if o.x < r.x and (not keys or o.k == r.k)]
        assert r.y_before == (max(before) if before else None)


def wide(spark):
    rows = [(str(i), None if i == 0 else i % 3 > 0, 5 + i, float(i) if i != 4 else None, float(-i), float(i % 2), float(i % 3)) for i in range(30)]
    return spark.createDataFrame(rows, "prompt_id string, is_correct boolean, n_visible_tokens int, msp double, `se-marginal` double, `random-0-ecc` double, `random-1-ecc` double")


def test_evaluate_run(spark):
    rows = wide(spark).withColumn("id", F.col("prompt_id").cast("bigint")).drop("prompt_id")
    got = {r.feature: r for r in metrics.evaluate_run(rows, id_col="id").collect()}
    assert set(got) == {"msp", "se-marginal", "random-ecc"}
    assert got["random-ecc"].n_random_selections == 2 and got["msp"].n_random_selections is None
    s = [(-float(i), int(i % 3 == 0)) for i in range(1, 30) if i != 4]
    assert abs(got["msp"].auroc - brute(*zip(*s, strict=True))["auroc"]) < 1e-9  # msp speaks for confidence
    summary = metrics.run_summary(rows).first()
    assert (summary.n_examples, summary.n_correct, summary.n_wrong) == (29, 20, 9) and abs(summary.accuracy - 20 / 29) < 1e-12
    with pytest.raises(ValueError):
        metrics.evaluate_run(rows.where("is_correct is null"))


def test_bootstrap(spark):
    rng = np.random.default_rng(4)
    rows = [("f", i, int(y), float(s)) for i, (s, y) in enumerate(zip(rng.normal(size=30), rng.integers(0, 2, 30), strict=True))]
    df = spark.createDataFrame(rows, "feature string, id bigint, y int, s double")
    drawn = resample.resamples(df, 5).collect()
    assert len(drawn) == 150 and {r.rep for r in drawn} == set(range(5))
    values = [brute([r.s for r in drawn if r.rep == k], [r.y for r in drawn if r.rep == k])["auroc"] for k in range(5)]
    got = resample.bootstrap_metrics(df, 5).first()
    assert abs(got.auroc_bootstrap_mean - np.mean(values)) < 1e-9 and abs(got.auroc_bootstrap_std - np.std(values, ddof=1)) < 1e-9
    assert abs(got.auroc_ci_low - np.percentile(values, 2.5)) < 1e-9 and got.valid_bootstrap == 5
    one = spark.createDataFrame([("f", 0, 1, 1.0), ("f", 1, 1, 2.0)], "feature string, id bigint, y int, s double")
    assert resample.bootstrap_metrics(one, 5).count() == 0  # no resample has both classes


def test_generator_draws_are_numpys(spark):
    got = resample.generator_draws(spark, 7, 3, seed=5).orderBy("rep", "draw").collect()
    rng = np.random.default_rng(5)
    assert [r.pos for r in got] == np.concatenate([rng.integers(0, 7, 7) for _ in range(3)]).tolist()


@pytest.mark.parametrize("n,reps,slice_words", [(1, 4, 16), (2, 9, 4), (1000, 40, 128), (50_001, 3, 4096), (1 << 16, 2, 1 << 14)])
def test_generator_draws_by_slices(spark, n, reps, slice_words):
    got = resample.generator_draws(spark, n, reps, 11, slice_words).orderBy("rep", "draw").toPandas()
    rng = np.random.default_rng(11)
    assert got.pos.tolist() == np.concatenate([rng.integers(0, n, n) for _ in range(reps)]).tolist()
    assert got.rep.tolist() == np.repeat(np.arange(reps), n).tolist()


def test_refused_words_are_those_of_numpy():
    n = 3_000_000_011  # three words in ten are refused
    words, kept = resample._raw_words(3, 0, 4000), []
    for w in words.tolist():
        if w * n % 2**32 >= (2**32 - n) % n:
            kept.append(w * n >> 32)
    assert kept[:2000] == np.random.default_rng(3).integers(0, n, 2000).tolist()


def test_aggregate_folds(spark):
    rows = [("baseline", "f", "auroc", 0, 0.5), ("baseline", "f", "auroc", 2, 0.7), ("baseline", "f", "auroc", 1, float("nan")), ("baseline", "g", "auroc", 0, None)]
    got = resample.aggregate_folds(spark.createDataFrame(rows, "section string, feature string, metric string, fold int, value double")).collect()
    assert len(got) == 1 and abs(got[0]["mean"] - 0.6) < 1e-12 and abs(got[0]["std"] - 0.1) < 1e-12
    assert got[0].per_fold[0] == 0.5 and np.isnan(got[0].per_fold[1]) and got[0].per_fold[2] == 0.7


def ids(spark, n):
    return spark.createDataFrame([(str(i), i % 11 == 0) for i in range(n)], "prompt_id string, is_correct boolean")


def test_splits(spark, tmp_path):
    got = resample.split_prompts(ids(spark, 100).select("prompt_id"), 10, 30, 40)
    rows = got.collect()
    assert {s: sum(r.split == s for r in rows) for s in ("train", "val", "test")} == {"train": 10, "val": 30, "test": 40}
    assert len({r.prompt_id for r in rows}) == 80
    assert sorted(rows) == sorted(resample.split_prompts(ids(spark, 100).select("prompt_id"), 10, 30, 40).collect())
    assert sorted(rows) != sorted(resample.split_prompts(ids(spark, 100).select("prompt_id"), 10, 30, 40, seed=1).collect())
    with pytest.raises(ValueError, match="80.*50"):
        resample.split_prompts(ids(spark, 50).select("prompt_id"), 10, 30, 40)
    resample.save_splits(got, f"{tmp_path}/s.json", seed=42)
    back, about = resample.load_splits(spark, f"{tmp_path}/s.json")
    assert sorted((r.split, r.prompt_id) for r in back.collect()) == sorted((r.split, r.prompt_id) for r in rows)
    assert about == {"seed": 42, "counts": {"test": 40, "train": 10, "val": 30}}


@pytest.mark.parametrize("label", [None, "is_correct"])
def test_folds(spark, tmp_path, label):
    got = resample.kfold_splits(ids(spark, 83), 5, 20, label=label)
    rows = got.collect()
    sizes = sorted(sum(r.fold == f and r.role == "test" for r in rows) for f in range(5))
    assert sizes == [16, 16, 17, 17, 17]
    for f in range(5):
        own = {role: {r.id for r in rows if r.fold == f and r.role == role} for role in ("train", "val", "test")}
        assert len(own["train"]) == 20 and sum(map(len, own.values())) == 83 == len(set.union(*own.values()))
    assert len({r.id for r in rows if r.role == "test"}) == 83
    for k, n in ((1, 5), (84, 5), (5, 70)):
        with pytest.raises(ValueError):
            resample.kfold_splits(ids(spark, 83), k, n)
    resample.save_splits(got, f"{tmp_path}/f.json", n_train=20, seed=42)
    back, about = resample.load_splits(spark, f"{tmp_path}/f.json")
    assert sorted((r.fold, r.role, r.id) for r in back.collect()) == sorted((r.fold, r.role, r.id) for r in rows)
    assert about == {"k": 5, "n_train": 20, "seed": 42}


def test_alternating_labels_reach_every_fold(spark):
    some = spark.createDataFrame([(i, i % 2 == 0) for i in range(12)], "prompt_id bigint, is_correct boolean")
    rows = resample.kfold_splits(some, 2, 3, label="is_correct").collect()
    for f in range(2):
        for role, n in (("test", 6), ("train", 3), ("val", 3)):
            own = [r.id % 2 for r in rows if r.fold == f and r.role == role]
            assert len(own) == n and abs(sum(own) - n / 2) < 1


def test_stratified_folds_keep_shares(spark):
    some = spark.createDataFrame([(i, i < 92) for i in range(1000)], "prompt_id bigint, is_correct boolean")
    rows = resample.kfold_splits(some, 3, 300, label="is_correct").collect()
    for f in range(3):
        for role in ("train", "val", "test"):
            own = [r.id < 92 for r in rows if r.fold == f and r.role == role]
            assert abs(sum(own) / len(own) - 0.092) < 0.02


def test_draws_meet_their_rows_without_a_broadcast(spark):
    df = spark.createDataFrame([("f", i, i % 2, float(i)) for i in range(50)], "feature string, id bigint, y int, s double")
    plan = resample.resamples(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # the rows' side grows with the table


def test_nested_runs_are_found_without_a_shuffle_of_the_runs(spark):
    paths = ["out/r0", "out/r0/1", "out/r01/1", "out/r1/x/y", "out/r1/x", "out/r1", None, "", "/out/r0/1", "other"]
    runs = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, run_dir string")
    kfold = spark.createDataFrame([("out/r0",), ("out/r1/x",), (None,), ("out/r0",), ("none/of/these/there",)], "run_dir string")
    left = report.without_nested(runs, kfold)
    assert sorted(r.i for r in left.collect()) == [2, 5, 6, 7, 8, 9] and left.columns == runs.columns
    assert report.without_nested(runs, kfold.limit(0)).count() == len(paths)
    assert [r.i for r in report.without_nested(runs, spark.createDataFrame([("",)], "run_dir string")).collect()] == [i for i, p in enumerate(paths) if p is None or p.split("/")[0] != ""]
    one = report.without_nested(runs, spark.createDataFrame([("out/r0",)], "run_dir string"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "explode" not in plan.lower()
