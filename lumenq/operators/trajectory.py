"""Answer trajectories: distance of steps from the final answer, scopes, step selection and kernel discrepancies."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.backends import EntailmentScorer
from lumenq.functions.text import is_valid_text
from lumenq.operators.graph import MAX_ITEMS, pairs, sampling_features, scored_pairs, subsample
from lumenq.staging import staged

#: Steps of a random scope, and how many are drawn.
RANDOM_STEPS, RANDOM_SCOPES = 20, 5


def modal_length(trajectories: DataFrame, steps: str = "num_steps", order: str = "ord") -> DataFrame:
    """Trajectories with the most common number of steps; of equally common ones, the one seen first."""
    counts = trajectories.groupBy(steps).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
    best = counts.agg(F.max_by(F.col(steps), F.struct("__n", (-F.col("__first")).alias("f"))).alias("__steps"))
    return trajectories.join(best, trajectories[steps] == best["__steps"], "left_semi")


def target_trajectory(samples: DataFrame, key: str = "prompt_id", sample: str = "response_sample_id") -> DataFrame:
    """Each prompt's trajectory with the lowest sample id."""
    columns = [c for c in samples.columns if c != key]
    return samples.groupBy(key).agg(F.min_by(F.struct(*columns), F.col(sample)).alias("__t")).select(key, *[F.col("__t")[c].alias(c) for c in columns])


def steps_of(trajectories: DataFrame, key: Sequence[str] = ("prompt_id",)) -> DataFrame:
    """(key, step, text, final) from arrays of step answers."""
    return trajectories.select(*key, F.posexplode("step_answers").alias("step", "text"), F.col("final_answer").alias("final"))


def _with_final(steps: DataFrame) -> tuple[DataFrame, Column]:
    """(both directions of each distinct step and final answer that differ, which steps those are)."""
    valid = is_valid_text(F.col("text")) & is_valid_text(F.col("final")) & (F.col("text") != F.col("final"))
    ask = steps.where(valid).select("text", "final").distinct()
    one = lambda a, b: F.struct(F.col(a).alias("premise"), F.col(b).alias("hypothesis"), "text", "final")
    return ask.select(F.explode(F.array(one("text", "final"), one("final", "text"))).alias("p")).select("p.*"), valid


def needed_pairs(steps: DataFrame, scopes: Sequence[tuple[DataFrame, str]] = (), most: int = MAX_ITEMS) -> list[DataFrame]:
    """What step_dissimilarities of steps, and trajectory_features of each (steps of a scope, key), will ask a scorer for."""
    found = [_with_final(steps)[0].select("premise", "hypothesis")]
    for rows, key in scopes:
        items = subsample(rows.where(is_valid_text(F.col("text"))), most, key, "step").select(key, "n", "i", "text")
        found.append(pairs(items, "text", key).select("premise", "hypothesis"))
    return found


def step_dissimilarities(steps: DataFrame, scorer: EntailmentScorer | None = None) -> DataFrame:
    """steps with d: 1 minus the mean entailment of step and final answer in both directions.

    0 for a step equal to the final answer, and where either is not valid. Distinct pairs are scored once.
    """
    both, valid = _with_final(steps)
    scored = scored_pairs(both, scorer).groupBy("text", "final").agg((1 - F.avg("p_entailment")).alias("__d"))
    found = steps.join(scored, ["text", "final"], "left")
    return found.select(*steps.columns, F.when(valid, F.coalesce("__d", F.lit(0.0))).otherwise(0.0).alias("d"))


def averaged_dissimilarity(distances: DataFrame, key: str = "prompt_id", weights: DataFrame | None = None) -> DataFrame:
    """(key, ad): mean of d over all steps, or its product with weights (step, weight).

    Null for an invalid final answer, and where the number of weights is not that of the steps.
    """
    final_ok = F.bool_and(is_valid_text(F.col("final")))
    if weights is None:
        return distances.groupBy(key).agg(F.when(final_ok, F.avg("d")).alias("ad"))
    n = weights.agg(F.count("*").alias("__n"))
    joined = distances.join(weights.select("step", "weight"), "step", "left").join(n, F.lit(True))
    fits = (F.count("*") == F.max("__n")) & (F.count("weight") == F.max("__n"))
    return joined.groupBy(key).agg(F.when(final_ok & fits, F.sum(F.col("weight") * F.col("d"))).alias("ad"))


# --- which steps -----------------------------------------------------------------------------------------------------


def _check(t: int, k: int | None) -> int:
    if k is None or k < 1:
        raise ValueError("a number of steps is needed")
    return min(k, t)


def uniform_steps(t: int, k: int) -> list[int]:
    """k steps evenly spaced before the last."""
    return sorted({int(round(x)) for x in np.linspace(0, t - 2, _check(t - 1, k))}) if t > 1 else []


def last_steps(t: int, k: int) -> list[int]:
    """The k steps before the last."""
    return list(range(max(0, t - 1 - _check(max(t - 1, 1), k)), t - 1))


def range_steps(t: int, k: int, part: int, parts: int) -> list[int]:
    """Window part of parts of k steps: the first begins at 0, the last ends at t - 1, evenly spaced between."""
    k = _check(t, k)
    start = 0 if parts == 1 else int(round(part * (t - k) / (parts - 1)))
    return list(range(start, start + k))


def random_steps(t: int, k: int, seed: int) -> list[int]:
    """k steps without replacement by numpy's generator, sorted."""
    return sorted(np.random.default_rng(seed).choice(t, size=_check(t, k), replace=False).tolist())


def top_steps(weights: Sequence[float], k: int) -> list[int]:
    """The k steps of largest weight, ties to the earlier, sorted; a weight of 0 is never taken."""
    order = sorted((i for i, w in enumerate(weights) if w > 0), key=lambda i: (-weights[i], i))
    return sorted(order[: _check(len(weights), k)])


def rounded_steps(weights: Sequence[float], k: int, seed: int) -> list[int]:
    """k steps drawn without replacement in proportion to their weights, sorted."""
    w = np.maximum(np.asarray(weights, float), 0)
    k = min(_check(len(w), k), int((w > 0).sum()))
    return sorted(np.random.default_rng(seed).choice(len(w), size=k, replace=False, p=w / w.sum()).tolist()) if k else []


def discretize(weights: Sequence[float], k: int, mode: str = "top_k", seed: int = 0) -> list[int]:
    if mode == "top_k":
        return top_steps(weights, k)
    if mode == "randomized":
        return rounded_steps(weights, k, seed)
    raise ValueError(f"unknown mode {mode}")


def binarized_weights(steps: Sequence[int], t: int, k: int) -> list[float]:
    """1 / k at the steps, 0 elsewhere."""
    return [1.0 / k if i in set(steps) else 0.0 for i in range(t)]


def top_step_weights(weights: Column, k: Column) -> Column:
    """top_steps and binarized_weights over a column of weight arrays: 1 / k at the k largest weights above 0, else 0.

    Ties go to the earlier step; k beyond the number of weights takes all of them.
    """
    places = F.filter(F.transform(weights, lambda w, i: F.struct((-w).alias("w"), i.alias("i"))), lambda x: x["w"] < 0)
    chosen = F.transform(F.slice(F.array_sort(places), F.lit(1), k), lambda x: x["i"])
    return F.transform(weights, lambda w, i: F.when(F.array_contains(chosen, i), 1.0 / k).otherwise(0.0))


def load_weights(weights: Sequence[float], k: int) -> list[int]:
    """Steps of trained weights: the last step's weight is left out."""
    return top_steps(list(weights)[:-1], min(k, max(1, len(weights) - 1)))


def build_scopes(t: int, k: int, ranges: int = 0, random_scopes: int = 0, seed: int = 0) -> dict[str, list[int]]:
    """full, range-<i> and random-<i> scopes."""
    out = {"full": list(range(t))}
    out |= {f"range-{i}": range_steps(t, k, i, ranges) for i in range(ranges)}
    return out | {f"random-{i}": random_steps(t, k, seed + i) for i in range(random_scopes)}


def select_steps(t: int, mode: str, k: int | None = None, seed: int = 0) -> list[int]:
    """Steps by a mode: full, uniform, last, random."""
    if mode == "full":
        return list(range(t))
    found = {"uniform": uniform_steps, "last": last_steps, "random": lambda t, k: random_steps(t, k, seed)}.get(mode)
    if found is None:
        raise ValueError(f"unknown mode {mode}")
    return found(t, _check(t, k))


def in_scope(steps: DataFrame, t: Column, k: int, mode: str, part: int = 0, parts: int = 1) -> DataFrame:
    """Rows of steps within a scope, where the number of steps t is a column: uniform, last or range, without a join."""
    step, size = F.col("step"), F.least(F.lit(k), t)
    if mode == "last":
        return steps.where((step >= F.greatest(t - 1 - k, F.lit(0))) & (step < t - 1))
    if mode == "range":
        start = F.lit(0) if parts == 1 else F.bround(F.lit(part) * (t - size) / (parts - 1), 0)
        return steps.where((step >= start) & (step < start + size))
    if mode == "uniform":
        m = F.least(F.lit(k), t - 1)
        wanted = F.transform(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0)).cast("int")), lambda i: F.coalesce(F.bround(F.try_divide(i * (t - 2), m - 1), 0), F.lit(0.0)).cast("int"))
        return steps.where((t > 1) & F.array_contains(wanted, step))
    raise ValueError(f"unknown mode {mode}")


def random_scope_steps(prompts: DataFrame, seed: int, k: int = RANDOM_STEPS, scopes: int = RANDOM_SCOPES) -> DataFrame:
    """(prompt_id, rep, step) from (prompt_id, idx, num_steps): draws seeded by seed * 100000 + idx * 1000 + rep."""
    kind = prompts.schema["prompt_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(p, rep, step) for p, idx, t in zip(*(batch.column(c).to_pylist() for c in ("prompt_id", "idx", "num_steps")), strict=True) if t for rep in range(scopes) for step in random_steps(t, k, seed * 100_000 + idx * 1_000 + rep)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.schema.field("prompt_id").type), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())], ["prompt_id", "rep", "step"])

    return prompts.select("prompt_id", "idx", "num_steps").mapInArrow(rows, f"prompt_id {kind}, rep int, step int")


def trajectory_features(steps: DataFrame, prefix: str, scorer: EntailmentScorer | None = None, most: int = MAX_ITEMS, key: str = "prompt_id") -> DataFrame:
    """The six graph features over the texts of a prompt's steps, named prefix-feature."""
    found = sampling_features(steps.where(is_valid_text(F.col("text"))), scorer, most, key, "step")
    return found.select(key, *[F.col(c).alias(f"{prefix}-{c.replace('_', '-')}") for c in ("se_marginal", "se_conditional", "ecc", "eigval", "kle_heat", "kle_matern")])


# --- kernel discrepancies --------------------------------------------------------------------------------------------


def mmd2(points: DataFrame, unbiased: bool = False, gamma: float | None = None, vector: str = "embedding", group: str = "side", owner: str = "owner") -> DataFrame:
    """mmd2 between the points of side x and side y: mean k(x, x) + mean k(y, y) - 2 mean k(x, y); NaN without pairs.

    unbiased leaves out pairs of one trajectory (owner) within a side. The linear kernel (gamma None) needs no pairs:
    its means follow from vector sums by owner, so the work is linear in the points. With gamma, k = exp(-gamma d^2),
    which is defined over all pairs: they are summed up block against block, a task holding two blocks of points.
    """
    return _linear_mmd2(points, unbiased, vector, group, owner) if gamma is None else _blocked_mmd2(points, unbiased, gamma, vector, group, owner)


#: Points of a block, of which a task holds two, and rows of a strip: a task holds kernel values of a strip against a block at a time.
BLOCK_POINTS, STRIP = 8_000, 256


def _as_vectors(points: DataFrame, vector: str) -> Column:
    """The vectors as they are if their numbers are floats or doubles, else as doubles; kernels are doubles in any case."""
    of = points.schema[vector].dataType.elementType
    return F.col(vector) if isinstance(of, (T.FloatType, T.DoubleType)) else F.transform(vector, lambda v: v.cast("double"))


def _met(packed: DataFrame, key: str) -> DataFrame:
    """(key, block, b2, points, points2) for each two blocks of a key, block <= b2, from (key, block, blocks, points).

    Both ends are dealt by the pair, so that a block's meetings spread over all tasks.
    """
    first = packed.select(key, "block", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("b2"), "points")
    second = packed.select(F.col(key).alias("__key"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("__block"), F.col("block").alias("__b2"), F.col("points").alias("points2"))
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("block") == F.col("__block")) & (F.col("b2") == F.col("__b2"))
    return first.join(second.hint("merge"), same).select(key, "block", "b2", "points", "points2")


def _matrix_of(points: pa.StructArray) -> np.ndarray:
    """The vectors of a block; an error where they differ in length."""
    vectors = points.field("v")
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and not (lengths == lengths[0]).all():
        raise ValueError("vectors of different lengths")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(points), -1)


def _strips(va: np.ndarray, vb: np.ndarray, gamma: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, exp(-gamma d^2) of STRIP rows of va against all of vb); the values may be written over."""
    left = np.column_stack([2 * gamma * va, -gamma * (va**2).sum(1), np.ones(len(va))])
    right = np.ascontiguousarray(np.column_stack([vb, np.ones(len(vb)), -gamma * (vb**2).sum(1)]).T)
    for at in range(0, len(va), STRIP):
        kernel = left[at : at + STRIP] @ right
        np.minimum(kernel, 0, out=kernel)
        yield at, np.exp(kernel, out=kernel)


def _blocked_mmd2(points: DataFrame, unbiased: bool, gamma: float, vector: str, group: str, owner: str) -> DataFrame:
    """Points are packed to a row for each block of a side, blocks meet two at a time, and tasks give partial sums.

    Blocks of both sides are numbered through, x first.
    """
    known = points.where(F.col(group).isin("x", "y")).select(F.col(group).alias("g"), F.xxhash64(owner).alias("o"), _as_vectors(points, vector).alias("v"))
    known = staged(known, "mmd-points")
    sizes = known.groupBy("g").agg(F.ceil(F.count("*") / BLOCK_POINTS).cast("int").alias("n"))  # two rows at most
    every = sizes.agg(F.sum("n").cast("int").alias("blocks"), F.coalesce(F.sum(F.when(F.col("g") == "x", F.col("n"))), F.lit(0)).cast("int").alias("nx"))
    # dealt by a hash that tells repeats of a point apart, so that a block is bounded but for chance
    dealt = known.withColumn("h", F.xxhash64("o", "v", F.monotonically_increasing_id())).join(F.broadcast(sizes), "g").join(F.broadcast(every))
    block = F.pmod("h", "n").cast("int") + F.when(F.col("g") == "y", F.col("nx")).otherwise(0)
    packed = dealt.groupBy(F.lit(0).alias("all"), "g", block.alias("block"), "blocks", "nx").agg(F.collect_list(F.struct("o", "v")).alias("points"))
    packed = staged(packed, "mmd-blocks")
    met = _met(packed.select("all", "block", "blocks", F.struct("g", "points").alias("points")), "all")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                ends = [one.column(c) for c in ("points", "points2")]
                (g, g2), (a, b) = [e.field("g")[0].as_py() for e in ends], [e.field("points").flatten() for e in ends]
                oa, ob = a.field("o").to_numpy(), b.field("o").to_numpy()
                total, n = 0.0, len(a) * len(b)
                for at, kernel in _strips(_matrix_of(a), _matrix_of(b), gamma):
                    if unbiased and g == g2:
                        own = oa[at : at + STRIP, None] == ob[None]
                        kernel[own] = 0
                        n -= int(np.count_nonzero(own))
                    total += float(kernel.sum())
                twice = 2 if g == g2 and one.column("block")[0].as_py() != one.column("b2")[0].as_py() else 1
                yield pa.RecordBatch.from_arrays([pa.array([g + g2]), pa.array([twice * total]), pa.array([twice * n], pa.int64())], ["sides", "k", "n"])

    partial = met.mapInArrow(sums, "sides string, k double, n bigint")
    mean = lambda sides: F.try_divide(F.sum(F.when(F.col("sides") == sides, F.col("k"))), F.sum(F.when(F.col("sides") == sides, F.col("n"))))
    return partial.agg(F.coalesce(mean("xx") + mean("yy") - 2 * mean("xy"), F.lit(float("nan"))).alias("mmd2"))


def fourier_features(points: DataFrame, gamma: float, size: int = 256, seed: int = 0, vector: str = "embedding") -> DataFrame:
    """points with vector replaced by size cosines whose products are, on average, exp(-gamma d^2).

    The frequencies are drawn by numpy's generator from the seed and the vectors' length, so every task has the same.
    Vectors that are null stay null.
    """
    kind = points.schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.schema.get_field_index(vector)
            column = batch.column(at)
            lengths = [len(v) if v is not None else -1 for v in column.to_pylist()]
            out: list = [None] * len(lengths)
            for d in set(lengths) - {-1}:
                if d not in drawn:
                    drawn[d] = np.random.default_rng([seed, d]).normal(0, np.sqrt(2 * gamma), (d, size // 2))
                rows_d = [i for i, n in enumerate(lengths) if n == d]
                angle = np.array(column.take(pa.array(rows_d)).to_pylist(), float).reshape(len(rows_d), d) @ drawn[d]
                found = np.concatenate([np.cos(angle), np.sin(angle)], axis=1) / np.sqrt(size // 2)
                for i, f in zip(rows_d, found.tolist(), strict=True):
                    out[i] = f
            columns = [c if i != at else pa.array(out, pa.list_(pa.float64())) for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    fields = [T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == vector else f.dataType) for f in kind.fields]
    return points.mapInArrow(rows, T.StructType(fields))


def mmd2_fourier(points: DataFrame, gamma: float, unbiased: bool = False, size: int = 256, repeats: int = 8, chance: float = 0.01, seed: int = 0, vector: str = "embedding", group: str = "side", owner: str = "owner") -> DataFrame:
    """(mmd2, bound): the Gaussian discrepancy from repeats independent draws of random Fourier features, linear in the points.

    Each draw's discrepancy is a linear one, so it comes from vector sums; mmd2 is the mean of the draws. The exact value
    lies within bound of it but for chance: a draw is the mean over its size / 2 frequencies of the squared difference of
    two mean waves, between 0 and 4, so Hoeffding's inequality holds for all size / 2 * repeats frequencies together. The
    bound is for the biased discrepancy; leaving out an owner's own pairs keeps each frequency's value within a span of
    8, for which it is doubled. NaN without pairs. The exact way, block by block, is mmd2.
    """
    draws = None
    for r in range(repeats):
        one = _linear_mmd2(fourier_features(points.select(vector, group, owner), gamma, size, seed + r, vector), unbiased, vector, group, owner)
        draws = one if draws is None else draws.unionByName(one)
    span = 8.0 if unbiased else 4.0
    bound = span * float(np.sqrt(np.log(2 / chance) / (2 * (size // 2) * repeats)))
    return draws.agg(F.avg("mmd2").alias("mmd2"), F.lit(bound).alias("bound"))


def _linear_mmd2(points: DataFrame, unbiased: bool, vector: str, group: str, owner: str) -> DataFrame:
    size = F.size(vector)
    long = points.select(F.col(group).alias("g"), F.col(owner).alias("o"), size.alias("d"), F.posexplode(vector).alias("k", "v"))
    own = long.groupBy("g", "o", "k").agg(F.sum(F.col("v").cast("double")).alias("v"), F.count("*").alias("c"))
    sums = own.groupBy("g", "k").agg(F.sum("v").alias("v"), F.sum("c").alias("c"), F.sum(F.col("v") * F.col("v")).alias("own"), F.sum(F.col("c") * F.col("c")).alias("own_c"))
    side = lambda name, g: F.sum(F.when(F.col("g") == g, F.col(name)))
    dims = sums.groupBy("k").agg(*[side(n, g).alias(f"{n}_{g}") for n in ("v", "c", "own", "own_c") for g in ("x", "y")])

    def within(g: str) -> Column:
        left, left_c = (F.col(f"own_{g}"), F.max(f"own_c_{g}")) if unbiased else (F.lit(0.0), F.lit(0))
        return F.try_divide(F.sum(F.col(f"v_{g}") * F.col(f"v_{g}") - left), F.max(F.col(f"c_{g}") * F.col(f"c_{g}")) - left_c)

    xy = F.try_divide(F.sum(F.col("v_x") * F.col("v_y")), F.max(F.col("c_x") * F.col("c_y")))
    return dims.agg(F.coalesce(within("x") + within("y") - 2 * xy, F.lit(float("nan"))).alias("mmd2"))


def finite_mean_std(values: Sequence[float]) -> tuple[float, float, int]:
    """Mean, population deviation and count of the finite values; NaN, NaN, 0 without any."""
    clean = np.asarray([v for v in values if np.isfinite(v)], float)
    return (float(clean.mean()), float(clean.std()), len(clean)) if len(clean) else (float("nan"), float("nan"), 0)


def finite_summary(value: Column) -> list[Column]:
    """finite_mean_std as aggregates mean, std, count."""
    v = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    return [F.coalesce(F.avg(v), F.lit(float("nan"))).alias("mean"), F.coalesce(F.stddev_pop(v), F.lit(float("nan"))).alias("std"), F.count(v).alias("count")]


def kernel_matrices(embeddings: np.ndarray, kernel: str = "linear", gamma: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A_V, A_U, C) over steps from an array trajectory x step x dimension.

    Own definitions: C averages the kernel of steps t, t' within a trajectory, A_U between different ones, and
    A_V = C - A_U, which is 0 for one trajectory. All are symmetric.
    """
    n, t, _ = embeddings.shape
    if kernel not in ("linear", "rbf"):
        raise ValueError(f"unknown kernel {kernel}")
    flat = embeddings.reshape(n * t, -1).astype(float)
    sq = (flat**2).sum(1)
    own, other = np.zeros((t, t)), np.zeros((t, t))
    for i in range(n):  # a trajectory against all: t x (n t) values at a time
        k = flat[i * t : (i + 1) * t] @ flat.T
        if kernel == "rbf":
            k = np.exp(-gamma * np.maximum(sq[i * t : (i + 1) * t, None] + sq[None] - 2 * k, 0))
        k = k.reshape(t, n, t)
        own += k[:, i]
        other += k.sum(1) - k[:, i]
    own /= n
    other = other / (n * (n - 1)) if n > 1 else own
    sym = lambda m: (m + m.T) / 2
    return sym(own - other), sym(other), sym(own)


def delta_u(c: np.ndarray, a_u: np.ndarray) -> np.ndarray:
    return c - a_u


def verify_psd(m: np.ndarray, tolerance: float = 1e-8) -> dict:
    low = float(np.linalg.eigvalsh((m + m.T) / 2).min())
    return {"is_psd": bool(low >= -tolerance), "min_eigenvalue": low}


def quadratic_weights(a: np.ndarray, gain: np.ndarray, ridge: float, steps: int = 2000) -> np.ndarray:
    """Weights on the simplex that minimise w'Aw - gain'w + ridge |w|^2, by projected gradient. Own objective.

    An active-set step then makes them exact: the weights of the steps in use solve their linear equations, as long as
    none is negative and no other step would gain.
    """
    t = len(gain)
    m = (a + a.T) / 2 + ridge * np.eye(t)
    rate = 1 / (2 * max(1e-9, np.abs(np.linalg.eigvalsh(m)).max()))
    w = np.full(t, 1.0 / t)
    for _ in range(steps):
        v = w - rate * (2 * m @ w - gain)
        u = np.sort(v)[::-1]
        cut = (np.cumsum(u) - 1) / np.arange(1, t + 1)
        w = np.maximum(0, v - cut[np.flatnonzero(u > cut)[-1]])
    used = w > 1e-9
    for _ in range(4 * t):
        at = np.flatnonzero(used)
        whole = np.block([[2 * m[np.ix_(at, at)], -np.ones((len(at), 1))], [np.ones((1, len(at))), np.zeros((1, 1))]])
        found = np.linalg.lstsq(whole, np.append(gain[at], 1.0), rcond=None)[0]
        if found[:-1].min() < -1e-12:
            used[at[found[:-1].argmin()]] = False
            continue
        exact = np.zeros(t)
        exact[at] = np.maximum(found[:-1], 0)
        slack = 2 * m @ exact - gain - found[-1]
        if slack.min() >= -1e-12 * max(1, np.abs(m).max()):
            return exact / exact.sum() if exact @ m @ exact - gain @ exact <= w @ m @ w - gain @ w + 1e-12 else w
        used[slack.argmin()] = True
    return w


def certificate(a: np.ndarray, gain: np.ndarray, ridge: float, w: np.ndarray) -> tuple[float, float, float]:
    """(objective, gap, residual) of weights w: how far they can be from the best.

    gap is w'g - min g for the gradient g: for a convex objective no weights on the simplex are better by more. residual
    is the largest difference, among steps with a weight, of their gradient from the least one.
    """
    m = (a + a.T) / 2 + ridge * np.eye(len(gain))
    g = 2 * m @ w - gain
    return float(w @ m @ w - gain @ w), float(g @ w - g.min()), float(np.max(np.where(w > 1e-9, g - g.min(), 0)))


#: The ridges that a search tries.
RIDGES = (0, 0.01, 0.1, 0.2, 0.5, 1, 5, 10)


def search_weights(a: np.ndarray, gain: np.ndarray, score, ridges: Sequence[float] = RIDGES) -> tuple[float, np.ndarray]:
    """The ridge whose weights score best, the first of equals, with the weights."""
    tried = [(r, quadratic_weights(a, gain, r)) for r in ridges]
    return max(tried, key=lambda x: score(x[1]))


def _linear_sums(points: DataFrame, key: str) -> DataFrame:
    """kernel_sums of the linear kernel: no pairs of vectors but within a trajectory."""
    kind = points.schema[key].dataType.simpleString()

    def from_sums(pdf: pd.DataFrame) -> pd.DataFrame:
        own, sums = pdf[pdf["other"].notna()], pdf[pdf["other"].isna()]
        steps = sorted(sums["step"])
        at = {s: i for i, s in enumerate(steps)}
        within, both, counts = np.zeros((len(at), len(at))), np.zeros((len(at), len(at))), np.zeros(len(at))
        for a, b, dot, n in zip(own["step"], own["other"], own["dot"], own["n"], strict=True):
            within[at[a], at[b]], both[at[a], at[b]] = dot, n
        total = np.stack([v for _, v in sorted(zip(sums["step"], sums["total"], strict=True), key=lambda x: x[0])])
        for s, n in zip(sums["step"], sums["n"], strict=True):
            counts[at[s]] = n
        rows = itertools.product(range(len(at)), repeat=2)
        others, crossed = np.outer(counts, counts) - both, total @ total.T - within
        return pd.DataFrame([(pdf[key].iloc[0], steps[i], steps[j], within[i, j], int(both[i, j]), crossed[i, j], int(others[i, j])) for i, j in rows], columns=[key, "step", "other", "own", "n_own", "crossed", "n_crossed"])

    doubles = F.transform("embedding", lambda v: v.cast("double"))
    placed = points.select(key, "trajectory", F.struct("step", doubles.alias("v")).alias("p"))
    whole = placed.groupBy(key, "trajectory").agg(F.collect_list("p").alias("ps"))
    pairs = whole.select(key, "ps", F.explode("ps").alias("p")).select(key, "p", F.explode("ps").alias("q"))
    dot = F.aggregate(F.zip_with("p.v", "q.v", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    own = pairs.select(key, F.col("p.step").alias("step"), F.col("q.step").alias("other"), dot.alias("dot"))
    own = own.groupBy(key, "step", "other").agg(F.sum("dot").alias("dot"), F.count("*").alias("n"))
    long = placed.select(key, F.col("p.step").alias("step"), F.posexplode("p.v").alias("__k", "__v"))
    sums = long.groupBy(key, "step", "__k").agg(F.sum("__v").alias("__v"), F.count("*").alias("n")).groupBy(key, "step")
    sums = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__v"))), lambda x: x["__v"]).alias("total"), F.max("n").alias("n"))
    made = own.unionByName(sums, allowMissingColumns=True).groupBy(key).applyInPandas(from_sums, f"{key} {kind}, step bigint, other bigint, own double, n_own bigint, crossed double, n_crossed bigint")
    return made


def _tiled_sums(points: DataFrame, key: str, gamma: float) -> DataFrame:
    """kernel_sums of the Gaussian kernel, over all pairs: blocks of a group's points meet two at a time.

    A group of any size is cut to blocks of about BLOCK_POINTS; a task holds two of them, and kernel values of a strip of
    one against the other, which give a row for each two steps. Sums of all tiles meet by key, so no group comes to one task.
    """
    kind = points.schema[key].dataType.simpleString()
    known = staged(points.select(F.col(key).alias("g"), F.xxhash64("trajectory").alias("o"), F.col("step").cast("bigint").alias("s"), _as_vectors(points, "embedding").alias("v")), "kernel-points")
    sizes = staged(known.groupBy("g").agg(F.ceil(F.count("*") / BLOCK_POINTS).cast("int").alias("blocks")), "kernel-sizes")
    dealt = known.withColumn("h", F.xxhash64("o", "s", "v", F.monotonically_increasing_id())).join(sizes.select(F.col("g").alias("g1"), "blocks"), F.col("g").eqNullSafe(F.col("g1"))).drop("g1")
    packed = staged(dealt.groupBy("g", F.pmod("h", "blocks").cast("int").alias("block"), "blocks").agg(F.collect_list(F.struct("o", "s", "v")).alias("points")), "kernel-blocks")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                # in the order of steps, so that a step is a run of rows and of columns
                (va, oa, ta), (vb, ob, tb) = (_by_step(one.column(c).flatten()) for c in ("points", "points2"))
                sb, first_b, ib, count_b = np.unique(tb, return_index=True, return_inverse=True, return_counts=True)
                mirrored = one.column("block")[0].as_py() != one.column("b2")[0].as_py()
                for at, kernel in _strips(va, vb, gamma):
                    sa, first_a, ia, count_a = np.unique(ta[at : at + STRIP], return_index=True, return_inverse=True, return_counts=True)
                    rows, columns = np.nonzero(oa[at : at + STRIP, None] == ob[None])
                    tile = ia[rows] * len(sb) + ib[columns]
                    own, n_own = (np.bincount(tile, w, len(sa) * len(sb)) for w in (kernel[rows, columns], None))
                    kernel[rows, columns] = 0
                    crossed = np.add.reduceat(np.add.reduceat(kernel, first_b, axis=1), first_a, axis=0).ravel()
                    n_crossed = np.outer(count_a, count_b).ravel() - n_own
                    step, other = np.repeat(sa, len(sb)), np.tile(sb, len(sa))
                    out = [step, other, own.astype(float), n_own.astype(np.int64), crossed, n_crossed.astype(np.int64)]
                    if mirrored:
                        out = [np.concatenate([x, y]) for x, y in zip(out, [other, step, *out[2:]], strict=True)]
                    groups = pa.array([one.column("g")[0].as_py()] * len(out[0]), one.column("g").type)
                    yield pa.RecordBatch.from_arrays([groups, *map(pa.array, out)], [key, "step", "other", "own", "n_own", "crossed", "n_crossed"])

    tiles = _met(packed, "g").mapInArrow(sums, f"{key} {kind}, step bigint, other bigint, own double, n_own bigint, crossed double, n_crossed bigint")
    return tiles.groupBy(key, "step", "other").agg(*[F.sum(c).alias(c) for c in ("own", "n_own", "crossed", "n_crossed")])


def _by_step(points: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, owners, steps) of a block in the order of steps."""
    steps = points.field("s").to_numpy()
    order = np.argsort(steps, kind="stable")
    return _matrix_of(points)[order], points.field("o").to_numpy()[order], steps[order]


def kernel_sums(points: DataFrame, key: str, kernel: str = "linear", gamma: float = 1.0) -> DataFrame:
    """(key, step, other, c, a_u): the matrices C and A_U of each group of (key, trajectory, step, embedding), a row for each two steps.

    C averages the kernel within trajectories, over those that have both steps, 0 without any; A_U between different
    ones, and is C without any. The linear kernel needs no pairs of vectors; the Gaussian one sums all of them by tiles.
    """
    if kernel not in ("linear", "rbf"):
        raise ValueError(f"unknown kernel {kernel}")
    sums = _linear_sums(points, key) if kernel == "linear" else _tiled_sums(points, key, gamma)
    c = F.coalesce(F.try_divide("own", "n_own"), F.lit(0.0))
    return sums.select(key, F.col("step").cast("int").alias("step"), F.col("other").cast("int").alias("other"), c.alias("c"), F.coalesce(F.try_divide("crossed", "n_crossed"), c).alias("a_u"))


def _matrix(pdf: pd.DataFrame) -> tuple[list[int], np.ndarray]:
    """(steps, C - A_U made symmetric) of one group of kernel_sums."""
    steps = sorted(set(pdf["step"]))
    at = {s: i for i, s in enumerate(steps)}
    m = np.zeros((len(steps), len(steps)))
    for i, j, c, u in zip(pdf["step"], pdf["other"], pdf["c"], pdf["a_u"], strict=True):
        m[at[i], at[j]] = c - u
    return steps, (m + m.T) / 2


def kernel_matrices_by_group(points: DataFrame, key: str, kernel: str = "linear", gamma: float = 1.0) -> DataFrame:
    """(key, is_psd, min_eigenvalue, trace) of C - A_U for each group of (key, trajectory, step, embedding); see kernel_sums."""
    kind = points.schema[key].dataType.simpleString()

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(pdf)[1]
        return pd.DataFrame({key: [pdf[key].iloc[0]], **{k: [v] for k, v in verify_psd(m).items()}, "trace": [float(np.trace(m))]})

    # a group is a row for each two steps, however many vectors it has
    return kernel_sums(points, key, kernel, gamma).groupBy(key).applyInPandas(rows, f"{key} {kind}, is_psd boolean, min_eigenvalue double, trace double")


def step_weights(points: DataFrame, key: str, kernel: str = "linear", gamma: float = 1.0, ridge: float = 0.1, gain: Sequence[float] | None = None) -> DataFrame:
    """(key, step, weight, objective, gap, residual, shift) of each group: the steps' weights with their certificate.

    Weights on the simplex that minimise w'(C - A_U)w + ridge |w|^2 - gain'w: steps in which trajectories differ least
    weigh most. Spark makes the sums; a task solves one group's small programme. shift is what was added to the diagonal
    where C - A_U with the ridge has a negative eigenvalue, so that gap bounds how far the objective is from the best.
    """
    kind = points.schema[key].dataType.simpleString()

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        steps, m = _matrix(pdf)
        own = np.zeros(len(steps)) if gain is None else np.asarray(gain, float)
        shift = max(0.0, -float(np.linalg.eigvalsh(m).min()) - ridge)
        w = quadratic_weights(m, own, ridge + shift)
        objective, gap, residual = certificate(m, own, ridge + shift, w)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(steps), "step": steps, "weight": w, "objective": objective, "gap": gap, "residual": residual, "shift": shift})

    return kernel_sums(points, key, kernel, gamma).groupBy(key).applyInPandas(rows, f"{key} {kind}, step int, weight double, objective double, gap double, residual double, shift double")


#: Numbers of a hashed vector of a text.
HASHED_SIZE = 64


def hashed_vectors(texts: DataFrame, keys: Sequence[str], text: str = "text", size: int = HASHED_SIZE) -> DataFrame:
    """(keys, embedding): words of each text counted by hash, at length 1; texts without words give zeros."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter("__at", lambda p: p == k)).cast("double"))
    norm = F.sqrt(F.aggregate("__n", F.lit(0.0), lambda s, v: s + v * v))
    made = texts.select(*keys, places.alias("__at")).select(*keys, counts.alias("__n")).select(*keys, "__n", norm.alias("__norm"))
    return made.select(*keys, F.transform("__n", lambda v: v / F.greatest("__norm", F.lit(1e-12))).alias("embedding"))


def pair_means(vectors: DataFrame, group: str = "label", vector: str = "embedding") -> DataFrame:
    """(group, mean_dot): mean dot product over all ordered pairs of a group, from its vector sum: no pairs are formed."""
    long = vectors.select(group, F.posexplode(vector).alias("k", "v"))
    sums = long.groupBy(group, "k").agg(F.sum(F.col("v").cast("double")).alias("v"), F.count("*").alias("c"))
    return sums.groupBy(group).agg((F.sum(F.col("v") * F.col("v")) / F.max(F.col("c") * F.col("c"))).alias("mean_dot"))
