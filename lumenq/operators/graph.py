"""Similarity graphs over the samples of a prompt, and the uncertainty read from them.

A prompt has at most max_items samples after even sub-sampling, so its pairs are bounded; they come from an equi-join on
the prompt, never from a cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenq.backends import EntailmentScorer, JaccardScorer
from lumenq.functions.arrays import evenly_spaced
from lumenq.staging import staged

#: Cluster threshold, diffusion time, and shift and power of the second kernel.
CLUSTER, HEAT, SHIFT, POWER = 0.5, 0.3, 2.0, -1
MAX_ITEMS = 20


def subsample(items: DataFrame, most: int = MAX_ITEMS, key: str = "prompt_id", order: str = "sample_id") -> DataFrame:
    """Items numbered i from 0 by order within key, at most most of them, evenly spaced; n is their number."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = items.withColumn("__at", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    chosen = evenly_spaced(F.col("__n").cast("int"), most)
    picked = numbered.withColumn("__chosen", chosen).where(F.array_contains("__chosen", F.col("__at")))
    return picked.withColumn("i", F.array_position("__chosen", F.col("__at")).cast("int") - 1).withColumn("n", F.size("__chosen")).drop("__at", "__n", "__chosen")


def pairs(items: DataFrame, text: str = "text", key: str = "prompt_id") -> DataFrame:
    """(key, n, i, j, premise, hypothesis): all ordered pairs of a prompt's items, the diagonal included."""
    left = items.select(key, "n", "i", F.col(text).alias("premise"))
    right = items.select(key, F.col("i").alias("j"), F.col(text).alias("hypothesis"))
    return left.join(right, key)


def scored_pairs(asked: DataFrame, scorer: EntailmentScorer | None = None, cache: DataFrame | None = None) -> DataFrame:
    """asked with p_contradiction, p_neutral, p_entailment, cls: each distinct (premise, hypothesis) is scored once.

    cache has pairs scored before; only others reach the scorer. Probabilities pass through single precision.
    """
    distinct = asked.select("premise", "hypothesis").distinct()
    scorer = scorer or JaccardScorer()
    if cache is not None:
        known = cache.select("premise", "hypothesis", "p_contradiction", "p_neutral", "p_entailment", "cls").dropDuplicates(["premise", "hypothesis"])
        fresh = scorer.score(distinct.join(known, ["premise", "hypothesis"], "left_anti"))
        table = fresh.unionByName(known)
    else:
        table = scorer.score(distinct)
    single = [F.col(c).cast("float").cast("double").alias(c) for c in ("p_contradiction", "p_neutral", "p_entailment")]
    return asked.join(table.select("premise", "hypothesis", *single, "cls"), ["premise", "hypothesis"])


def symmetric(edges: DataFrame, weight: str = "p_entailment", key: str = "prompt_id") -> DataFrame:
    """(key, n, i, j, w): both directions averaged, 1 on the diagonal. One aggregation, no second join."""
    low, high = F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")
    half = edges.groupBy(key, "n", low, high).agg(F.avg(weight).alias("w"))
    full = half.select(key, "n", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")))).otherwise(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j"))))).alias("e"), "w")
    return full.select(key, "n", "e.i", "e.j", F.when(F.col("e.i") == F.col("e.j"), 1.0).otherwise(F.col("w")).alias("w"))


def matrices(edges: DataFrame, key: str = "prompt_id") -> DataFrame:
    """(key, n, m): the rows of each matrix as an array of arrays."""
    rows = edges.groupBy(key, "n", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "w"))), lambda e: e["w"]).alias("row"))
    return rows.groupBy(key, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda r: r["row"]).alias("m"))


def leaders(m: Column, threshold: float = CLUSTER) -> Column:
    """Greedy clusters of a matrix: each item joins the first leader it is similar enough to, or leads itself."""
    n = F.size(m)
    start = F.array().cast("array<int>")

    def place(led: Column, j: Column) -> Column:
        earlier = F.filter(F.sequence(F.lit(0), j), lambda i: (i < j) & (F.get(led, i) == i) & (F.get(F.get(m, i), j) >= threshold))
        return F.concat(led, F.array(F.coalesce(F.get(earlier, F.lit(0)), j)))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), start, place)).otherwise(start)


def clusters(edges: DataFrame, threshold: float = CLUSTER, key: str = "prompt_id") -> DataFrame:
    """(key, n, i, cluster): clusters numbered from 0 by their leader."""
    led = matrices(edges, key).select(key, "n", leaders(F.col("m"), threshold).alias("led"))
    named = F.transform("led", lambda x: F.array_position(F.array_sort(F.array_distinct("led")), x).cast("int") - 1)
    return led.select(key, "n", F.posexplode(named).alias("i", "cluster"))


def cluster_entropy(labels: DataFrame, key: str = "prompt_id") -> DataFrame:
    """se_marginal, the entropy of the clusters' shares, and se_conditional, the share of entropy within clusters."""
    c, n = F.col("c"), F.col("n")
    sizes = labels.groupBy(key, "n", "cluster").agg(F.count("*").alias("c"))
    return sizes.groupBy(key, "n").agg(
        F.when(F.count("*") == 1, F.lit(0.0)).otherwise(-F.sum(c / n * F.ln(c / n))).alias("se_marginal"),
        F.try_divide(F.sum(F.when(c > 1, c / n * F.ln(c.cast("double"))).otherwise(0.0)), F.ln(n.cast("double"))).alias("se_conditional"),
    )


def degrees(edges: DataFrame, key: str = "prompt_id") -> DataFrame:
    """(key, n, i, degree): sums of non-negative weights off the diagonal, the diagonal of the Laplacian."""
    return edges.groupBy(key, "n", "i").agg(F.sum(F.when(F.col("i") != F.col("j"), F.greatest("w", F.lit(0.0))).otherwise(0.0)).alias("degree"))


def laplacian(edges: DataFrame, key: str = "prompt_id") -> DataFrame:
    """(key, n, i, j, value) of degree minus weight."""
    w = F.when(F.col("i") != F.col("j"), F.greatest("w", F.lit(0.0))).otherwise(0.0)
    return edges.join(degrees(edges, key), [key, "n", "i"]).select(key, "n", "i", "j", (F.when(F.col("i") == F.col("j"), F.col("degree")).otherwise(0.0) - w).alias("value"))


def eigval(edges: DataFrame, key: str = "prompt_id") -> DataFrame:
    """(n - sum of Laplacian eigenvalues) / n: by the trace, 1 - sum of weights / n, without an eigensolver."""
    return edges.groupBy(key, "n").agg((1 - F.sum(F.when(F.col("i") != F.col("j"), F.greatest("w", F.lit(0.0))).otherwise(0.0)) / F.col("n")).alias("eigval"))


def entropy_of(values: np.ndarray) -> float:
    """Entropy of eigenvalues as shares; those up to 1e-12 are left out."""
    values = values[values > 1e-12]
    if not len(values):
        return 0.0
    p = values / values.sum()
    return float(-(p * np.log(p)).sum())


def spectral(edges: DataFrame, key: str = "prompt_id") -> DataFrame:
    """ecc, the second smallest Laplacian eigenvalue, and the entropies kle_heat and kle_matern of two kernels.

    Spark has no eigensolver: the matrices of a batch of prompts are solved with numpy, each at most max_items wide.
    """

    def rows(batches):
        for batch in batches:
            out = []
            for m in batch["m"]:
                w = np.maximum(np.array([np.asarray(r, float) for r in m]), 0)
                np.fill_diagonal(w, 0)
                lap = np.diag(w.sum(1)) - w
                values = np.linalg.eigvalsh((lap + lap.T) / 2)
                out.append((max(0.0, values[1]) if len(values) > 1 else None, entropy_of(np.exp(-HEAT * values)), entropy_of(np.maximum(SHIFT + values, 1e-12) ** POWER)))
            yield pd.concat([batch[[key, "n"]].reset_index(drop=True), pd.DataFrame(out, columns=["ecc", "kle_heat", "kle_matern"], dtype=float)], axis=1)

    m = matrices(edges, key)
    kind = m.schema[key].dataType.simpleString()
    return m.mapInPandas(rows, f"{key} {kind}, n int, ecc double, kle_heat double, kle_matern double")


def spectral_moments(edges: DataFrame, powers: int = 6, key: str = "prompt_id") -> DataFrame:
    """power_1 .. power_<powers> and residual of each prompt: a certificate of the eigenvalues that spectral works with.

    power_k is the sum of the eigenvalues' k-th powers, which is the trace of the Laplacian's k-th power; residual is the
    largest |L v - value v| over all eigenvectors v. Traces follow from joins of laplacian with itself, so that a join
    confirms the eigenvalues without an eigensolver.
    """

    def rows(batches):
        for batch in batches:
            out = []
            for m in batch["m"]:
                w = np.maximum(np.array([np.asarray(r, float) for r in m]), 0)
                np.fill_diagonal(w, 0)
                lap = np.diag(w.sum(1)) - w
                values, vectors = np.linalg.eigh((lap + lap.T) / 2)
                out.append([float((values**k).sum()) for k in range(1, powers + 1)] + [float(np.abs((lap + lap.T) / 2 @ vectors - vectors * values).max())])
            yield pd.concat([batch[[key, "n"]].reset_index(drop=True), pd.DataFrame(out, columns=[*names, "residual"], dtype=float)], axis=1)

    names = [f"power_{k}" for k in range(1, powers + 1)]
    m = matrices(edges, key)
    kind = m.schema[key].dataType.simpleString()
    return m.mapInPandas(rows, f"{key} {kind}, n int, {', '.join(f'{n} double' for n in names)}, residual double")


def graph_features(edges: DataFrame, key: str = "prompt_id") -> DataFrame:
    """se_marginal, se_conditional, ecc, eigval, kle_heat, kle_matern of each prompt; all null for fewer than two items."""
    parts = [cluster_entropy(clusters(edges, key=key), key), spectral(edges, key), eigval(edges, key)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p.drop("n"), key)
    names = ("se_marginal", "se_conditional", "ecc", "eigval", "kle_heat", "kle_matern")
    return out.select(key, "n", *[F.when(F.col("n") >= 2, F.col(c)).alias(c) for c in names])


def sampling_features(samples: DataFrame, scorer: EntailmentScorer | None = None, most: int = MAX_ITEMS, key: str = "prompt_id", order: str = "sample_id", text: str = "text") -> DataFrame:
    """The six graph features of a table of sampled texts.

    Edges are written once, for three of the features start from them; so are the numbered items, as pairs meet their scores.
    """
    items = staged(subsample(samples, most, key, order).select(key, "n", "i", text), "items")
    edges = staged(symmetric(scored_pairs(pairs(items, text, key), scorer), key=key), "edges")
    return graph_features(edges, key)
