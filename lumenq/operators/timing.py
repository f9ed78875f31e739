"""Timers, timed calls and batch-size search for external scorers."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lumenq.operators import graph, tokens
from lumenq.operators.features import family
from lumenq.staging import discard, staged


class Timer:
    """elapsed seconds of a with block, set also when it raises."""

    elapsed: float | None = None

    def __enter__(self) -> Timer:
        self._began = time.perf_counter()
        return self

    def __exit__(self, *_) -> None:
        self.elapsed = time.perf_counter() - self._began


def timed(operator: Callable[..., DataFrame], *args, **kwargs) -> tuple[float, int]:
    """(seconds, rows) of an operator's result, computed whole where it lies: rows are counted, none comes to the driver."""
    with Timer() as t:
        out = operator(*args, **kwargs)
        seen = Observation()
        out.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return t.elapsed, seen.get["n"]


#: Each timed feature's operator: from edges (prompt_id, n, i, j, w) or from visible tokens (sample_id, pos, lp, top_lp),
#: mcnse's with prompt_id, to the feature's values.
KERNELS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "se-marginal": lambda edges: graph.cluster_entropy(graph.clusters(edges)).select("prompt_id", F.col("se_marginal").alias("value")),
    "se-conditional": lambda edges: graph.cluster_entropy(graph.clusters(edges)).select("prompt_id", F.col("se_conditional").alias("value")),
    "ecc": lambda edges: graph.spectral(edges).select("prompt_id", F.col("ecc").alias("value")),
    "eigval": lambda edges: graph.eigval(edges).select("prompt_id", F.col("eigval").alias("value")),
    "kle-heat": lambda edges: graph.spectral(edges).select("prompt_id", F.col("kle_heat").alias("value")),
    "kle-matern": lambda edges: graph.spectral(edges).select("prompt_id", F.col("kle_matern").alias("value")),
    "msp": lambda seen: tokens.msp(seen).select("sample_id", F.col("msp").alias("value")),
    "perplexity": lambda seen: tokens.perplexity(seen).select("sample_id", F.col("perplexity").alias("value")),
    "mte": lambda seen: tokens.mean_token_entropy(seen).select("sample_id", F.col("mte").alias("value")),
    "mcnse": lambda seen: tokens.negative_log_likelihood(seen).select("prompt_id", F.col("mcnse").alias("value")),
}


def timed_feature(feature: str, table: DataFrame) -> tuple[float, DataFrame]:
    """(seconds, values) of one feature's operator over a table that is written already; the values are written in that time."""
    if feature not in KERNELS:
        raise ValueError(f"no timed feature {feature}")
    with Timer() as t:
        values = staged(KERNELS[feature](table), "timed-values")
    return t.elapsed, values


def latency_profile(tables: dict[str, DataFrame], repeats: int = 3, generation: float = 0.0) -> DataFrame:
    """Mean and deviation of the seconds of each feature over its table, in the columns of a latency profile.

    Every table is written first, so that a feature's time is its own. A first run of each is left out, as it also
    starts workers and compiles. generation: mean seconds of the base generation, which counts as no overhead.
    """
    inputs = {id(t): t for t in tables.values()}
    written = {k: staged(t, "timed-input") for k, t in inputs.items()}
    rows = []
    for feature, table in tables.items():
        seconds = []
        for _ in range(repeats + 1):
            took, values = timed_feature(feature, written[id(table)])
            discard(values)
            seconds.append(took)
        rows += [(feature, s, generation) for s in seconds[1:]]
    spark = next(iter(tables.values())).sparkSession
    each = spark.createDataFrame(rows, "feature string, seconds double, generation double")
    found = each.groupBy("feature").agg(
        F.max("generation").alias("time_gen_mean"), F.avg("seconds").alias("time_math_mean"), F.stddev_pop("seconds").alias("time_math_std"), (F.max("generation") + F.avg("seconds")).alias("time_total_mean"), F.stddev_pop("seconds").alias("time_total_std")
    )
    return with_overhead(found)


def largest_working(candidates: Sequence[int], run: Callable[[int], object]) -> int:
    """The largest candidate before the first that fails; an error if none works."""
    best = None
    for size in sorted(candidates):
        try:
            run(size)
        except (RuntimeError, MemoryError):
            break
        best = size
    if best is None:
        raise RuntimeError("no batch size works")
    return best


def with_overhead(profile: DataFrame) -> DataFrame:
    """A timing profile with family, where absent, and overhead: total time beyond the base generation."""
    base = F.coalesce(F.col("time_gen_mean"), F.lit(0.0))
    out = profile if "family" in profile.columns else profile.withColumn("family", family(F.col("feature")))
    return out.withColumns({"overhead_mean": F.greatest(F.col("time_total_mean") - base, F.lit(0.0)), "overhead_std": F.col("time_total_std")})


def decode_steps(decode: Callable[[Sequence[int]], str], ids, sample: int) -> list[str]:
    """Texts of a sample's steps from ids of sample x step x position; a wrong shape or index gives an empty list."""
    shape = getattr(ids, "shape", ())
    if len(shape) != 3 or not 0 <= sample < shape[0]:
        return []
    return [decode(step.tolist()).strip() for step in ids[sample]]
