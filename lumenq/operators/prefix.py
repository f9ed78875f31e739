"""Prefix sums and running maxima over a total order without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks that a group's order is cut into at most, and rows of the group for each block below that.
MOST_BLOCKS, ROWS_A_BLOCK = 1024, 50_000


def _largest(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group, one number for the driver."""
    return (df.groupBy(*keys).count() if keys else df.agg(F.count("*").alias("count"))).agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def _cut(df: DataFrame, keys: Sequence[str], order: str, blocks: int | None) -> DataFrame:
    """df with __block: cut at approximate percentiles of order, so that a row's block follows from its value alone.

    Without a number of blocks, a group gets as many as its rows need: evenly spaced ones of the finest percentiles, of
    which there are as many as the largest group needs. Where no group needs two, nothing is cut.
    """
    finest = blocks or min(MOST_BLOCKS, -(-_largest(df, keys) // ROWS_A_BLOCK))
    if finest <= 1:
        return df.withColumn("__block", F.lit(0))
    cuts = df.groupBy(*keys).agg(F.percentile_approx(order, [i / finest for i in range(1, finest)], max(1000, 4 * finest)).alias("__cuts"), F.count("*").alias("__n"))
    if not blocks:
        own = F.least(F.lit(finest), F.ceil(F.col("__n") / ROWS_A_BLOCK)).cast("int")
        chosen = F.transform(F.sequence(F.lit(1), own - 1), lambda i: F.element_at("__cuts", F.floor(i * finest / own).cast("int")))
        cuts = cuts.withColumn("__cuts", F.when((own > 1) & F.col("__cuts").isNotNull(), chosen).otherwise(F.slice("__cuts", 1, 0)))
    # null keys meet null keys, so the join is null-safe
    renamed = cuts.select(*[F.col(k).alias(f"__{k}") for k in keys], "__cuts")
    same = [df[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    joined = df.join(renamed, same, "left") if keys else df.join(F.broadcast(renamed))  # without keys: one row
    return joined.withColumn("__block", F.size(F.filter("__cuts", lambda c: c < F.col(order)))).drop("__cuts", *[f"__{k}" for k in keys])


def _with_offsets(cut: DataFrame, keys: Sequence[str], totals: DataFrame, offsets: Sequence[Column], names: Sequence[str]) -> tuple[DataFrame, Window]:
    """cut joined with what the blocks before give, of which a group has at most blocks; and the window within a block."""
    earlier = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__block").alias("__b"), *[o.alias(n) for o, n in zip(offsets, names, strict=True)])
    out = cut.join(earlier, [*[cut[k].eqNullSafe(earlier[f"__{k}"]) for k in keys], cut["__block"] == earlier["__b"]])
    return out, Window.partitionBy(*keys, "__block")


def _earlier_blocks(keys: Sequence[str]):
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)


def prefix_sums(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], blocks: int | None = None) -> DataFrame:
    """df with, for each of values, {value}_before: its sum over the rows of the same keys that come earlier by order.

    order is numeric and distinct within keys. Windows run within a block, and over block totals. blocks: by the
    group's rows if None; it decides only how the work is cut.
    """
    keys = list(keys)
    cut = _cut(df, keys, order, blocks)
    totals = cut.groupBy(*keys, "__block").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    before = [F.coalesce(F.sum(f"__{v}").over(_earlier_blocks(keys)), F.lit(0)) for v in values]
    out, inside = _with_offsets(cut, keys, totals, before, [f"__{v}_offset" for v in values])
    within = inside.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return out.select(*[cut[c] for c in df.columns], *[(F.coalesce(F.sum(v).over(within), F.lit(0)) + F.col(f"__{v}_offset")).alias(f"{v}_before") for v in values])


def prefix_max(df: DataFrame, keys: Sequence[str], order: str, value: str, blocks: int | None = None) -> DataFrame:
    """df with {value}_before: its greatest over the rows of the same keys that come earlier by order, null without any."""
    keys = list(keys)
    cut = _cut(df, keys, order, blocks)
    totals = cut.groupBy(*keys, "__block").agg(F.max(value).alias("__most"))
    out, inside = _with_offsets(cut, keys, totals, [F.max("__most").over(_earlier_blocks(keys))], ["__offset"])
    within = inside.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return out.select(*[cut[c] for c in df.columns], F.greatest(F.max(value).over(within), F.col("__offset")).alias(f"{value}_before"))
