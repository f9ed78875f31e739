"""Roll-ups over runs, cost and quality, fronts and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenq.config import DATASETS, MODEL_IDS, STRATEGIES
from lumenq.operators.metrics import METRICS
from lumenq.operators.prefix import prefix_max
from lumenq.staging import staged

C = F.col
# Titles that differ from the dataset's name.
TITLES = {"triviaqa": "TriviaQA", "gsm8k": "GSM8K", "wmt14_fr_en": "WMT14 Fr-En", "xsum": "XSum", "samsum": "SamSum", "hotpotqa": "HotpotQA", "musique": "MuSiQue"}
COMPETITOR = ("model_id", "max_gen_length", "steps", "remasking", "label_method")


def numeric(x: Column) -> Column:
    """A finite number, else null."""
    value = x.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean by positive weights; without any, the plain mean. Values that are not finite are left out."""
    v = numeric(value)
    w = F.when(v.isNotNull() & (weight > 0), weight.cast("double"))
    return F.coalesce(F.try_divide(F.sum(v * w), F.sum(w)), F.avg(v))


def first_numeric(*candidates: Column) -> Column:
    """The first candidate that is a finite number."""
    return F.coalesce(*[numeric(c) for c in candidates])


def competitor_rollup(runs: DataFrame, values: Sequence[str], keys: Sequence[str] = ("dataset", *COMPETITOR)) -> DataFrame:
    """run_count, weighted accuracy and tokens, and the mean of each of values, by dataset and competitor."""
    return runs.groupBy(*keys).agg(
        F.count("*").alias("run_count"), weighted_mean(C("qa_accuracy"), C("weight")).alias("qa_accuracy"), weighted_mean(C("mean_tokens"), C("weight")).alias("mean_tokens"), *[F.avg(numeric(C(v))).alias(v) for v in values]
    )


def feature_rollup(values: DataFrame, keys: Sequence[str] = ("dataset", *COMPETITOR)) -> DataFrame:
    """mean of finite values, mean of finite deviations and count by keys, feature and metric, from long rows."""
    return values.groupBy(*keys, "feature", "metric").agg(F.avg(numeric(C("value"))).alias("mean"), F.avg(numeric(C("std"))).alias("std"), F.count(numeric(C("value"))).alias("n"))


def model_name(model_id: Column) -> Column:
    """The short name of a model id: by exact id, else by a name within it or the end of its id, else itself."""
    out = model_id
    for name, full in reversed(MODEL_IDS.items()):
        out = F.when(F.lower(model_id).contains(name.lower()) | model_id.endswith(full.split("/")[-1]), F.lit(name)).otherwise(out)
    for name, full in MODEL_IDS.items():
        out = F.when(model_id == full, F.lit(name)).otherwise(out)
    return out


def model_rollup(values: DataFrame) -> DataFrame:
    """Means by model name, dataset, strategy, feature and metric."""
    return feature_rollup(values.withColumn("model", model_name(C("model_id"))), ("model", "dataset", "remasking"))


def summary_columns(values: DataFrame, metric: str = "prr") -> DataFrame:
    """run_count and the mean of metric by dataset, model and strategy: a second level over the competitors."""
    runs = values.select("run_dir", "dataset", "model_id", "remasking").distinct().groupBy("dataset", "model_id", "remasking").agg(F.count("*").alias("run_count"))
    means = values.where(C("metric") == metric).groupBy("dataset", "model_id", "remasking", "feature").agg(F.avg(numeric(C("value"))).alias(f"mean_{metric}"))
    return means.join(runs, ["dataset", "model_id", "remasking"])


def levels(values: DataFrame, keys: Sequence[str] = ("dataset", "model_id", "remasking")) -> DataFrame:
    """Means at every level of keys, the coarser ones with nulls."""
    return values.rollup(*keys).agg(F.avg(numeric(C("value"))).alias("mean"), F.count("*").alias("n"), F.grouping_id().alias("level"))


def order_index(x: Column, order: Sequence[str]) -> Column:
    """Place in a fixed order; unknown values come last."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), x) - 1
    return F.coalesce(F.when(place >= 0, place), F.lit(len(order))).cast("int")


def report_order(df: DataFrame) -> DataFrame:
    return df.orderBy(order_index(C("dataset"), DATASETS), order_index(C("remasking"), tuple(STRATEGIES)))


def feature_matrix(rollup: DataFrame, metric: str, column: Column, value: str = "mean") -> DataFrame:
    """feature x competitor with mean (std) as text."""
    from lumenq.functions.text import format_mean_std

    cell = format_mean_std(C(value), C("std"))
    return rollup.where(C("metric") == metric).withColumn("__column", column).groupBy("feature").pivot("__column").agg(F.first(cell))


def pareto(points: DataFrame, x: str = "x", y: str = "y", key: str = "id", group: Sequence[str] = ()) -> DataFrame:
    """points with on_front: nothing has as little x and as much y, of equal ones the first by key.

    A point is on the front if its y exceeds every y before it in the order of x, falling y and key. Points are first
    cut to the best of each x; the greatest y before is then found in blocks of x, so no window holds a whole group.
    Points without x or y are not on the front.
    """
    placed = points.where(C(x).isNotNull() & C(y).isNotNull())
    best = placed.groupBy(*group, x).agg(F.min_by(F.struct(C(key).alias("__key"), C(y).alias("__y")), F.struct(-C(y), C(key))).alias("__b")).select(*group, C(x).alias("__x"), "__b.*")
    above = prefix_max(staged(best, "best-points"), list(group), "__x", "__y")
    front = above.where(C("__y_before").isNull() | (C("__y") > C("__y_before"))).select(*group, C("__key").alias(key), F.lit(True).alias("__on"))
    return points.join(front, [*group, key], "left").withColumn("on_front", F.coalesce("__on", F.lit(False))).drop("__on")


def performance_latency(performance: DataFrame, latency: DataFrame, keys: Sequence[str] = ("model", "dataset", "remasking")) -> DataFrame:
    """Performance rows (keys, feature, value, is_selection, ord) with the cost of their feature.

    Of several rows a selection overrides and the last counts; otherwise the first counts.
    """
    place = F.struct(C("is_selection").cast("int").alias("s"), F.when(C("is_selection"), C("ord")).otherwise(-C("ord")).alias("o"))
    one = performance.where(C("value").isNotNull()).groupBy(*keys, "feature").agg(F.max_by("value", place).alias("value"))
    return one.join(latency, [*keys, "feature"])


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row by order of each of keys; rows with an empty key are left out."""
    filled = rows.where(" and ".join(f"coalesce({k}, '') <> ''" for k in keys))
    columns = [c for c in rows.columns if c not in keys]
    return filled.groupBy(*keys).agg(F.max_by(F.struct(*columns), C(order)).alias("__r")).select(*keys, *[C("__r")[c].alias(c) for c in columns])


def timing_aggregate(records: DataFrame) -> DataFrame:
    """n, mean and sample deviation (0 for one row) of gen, nli, math and total time by family and feature, and overhead."""
    total = C("time_gen") + C("time_nli") + C("time_math")
    timed = records.withColumns({"time_total": total})
    aggregates = [F.count("*").alias("n_prompts"), F.avg("n_extra_gen").alias("n_extra_gen"), F.avg("n_nli_pairs").alias("n_nli_pairs")]
    for name in ("time_gen", "time_nli", "time_math", "time_total"):
        aggregates += [F.avg(name).alias(f"{name}_mean"), F.coalesce(F.stddev_samp(name), F.lit(0.0)).alias(f"{name}_std")]
    return timed.groupBy("family", "feature").agg(*aggregates)


def node_scores(nodes: DataFrame) -> DataFrame:
    """score, rank and tier of nodes (node, matmul, clone, copy): shares of the best, weighted .50, .35, .15."""
    best = F.broadcast(nodes.agg(*[F.max(c).alias(f"__{c}") for c in ("matmul", "clone", "copy")]))  # one row
    score = F.round(100 * (0.5 * F.try_divide(C("matmul"), C("__matmul")) + 0.35 * F.try_divide(C("clone"), C("__clone")) + 0.15 * F.try_divide(C("copy"), C("__copy"))), 1)
    tier = F.when(C("score") >= 95, "prefer").when(C("score") < 80, "avoid").otherwise("ok")
    # nodes of a cluster are few; their rank is a single small window
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "node"))
    return nodes.crossJoin(best).withColumn("score", score).select("node", "score", rank.alias("rank"), tier.alias("tier"))


def pooled_folds(folds: DataFrame, keys: Sequence[str] = ("run_dir",)) -> DataFrame:
    """Accuracy pooled over folds, example-weighted mean tokens, and the examples as weight."""
    right, n, tokens = numeric(C("n_correct")), numeric(C("n_examples")), numeric(C("mean_visible_tokens"))
    both = right.isNotNull() & n.isNotNull()
    weight = F.when(tokens.isNotNull() & (n > 0), n)
    return folds.groupBy(*keys).agg(F.try_divide(F.sum(F.when(both, right)), F.sum(F.when(both, n))).alias("qa_accuracy"), F.nullif(F.sum(F.when(both, n)).cast("bigint"), F.lit(0)).alias("weight"), F.try_divide(F.sum(tokens * weight), F.sum(weight)).alias("mean_tokens"))


def without_nested(runs: DataFrame, kfold: DataFrame, path: str = "run_dir") -> DataFrame:
    """Plain runs that do not lie under a folded run's folder.

    A join on equality for each depth at which there are folded runs, a few numbers that the driver gets: a run's
    ancestor of that depth is looked up. Runs pass as they are, so where the folded runs are few nothing is shuffled.
    """
    folded = kfold.select(C(path).alias("__folder")).where(C("__folder").isNotNull()).distinct()
    depth = F.size(F.split("__folder", "/"))
    for d in sorted(folded.agg(F.collect_set(depth)).first()[0]):
        runs = runs.join(folded.where(depth == d), F.substring_index(path, "/", d) == C("__folder"), "left_anti")
    return runs


def normalized_metrics(names: Column, default: Sequence[str] = ("auroc",)) -> Column:
    """normalize_metrics over a column of name lists (arrays of strings, null for none given): null where a name is unknown."""
    split = F.flatten(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda m: F.split(F.coalesce(m, F.lit("")), ",")))
    found = F.array_distinct(F.filter(F.transform(split, lambda m: F.lower(F.trim(m))), lambda m: m != ""))
    found = F.when(F.size(found) == 0, F.array(*map(F.lit, default))).otherwise(found)
    return F.when(F.forall(found, lambda m: m.isin(*METRICS)), found)


def normalize_metrics(metrics: Sequence[str] | None, default: Sequence[str] = ("auroc",)) -> list[str]:
    """Metric names split at commas, lower case, each once; an error for unknown ones."""
    names = [p.strip().lower() for m in (metrics or default) for p in str(m).split(",") if p.strip()]
    names = list(dict.fromkeys(names)) or list(default)
    unknown = [m for m in names if m not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    return names
