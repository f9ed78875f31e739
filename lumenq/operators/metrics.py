"""Scores as error detectors: ranking, rejection and calibration metrics in long form.

Input is a table of keys (feature, and rep or run where there are some), id, y and s: y is 1 for an error, s grows with
uncertainty. Everything comes from one table of distinct scores with their counts and what lies below them, so rows are
pre-aggregated before they are ordered, and no window holds a whole feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenq.operators.features import all_feature_names, orientation
from lumenq.operators.prefix import prefix_sums
from lumenq.staging import staged

METRICS = ("auroc", "auprc", "prr", "ece", "brier", "spearman_rho", "kendall_tau")
COVERAGES = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)
BINS = 10


def numeric_id(rows: DataFrame, id_col: str) -> Column:
    """An id that orders ties: whole numbers as they are, others by their hash."""
    kind = rows.schema[id_col].dataType.simpleString()
    return F.col(id_col).cast("bigint") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(F.col(id_col).cast("string"))


def long_scores(rows: DataFrame, features: Sequence[str], id_col: str = "prompt_id", correct: str = "is_correct") -> DataFrame:
    """(feature, id, y, s) from a wide feature table: rows without a label and values that are null are left out."""
    labelled = rows.where(F.col(correct).isNotNull())
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("value")) for f in features]))
    out = labelled.select(numeric_id(rows, id_col).alias("id"), (~F.col(correct).cast("boolean")).cast("int").alias("y"), pairs.alias("p")).where("p.value is not null")
    return out.select("p.feature", "id", "y", (F.col("p.value") * orientation(F.col("p.feature"))).alias("s"))


def require_labels(rows: DataFrame, correct: str = "is_correct") -> DataFrame:
    """rows with a label; an error if none has one."""
    kept = rows.where(F.col(correct).isNotNull())
    if kept.isEmpty():
        raise ValueError("no labelled rows to evaluate")
    return kept


def _steps(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each distinct score: c rows and p errors at it, c_before and p_before below it.

    The distinct scores are written once: prefix sums read them in several passes, and each would make the scores anew.
    """
    distinct = scores.groupBy(*keys, "s").agg(F.count("*").alias("c"), F.sum(F.col("y").cast("bigint")).alias("p"))
    return prefix_sums(staged(distinct, "distinct-scores"), keys, "s", ["c", "p"])


def _two_classes(value: Column) -> Column:
    return F.when((F.col("pos") > 0) & (F.col("pos") < F.col("n")), value)


def _totals(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    return steps.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum("p").alias("pos"), F.min("s").alias("low"), F.max("s").alias("high"))


def rank_metrics(scores: DataFrame, keys: Sequence[str] = ("feature",), steps: DataFrame | None = None) -> DataFrame:
    """n, pos, auroc, auprc, spearman_rho and kendall_tau; null with a single class, Spearman also below three rows.

    Ties share their average rank. Closed forms for a binary y: no pair of rows is ever formed.
    """
    keys = list(keys)
    steps = steps or _steps(scores, keys)
    t = steps.join(_totals(steps, keys), keys)
    c, p, n, pos = F.col("c"), F.col("p"), F.col("n"), F.col("pos")
    rank = F.col("c_before") + (c + 1) / F.lit(2.0)
    low_rank, high_rank = (n - pos + 1) / F.lit(2.0), n - pos + (pos + 1) / F.lit(2.0)
    mean = (n + 1) / F.lit(2.0)
    sums = t.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("pos").alias("pos"),
        F.sum(p * rank).alias("rank_sum"),
        F.sum(F.try_divide(p, pos) * F.try_divide(pos - F.col("p_before"), n - F.col("c_before"))).alias("precision"),
        F.sum(c * (c - 1) / F.lit(2.0)).alias("tied"),
        F.sum(c * (rank - mean) * (rank - mean)).alias("var_s"),
        F.sum(p * (rank - mean) * (high_rank - mean) + (c - p) * (rank - mean) * (low_rank - mean)).alias("cov"),
    )
    u = F.col("rank_sum") - pos * (pos + 1) / F.lit(2.0)
    both = (pos * (n - pos)).cast("double")
    var_y = pos * (high_rank - mean) * (high_rank - mean) + (n - pos) * (low_rank - mean) * (low_rank - mean)
    return sums.select(
        *keys,
        "n",
        "pos",
        _two_classes(F.try_divide(u, both)).alias("auroc"),
        _two_classes(F.col("precision")).alias("auprc"),
        _two_classes(F.when(n >= 3, F.try_divide(F.col("cov"), F.sqrt(F.nullif(F.col("var_s") * var_y, F.lit(0.0)))))).alias("spearman_rho"),
        _two_classes(F.when(n >= 3, F.try_divide(2 * u - both, F.sqrt(F.nullif((n * (n - 1) / F.lit(2.0) - F.col("tied")) * both, F.lit(0.0)))))).alias("kendall_tau"),
    )


def _kept(n: Column) -> Column:
    """(coverage, k) for each coverage: k rows are kept, half to even and one at least."""
    return F.explode(F.array(*[F.struct(F.lit(v).alias("coverage"), F.greatest(F.lit(1), F.bround(F.lit(v) * n, 0).cast("bigint")).alias("k")) for v in COVERAGES]))


def risk_curve(scores: DataFrame, keys: Sequence[str] = ("feature",), steps: DataFrame | None = None) -> DataFrame:
    """(coverage, k, risk): mean error of the k rows with the lowest scores; ties by id, which is numeric."""
    keys = list(keys)
    steps = steps or _steps(scores, keys)
    totals = _totals(steps, keys)
    cuts = totals.select(*keys, "n", "pos", _kept(F.col("n")).alias("cut")).select(*keys, "n", "pos", "cut.coverage", "cut.k")
    at = cuts.join(steps, keys).where((F.col("c_before") < F.col("k")) & (F.col("k") <= F.col("c_before") + F.col("c")))
    # only where a cut splits a tie are its rows ordered by id
    split = at.where("k < c_before + c and p > 0 and p < c").select(*keys, "s").distinct()
    ties = prefix_sums(scores.join(split, [*keys, "s"]).select(*keys, "s", "id", F.col("y").cast("bigint").alias("y"), F.lit(1).cast("bigint").alias("one")), [*keys, "s"], "id", ["y", "one"])
    inside = ties.select(*keys, "s", (F.col("one_before") + 1).alias("taken"), (F.col("y_before") + F.col("y")).alias("errors"))
    taken = at.withColumn("taken", F.col("k") - F.col("c_before")).join(inside, [*keys, "s", "taken"], "left")
    errors = F.coalesce("errors", F.when(F.col("p") == F.col("c"), F.col("taken")).when(F.col("p") == 0, F.lit(0)).otherwise(F.col("p")))
    return taken.select(*keys, "coverage", "k", "n", "pos", ((F.col("p_before") + errors) / F.col("k")).alias("risk"))


def _area(risks: list[Column]) -> Column:
    """Trapezoids over the coverages."""
    return sum((F.lit(a - b) * (x + y) / 2 for a, b, x, y in zip(COVERAGES, COVERAGES[1:], risks, risks[1:], strict=False)), F.lit(0.0))


def rejection_ratio(scores: DataFrame, keys: Sequence[str] = ("feature",), steps: DataFrame | None = None) -> DataFrame:
    """prr: area gained over random rejection, as a share of what an oracle gains.

    Null below two rows, for a base risk of 0 or 1, or where the oracle gains less than 1e-12.
    """
    keys = list(keys)
    curve = risk_curve(scores, keys, steps).groupBy(*keys).agg(F.max("n").alias("n"), F.max("pos").alias("pos"), *[F.max(F.when(F.abs(F.col("coverage") - v) < 1e-9, F.col("risk"))).alias(f"r{i}") for i, v in enumerate(COVERAGES)])
    n, pos = F.col("n"), F.col("pos")
    base = pos / n
    kept = [F.greatest(F.lit(1), F.bround(F.lit(v) * n, 0).cast("bigint")) for v in COVERAGES]
    oracle = [F.greatest(F.lit(0), k - (n - pos)) / k for k in kept]
    flat = _area([base] * len(COVERAGES))
    gain, most = flat - _area([F.col(f"r{i}") for i in range(len(COVERAGES))]), flat - _area(oracle)
    return curve.select(*keys, F.when((n >= 2) & (pos > 0) & (pos < n) & (F.abs(most) >= 1e-12), F.try_divide(gain, most)).alias("prr"))


def scaled(low: Column, high: Column, s: Column) -> Column:
    """Min-max scaling; a flat range is 0.5."""
    return F.when(high - low < 1e-12, F.lit(0.5)).otherwise(F.try_divide(s - low, high - low))


def minmax(scores: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Scores with u, their place between the lowest and the highest of their keys."""
    keys = list(keys)
    ends = scores.groupBy(*keys).agg(F.min("s").alias("low"), F.max("s").alias("high"))
    return scores.join(ends, keys).withColumn("u", scaled(F.col("low"), F.col("high"), F.col("s"))).drop("low", "high")


def calibration(scores: DataFrame, keys: Sequence[str] = ("feature",), bins: int = BINS, guard: bool = True, steps: DataFrame | None = None) -> DataFrame:
    """ece over equal-width bins, the last closed on the right, and brier, of min-max scaled scores.

    Both are null with a single class, as in a full evaluation; guard=False leaves only the rule of two rows for ece.
    """
    keys = list(keys)
    steps = steps or scores.groupBy(*keys, "s").agg(F.count("*").alias("c"), F.sum(F.col("y").cast("bigint")).alias("p"))
    u = steps.join(_totals(steps, keys).select(*keys, "low", "high"), keys).withColumn("u", scaled(F.col("low"), F.col("high"), F.col("s")))
    c, p, v = F.col("c"), F.col("p"), F.col("u")
    edges = [i * (1.0 / bins) for i in range(bins)]
    bin_of = F.lit(0)
    for i, edge in enumerate(edges[1:], 1):
        bin_of = F.when(F.col("u") >= edge, F.lit(i)).otherwise(bin_of)
    by_bin = u.groupBy(*keys, bin_of.alias("bin")).agg(F.sum(c).alias("c"), F.sum(p).alias("p"), F.sum(c * v).alias("su"), F.sum(p * (v - 1) * (v - 1) + (c - p) * v * v).alias("se"))
    out = by_bin.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum("p").alias("pos"), F.sum(F.abs(F.col("p") - F.col("su"))).alias("gap"), F.sum("se").alias("se"))
    ece, brier = F.when(F.col("n") >= 2, F.col("gap") / F.col("n")), F.col("se") / F.col("n")
    return out.select(*keys, *[(_two_classes(v) if guard else v).alias(name) for v, name in ((ece, "ece"), (brier, "brier"))])


def evaluate_scores(scores: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """All seven metrics of each of the keys, with n and pos.

    The scores are written once, and so are the distinct scores that every metric starts from.
    """
    keys = list(keys)
    scores = staged(scores, "scores")
    steps = staged(_steps(scores, keys), "steps")
    out = rank_metrics(scores, keys, steps)
    for part in (rejection_ratio(scores, keys, steps), calibration(scores, keys, steps=steps)):
        out = out.join(part, keys)
    return out.select(*keys, "n", "pos", *METRICS)


def evaluated_features(rows: DataFrame) -> list[str]:
    """The features to evaluate: known names, and random-<i>-<name>, that the table has a column for."""
    import re

    known = [f for f in all_feature_names() if f in rows.columns]
    return known + sorted(c for c in rows.columns if re.fullmatch(r"random-\d+-.+", c))


def run_summary(rows: DataFrame, keys: Sequence[str] = (), correct: str = "is_correct", tokens: str = "n_visible_tokens") -> DataFrame:
    """n_examples, n_correct, n_wrong, accuracy and mean_visible_tokens (null without that column) of labelled rows."""
    y = F.col(correct).cast("boolean")
    if tokens not in rows.columns:
        rows = rows.withColumn(tokens, F.lit(None).cast("double"))
    return (
        rows.where(F.col(correct).isNotNull())
        .groupBy(*keys)
        .agg(F.count("*").alias("n_examples"), F.count_if(y).alias("n_correct"), F.count_if(~y).alias("n_wrong"), F.try_divide(F.count_if(y), F.count("*")).alias("accuracy"), F.avg(tokens).alias("mean_visible_tokens"))
    )


def fold_random(metrics: DataFrame, value_cols: Sequence[str] = METRICS) -> DataFrame:
    """random-<i>-<name> rows averaged to random-<name>, with n_random_selections; other rows as they are."""
    indexed = r"^random-([0-9]+)-(.+)$"
    own = F.col("feature").rlike(indexed)
    name = F.when(own, F.concat(F.lit("random-"), F.regexp_extract("feature", indexed, 2))).otherwise(F.col("feature"))
    return metrics.groupBy(name.alias("feature")).agg(*[F.avg(v).alias(v) for v in value_cols], F.nullif(F.count_if(own), F.lit(0)).alias("n_random_selections"))


def evaluate_run(rows: DataFrame, bootstrap: int = 0, seed: int = 0, id_col: str = "prompt_id") -> DataFrame:
    """Metrics of every feature of a wide feature table, random selections averaged, with bootstrap columns if asked.

    Features without two classes among their valid rows appear with null metrics.
    """
    from lumenq.operators.resample import bootstrap_metrics

    rows = require_labels(rows)
    features = evaluated_features(rows)
    scores = long_scores(rows, features, id_col)
    names = rows.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    out = names.join(evaluate_scores(scores), "feature", "left").drop("n", "pos")
    values = list(METRICS)
    if bootstrap:
        boot = bootstrap_metrics(scores, bootstrap, seed)
        values += [c for c in boot.columns if c != "feature"]
        out = out.join(boot, "feature", "left")
    return fold_random(out, values)
