"""Report sheets as tables of cells (sheet, row, col, value, fill): a sheet for each data set, or for each model.

Everything starts from roll-ups over runs, a row for each competitor, feature and metric, so the windows that number
rows and columns see small tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenq.config import DATASETS, MODEL_IDS, STRATEGIES
from lumenq.functions.text import format_mean_std, performance_fill
from lumenq.operators.features import GROUPS, all_feature_names
from lumenq.operators.report import COMPETITOR, TITLES, competitor_rollup, feature_rollup, model_name, order_index

C, L = F.col, F.lit
# The labels of the rows above the features.
HEADERS = (("model_id", "Model"), ("max_gen_length", "Max gen length"), ("steps", "Steps"), ("remasking", "Strategy"), ("label_method", "Label method"))
_FEATURE_ROW = len(HEADERS) + 6  # the first feature of a data set's sheet


def _cells(df: DataFrame, row: Column, col: Column, value: Column, fill: Column | None = None) -> DataFrame:
    return df.select("sheet", row.cast("int").alias("row"), col.cast("int").alias("col"), value.cast("string").alias("value"), (L(None).cast("string") if fill is None else fill).alias("fill"))


def _together(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).where("value is not null")


def _percent(x: Column) -> Column:
    return F.format_string("%.1f%%", 100 * x)


def _runs(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A roll-up with a row for each of keys, from a row for each run."""
    one = results.select("run_dir", *keys, "qa_accuracy", "weight", "mean_tokens").dropDuplicates(["run_dir", *keys])
    return competitor_rollup(one, [], keys)


def _filled(df: DataFrame, value: str = "mean", sheet: str = "sheet") -> DataFrame:
    """df with fill by where value lies among all of its sheet."""
    w = Window.partitionBy(sheet)
    return df.withColumn("fill", F.when(C(value).isNotNull(), performance_fill(C(value), F.min(value).over(w), F.max(value).over(w))))


def dataset_cells(results: DataFrame, metrics: Sequence[str] = ("auroc",)) -> DataFrame:
    """A sheet for each data set: competitors by metrics as columns, above them their settings, runs and accuracy.

    Competitors are sorted by their settings as text; features have their fixed order, others follow by name.
    """
    names = list(metrics)
    keys = ["dataset", *COMPETITOR]
    columns = _runs(results, keys).withColumn("at", F.dense_rank().over(Window.partitionBy("dataset").orderBy(*COMPETITOR)) - 1)
    columns = columns.withColumn("sheet", F.regexp_replace(C("dataset"), r"[\\/*?:\[\]]", "_").substr(1, 31))
    wide = columns.withColumn("m", F.explode(F.array(*[F.struct(L(i).alias("i"), L(m).alias("name")) for i, m in enumerate(names)]))).withColumn("col", C("at") * len(names) + C("m.i") + 2)
    sheets = columns.select("sheet").distinct()
    labels = [label for _, label in HEADERS] + ["Metric", "Runs included", "Greedy accuracy"]
    parts = [_cells(sheets, L(i), L(1), L(label)) for i, label in enumerate(labels, 1)] + [_cells(sheets, L(_FEATURE_ROW - 1), L(1), L("Feature"))]
    parts += [_cells(wide, L(i), C("col"), C(name)) for i, (name, _) in enumerate(HEADERS, 1)]
    n = len(HEADERS)
    parts += [_cells(wide, L(n + 1), C("col"), F.upper("m.name")), _cells(wide, L(n + 2), C("col"), C("run_count")), _cells(wide, L(n + 3), C("col"), _percent(C("qa_accuracy")))]
    # every feature that a data set has, against every column of it
    rolled = feature_rollup(results.where(C("feature").isNotNull() & C("metric").isin(*names)), keys)
    features = rolled.select("dataset", "feature").distinct().withColumn("row", F.row_number().over(Window.partitionBy("dataset").orderBy(order_index(C("feature"), all_feature_names()), "feature")) + _FEATURE_ROW - 1)
    found = rolled.join(wide.select(*keys, C("m.name").alias("metric"), "col"), [*keys, "metric"]).select("dataset", "feature", "col", "mean", "std")
    grid = features.join(wide.select("dataset", "sheet", "col"), "dataset").join(found, ["dataset", "feature", "col"], "left")
    grid = _filled(grid)
    parts += [_cells(features.join(columns.select("dataset", "sheet").distinct(), "dataset"), C("row"), L(1), C("feature")), _cells(grid, C("row"), C("col"), F.coalesce(format_mean_std(C("mean"), C("std")), L("N/A")), C("fill"))]
    return _together(parts)


def model_cells(results: DataFrame, metric: str = "prr") -> DataFrame:
    """A sheet for each known model: data sets and strategies as columns, features by report group; others are left out."""
    keys = ["sheet", "dataset", "remasking"]
    known = results.withColumn("sheet", model_name(C("model_id"))).where(C("sheet").isin(*MODEL_IDS))
    place = [order_index(C("dataset"), DATASETS), order_index(C("remasking"), tuple(STRATEGIES)), C("dataset"), C("remasking")]
    columns = _runs(known, keys).withColumn("col", F.row_number().over(Window.partitionBy("sheet").orderBy(*place)) + 1)
    title = reduce(lambda out, t: out.when(C("dataset") == t[0], t[1]), TITLES.items(), F.when(L(False), "")).otherwise(C("dataset"))
    first = C("col") == F.min("col").over(Window.partitionBy("sheet", "dataset"))
    parts = [_cells(columns.where("true").withColumn("__first", first).where("__first"), L(1), C("col"), title), _cells(columns, L(2), C("col"), C("remasking")), _cells(columns, L(3), C("col"), _percent(C("qa_accuracy"))), _cells(columns, L(4), C("col"), F.format_string("%.1f", C("mean_tokens")))]
    sheets = columns.select("sheet").distinct()
    parts += [_cells(sheets, L(i), L(1), L(label)) for i, label in ((3, "Greedy accuracy"), (4, "Mean tokens"))]
    members = [(g, title, f) for g, (title, names) in enumerate(GROUPS.items()) for f in names]
    order = F.array(*[F.struct(L(g).alias("g"), L(t).alias("title"), L(i).alias("f"), L(f).alias("feature")) for i, (g, t, f) in enumerate(members)])
    rolled = feature_rollup(known.where((C("metric") == metric) & C("feature").isNotNull()), keys).where("mean is not null")
    listed = rolled.select("sheet", "feature").distinct().withColumn("o", F.explode(order)).where("o.feature = feature").select("sheet", "feature", "o.g", "o.title", "o.f")
    # a group takes a row for its title, one for each feature it has, and a blank one
    at = F.row_number().over(Window.partitionBy("sheet").orderBy("f")) + 2 * (F.dense_rank().over(Window.partitionBy("sheet").orderBy("g")) - 1) + 6
    rows = listed.withColumn("row", at)
    cells = _filled(rolled.join(rows.select("sheet", "feature", "row"), ["sheet", "feature"]).join(columns.select(*keys, "col"), keys))
    parts += [_cells(rows.groupBy("sheet", "g", "title").agg((F.min("row") - 1).alias("row")), C("row"), L(1), C("title")), _cells(rows, C("row"), L(1), C("feature")), _cells(cells, C("row"), C("col"), format_mean_std(C("mean"), C("std")), C("fill"))]
    return _together(parts)
