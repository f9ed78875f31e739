"""Writers of prompts, answers, features, metrics, summaries and report matrices."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenq.operators.metrics import METRICS
from lumenq.sources import places


def to_jsonable(x):
    """Plain values: array scalars and arrays become numbers and lists, keys become text."""
    if isinstance(x, Mapping):
        return {str(k): to_jsonable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [to_jsonable(v) for v in x]
    return to_jsonable(x.tolist()) if hasattr(x, "tolist") else x


def write_json(document, path: str) -> None:
    """A small document, indented; NaN is allowed."""
    places.write_text(path, json.dumps(to_jsonable(document), indent=2) + "\n")


def finite_or_fail(df: DataFrame) -> DataFrame:
    """df, with an error in every row that has a NaN or infinite number."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float")]
    for c in numbers:
        name = F.col(f"`{c}`")
        df = df.withColumn(c, F.when(F.isnan(name) | (F.abs(name) == float("inf")), F.raise_error(F.lit(f"{c} is not finite")).cast("double")).otherwise(name))
    return df


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines by Spark; a number that is not finite fails the write."""
    finite_or_fail(df).write.mode(mode).json(path)


def write_prompts(prompts: DataFrame, path: str, mode: str = "errorifexists", text: bool = False) -> None:
    """Prompt records in the order of prompt_id, and their texts beside them if asked."""
    prompts.sort("prompt_id").write.mode(mode).json(path)
    if text:
        prompts.sort("prompt_id").select(F.col("prompt_text").alias("value")).write.mode(mode).text(path + ".txt")


def save_results(answers: DataFrame, tensors: DataFrame | None, config: dict, metadata: dict, path: str, mode: str = "errorifexists") -> None:
    """A run: answers and tensors by Spark, configuration and metadata as documents."""
    answers.write.mode(mode).json(f"{path}/answers.jsonl")
    if tensors is not None:
        tensors.write.mode(mode).parquet(f"{path}/topk_logprobs.parquet")
    write_json(config, f"{path}/config.json")
    write_json({**metadata, "run_config": config}, f"{path}/metadata.json")


def replace_records(records: DataFrame, path: str) -> None:
    """Records written over the folder that they were read from: beside it first, then swapped by renaming."""
    spark = records.sparkSession
    new, old = path.rstrip("/") + ".new", path.rstrip("/") + ".old"
    records.write.mode("overwrite").json(new)
    jvm = spark._jvm.org.apache.hadoop.fs
    at = lambda p: jvm.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at(old), True)
    fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))
    fs.delete(at(old), True)


def metrics_document(summary: Mapping, metrics: DataFrame) -> dict:
    """The summary with features: {feature: {metric: value}}; metrics has a row for each of a few dozen features."""
    rows = [r.asDict() for r in metrics.orderBy("feature").collect()]
    return {**summary, "features": {r.pop("feature"): {k: v for k, v in r.items() if v is not None or k in METRICS} for r in rows}}


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    """feature and the seven metrics; null is empty."""
    rows = metrics.select("feature", *METRICS).orderBy("feature").collect()  # one row for each feature
    _write_rows(["feature", *METRICS], [["" if v is None else v for v in r] for r in rows], path)


def _write_rows(head: Sequence[str], rows, path: str) -> None:
    import csv
    import io

    text = io.StringIO(newline="")
    csv.writer(text).writerows([head, *rows])
    places.write_text(path, text.getvalue())


def write_kfold_summary(folds: DataFrame, n_folds: int, path: str, per_fold: Sequence[Mapping] = ()) -> None:
    """{section: {feature: {metric: {mean, std, per_fold}}}} as JSON, and beside it as CSV with a column for each fold."""
    document: dict = {"n_folds": n_folds, "baseline": {}, "selection": {}, "per_fold": list(per_fold)}
    rows = folds.orderBy("section", "feature", "metric").collect()  # one row for each feature and metric
    for r in rows:
        document.setdefault(r.section, {}).setdefault(r.feature, {})[r.metric] = {"mean": r["mean"], "std": r["std"], "per_fold": list(r.per_fold)}
    write_json(document, path)
    width = max([n_folds, *(len(r.per_fold) for r in rows)])
    text = lambda v: "" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6f}"
    table = [[r.section, r.feature, r.metric, text(r["mean"]), text(r["std"]), *(text(v) for v in r.per_fold), *[""] * (width - len(r.per_fold))] for r in rows]
    _write_rows(["section", "feature", "metric", "mean", "std", *(f"fold_{i}" for i in range(width))], table, path.removesuffix(".json") + ".csv")


def write_workbook(sheets: Mapping[str, DataFrame], path: str) -> str:
    """A sheet for each matrix; without a spreadsheet library, a folder of CSV files of the same name."""
    try:
        from openpyxl import Workbook
    except ImportError:
        folder = path.removesuffix(".xlsx")
        for name, df in sheets.items():
            rows = df.collect()  # a report matrix
            _write_rows(df.columns, [["" if v is None else v for v in r] for r in rows], f"{folder}/{name}.csv")
        return folder
    book = Workbook()
    book.remove(book.active)
    for name, df in sheets.items():
        sheet = book.create_sheet(name[:31])
        sheet.append(df.columns)
        for r in df.collect():
            sheet.append(list(r))
    book.save(path)
    return path


def write_sheets(cells: DataFrame, path: str) -> str:
    """Sheets of cells (sheet, row, col, value, fill); without a spreadsheet library, a folder with a CSV file for each.

    A sheet without fills is as good as one with: the folder keeps them in a second file beside each.
    """
    sheets: dict[str, dict] = {}
    for r in cells.collect():  # a report's cells
        sheets.setdefault(r.sheet, {})[r.row, r.col] = (r.value, r.fill)
    if not sheets:
        sheets = {"Summary": {(1, 1): ("No evaluated runs found", None)}}
    try:
        from openpyxl import Workbook
        from openpyxl.styles import PatternFill
    except ImportError:
        folder = path.removesuffix(".xlsx")
        for name, own in sorted(sheets.items()):
            high, wide = (max(k[i] for k in own) for i in (0, 1))
            lines = lambda i, own=own, high=high, wide=wide: [[own.get((r, c), ("", ""))[i] or "" for c in range(1, wide + 1)] for r in range(1, high + 1)]
            values, fills = lines(0), lines(1)
            _write_rows(values[0], values[1:], f"{folder}/{name}.csv")
            _write_rows(fills[0], fills[1:], f"{folder}/{name}.fills.csv")
        return folder
    book = Workbook()
    book.remove(book.active)
    for name, own in sorted(sheets.items()):
        sheet = book.create_sheet(name[:31])
        for (row, col), (value, fill) in own.items():
            cell = sheet.cell(row=row, column=col, value=value)
            if fill:
                cell.fill = PatternFill("solid", fgColor=fill)
    book.save(path)
    return path
