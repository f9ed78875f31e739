"""Readers of datasets, prompts, answers, metrics and latency profiles."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenq.operators.metrics import METRICS
from lumenq.operators.report import latest, model_name, numeric
from lumenq.sources import places, schemas

SKIPPED = ("__pycache__", ".git", ".pytest_cache")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON document as a row."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines: blank lines are skipped, a malformed one is an error."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, number, value) of the lines of text files, numbered from 1 in each file.

    A task reads parts of files, and knows a line's place in its part; the lines of the parts before it come from a
    count of each part, so long files are numbered without being read by one task.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"))
    parts = text.groupBy("path", "part").agg(F.min("at").alias("first"), F.count("*").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each part of a file
    return text.join(parts.withColumn("before", before), ["path", "part"]).select("path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("number"), "value")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, number, line) of lines that are no JSON object, to find what FAILFAST stopped at."""
    parsed = F.try_parse_json("value")
    bad = (F.trim("value") != "") & (parsed.isNull() | (F.schema_of_variant(parsed).startswith("OBJECT") == F.lit(False)))
    return numbered_lines(spark, path).where(bad).select("path", "number", F.col("value").alias("line"))


def load_dataset(spark: SparkSession, source: str, split: str = "test", config: str | None = None, schema: str | None = None) -> DataFrame:
    """A dataset by its folder of Parquet or JSON files, laid out as source[/config]/split; nothing is downloaded."""
    base = "/".join(x for x in (source, config, split) if x)
    try:
        return spark.read.parquet(base)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e) or "FAILED_READ_FILE" in str(e):
            return read_jsonl(spark, base + ".jsonl", schema)
        raise


def load_local_dataset(spark: SparkSession, path: str, file_format: str = "jsonl", schema: str | None = None) -> DataFrame:
    """jsonl, or json that holds an array of rows."""
    if file_format not in ("jsonl", "json"):
        raise ValueError(f"unknown file format {file_format}")
    if not places.exists(path):
        raise FileNotFoundError(path)
    if file_format == "jsonl":
        return read_jsonl(spark, path, schema)
    first = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim(F.regexp_replace("value", r"^\s+", "")), 1, 1)).head()
    if first is None or first[0] != "[":
        raise ValueError(f"{path} holds no array")
    return read_json(spark, path, schema)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.ANSWERS)


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.TRAJECTORIES)


def read_run(spark: SparkSession, folder: str, step_view: str = "x0", name: str = "trajectories.jsonl") -> DataFrame:
    """A generated run's trajectories in one view of their steps, (prompt_id, num_steps, response_sample_id, step_answers, final_answer).

    A view is a column step_answers_<view>; step_answers alone is the view x0. An error for a view that is not there.
    """
    rows = read_jsonl(spark, f"{folder}/{name}")
    column = f"step_answers_{step_view}"
    if column not in rows.columns:
        if step_view != "x0" or "step_answers" not in rows.columns:
            raise ValueError(f"{folder} has no steps in the view {step_view}")
        column = "step_answers"
    steps = F.col(column).cast("array<string>")
    size = F.coalesce(F.col("num_steps").cast("int"), F.size(steps)) if "num_steps" in rows.columns else F.size(steps)
    sample = F.coalesce(F.col("response_sample_id").cast("int"), F.lit(0)) if "response_sample_id" in rows.columns else F.lit(0)
    return rows.select(F.col("prompt_id").cast("string").alias("prompt_id"), size.alias("num_steps"), sample.alias("response_sample_id"), steps.alias("step_answers"), F.col("final_answer").cast("string").alias("final_answer"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows; only columns that some row has, so that an absent feature stays absent."""
    return read_jsonl(spark, path)


def read_latency(spark: SparkSession, path: str) -> DataFrame:
    """A latency profile by feature: absent numbers are 0, an absent family is empty, the last row of a feature counts."""
    text = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    columns = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in text.columns else F.lit(0.0).alias(c) for c in ("overhead_mean", "overhead_std", "time_total_mean", "time_total_std", "time_gen_mean", "time_nli_mean", "time_math_mean")]
    family = F.coalesce(F.col("family"), F.lit("")) if "family" in text.columns else F.lit("")
    rows = text.select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder"), "feature", *columns, family.alias("family"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line"))
    return latest(rows, ("folder", "feature"), "__line").drop("__block", "__line")


def discover_latency(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles with their model, dataset and strategy from the metadata beside them; the last by path of equal ones."""
    profiles = read_latency(spark, folder)
    about = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "latency_metadata.json").schema("model_id string, dataset string, remasking string").json(folder)
    about = about.select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder"), model_name(F.coalesce("model_id", F.lit(""))).alias("model"), "dataset", "remasking")
    chosen = latest(about, ("model", "dataset", "remasking"), "folder")
    return profiles.join(chosen, "folder")


def find_files(roots: Iterable[str], name: str, skip: Iterable[str] = SKIPPED) -> list[str]:
    """Files of a name at or below the roots, each once, sorted. A listing, no data."""
    found = (places.resolved(p) for root in map(str, roots) for p in places.walk(root) if p.rsplit("/", 1)[-1] == name and not set(p.split("/")) & set(skip))
    return sorted(set(found))


def find_metrics_files(roots: Iterable[str], name: str = "uq_eval_metrics.json") -> list[str]:
    return find_files(roots, name)


def find_kfold_summaries(roots: Iterable[str], name: str = "kfold_summary.json") -> list[str]:
    return find_files(roots, name, ())


def discover_runs(folder: str, answers: str = "answers.jsonl", config: str = "config.json", exclude: Iterable[str] = ()) -> list[str]:
    """Folders right below folder that hold both, without the excluded names, sorted. Answers are a file or Spark's folder of them."""
    runs = {p.rsplit("/", 1)[0] for p in places.walk(str(folder)) if p.endswith(f"/{config}")}
    return sorted(r for r in runs if r.rsplit("/", 1)[-1] not in set(exclude) and places.resolved(r.rsplit("/", 1)[0]) == places.resolved(str(folder)) and places.exists(f"{r}/{answers}"))


def run_config(folder: str, ancestors: bool = False) -> dict:
    """config.json overlaid by metadata.json's run_config, or by metadata.json where it has none; nearest ones if asked."""
    out: dict = {}
    around = places.above(str(folder)) if ancestors else [str(folder)]
    for name in ("config.json", "metadata.json"):
        path = next((f"{p}/{name}" for p in around if places.exists(f"{p}/{name}")), None)
        if path:
            content = json.loads(places.read_text(path))
            out |= content["run_config"] if name == "metadata.json" and isinstance(content.get("run_config"), dict) else content
    return out


def competitor(config: dict) -> dict:
    """Dataset and competitor columns of a configuration; absent values are the text unknown."""
    pick = lambda *names: str(next((config[n] for n in names if config.get(n) is not None), "unknown"))
    return {"dataset": pick("dataset"), "model_id": pick("model_id", "model_name_or_path"), "max_gen_length": pick("max_gen_length", "gen_length"), "steps": pick("steps"), "remasking": pick("remasking"), "label_method": pick("label_method", "correctness_method")}


_RUN = "run_dir string, dataset string, model_id string, max_gen_length string, steps string, remasking string, label_method string"


def _configs(spark: SparkSession, folders: Iterable[str], ancestors: bool) -> DataFrame:
    """Competitor columns of run folders: one small document for each run."""
    rows = [(f, *competitor(run_config(f, ancestors)).values()) for f in folders]
    return spark.createDataFrame(rows, _RUN)


def load_run_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Long rows (run_dir, competitor, qa_accuracy, weight, mean_tokens, feature, metric, value, std) of metrics files.

    A metric is the first finite number of its nested bootstrap mean, its flat bootstrap mean and its point estimate.
    A legacy scores list wins over the features map. Files are read and taken apart by Spark.
    """
    if not paths:
        return spark.createDataFrame([], _RUN + ", qa_accuracy double, weight bigint, mean_tokens double, feature string, metric string, value double, std double")
    text = spark.read.text(paths, wholetext=True).select(F.regexp_replace(F.regexp_replace("_metadata.file_path", "^file:/*", "/"), "/[^/]*$", "").alias("run_dir"), "value")
    number = lambda path: numeric(F.get_json_object("value", path))
    head = text.select(
        "run_dir",
        F.coalesce(number("$.dataset_summary.accuracy"), number("$.accuracy"), F.try_divide(number("$.n_correct"), F.nullif(number("$.n_examples"), F.lit(0.0)))).alias("qa_accuracy"),
        F.coalesce(number("$.dataset_summary.n_labelled"), number("$.n_examples")).cast("bigint").alias("weight"),
        number("$.mean_visible_tokens").alias("mean_tokens"),
        F.from_json(F.get_json_object("value", "$.features"), "map<string,string>").alias("features"),
        F.from_json(F.get_json_object("value", "$.scores"), "array<string>").alias("scores"),
    )
    listed = head.select("run_dir", F.explode("scores").alias("entry")).select("run_dir", F.get_json_object("entry", "$.score_name").alias("feature"), "entry").where("coalesce(feature, '') <> ''")
    mapped = head.select("run_dir", F.explode("features").alias("feature", "entry")).join(listed.select("run_dir", "feature"), ["run_dir", "feature"], "left_anti")
    both = listed.unionByName(mapped)
    of = lambda m, *tails: F.coalesce(*[numeric(F.get_json_object("entry", f"$.{t.format(m=m)}")) for t in tails])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), of(m, "bootstrap.metrics.{m}.mean", "{m}_bootstrap_mean", "{m}").alias("value"), of(m, "bootstrap.metrics.{m}.std", "{m}_bootstrap_std").alias("std")) for m in METRICS]))
    long = both.select("run_dir", "feature", each.alias("e")).where("e.value is not null").select("run_dir", "feature", "e.*")
    configs = _configs(spark, sorted({places.resolved(p).rsplit("/", 1)[0] for p in paths}), False)
    return configs.join(head.drop("features", "scores"), "run_dir").join(long, "run_dir", "left")


def load_kfold_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same long rows from k-fold summaries, run_dir ending in the section; entries are {mean, std} or a number."""
    from lumenq.operators.report import pooled_folds

    text = spark.read.text(paths, wholetext=True).select(F.regexp_replace(F.regexp_replace("_metadata.file_path", "^file:/*", "/"), "/[^/]*$", "").alias("kfold_dir"), "value")
    sections = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.from_json(F.get_json_object("value", f"$.{s}"), "map<string,map<string,string>>").alias("features")) for s in ("baseline", "selection")]))
    rows = text.select("kfold_dir", sections.alias("s")).select("kfold_dir", "s.section", F.explode("s.features").alias("feature", "metrics")).select("kfold_dir", "section", "feature", F.explode("metrics").alias("metric", "entry")).where(F.col("metric").isin(*METRICS))
    rows = rows.select("kfold_dir", F.concat_ws("/", "kfold_dir", "section").alias("run_dir"), "feature", "metric", F.coalesce(numeric(F.get_json_object("entry", "$.mean")), numeric(F.col("entry"))).alias("value"), numeric(F.get_json_object("entry", "$.std")).alias("std")).where("value is not null")
    folders = sorted({places.resolved(p).rsplit("/", 1)[0] for p in paths})
    folds = [f for d in folders for f in find_files([d], "uq_eval_metrics.json") if "/baseline/" in f]
    schema = "n_correct double, n_examples double, mean_visible_tokens double"
    if folds:
        each = spark.read.option("multiLine", True).schema(schema).json(folds).select(F.regexp_replace(F.regexp_replace("_metadata.file_path", "^file:/*", "/"), "/fold_[0-9]+/baseline/[^/]*$", "").alias("kfold_dir"), "n_correct", "n_examples", "mean_visible_tokens")
    else:
        each = spark.createDataFrame([], "kfold_dir string, " + schema)
    configs = _configs(spark, folders, True).withColumnRenamed("run_dir", "kfold_dir")
    return configs.join(pooled_folds(each, ["kfold_dir"]), "kfold_dir", "left").join(rows, "kfold_dir").drop("kfold_dir")
