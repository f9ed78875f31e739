"""Correctness labels: which records are labelled, exact match, judge with a retry, and what stays ambiguous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenq.backends import Judge
from lumenq.config import DATASET_SETTINGS
from lumenq.functions.text import strip
from lumenq.operators.prompts import adapter, first_records

C = F.col


def response_text() -> Column:
    return strip(F.coalesce(C("raw_answer").cast("string"), F.lit("")))


def select_to_label(records: DataFrame, key: str = "prompt_id", order: str = "sample_id", mode: str = "generation_mode") -> DataFrame:
    """All records that are not sampled if there are any; else the first record of each prompt."""
    if mode not in records.columns:
        return records
    other = F.coalesce(C(mode) != "sampled", F.lit(True))
    # one row that says whether any record is not sampled, met by every row
    some = F.broadcast(records.agg(F.coalesce(F.bool_or(other), F.lit(False)).alias("__some")))
    rows = records.crossJoin(some)
    return rows.where("__some").where(other).unionByName(first_records(rows.where("not __some"), key, order)).drop("__some")


def exact_match(records: DataFrame, parse, output: str = "label") -> DataFrame:
    """True where the parsed answer is an alias, or the reference answer where there are no aliases; empty is false."""
    parsed = parse(response_text())
    aliases = C("aliases") if "aliases" in records.columns else F.array().cast("array<string>")
    accepted = F.when(F.size(F.coalesce(aliases, F.array().cast("array<string>"))) > 0, aliases).otherwise(F.array(C("reference_answer").cast("string")))
    hit = F.exists(accepted, lambda a: a == parsed)
    return records.withColumn(output, F.when((response_text() == "") | (F.coalesce(parsed, F.lit("")) == ""), False).otherwise(F.coalesce(hit, F.lit(False))))


def judged(records: DataFrame, dataset: str, judge: Judge, retry: Judge | None = None, key: str = "sample_id") -> DataFrame:
    """records with label and retried: empty responses are false and never asked; what stays unclear is asked once more.

    The judge is asked once for each distinct prompt; records then meet its answer by the prompt.
    """
    own = adapter(dataset)
    asked = records.withColumn("__prompt", F.when(response_text() != "", own.judge()))
    prompts = asked.where(C("__prompt").isNotNull()).select(C("__prompt").alias("prompt")).distinct()
    first = judge.predict(prompts).withColumn("__first", own.parse(C("output"))).select("prompt", "__first")
    again = (retry or judge).predict(first.where(C("__first").isNull()).select("prompt")).withColumn("__second", own.parse(C("output"))).select("prompt", "__second")
    answers = first.join(again, "prompt", "left").withColumnRenamed("prompt", "__prompt")
    out = asked.join(answers, "__prompt", "left")
    label = F.when(C("__prompt").isNull(), False).otherwise(F.coalesce("__first", "__second"))
    return out.withColumns({"label": label, "retried": C("__prompt").isNotNull() & C("__first").isNull()}).drop("__prompt", "__first", "__second")


def retry_labels(rows: DataFrame, response: str, first: str, second: str) -> DataFrame:
    """label, retried and method from two rounds of judge outputs that are there already."""
    from lumenq.functions.text import judge_score

    empty = strip(F.coalesce(C(response), F.lit(""))) == ""
    one, two = judge_score(C(first)), judge_score(C(second))
    out = rows.withColumn("retried", ~empty & one.isNull()).withColumn("label", F.when(empty, False).otherwise(F.coalesce(one, two)))
    return out.withColumn("method", label_method("llm_judge"))


def label_method(method: str) -> Column:
    """The method, with _ambiguous where no label was reached, _retry where it took a second round."""
    retried = F.coalesce(C("retried"), F.lit(False))
    return F.when(C("label").isNull(), f"{method}_ambiguous").when(retried, f"{method}_retry").otherwise(method)


def label_records(records: DataFrame, dataset: str, judge: Judge | None = None, force: bool = False, method: str | None = None, key: str = "sample_id") -> DataFrame:
    """records with label and final(is_correct, correctness_method) set where they are selected and have none yet."""
    method = method or DATASET_SETTINGS[dataset].label_method
    chosen = select_to_label(records, "prompt_id" if "prompt_id" in records.columns else "qa_example_id", key)
    todo = chosen if force or "label" not in records.columns else chosen.where(C("label").isNull())
    found = label_samples(todo, dataset, judge, method)
    final = F.struct(C("label").alias("is_correct"), label_method(method).alias("correctness_method"))
    new = found.select(C(key).alias("__key"), C("label").alias("__label"), final.alias("__final"))
    joined = records.join(new, records[key] == new["__key"], "left")
    old_label = C("label") if "label" in records.columns else F.lit(None).cast("boolean")
    old_final = F.struct(F.col("final.is_correct").cast("boolean").alias("is_correct"), F.col("final.correctness_method").cast("string").alias("correctness_method")) if "final" in records.columns else F.lit(None).cast("struct<is_correct:boolean,correctness_method:string>")
    done = C("__key").isNotNull()
    return joined.withColumns({"label": F.when(done, C("__label")).otherwise(old_label), "final": F.when(done, C("__final")).otherwise(old_final)}).drop("__key", "__label", "__final")


def label_samples(samples: DataFrame, dataset: str, judge: Judge | None = None, method: str | None = None) -> DataFrame:
    """label and retried of all samples, without selection."""
    method = method or DATASET_SETTINGS[dataset].label_method
    if method == "exact_match":
        return exact_match(samples, adapter(dataset).parse).withColumn("retried", F.lit(False))
    if method != "llm_judge":
        raise ValueError(f"unknown label method {method}")
    if judge is None:
        raise ValueError("this method needs a judge")
    return judged(samples, dataset, judge)


def ambiguous_prompts(records: DataFrame, key: str = "prompt_id", order: str = "sample_id") -> DataFrame:
    """Distinct prompts whose record for labelling has no label."""
    return select_to_label(records, key, order).where(C("label").isNull()).select(key).distinct()


def without_ambiguous(rows: DataFrame, records: DataFrame, key: str = "prompt_id", order: str = "sample_id") -> DataFrame:
    return rows.join(ambiguous_prompts(records, key, order), key, "left_anti")


def label_accuracy(records: DataFrame, *keys: str) -> DataFrame:
    """n_correct, n_incorrect, n_ambiguous, and accuracy over those with a label."""
    right, wrong = F.count_if(C("label")), F.count_if(~C("label"))
    return records.groupBy(*keys).agg(right.alias("n_correct"), wrong.alias("n_incorrect"), F.count_if(C("label").isNull()).alias("n_ambiguous"), F.try_divide(right, right + wrong).alias("accuracy"))
