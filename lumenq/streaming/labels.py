"""Labels over a stream of answers: an extension of the batch operators, with watermarks and bounded state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenq.operators.labeling import label_samples

C = F.col


def answer_stream(spark, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def running_accuracy(answers: DataFrame, parse, *keys: str, time: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Accuracy of exact-match labels by event-time window and keys; rows later than the watermark are dropped."""
    from lumenq.operators.labeling import exact_match

    labelled = exact_match(answers, parse).withWatermark(time, late)
    return labelled.groupBy(F.window(time, window).alias("window"), *keys).agg(F.count_if("label").alias("n_correct"), F.count("*").alias("n"), F.avg(C("label").cast("double")).alias("accuracy"))


def label_stream(answers: DataFrame, dataset: str) -> DataFrame:
    """Labels of exact-match datasets, row by row; no state is kept."""
    return label_samples(answers, dataset, method="exact_match").drop("retried")


def windowed_counts(events: DataFrame, kind: Column, time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), kind.alias("kind")).agg(F.count("*").alias("n"))
