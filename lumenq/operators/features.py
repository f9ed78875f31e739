"""Feature names and their directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names and orientation of the features.
BASE = ("msp", "perplexity", "mte")
SEMANTIC = ("se-marginal", "se-conditional", "ecc", "eigval", "kle-heat", "kle-matern")
SAMPLING = ("mcnse", *SEMANTIC)
SCOPES = ("full", "selected", "random")
CONFIDENCE = ("msp", "se-conditional", "ecc")
GROUPS = {
    "Token UQ": BASE,
    "IID Sample UQ": SAMPLING,
    "Full Trajectory UQ": tuple(f"full-{f}" for f in SEMANTIC),
    "Selected Step UQ": tuple(f"selected-{f}" for f in SEMANTIC),
    "Random Scope UQ": tuple(f"random-{f}" for f in SEMANTIC),
    "Trajectory AD": ("full-ad", "weighted-ad"),
}


def all_feature_names() -> list[str]:
    return [*BASE, *SAMPLING, *(f"{s}-{f}" for s in SCOPES for f in SEMANTIC), "ad", "full-ad", "weighted-ad"]


def base_feature(name: Column) -> Column:
    """A feature's name without its scope."""
    return F.regexp_replace(name, r"^(?:full|selected|random(?:-[0-9]+)?)-", "")


def orientation(name: Column) -> Column:
    """-1 for features that speak for confidence, 1 for those that speak for uncertainty, and for unknown ones."""
    return F.when(base_feature(name).isin(*CONFIDENCE), -1.0).otherwise(1.0)


def oriented(scores: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Scores that grow with uncertainty."""
    return scores.withColumn(value, F.col(value) * orientation(F.col(feature)))


def directions(spark: SparkSession) -> DataFrame:
    """(feature, direction) of all features."""
    names = spark.createDataFrame([(f,) for f in all_feature_names()], "feature string")
    return names.withColumn("direction", F.when(orientation(F.col("feature")) < 0, "confidence").otherwise("uncertainty"))


def family(name: Column) -> Column:
    """Cost family of a feature."""
    return (
        F.when(name.startswith("selected-") | (name == "weighted-ad"), "selected").when(name.startswith("full-"), "full").when(name.startswith("random-"), "random").when(name.isin(*BASE), "token").otherwise("iid")
    )


def group(name: Column) -> Column:
    """Report group of a feature."""
    found = F.lit(None).cast("string")
    for title, names in GROUPS.items():
        found = F.when(name.isin(*names), F.lit(title)).otherwise(found)
    return F.coalesce(found, F.when(name.rlike("^(selected|full|random)-"), "trajectory").when(name.startswith("kle-"), "sampling").otherwise("other"))


def selection_name(name: Column) -> Column:
    """A feature's name in a report of selected steps."""
    return F.when(name == "ad", "weighted-ad").otherwise(F.concat(F.lit("selected-"), name))
