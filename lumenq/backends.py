"""External scorers behind narrow interfaces, with deterministic defaults that need no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORED = "premise string, hypothesis string, p_contradiction double, p_neutral double, p_entailment double, cls int"
ENTAILMENT = 2


class EntailmentScorer(Protocol):
    def score(self, pairs: DataFrame) -> DataFrame:
        """(premise, hypothesis) -> SCORED; classes are contradiction, neutral, entailment."""


class Judge(Protocol):
    def predict(self, prompts: DataFrame, prompt: str = "prompt", output: str = "output") -> DataFrame:
        """prompts with the judge's text in output."""


def words(x: Column) -> Column:
    """Distinct lower-case words of letters, digits and beyond ASCII."""
    return F.array_distinct(F.filter(F.split(F.lower(x), r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"), lambda w: w != ""))


class JaccardScorer:
    """Entailment as the share of common words, in SQL functions alone; what is left is neutral."""

    def score(self, pairs: DataFrame) -> DataFrame:
        a, b = words(F.col("premise")), words(F.col("hypothesis"))
        shared = F.size(F.array_intersect(a, b))
        p = F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.try_divide(shared, F.size(F.array_union(a, b))))
        return pairs.select("premise", "hypothesis", p.alias("p")).select(
            "premise", "hypothesis", F.lit(0.0).alias("p_contradiction"), (1 - F.col("p")).alias("p_neutral"), F.col("p").alias("p_entailment"), F.when(F.col("p") >= 0.5, ENTAILMENT).otherwise(1).alias("cls")
        )


class ModelScorer:
    """A scorer around load() -> f(premises, hypotheses) -> rows of three probabilities; loaded once a worker task."""

    def __init__(self, load: Callable[[], Callable[[Sequence[str], Sequence[str]], Sequence[Sequence[float]]]], batch_size: int = 64):
        self.load, self.batch_size = load, batch_size

    def score(self, pairs: DataFrame) -> DataFrame:
        load, size = self.load, self.batch_size

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                for start in range(0, len(batch), size):
                    part = batch.iloc[start : start + size].reset_index(drop=True)
                    p = pd.DataFrame(list(model(part.premise.tolist(), part.hypothesis.tolist())), columns=["p_contradiction", "p_neutral", "p_entailment"], dtype="float64")
                    yield pd.concat([part, p.assign(cls=p.to_numpy().argmax(1).astype("int32"))], axis=1)

        return pairs.select("premise", "hypothesis").mapInPandas(rows, SCORED)


class ScriptedJudge:
    """A judge whose text is a column expression of the prompt."""

    def __init__(self, expression: Callable[[Column], Column]):
        self.expression = expression

    def predict(self, prompts: DataFrame, prompt: str = "prompt", output: str = "output") -> DataFrame:
        return prompts.withColumn(output, self.expression(F.col(prompt)))


class ModelJudge:
    """A judge around load() -> f(prompts) -> texts; loaded once a worker task, and only if there are rows."""

    def __init__(self, load: Callable[[], Callable[[Sequence[str]], Sequence[str]]]):
        self.load = load

    def predict(self, prompts: DataFrame, prompt: str = "prompt", output: str = "output") -> DataFrame:
        load, made = self.load, T.StructType([*prompts.schema.fields, T.StructField(output, T.StringType())])

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = None
            for batch in batches:
                if len(batch):
                    model = model or load()
                    yield batch.assign(**{output: list(model(batch[prompt].tolist()))})

        return prompts.mapInPandas(rows, made)


class TemplateChat:
    """A chat template as a format string with {prompt}."""

    def __init__(self, template: str = "{prompt}"):
        self.before, _, self.after = template.partition("{prompt}")

    def apply(self, prompt: Column) -> Column:
        return F.concat(F.lit(self.before), prompt, F.lit(self.after))
