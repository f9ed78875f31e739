"""Token-level uncertainty from log-probabilities in long form.

A token table has keys (prompt_id, sample_id), pos, token_id and lp; positions are real columns, never file order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenq.functions.arrays import finite, safe_exp, softmax_entropy


def visible_positions(ids: Column, special: Sequence[int] | Column, eos: Sequence[int] | Column) -> Column:
    """Positions of an id array before its first end token, without special and null ids."""
    as_array = lambda x: x if isinstance(x, Column) else F.array(*[F.lit(i) for i in x]).cast("array<int>")
    special, eos = as_array(special), as_array(eos)
    n = F.size(ids)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    token = lambda i: F.get(ids, i)
    end = F.coalesce(F.array_min(F.filter(places, lambda i: F.array_contains(eos, token(i)))), n)
    return F.filter(places, lambda i: (i < end) & token(i).isNotNull() & ~F.coalesce(F.array_contains(special, token(i)), F.lit(False)))


def visible_tokens(tokens: DataFrame, is_end: Column, is_special: Column, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Rows before the first end token of their sample that are not special.

    The first end is a minimum with map-side combination, not a running window, so a sample is never sorted.
    """
    keys = list(keys)
    ends = tokens.groupBy(*keys).agg(F.min(F.when(is_end, F.col("pos"))).alias("__end"))
    return tokens.join(ends, keys).where((F.col("__end").isNull() | (F.col("pos") < F.col("__end"))) & ~is_special).drop("__end")


def msp(tokens: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """exp of the sum of finite log-probabilities: the probability of the sequence; null without any."""
    return tokens.groupBy(*keys).agg(safe_exp(F.sum(finite(F.col("lp").cast("double")))).alias("msp"))


def perplexity(tokens: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """exp of minus the mean finite log-probability; null without any."""
    return tokens.groupBy(*keys).agg(safe_exp(-F.avg(finite(F.col("lp").cast("double")))).alias("perplexity"))


def mean_token_entropy(tokens: DataFrame, keys: Sequence[str] = ("sample_id",), top: str = "top_lp") -> DataFrame:
    """Mean over positions of the entropy of the renormalised top log-probabilities; null arrays are left out."""
    return tokens.groupBy(*keys).agg(F.avg(softmax_entropy(F.col(top))).alias("mte"))


def negative_log_likelihood(tokens: DataFrame, prompt: Sequence[str] = ("prompt_id",), sample: str = "sample_id") -> DataFrame:
    """mcnse: mean over samples of the mean -lp; samples without finite values are left out."""
    lp = finite(F.col("lp").cast("double"))
    each = tokens.groupBy(*prompt, sample).agg(F.avg(-lp).alias("__mean")).where("__mean is not null")
    return each.groupBy(*prompt).agg(F.avg("__mean").alias("mcnse"))


def token_features(tokens: DataFrame, keys: Sequence[str] = ("sample_id",), top: str | None = "top_lp") -> DataFrame:
    """msp, perplexity, mte and n_visible_tokens of each of keys, in one aggregation."""
    lp = finite(F.col("lp").cast("double"))
    entropy = F.avg(softmax_entropy(F.col(top))) if top else F.lit(None).cast("double")
    return tokens.groupBy(*keys).agg(safe_exp(F.sum(lp)).alias("msp"), safe_exp(-F.avg(lp)).alias("perplexity"), entropy.alias("mte"), F.count("*").cast("int").alias("n_visible_tokens"))


def tokens_of_array(samples: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """An array of log-probabilities as (keys, pos, lp)."""
    return samples.select(*keys, F.posexplode(column).alias("pos", "lp"))


def last_pass(tensor: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """(keys, pos, token_id, lp, top_lp) from (keys, pos, rank, token_id, logprob): the first rank, and all ranks in order."""
    first = F.col("rank") == 0
    order = F.array_sort(F.collect_list(F.struct("rank", "logprob")))
    return tensor.groupBy(*keys, "pos").agg(F.max(F.when(first, F.col("token_id"))).alias("token_id"), F.max(F.when(first, F.col("logprob"))).alias("lp"), F.transform(order, lambda r: r["logprob"]).alias("top_lp"))


def top_k(logits: DataFrame, k: int, keys: Sequence[str] = ("sample_id", "pos"), value: str = "logit") -> DataFrame:
    """The k largest values of each of keys with their rank from 0; ties by token_id."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), F.asc("token_id"))
    return logits.withColumn("rank", (F.row_number().over(w) - 1).cast("int")).where(F.col("rank") < k)
