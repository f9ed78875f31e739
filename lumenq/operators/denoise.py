"""The array dataflow around a masked-diffusion model: schedules, guidance, noise, commitment and final log-probabilities."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenq.operators.resample import digest_number
from lumenq.operators.tokens import top_k
from lumenq.staging import discard, staged

C = F.col


def transfer_count(masked: Column, steps: Column, step: Column) -> Column:
    """How many of masked positions are committed at a step: the quotient, and one of the remainder's first steps."""
    return (F.floor(masked / steps) + (step < masked % steps).cast("int")).cast("int")


def transfer_schedule(samples: DataFrame, masked: str = "masked", steps: str = "steps") -> DataFrame:
    """A row for each step from 0 with transfer, the positions committed there."""
    each = samples.withColumn("step", F.explode(F.when(C(steps) > 0, F.sequence(F.lit(0), C(steps) - 1))))
    return each.withColumn("transfer", transfer_count(C(masked), C(steps), C("step")))


def block_schedule(length: int, block: int | None, steps: int) -> tuple[int, int]:
    """(blocks, steps a block); the block must divide the length, steps left over are dropped."""
    block = block or length
    if length % block:
        raise ValueError(f"a block of {block} does not divide {length}")
    blocks = length // block
    return blocks, steps // blocks


def block_counts(length: Column, block: Column, steps: Column) -> Column:
    """struct(blocks, steps a block) over a table of configurations, as block_schedule; null where the block does not divide the length."""
    size = F.coalesce(block, length)
    blocks = F.when(length % size == 0, F.floor(length / size))
    return F.when(blocks.isNotNull(), F.struct(blocks.cast("int").alias("blocks"), F.floor(steps / blocks).cast("int").alias("steps")))


def masked_sequences(prompts: DataFrame, length: int, mask_id: int, pad_id: int) -> DataFrame:
    """(sample_id, pos, token_id, is_prompt): prompts (sample_id, ids) padded on the left, then length masks."""
    longest = F.broadcast(prompts.agg(F.max(F.size("ids")).alias("__width")))  # one row
    padding = lambda n, x: F.when(n > 0, F.array_repeat(F.lit(x), n)).otherwise(F.array().cast("array<int>"))
    whole = F.concat(padding((C("__width") - F.size("ids")).cast("int"), pad_id), C("ids"), F.array_repeat(F.lit(mask_id), length))
    return prompts.crossJoin(longest).select("sample_id", F.posexplode(whole).alias("pos", "token_id"), (C("pos") < C("__width")).alias("is_prompt"))


def guided(conditional: Column, unconditional: Column, scale: float) -> Column:
    """Classifier-free guidance."""
    return unconditional + (scale + 1) * (conditional - unconditional) if scale > 0 else conditional


def noisy(logit: Column, u: Column, temperature: float) -> Column:
    """Gumbel noise from a uniform u in double precision; none at temperature 0."""
    if temperature == 0:
        return logit
    return F.try_divide(F.exp(logit.cast("double")), F.pow(-F.ln(u), F.lit(float(temperature))))


def suppressed(logits: DataFrame, ids: Sequence[int], value: str = "logit") -> DataFrame:
    """Logits with minus infinity at ids."""
    return logits.withColumn(value, F.when(C("token_id").isin(*ids), F.lit(float("-inf"))).otherwise(C(value))) if ids else logits


def chosen_tokens(logits: DataFrame, keys: Sequence[str] = ("sample_id", "pos"), score: str = "score") -> DataFrame:
    """The token with the highest score of each of keys, the smallest id of equals, with its softmax probability by logit."""
    w = [*keys]
    top = logits.groupBy(*w).agg(F.max_by(F.struct("token_id", "logit"), F.struct(score, -C("token_id"))).alias("best"), F.max("logit").alias("top"))
    mass = logits.join(top, w).groupBy(*w).agg(F.sum(F.exp(C("logit") - C("top"))).alias("mass"), F.first("best").alias("best"), F.first("top").alias("top"))
    return mass.select(*w, C("best.token_id").alias("token_id"), F.try_divide(F.exp(C("best.logit") - C("top")), C("mass")).alias("probability"))


def committed(candidates: DataFrame, counts: DataFrame, block_end: int | None = None) -> DataFrame:
    """The masked positions with the highest confidence of each sample, as many as counts (sample_id, transfer) says.

    Positions from block_end on are never taken; ties go to the earlier position.
    """
    rows = candidates.where("is_masked")
    if block_end is not None:
        rows = rows.where(C("pos") < block_end)
    w = Window.partitionBy("sample_id").orderBy(F.desc("confidence"), "pos")
    return rows.withColumn("__rank", F.row_number().over(w)).join(counts.select("sample_id", "transfer"), "sample_id").where("__rank <= transfer").drop("__rank", "transfer")


def log_softmax_top_k(logits: DataFrame, k: int, keys: Sequence[str] = ("sample_id", "pos")) -> DataFrame:
    """The k largest log-probabilities of each of keys with their rank from 0."""
    top = logits.groupBy(*keys).agg(F.max("logit").alias("__top"))
    mass = logits.join(top, list(keys)).groupBy(*keys).agg((F.max("__top") + F.ln(F.sum(F.exp(C("logit") - C("__top"))))).alias("__norm"))
    return top_k(logits, k, keys).join(mass, list(keys)).select(*keys, "rank", "token_id", (C("logit") - C("__norm")).alias("logprob"))


def uniform(seed: int, *keys: Column) -> Column:
    """A number strictly between 0 and 1 from a digest of seed and keys."""
    return (digest_number(F.lit(seed), *keys) + 1) / F.lit(4294967297.0)


def denoised(
    sequences: DataFrame,
    model: Callable[[DataFrame, DataFrame], DataFrame],
    mask_id: int,
    length: int,
    steps: int,
    block: int | None = None,
    temperature: float = 0.0,
    scale: float = 0.0,
    strategy: str = "low_confidence",
    eos: Sequence[int] = (),
    logits_eos_inf: bool = False,
    confidence_eos_inf: bool = False,
    seed: int = 42,
) -> DataFrame:
    """The denoising loop as joins: sequences (sample_id, pos, token_id, is_prompt) with their masks replaced.

    sequences: as masked_sequences gives them, all prompts of one width, then length masks. model(state, asked) gives
    logits (sample_id, pos, token_id, logit) for the positions asked, from a state like sequences: a model is whatever
    joins and functions make of them. A row is a position, and a step asks only for the masked positions up to the end of
    its block. Each step's state is written, and the one before removed, so that a step's plan does not grow and lost
    executors lose one step; a block ends when a count finds nothing masked in it. Noise and random confidence are digests
    of seed, block, step and place, so that they do not depend on the partitioning. The result is written.
    """
    if strategy not in ("low_confidence", "random"):
        raise ValueError(f"unknown strategy {strategy}")
    blocks, per_block = block_schedule(length, block, steps)
    size, place = length // blocks, ["sample_id", "pos"]
    state = staged(sequences.select(*place, "token_id", "is_prompt"), "denoising")
    start = state.where("is_prompt").agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
    for b in range(blocks):
        end = start + (b + 1) * size
        masked = state.where((C("token_id") == mask_id) & C("pos").between(end - size, end - 1)).groupBy("sample_id").agg(F.count("*").alias("masked"))
        waiting = staged(masked, "denoising-counts")
        for step in range(per_block):
            asked = state.where((C("token_id") == mask_id) & ~C("is_prompt") & (C("pos") < end)).select(*place)
            if asked.isEmpty():
                break
            logits = model(state, asked)
            if scale > 0:
                bare = model(state.withColumn("token_id", F.when(C("is_prompt"), F.lit(mask_id)).otherwise(C("token_id"))), asked)
                both = logits.join(bare.withColumnRenamed("logit", "bare"), [*place, "token_id"])
                logits = both.withColumn("logit", guided(C("logit"), C("bare"), scale)).drop("bare")
            logits = suppressed(logits, eos if logits_eos_inf else ())
            scored = logits.withColumn("score", noisy(C("logit"), uniform(seed, F.lit(b), F.lit(step), C("sample_id"), C("pos"), C("token_id")), temperature))
            chosen = chosen_tokens(suppressed(scored, eos if confidence_eos_inf and strategy == "low_confidence" else ()))
            sure = C("probability") if strategy == "low_confidence" else uniform(seed, F.lit(b), F.lit(step), C("sample_id"), C("pos"))
            counts = waiting.select("sample_id", transfer_count(C("masked"), F.lit(per_block), F.lit(step)).alias("transfer"))
            picked = committed(chosen.select(*place, C("token_id").alias("new"), sure.alias("confidence"), F.lit(True).alias("is_masked")), counts, end)
            after = staged(state.join(picked.select(*place, "new"), place, "left").select(*place, F.coalesce("new", "token_id").alias("token_id"), "is_prompt"), "denoising")
            discard(state)
            state = after
        discard(waiting)
    return state


def final_log_probabilities(state: DataFrame, model: Callable[[DataFrame, DataFrame], DataFrame], k: int = 64) -> DataFrame:
    """(sample_id, pos, rank, token_id, logprob) of the answer's positions, from a last look of the model at the whole state."""
    return log_softmax_top_k(model(state, state.where(~C("is_prompt")).select("sample_id", "pos")), k)


def generate(
    prompts: Sequence[Sequence[int]],
    model: Callable[[np.ndarray], np.ndarray],
    mask_id: int,
    pad_id: int = 0,
    length: int = 128,
    steps: int = 128,
    block: int | None = None,
    temperature: float = 0.0,
    scale: float = 0.0,
    strategy: str = "low_confidence",
    eos: Sequence[int] = (),
    logits_eos_inf: bool = False,
    confidence_eos_inf: bool = False,
    keep: int = 64,
    seed: int | Sequence[int] = 42,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, log-probabilities, ids) of a batch: the denoising loop around model(tokens) -> logits.

    The loop is sequential within a sample and free across samples, so a batch of samples is one call in a worker.
    """
    if strategy not in ("low_confidence", "random"):
        raise ValueError(f"unknown strategy {strategy}")
    blocks, per_block = block_schedule(length, block, steps)
    block = length // blocks
    rng = np.random.default_rng(seed)
    width = max(map(len, prompts))
    x = np.full((len(prompts), width + length), mask_id, np.int64)
    for row, p in zip(x, prompts, strict=True):
        row[:width] = [pad_id] * (width - len(p)) + list(p)
    asked = np.zeros_like(x, bool)
    asked[:, :width] = True
    for b in range(blocks):
        end = width + (b + 1) * block
        waiting = (x[:, end - block : end] == mask_id).sum(1)
        for step in range(per_block):
            masked = x == mask_id
            logits = np.asarray(model(x), float)
            if scale > 0:
                logits = logits + 0.0
                bare = np.asarray(model(np.where(asked, mask_id, x)), float)
                logits = bare + (scale + 1) * (logits - bare)
            own = [e for e in eos if 0 <= e < logits.shape[-1]]
            if logits_eos_inf:
                logits[..., own] = -np.inf
            noise = logits if temperature == 0 else np.exp(logits) / (-np.log(rng.random(logits.shape))) ** temperature
            new = noise.argmax(-1)
            if strategy == "random":
                sure = rng.random(new.shape)
            else:
                if confidence_eos_inf:
                    logits[..., own] = -np.inf
                e = np.exp(logits - logits.max(-1, keepdims=True))
                sure = np.take_along_axis(e / e.sum(-1, keepdims=True), new[..., None], -1)[..., 0]
            sure[:, end:] = -np.inf
            sure = np.where(masked, sure, -np.inf)
            for i in range(len(x)):
                take = waiting[i] // per_block + (step < waiting[i] % per_block)
                at = np.argsort(-sure[i], kind="stable")[:take]
                at = at[masked[i, at]]
                x[i, at] = new[i, at]
    final = np.asarray(model(x), float)[:, width:]
    top = final.max(-1, keepdims=True)
    lp = final - top - np.log(np.exp(final - top).sum(-1, keepdims=True))
    ids = np.argsort(-lp, axis=-1, kind="stable")[..., : min(keep, lp.shape[-1])]
    return x[:, width:], np.take_along_axis(lp, ids, -1).astype(np.float32), ids.astype(np.int32)


def generate_frame(prompts: DataFrame, load_model: Callable[[], Callable], batch: int = 8, **settings) -> DataFrame:
    """(sample_id, tokens, topk_logprobs, topk_token_ids) of prompts (sample_id, ids): batches of samples in workers.

    The noise of a batch is seeded by the seed and its first sample, so that batches do not share theirs.
    """
    import pandas as pd

    seed = settings.pop("seed", 42)

    def rows(frames):
        model = None
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                model = model or load_model()
                x, lp, ids = generate([list(p) for p in part["ids"]], model, seed=[seed, int(part["sample_id"].iloc[0])], **settings)
                yield pd.DataFrame({"sample_id": part["sample_id"].to_numpy(), "tokens": x.astype("int32").tolist(), "topk_logprobs": lp.tolist(), "topk_token_ids": ids.tolist()})

    return prompts.select("sample_id", "ids").mapInPandas(rows, "sample_id bigint, tokens array<int>, topk_logprobs array<array<float>>, topk_token_ids array<array<int>>")


def largest_batch(fits: Callable[[int], bool], most: int = 64, safety: float = 0.9, accelerated: bool = True) -> int:
    """The largest batch that fits by binary search, times safety, at least 1; most without an accelerator."""
    if not accelerated:
        return most
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if fits(middle) else (low, middle - 1)
    return max(1, math.floor(low * safety))


def eos_ids(*sources) -> list[int]:
    """The union of ids from tokenizer and model settings, sorted."""
    out: set[int] = set()
    for s in sources:
        if s is not None:
            out |= {int(i) for i in s} if isinstance(s, (list, tuple, set)) else {int(s)}
    return sorted(out)


def generation_modes(temperature: float, greedy: bool, samples: int, seed: int) -> list[tuple[str, float, int, int]]:
    """(mode, temperature, rows a prompt, seed): greedy alone at temperature 0, else sampled, after a greedy pass if asked."""
    if temperature <= 0:
        return [("greedy", 0.0, 1, seed)]
    sampled = ("sampled", temperature, samples, seed + 1 if greedy else seed)
    return [("greedy", 0.0, 1, seed), sampled] if greedy else [sampled]
