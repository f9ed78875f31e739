"""Answers from prompts by a pluggable denoising model: greedy and sampled passes, interleaved by question."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenq.config import DEFAULT_MASK_ID, KNOWN_EOS_IDS, resolve_remasking, special_ids
from lumenq.operators import denoise, prompts
from lumenq.staging import staged

C = F.col


class Backend(Protocol):
    """What a model has to offer; load() runs once in each worker task."""

    mask_id: int
    pad_id: int
    eos: Sequence[int]

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: Sequence[int]) -> str: ...

    def load(self) -> Callable: ...


def load_backend(name: str) -> Backend:
    """An object by module:attribute; a class or function is called."""
    module, _, attribute = name.partition(":")
    found = getattr(importlib.import_module(module), attribute)
    return found() if callable(found) else found


def resolved_ids(backend: Backend, config: dict) -> dict:
    """mask_id, pad_token_id and eos_token_ids: a configuration's before the model's, before the known defaults; padding falls back to the first end of text."""
    mask = next((x for x in (config.get("mask_id"), getattr(backend, "mask_id", None)) if x is not None), DEFAULT_MASK_ID)
    eos = special_ids(config)[0] or [int(i) for i in getattr(backend, "eos", None) or ()] or list(KNOWN_EOS_IDS)
    pad = next((x for x in (config.get("pad_token_id"), getattr(backend, "pad_id", None)) if x is not None), eos[0])
    return {"mask_id": int(mask), "pad_token_id": int(pad), "eos_token_ids": eos}


def generate_answers(asked: DataFrame, backend: Backend, config: dict) -> tuple[DataFrame, DataFrame]:
    """(answers, tensors in long form) of prompts (prompt_id from 0, prompt_text).

    Greedy alone at temperature 0; else a greedy pass, if asked for, and then sampled ones with the next seed. Sample
    ids run through the questions, the greedy answer of each first.
    """
    samples = int(config.get("num_response_samples") or 1)
    modes = denoise.generation_modes(float(config.get("temperature") or 0), bool(config.get("generate_greedy", True)), samples, int(config.get("seed") or 0))
    per_prompt = sum(n for _, _, n, _ in modes)

    def encoded(batches):
        for b in batches:
            yield pd.DataFrame({"sample_id": b["sample_id"], "ids": [backend.encode(t) for t in b["prompt_text"]]})

    def decoded(batches):
        for b in batches:
            yield pd.DataFrame({"sample_id": b["sample_id"], "raw_answer": [backend.decode(list(t)).strip() for t in b["tokens"]], "topk_logprobs": b["topk_logprobs"], "topk_token_ids": b["topk_token_ids"]})

    special = resolved_ids(backend, config)
    made, first = None, 0
    for mode, temperature, n, seed in modes:
        rows = asked.withColumn("__k", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1)))).withColumn("sample_id", (C("prompt_id") * per_prompt + C("__k")).cast("bigint"))
        ids = rows.select("sample_id", "prompt_text").mapInPandas(encoded, "sample_id bigint, ids array<int>")
        out = denoise.generate_frame(
            ids, backend.load, int(config.get("batch_size") or 8), mask_id=special["mask_id"], pad_id=special["pad_token_id"], length=int(config["max_gen_length"]), steps=int(config["steps"]), block=config.get("block_size"), temperature=temperature,
            scale=float(config.get("cfg_scale") or 0), strategy=resolve_remasking(config.get("remasking", "lc")), eos=special["eos_token_ids"], logits_eos_inf=bool(config.get("logits_eos_inf")),
            confidence_eos_inf=bool(config.get("confidence_eos_eot_inf")), keep=int(config.get("top_k") or 64), seed=seed,
        )
        part = out.mapInPandas(decoded, "sample_id bigint, raw_answer string, topk_logprobs array<array<float>>, topk_token_ids array<array<int>>").withColumn("generation_mode", F.lit(mode))
        made = part if made is None else made.unionByName(part)
        first += n
    made = staged(made, "generated")
    tensors = made.select("sample_id", F.posexplode(F.arrays_zip("topk_logprobs", "topk_token_ids")).alias("pos", "row")).select("sample_id", "pos", F.posexplode(F.arrays_zip("row.topk_logprobs", "row.topk_token_ids")).alias("rank", "cell"))
    tensors = tensors.select(C("sample_id").cast("int").alias("sample_id"), "pos", "rank", C("cell.topk_token_ids").alias("token_id"), C("cell.topk_logprobs").alias("logprob"))
    whose = made.drop("topk_logprobs", "topk_token_ids").withColumn("prompt_id", F.floor(C("sample_id") / per_prompt))
    answers = asked.join(whose, "prompt_id").withColumns({"response_sample_id": (C("sample_id") % per_prompt).cast("int"), "num_response_samples": F.lit(per_prompt), "qa_index": C("prompt_id").cast("int"), "label": F.lit(None).cast("boolean")})
    named = prompts.expand_samples(asked, 0).select("prompt_id", "qa_example_id")
    return answers.join(named, "prompt_id").withColumn("sample_id", C("sample_id").cast("int")), tensors
