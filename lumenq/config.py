"""Canonical names, dataset settings and run configuration."""

from __future__ import annotations

import json
import os
import random
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.sources import places

# Names, ids and settings that make a run comparable with others of its kind.
MODEL_IDS = {"LLaDA": "GSAI-ML/LLaDA-8B-Instruct", "LLaDA1.5": "GSAI-ML/LLaDA-1.5"}
DATASETS = ("triviaqa", "gsm8k", "wmt14_fr_en", "xsum", "samsum", "hotpotqa", "musique")
STRATEGIES = {"lc": "low_confidence", "rd": "random"}
KNOWN_EOS_IDS = (126081, 126348)
DEFAULT_MASK_ID = 126336
GENERATION_DEFAULTS = {
    "model_id": "GSAI-ML/LLaDA-8B-Instruct",
    "seed": 42,
    "steps": 128,
    "max_gen_length": 128,
    "block_size": None,
    "temperature": 0.0,
    "cfg_scale": 0.0,
    "remasking": "lc",
    "batch_size": 8,
    "top_k": 64,
    "num_response_samples": 20,
    "generate_greedy": True,
    "num_questions": 1000,
    "fewshot_k": 0,
    "logits_eos_inf": False,
    "confidence_eos_eot_inf": False,
}


@dataclass(frozen=True)
class DatasetSettings:
    source: str
    variant: str | None
    split: str
    label_method: str
    label_on: str
    batch_size: int
    max_gen_length: int
    steps: int
    block_size: int | None = 32
    fewshot_k: int = 0
    local: bool = False


# One line for each dataset.
DATASET_SETTINGS = {
    "gsm8k": DatasetSettings("openai/gsm8k", "main", "test", "exact_match", "cpu", 16, 256, 256),
    "triviaqa": DatasetSettings("mandarjoshi/trivia_qa", "rc", "validation", "llm_judge", "gpu", 32, 32, 32),
    "wmt14_fr_en": DatasetSettings("wmt/wmt14", "fr-en", "test", "llm_judge", "gpu", 16, 128, 128),
    "xsum": DatasetSettings("EdinburghNLP/xsum", None, "test", "llm_judge", "gpu", 16, 128, 128),
    "samsum": DatasetSettings("knkarthick/samsum", None, "test", "llm_judge", "gpu", 16, 128, 128),
    "hotpotqa": DatasetSettings("hotpotqa/hotpot_qa", "fullwiki", "validation", "llm_judge", "gpu", 16, 64, 64),
    "musique": DatasetSettings("musique_data_v1.0/data/musique_full_v1.0_dev.jsonl", None, "train", "llm_judge", "gpu", 16, 64, 64, local=True),
}

UNSET = object()


def run_id(model: str, dataset: str, length: int, steps: int, remasking: str, block_size: int | None = None, temperature: float | None = None, fewshot_k: int | None = None) -> str:
    """The name of a run's folder."""
    parts = [model, dataset, f"l{length}", f"s{steps}", remasking]
    if block_size is not None:
        parts.append(f"b{block_size}")
    if temperature is not None:
        parts.append("t" + str(temperature).translate(str.maketrans({"+": "", "-": "m", ".": "p"})))
    if fewshot_k:
        parts.append(f"fs{fewshot_k}")
    return "_".join(parts)


def config_filename(model: str, dataset: str, length: int, steps: int, remasking: str, block_size: int | None = None, fewshot_k: int | None = None, confidence_eos_eot_inf: bool = False) -> str:
    return run_id(model, dataset, length, steps, remasking, block_size, None, fewshot_k) + "_ceot" * bool(confidence_eos_eot_inf) + ".json"


def derive_run_id(config: dict) -> str:
    """The run id of a configuration; "default" where a name is unknown."""
    model = {v: k for k, v in MODEL_IDS.items()}.get(config.get("model_id", ""))
    if model is None or config.get("dataset") not in DATASETS or config.get("remasking") not in STRATEGIES:
        return "default"
    block = config.get("block_size")
    return run_id(model, config["dataset"], int(config["max_gen_length"]), int(config["steps"]), config["remasking"], None if block is None else int(block), None, int(config.get("fewshot_k") or 0))


def run_id_column(columns: dict[str, Column] | None = None) -> Column:
    """run_id over a table of configurations with the columns model, dataset, max_gen_length, steps, remasking, block_size, temperature, fewshot_k."""
    c = {k: F.col(k) for k in ("model", "dataset", "max_gen_length", "steps", "remasking", "block_size", "temperature", "fewshot_k")} | (columns or {})
    text = lambda x: c[x].cast("string")
    return F.concat_ws(
        "_", c["model"], c["dataset"], F.concat(F.lit("l"), text("max_gen_length")), F.concat(F.lit("s"), text("steps")), c["remasking"], F.concat(F.lit("b"), text("block_size")),
        F.concat(F.lit("t"), F.translate(text("temperature"), ".-+", "pm")), F.when(c["fewshot_k"] > 0, F.concat(F.lit("fs"), text("fewshot_k"))),
    )


def generation_config(model: str, dataset: str, max_gen_length: int | None = None, steps: int | None = None, remasking: str = "lc", block_size=UNSET, **given) -> dict:
    """Given values over the dataset's settings over the defaults; block_size=None asks for no blocks."""
    own = DATASET_SETTINGS[dataset]
    config = {
        "model_family": "DLM",
        "model_id": MODEL_IDS[model],
        "dataset": dataset,
        "dataset_config_name": own.variant,
        "split": own.split,
        "label_method": own.label_method,
        "batch_size": own.batch_size,
        "num_questions": 1000,
        "max_gen_length": own.max_gen_length if max_gen_length is None else max_gen_length,
        "steps": own.steps if steps is None else steps,
        "block_size": own.block_size if block_size is UNSET else block_size,
        "remasking": remasking,
        "temperature": 1.0,
        "cfg_scale": 0.0,
        "num_response_samples": 20,
        "generate_greedy": True,
        "top_k": 64,
        "fewshot_k": own.fewshot_k,
        "confidence_eos_eot_inf": False,
    }
    return config | {k: v for k, v in given.items() if not (k == "fewshot_k" and v is None)}


def resolve_config(given: dict, config: dict | None = None) -> dict:
    """Precedence of a command line over a configuration over the defaults; None means not given."""
    return GENERATION_DEFAULTS | (config or {}) | {k: v for k, v in given.items() if v is not None}


def resolve_remasking(name: str) -> str:
    return STRATEGIES.get(name, name)


def config_grid(spark: SparkSession, models=tuple(MODEL_IDS), datasets=DATASETS, strategies=tuple(STRATEGIES), existing: DataFrame | None = None) -> DataFrame:
    """Model x dataset x strategy with each dataset's settings and the run id; rows of existing run ids are left out."""
    rows = [(m, MODEL_IDS[m], d, s, *(getattr(DATASET_SETTINGS[d], f) for f in ("max_gen_length", "steps", "block_size", "label_method"))) for m, d, s in product(models, datasets, strategies)]
    grid = spark.createDataFrame(rows, "model string, model_id string, dataset string, remasking string, max_gen_length int, steps int, block_size int, label_method string")
    grid = grid.withColumn("run_id", run_id_column({"temperature": F.lit(None), "fewshot_k": F.lit(None).cast("int")}))
    return grid if existing is None else grid.join(existing.select("run_id"), "run_id", "left_anti").select(grid.columns)


def load_config(path: str) -> dict:
    return json.loads(places.read_text(path))


def save_config(config: dict, path: str) -> None:
    places.write_text(path, json.dumps(config, indent=2) + "\n")


def special_ids(config: dict) -> tuple[list[int], list[int]]:
    """(eos, special) token ids: eos gathers all ends of text and turn; special adds mask and pad."""

    def gather(x) -> set[int]:
        if x is None:
            return set()
        return set().union(*map(gather, x)) if isinstance(x, (list, tuple, set)) else {int(x)}

    eos = gather([config.get(k) for k in ("eos_token_ids", "eos_token_id", "eot_token_id", "eos_eot_token_ids")])
    return sorted(eos), sorted(eos | gather([config.get(k) for k in ("mask_id", "pad_token_id")]))


def special_ids_columns(eos: Sequence[Column], other: Sequence[Column] = ()) -> Column:
    """struct(eos, special) over a table of configurations, as special_ids: array columns of ids, null where one gives none."""
    none = F.array().cast("array<bigint>")
    union = lambda ids: F.array_sort(F.array_distinct(F.filter(F.concat(none, *(F.coalesce(i.cast("array<bigint>"), none) for i in ids)), lambda i: i.isNotNull())))
    return F.struct(union(eos).alias("eos"), union([*eos, *other]).alias("special"))


def resolved_columns(given: dict[str, Column], config: dict[str, Column] | None = None) -> dict[str, Column]:
    """resolve_config over a table: each setting's first value that is not null, of what is given, the configuration's and the default."""
    config = config or {}
    return {k: F.coalesce(*(c[k] for c in (given, config) if k in c), F.lit(GENERATION_DEFAULTS.get(k))) for k in {**GENERATION_DEFAULTS, **config, **given}}


def remasking_name(name: Column) -> Column:
    """A strategy's full name; an unknown one as it is."""
    found = name
    for short, full in STRATEGIES.items():
        found = F.when(name == short, F.lit(full)).otherwise(found)
    return found


def configured(asked: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """asked (model, dataset, remasking, and settings of its own that may be null) with all settings and the run id.

    Own settings go before the data set's, as in generation_config; unknown models and data sets have no row. Rows whose run
    id is among existing's are left out. The settings are a row for each known data set and are broadcast.
    """
    fields = ("max_gen_length", "steps", "block_size", "label_method", "batch_size", "fewshot_k")
    rows = [(d, *(getattr(own, f) for f in fields)) for d, own in DATASET_SETTINGS.items()]
    known = asked.sparkSession.createDataFrame(rows, "dataset string, __max_gen_length int, __steps int, __block_size int, __label_method string, __batch_size int, __fewshot_k int")
    model_id = F.create_map(*(F.lit(x) for pair in MODEL_IDS.items() for x in pair))[F.col("model")]
    out = asked.join(F.broadcast(known), "dataset").withColumns({"model_id": model_id, **{f: F.coalesce(F.col(f), F.col(f"__{f}")) if f in asked.columns else F.col(f"__{f}") for f in fields}})
    out = out.where("model_id is not null").drop(*(f"__{f}" for f in fields))
    out = out.withColumn("run_id", run_id_column({"temperature": F.lit(None)}))
    return out if existing is None else out.join(existing.select("run_id"), "run_id", "left_anti").select(out.columns)


def seed_everything(seed: int) -> None:
    random.seed(seed)
    np.random.seed(seed % (1 << 32))
    os.environ["PYTHONHASHSEED"] = str(seed)


def settings_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([{"dataset": k, **asdict(v)} for k, v in DATASET_SETTINGS.items()], "dataset string, source string, variant string, split string, label_method string, label_on string, batch_size int, max_gen_length int, steps int, block_size int, fewshot_k int, local boolean")
