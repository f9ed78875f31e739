"""Commands over files: gen-configs, build-prompts, prepare-prompts, generate, label, label-all, features, baseline, evaluate, split, kfold, pipeline, export and report.

Models are given as module:attribute: a backend that generates, a judge (lumenq.backends.Judge) and an entailment scorer
(lumenq.backends.EntailmentScorer); without a scorer, words in common stand in for entailment.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from lumenq import config
from lumenq.operators import labeling, prompts, report, resample, sheets
from lumenq.operators.pair_cache import PairCache
from lumenq.plans import generate, pipeline
from lumenq.session import build_session
from lumenq.sources import files, places, schemas, sinks
from lumenq.sources.tensors import read_tensors


#: Stages of the pipeline command in their order.
STAGES = ("prompts", "generate", "label", "features", "baseline", "split", "kfold", "evaluate", "report")


def beside(path: str, name: str = "") -> str:
    """A name in the folder that holds path."""
    folder = path.rstrip("/").rpartition("/")[0] or "."
    return f"{folder}/{name}" if name else folder


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lumenq")
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, *given: [c := sub.add_parser(name), *[c.add_argument(*a, **k) for a, k in given]]
    arg = lambda *a, **k: (a, k)
    add("gen-configs", arg("output"), arg("--datasets", nargs="*", default=list(config.DATASETS)), arg("--models", nargs="*", default=list(config.MODEL_IDS)))
    add("build-prompts", arg("dataset"), arg("source"), arg("output"), arg("--fewshot", type=int, default=0), arg("--questions", type=int, default=1000))
    add("generate", arg("prompts"), arg("output"), arg("--config", required=True), arg("--backend", required=True, help="module:attribute of a model backend"))
    add("prepare-prompts", arg("configs", nargs="+"), arg("--sources", required=True, help="folder that holds the data sets"), arg("--output-dir", default="outputs"))
    judge, scorer = arg("--judge", help="module:attribute of a judge"), arg("--scorer", help="module:attribute of an entailment scorer")
    add("label", arg("answers"), arg("dataset"), judge, arg("--force", action="store_true"))
    add("label-all", arg("folder"), judge, arg("--exclude", nargs="*", default=()), arg("--force", action="store_true"))
    add("pipeline", arg("run"), arg("--stages", nargs="*", choices=STAGES, default=["label", "features", "evaluate"]), arg("--source", help="raw data of the prompts stage"), arg("--backend"), judge, scorer, arg("--trajectories"), arg("--bootstrap", type=int, default=1000), arg("--counts", type=int, nargs=3, default=(10, 30, 40)), arg("--k", type=int, default=5), arg("--train", type=int, default=10), arg("--seed", type=int, default=42))
    add("features", arg("answers"), arg("output"), arg("--tensors"), scorer, arg("--config", help="folder of config.json with the token ids; the answers' own if not given"), arg("--compat", action="store_true"))
    add("baseline", arg("features"), arg("trajectories"), arg("output"), scorer, arg("--pair-cache", help="folder of pairs scored in earlier runs; the scorer's name is its version"), arg("--answers", help="answers whose ambiguous prompts are left out of the order"), arg("--full", action="store_true"), arg("--seed", type=int, default=42))
    add("weights", arg("features"), arg("trajectories"), arg("output"), scorer, arg("--ridge", type=float, default=0.1), arg("--weights", help="file of the weights and their certificate"))
    add("evaluate", arg("features"), arg("output"), arg("--bootstrap", type=int, default=1000), arg("--seed", type=int, default=0))
    add("split", arg("features"), arg("output"), arg("--counts", type=int, nargs=3, default=(10, 30, 40)), arg("--seed", type=int, default=42))
    add("kfold", arg("features"), arg("output"), arg("--k", type=int, default=5), arg("--train", type=int, default=10), arg("--seed", type=int, default=42))
    add("export", arg("roots", nargs="+"), arg("--output", default="outputs/report"), arg("--metric", default="auroc"), arg("--latency"))
    add("report", arg("roots", nargs="+"), arg("--output", default="outputs/report"), arg("--metric", default="prr"), arg("--latency"))
    return top


def loaded(name: str | None):
    """A model by module:attribute; None without a name."""
    return generate.load_backend(name) if name else None


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = build_session()
    if a.command == "gen-configs":
        for model in a.models:
            for dataset in a.datasets:
                for strategy in config.STRATEGIES:
                    own = config.generation_config(model, dataset, remasking=strategy)
                    config.save_config(own, f"{a.output}/" + config.config_filename(model, dataset, own["max_gen_length"], own["steps"], strategy, own["block_size"]))
    elif a.command == "build-prompts":
        raw = files.load_local_dataset(spark, a.source, "jsonl", schemas.RAW[a.dataset]).withColumn("ord", F.monotonically_increasing_id())
        sinks.write_prompts(prompts.build_prompts(raw, a.dataset, a.fewshot, a.questions), a.output, "overwrite", text=True)
    elif a.command == "prepare-prompts":
        for path in a.configs:
            own = config.load_config(path)
            target = f"{a.output_dir}/{own.get('run_id') or config.derive_run_id(own)}/prompts.jsonl"
            if places.exists(target):
                print(f"{target}: is there")
                continue
            try:
                known = config.DATASET_SETTINGS[own["dataset"]]
                source = f"{a.sources}/{known.source}"
                raw = files.load_local_dataset(spark, source, "jsonl", schemas.RAW[own["dataset"]]) if known.local else files.load_dataset(spark, source, own.get("split") or known.split, known.variant, schemas.RAW[own["dataset"]])
                made = prompts.build_prompts(raw.withColumn("ord", F.monotonically_increasing_id()), own["dataset"], int(own.get("fewshot_k") or 0), int(own.get("num_questions") or 1000))
                sinks.write_prompts(made, target, "overwrite")
                print(f"{target}: written")
            except Exception as e:  # one configuration that fails does not keep the others from theirs
                print(f"{path}: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
    elif a.command == "generate":
        own = config.load_config(a.config)
        config.seed_everything(int(own.get("seed") or 0))
        backend = generate.load_backend(a.backend)
        answers, tensors = generate.generate_answers(files.read_jsonl(spark, a.prompts, schemas.PROMPTS), backend, own)
        sinks.save_results(answers, tensors, own | {"run_id": config.derive_run_id(own)} | generate.resolved_ids(backend, own), {"backend": a.backend}, a.output, "overwrite")
    elif a.command == "label":
        records = files.read_answers(spark, a.answers)
        labelled = labeling.label_records(records, a.dataset, loaded(a.judge), force=a.force)
        sinks.replace_records(labelled, a.answers)
        print(labeling.label_accuracy(files.read_answers(spark, a.answers)).first())
    elif a.command == "label-all":
        for run in files.discover_runs(a.folder, exclude=a.exclude):
            dataset = files.run_config(run)["dataset"]
            if a.judge or config.DATASET_SETTINGS[dataset].label_method == "exact_match":
                main(["label", f"{run}/answers.jsonl", dataset, *(["--judge", a.judge] if a.judge else []), *["--force"] * a.force])
            else:
                print(f"{run}: needs a judge")
    elif a.command == "pipeline":
        own = files.run_config(a.run) if places.exists(f"{a.run}/config.json") else {}
        config.seed_everything(a.seed)
        dataset, features, base = own.get("dataset", "gsm8k"), f"{a.run}/uq_features.jsonl", f"{a.run}/baseline_features.jsonl"
        model = lambda name, value: [f"--{name}", value] if value else []
        for stage in a.stages:
            tensors = f"{a.run}/topk_logprobs.parquet" if places.exists(f"{a.run}/topk_logprobs.parquet") else a.run if files.find_files([a.run], "topk_logprobs.npz") else None
            final = base if places.exists(base) else features
            main({
                "prompts": ["build-prompts", dataset, str(a.source), f"{a.run}/prompts.jsonl", "--fewshot", str(own.get("fewshot_k") or 0), "--questions", str(own.get("num_questions") or 1000)],
                "generate": ["generate", f"{a.run}/prompts.jsonl", a.run, "--config", f"{a.run}/config.json", "--backend", str(a.backend)],
                "label": ["label", f"{a.run}/answers.jsonl", dataset, *model("judge", a.judge)],
                "features": ["features", f"{a.run}/answers.jsonl", features, *model("tensors", tensors), *model("scorer", a.scorer)],
                "baseline": ["baseline", features, str(a.trajectories or f"{a.run}/trajectories.jsonl"), base, "--answers", f"{a.run}/answers.jsonl", "--seed", str(a.seed), *model("scorer", a.scorer)],
                "split": ["split", final, f"{a.run}/splits.json", "--counts", *map(str, a.counts), "--seed", str(a.seed)],
                "kfold": ["kfold", final, f"{a.run}/kfold/kfold_summary.json", "--k", str(a.k), "--train", str(a.train), "--seed", str(a.seed)],
                "evaluate": ["evaluate", final, a.run, "--bootstrap", str(a.bootstrap)],
                "report": ["report", a.run, "--output", f"{a.run}/report"],
            }[stage])
    elif a.command == "features":
        tensor = None
        if a.tensors:  # a folder of tensor files, or the long table that generate writes
            tensor = spark.read.parquet(a.tensors) if a.tensors.endswith(".parquet") else read_tensors(spark, a.tensors).drop("run")
        eos, special = config.special_ids(files.run_config(a.config or beside(a.answers)))
        rows = pipeline.build_features(files.read_answers(spark, a.answers), tensor, loaded(a.scorer), special, eos, compat=a.compat)
        sinks.write_jsonl(rows, a.output, "overwrite")
    elif a.command == "baseline":
        answers = prompts.group_key(files.read_answers(spark, a.answers), 1) if a.answers else None
        excluded = labeling.ambiguous_prompts(answers) if a.answers else None
        rows = pipeline.baseline_features(files.read_features(spark, a.features), files.read_trajectories(spark, a.trajectories), loaded(a.scorer), full_trajectory=a.full, cache=PairCache(spark, a.pair_cache, a.scorer or "default") if a.pair_cache else None, seed=a.seed, excluded=excluded)
        sinks.write_jsonl(rows, a.output, "overwrite")
    elif a.command == "weights":
        rows, weights = pipeline.weighted_features(files.read_features(spark, a.features), files.read_trajectories(spark, a.trajectories), loaded(a.scorer), a.ridge)
        sinks.write_jsonl(rows, a.output, "overwrite")
        sinks.write_json([r.asDict() for r in weights.orderBy("step").collect()], a.weights or f"{a.output}.weights.json")  # a row for each step
    elif a.command == "evaluate":
        summary, found = pipeline.evaluate(files.read_features(spark, a.features), a.bootstrap, a.seed)
        sinks.write_json(sinks.metrics_document(summary.first().asDict(), found), f"{a.output}/uq_eval_metrics.json")
        sinks.write_metrics_csv(found, f"{a.output}/uq_eval_metrics.csv")
    elif a.command == "split":
        resample.save_splits(resample.split_prompts(files.read_features(spark, a.features).select("prompt_id"), *a.counts, a.seed), a.output, seed=a.seed)
    elif a.command == "kfold":
        rows = files.read_features(spark, a.features)
        folds = resample.kfold_splits(rows.select("prompt_id", "is_correct"), a.k, a.train, a.seed, label="is_correct")
        sinks.write_kfold_summary(pipeline.evaluate_folds(rows, folds), a.k, a.output)
    elif a.command in ("report", "export"):
        metric = report.normalize_metrics([a.metric])[0]
        folded = files.find_kfold_summaries(a.roots)
        plain = files.load_run_results(spark, files.find_metrics_files(a.roots))
        if folded:
            other = files.load_kfold_results(spark, folded)
            nested = spark.createDataFrame([(p.rsplit("/", 2)[0],) for p in folded], "run_dir string")
            plain = report.without_nested(plain, nested).unionByName(other, allowMissingColumns=True)
        cells = sheets.model_cells(plain, metric) if a.command == "report" else sheets.dataset_cells(plain, report.normalize_metrics([a.metric]))
        where = sinks.write_sheets(cells, f"{a.output}/report.xlsx")
        if a.latency:
            points = pipeline.cost_quality(plain, files.discover_latency(spark, a.latency), metric)
            sinks.write_json([json.loads(r) for r in points.toJSON().collect()], f"{a.output}/cost_quality.json")
        print(where)


if __name__ == "__main__":
    main()
