"""Text functions, prompts, labels, reports and files, with their edges."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenq import config
from lumenq.backends import ModelJudge, ScriptedJudge, TemplateChat
from lumenq.functions import text
from lumenq.operators import labeling, prompts, report
from lumenq.plans import pipeline
from lumenq.sources import files, schemas, sinks
from lumenq.sources.tensors import read_tensors
from lumenq.streaming import labels as stream


def values(spark, f, *given):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


def test_judge_score(spark):
    assert values(spark, text.judge_score, "1.", "10", "Score: 0", None, " 1 ", "x1y", "maybe", "21 0") == [True, None, False, None, True, True, None, False]


def test_numbers(spark):
    assert values(spark, text.marked_number, "x #### 1,234.5 y", "#### 1\n#### -2\n", "none", "#### no", None) == ["1234.5", "-2", "", "", None]
    assert values(spark, text.extract_last_number, "so\n\nanswer: 3 and 4.", "#### 5\nlater 6", "\\boxed{7,000}", "none") == ["4", "6", "7000", ""]
    assert values(spark, text.parse_math_response, "a\n final answer: x. ", "\\boxed{a{b}c} \\boxed{d{e}}", "#### a\n b ") == ["x", "d{e}", "a\n b"]
    assert values(spark, text.boxed_content, "\\boxed{a", "none", "\\boxed{}", "\\boxed{ {x} }") == [None, None, "", "{x}"]


def test_normalising(spark):
    assert values(spark, text.normalize_text, " a  \t b\n", "\x1cq") == ["a b", "q"]
    assert values(spark, text.normalize_key, " (The  END!) ", "a-b") == ["the end", "a-b"]
    assert values(spark, text.parse_text_response, '{"content": " a  b "}', '{"text": "t", "answer": "a"}', " plain  x ") == ["a b", "t", "plain x"]
    assert values(spark, text.normalize_answer, "The  quick_fox, an A!") == ["quick fox"]
    assert values(spark, text.short_answer, "The answer is: 42.0\nbecause", "Paris.") == ["42", "Paris"]
    assert values(spark, text.is_valid_text, "", "None", "x", None) == [False, False, True, False]
    assert [r[0] for r in spark.createDataFrame([(0.0005, None), (1234.5678, 0.25), (None, 1.0)], "m double, s double").select(text.format_mean_std(F.col("m"), F.col("s"))).collect()] == [f"{0.0005:.3f}", "1234.568 (0.250)", None]


def test_run_ids():
    assert config.run_id("LLaDA1.5", "gsm8k", 256, 256, "lc", 32, 0.7, 4) == "LLaDA1.5_gsm8k_l256_s256_lc_b32_t0p7_fs4"
    assert config.run_id("LLaDA", "xsum", 1, 2, "rd", temperature=-1.5).endswith("_tm1p5") and config.derive_run_id({}) == "default"
    own = config.generation_config("LLaDA", "triviaqa", block_size=None)
    assert own["block_size"] is None and own["steps"] == 32 and config.derive_run_id(own) == "LLaDA_triviaqa_l32_s32_lc"
    assert config.config_filename("LLaDA", "xsum", 1, 2, "lc", 8, None, True) == "LLaDA_xsum_l1_s2_lc_b8_ceot.json"
    assert config.resolve_config({"steps": 4, "seed": None}, {"seed": 7})["seed"] == 7 and config.resolve_remasking("odd") == "odd"
    assert config.special_ids({"eos_token_ids": [[1], 2], "mask_id": 9}) == ([1, 2], [1, 2, 9])


def test_config_grid(spark):
    grid = config.config_grid(spark)
    assert grid.count() == 2 * 7 * 2 and grid.select("run_id").distinct().count() == 28
    assert config.config_grid(spark, existing=grid.limit(5)).count() == 23


def test_hotpot_edges(spark):
    rows = spark.createDataFrame([("q", "a", "1", (["t"], [["x", "y"]])), ("q", "a", "2", ([], []))], schemas.RAW["hotpotqa"])
    got = prompts.adapter("hotpotqa").sample(rows).collect()
    assert len(got) == 1 and got[0].source_documents[0].body == "xy"
    bad = spark.createDataFrame([("q", "a", "1", (["t", "u"], [["x"]]))], schemas.RAW["hotpotqa"])
    with pytest.raises(Exception, match="differ in number"):
        prompts.adapter("hotpotqa").sample(bad).collect()
    with pytest.raises(ValueError):
        prompts.adapter("odd")


def test_prompts_without_shots_and_expansion(spark):
    rows = spark.createDataFrame([(i, f" q{i} ", f"a{i}") for i in range(5)], "ord bigint, question string, answer string").select("ord", "question", F.concat("answer", F.lit(" #### 3")).alias("answer"))
    got = prompts.build_prompts(rows, "gsm8k", 0, 3).orderBy("prompt_id").collect()
    assert [r.prompt_id for r in got] == [0, 1, 2] and got[0].prompt_text.endswith("Question: q0\nAnswer:") and got[0].reference_answer == "3"
    one = prompts.expand_samples(spark.createDataFrame([(0, " ", "e")], "prompt_id bigint, id string, question_id string"), 1, greedy=False).collect()
    assert len(one) == 1 and one[0].sample_example_id == "e"
    assert TemplateChat("<u>{prompt}</u>").apply(F.lit("x")) is not None


def records(spark, rows):
    return spark.createDataFrame(rows, "prompt_id string, sample_id int, generation_mode string, question string, reference_answer string, aliases array<string>, raw_answer string, label boolean")


def test_labels(spark):
    rows = [("p", 0, "greedy", "q", "r", ["yes"], "good", None), ("p", 1, "sampled", "q", "r", [], "good", None), ("q", 2, "greedy", "q2", "r", [], " ", None), ("s", 3, "greedy", "q3", "r", [], "hm", None), ("t", 4, "greedy", "q4", "r", [], "done", True)]
    judge = ScriptedJudge(lambda p: F.when(p.contains("response: good"), "1").otherwise("unclear"))
    got = {r.sample_id: r for r in labeling.label_records(records(spark, rows), "triviaqa", judge).collect()}
    assert [got[i].label for i in range(5)] == [True, None, False, None, True]
    assert got[0].final.correctness_method == "llm_judge" and got[3].final.correctness_method == "llm_judge_ambiguous" and got[1].final is None and got[4].final is None
    labelled = labeling.label_records(records(spark, rows), "triviaqa", judge)
    assert [r.prompt_id for r in labeling.ambiguous_prompts(labelled).collect()] == ["s"]
    retried = labeling.judged(records(spark, rows[3:4]), "triviaqa", judge, retry=ScriptedJudge(lambda p: F.lit("1"))).first()
    assert retried.label is True and retried.retried is True

    def load():
        return lambda ps: ["0"] * len(ps)

    assert labeling.judged(records(spark, rows[:1]), "triviaqa", ModelJudge(load)).first().label is False
    for bad in (lambda: labeling.label_samples(records(spark, rows), "triviaqa"), lambda: labeling.label_samples(records(spark, rows), "triviaqa", judge, "odd")):
        with pytest.raises(ValueError):
            bad()


def test_report(spark):
    points = lambda *p: [r.on_front for r in report.pareto(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id int, x double, y double")).orderBy("id").collect()]
    assert points((0, 0.8), (1, 0.9), (2, 0.85), (0.5, 0.7)) == [True, True, False, False]
    assert points((0, 0.9), (0, 0.5), (1, 0.95)) == [True, False, True]
    times = spark.createDataFrame([("a", "f", 0.01, 0.0, 0.0, 1, 1), ("a", "f", 0.03, 0.0, 0.0, 1, 1), ("a", "g", 1.0, 0.0, 0.0, 1, 1)], "family string, feature string, time_gen double, time_nli double, time_math double, n_extra_gen int, n_nli_pairs int")
    got = {r.feature: r for r in report.timing_aggregate(times).collect()}
    assert abs(got["f"].time_gen_std - 0.01 * np.sqrt(2)) < 1e-12 and got["g"].time_gen_std == 0.0
    weights = spark.createDataFrame([(1.0, 1), (3.0, 3), (float("nan"), 9), (5.0, None)], "v double, w int")
    assert weights.agg(report.weighted_mean(F.col("v"), F.col("w"))).first()[0] == 2.5
    assert weights.agg(report.weighted_mean(F.col("v"), F.lit(0))).first()[0] == 3.0
    assert report.normalize_metrics(["prr, AUROC", "prr"]) == ["prr", "auroc"]
    with pytest.raises(ValueError):
        report.normalize_metrics(["odd"])


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"question": "q", "answer": "#### 1"}\n\n{"question": "r", "answer": "x"}\n')
    assert files.load_local_dataset(spark, f"{tmp_path}/a.jsonl", "jsonl", schemas.RAW["gsm8k"]).count() == 2
    (tmp_path / "b.json").write_text('[{"question": "q", "answer": "a"}]')
    assert files.load_local_dataset(spark, f"{tmp_path}/b.json", "json", schemas.RAW["gsm8k"]).first().answer == "a"
    (tmp_path / "c.json").write_text('{"question": "q"}')
    with pytest.raises(ValueError):
        files.load_local_dataset(spark, f"{tmp_path}/c.json", "json")
    with pytest.raises(ValueError):
        files.load_local_dataset(spark, f"{tmp_path}/a.jsonl", "csv")
    with pytest.raises(FileNotFoundError):
        files.load_local_dataset(spark, f"{tmp_path}/none.jsonl")
    (tmp_path / "bad.jsonl").write_text('{"question": "q"}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, f"{tmp_path}/bad.jsonl", "question string").collect()
    lp = np.random.default_rng(0).normal(size=(2, 3, 4)).astype(np.float32)
    np.savez(tmp_path / "topk_logprobs.npz", topk_logprobs=lp, topk_token_ids=np.arange(24).reshape(2, 3, 4))
    got = read_tensors(spark, str(tmp_path)).where("sample_id = 1 and pos = 2").orderBy("rank").collect()
    assert [r.token_id for r in got] == [20, 21, 22, 23] and np.allclose([r.logprob for r in got], lp[1, 2])


def test_sinks_and_results(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (float("inf"),)], "perplexity double")
    with pytest.raises(Exception, match="not finite"):
        sinks.write_jsonl(df, f"{tmp_path}/x")
    answers = spark.createDataFrame([(0, "p", "a")], "sample_id int, prompt_id string, raw_answer string")
    run = f"{tmp_path}/outputs/run1"
    own = config.generation_config("LLaDA1.5", "gsm8k")
    sinks.save_results(answers, None, own, {"note": 1}, run)
    sinks.replace_records(spark.read.json(f"{run}/answers.jsonl").withColumn("label", F.lit(True)), f"{run}/answers.jsonl")
    assert spark.read.json(f"{run}/answers.jsonl").first().label is True
    document = {"n_examples": 10, "n_correct": 4, "mean_visible_tokens": 3.0, "features": {"msp": {"prr": 0.3, "prr_bootstrap_mean": 0.4, "prr_bootstrap_std": 0.1, "auroc": "x"}, "ecc": {"prr": None}}}
    sinks.write_json(document, f"{run}/uq_eval_metrics.json")
    found = files.find_metrics_files([f"{tmp_path}/outputs"])
    rows = files.load_run_results(spark, found).collect()
    assert len(rows) == 1 and (rows[0].feature, rows[0].metric, rows[0].value, rows[0].std) == ("msp", "prr", 0.4, 0.1)
    assert rows[0].qa_accuracy == 0.4 and rows[0].model_id == "GSAI-ML/LLaDA-1.5" and rows[0].weight == 10
    legacy = {"accuracy": 0.5, "scores": [{"score_name": "msp", "bootstrap": {"metrics": {"prr": {"mean": 0.9, "std": 0.2}}}}], "features": {"msp": {"prr": 0.1}, "mte": {"auroc": 0.6}}}
    sinks.write_json(legacy, f"{tmp_path}/outputs/run2/uq_eval_metrics.json")
    both = {(r.feature, r.metric): r.value for r in files.load_run_results(spark, files.find_metrics_files([f"{tmp_path}/outputs/run2"])).collect()}
    assert both == {("msp", "prr"): 0.9, ("mte", "auroc"): 0.6}
    fold = spark.createDataFrame([("baseline", "msp", "prr", 0.5, 0.1, [0.4, 0.6])], "section string, feature string, metric string, mean double, std double, per_fold array<double>")
    sinks.write_kfold_summary(fold, 2, f"{run}/kfold/kfold_summary.json")
    sinks.write_json({"n_correct": 3, "n_examples": 4, "mean_visible_tokens": 2.0}, f"{run}/kfold/fold_0/baseline/uq_eval_metrics.json")
    k = files.load_kfold_results(spark, files.find_kfold_summaries([f"{tmp_path}/outputs"])).collect()
    assert len(k) == 1 and (k[0].value, k[0].std, k[0].qa_accuracy, k[0].dataset) == (0.5, 0.1, 0.75, "gsm8k") and k[0].run_dir.endswith("kfold/baseline")
    assert (tmp_path / "outputs/run1/kfold/kfold_summary.csv").read_text().splitlines()[1] == "baseline,msp,prr,0.500000,0.100000,0.400000,0.600000"
    reports = pipeline.performance_report(files.load_run_results(spark, found))
    assert sinks.write_workbook(reports, f"{tmp_path}/report.xlsx")
    assert reports["LLaDA1.5"].first()["gsm8k lc"] == "0.400 (0.100)"


def test_latency_and_cost(spark, tmp_path):
    folder = tmp_path / "lat" / "one"
    folder.mkdir(parents=True)
    (folder / "latency_summary.csv").write_text("feature,overhead_mean,family\nmsp,1.5,token\nmsp,2.5,token\necc,8,iid\n")
    (folder / "latency_metadata.json").write_text(json.dumps({"model_id": "GSAI-ML/LLaDA-1.5", "dataset": "gsm8k", "remasking": "lc"}))
    got = {r.feature: r for r in files.discover_latency(spark, f"{tmp_path}/lat").collect()}
    assert got["msp"].overhead_mean == 2.5 and got["ecc"].time_gen_mean == 0.0 and got["ecc"].model == "LLaDA1.5"
    results = spark.createDataFrame([("r", "gsm8k", "GSAI-ML/LLaDA-1.5", "lc", "msp", "prr", 0.5), ("r", "gsm8k", "GSAI-ML/LLaDA-1.5", "lc", "ecc", "prr", 0.4)], "run_dir string, dataset string, model_id string, remasking string, feature string, metric string, value double")
    cost = {r.feature: r.on_front for r in pipeline.cost_quality(results, files.discover_latency(spark, f"{tmp_path}/lat")).collect()}
    assert cost == {"msp": True, "ecc": False}
    ties = spark.createDataFrame([(f, 1.0, 2.0) for f in ("perplexity", "eigval", "msp")], "feature string, x double, y double")
    assert [r.feature for r in report.pareto(ties, key="feature").where("on_front").collect()] == ["eigval"]


def test_pipeline(spark, tmp_path):
    rows = []
    for p in range(12):
        for k in range(4):
            rows.append((f"p{p}", p * 4 + k, "greedy" if k == 0 else "sampled", "q", "a", [], f"answer {p} {k % 2}" + " word" * (p % 3), bool(p % 2) if k == 0 else None))
    answers = records(spark, rows).withColumn("qa_example_id", F.col("prompt_id")).drop("prompt_id")
    tensor = spark.createDataFrame([(s, p, r, p + r, -0.1 * (r + 1) - 0.01 * s) for s in range(48) for p in range(3) for r in range(2)], "sample_id int, pos int, rank int, token_id int, logprob double").withColumn("logprob", F.col("logprob").cast("float"))
    built = pipeline.build_features(answers, tensor, per_prompt=4)
    got = {r.prompt_id: r for r in built.collect()}
    assert len(got) == 12 and all(r.n_visible_tokens == 3 and r.mcnse is not None and r["se-marginal"] is not None for r in got.values())
    compat = pipeline.build_features(answers, tensor, special=[0], per_prompt=4, compat=True).first()
    assert compat.mcnse is None and compat.n_visible_tokens == 3
    bare = pipeline.build_features(answers, None, per_prompt=4).first()
    assert bare.msp is None and bare["ecc"] is not None
    trajectories = spark.createDataFrame([(f"p{p}", 1, 3, ["a", "b x", f"answer {p}"], f"answer {p}") for p in range(12)] + [("p0", 2, 9, ["z"], "z")], "prompt_id string, response_sample_id int, num_steps int, step_answers array<string>, final_answer string")
    base = pipeline.baseline_features(built, trajectories, full_trajectory=True, random_scopes=2, random_steps=2)
    row = base.where("prompt_id = 'p0'").first()
    assert row["full-ad"] > 0 and row["full-se-marginal"] is not None and row["random-1-ecc"] is not None
    sinks.write_jsonl(base, f"{tmp_path}/features")
    back = files.read_features(spark, f"{tmp_path}/features")
    metrics_rows = {r.feature for r in pipeline.metrics.evaluate_run(back).collect()}
    folds = pipeline.resample.kfold_splits(back.select("prompt_id", "is_correct"), 2, 3, label="is_correct")
    assert pipeline.evaluate_folds(back, folds).where("feature = 'msp' and metric = 'auroc'").count() == 1
    assert {"msp", "ecc", "full-ad", "random-ecc"} <= metrics_rows


def test_stream(spark, tmp_path):
    schema = "ts timestamp, reference_answer string, raw_answer string, source string"
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:0{i}:00Z", "reference_answer": "3", "raw_answer": f"#### {2 + i % 2}", "source": "s"}) for i in range(4)))
    answers = stream.answer_stream(spark, f"file://{source}", schema)
    running = stream.running_accuracy(answers, text.marked_number, "source")
    q = running.writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.n_correct) for r in spark.table("running").collect()] == [(4, 2)]


def test_commands(spark, tmp_path):
    from lumenq import cli

    cli.main(["gen-configs", f"{tmp_path}/configs", "--datasets", "gsm8k", "--models", "LLaDA"])
    assert len(list((tmp_path / "configs").iterdir())) == 2
    (tmp_path / "raw.jsonl").write_text("\n".join(json.dumps({"question": f"q{i}", "answer": f"#### {i}"}) for i in range(6)))
    cli.main(["build-prompts", "gsm8k", f"{tmp_path}/raw.jsonl", f"{tmp_path}/prompts", "--fewshot", "1", "--questions", "3"])
    made = spark.read.json(f"{tmp_path}/prompts").orderBy("prompt_id").collect()
    assert len(made) == 3 and "Answer: #### 0" in made[0].prompt_text
    run = tmp_path / "runs" / "one"
    run.mkdir(parents=True)
    answers = [{"qa_example_id": f"e{p}", "sample_id": p * 3 + k, "generation_mode": "greedy" if k == 0 else "sampled", "question": "q", "reference_answer": "1", "raw_answer": f"x{k} #### {p % 2}"} for p in range(8) for k in range(3)]
    (run / "answers.jsonl").write_text("\n".join(map(json.dumps, answers)))
    sinks.write_json(config.generation_config("LLaDA", "gsm8k"), str(run / "config.json"))
    cli.main(["label-all", str(tmp_path / "runs")])
    cli.main(["pipeline", str(run), "--stages", "features", "evaluate", "--bootstrap", "0"])
    document = json.loads((run / "uq_eval_metrics.json").read_text())
    cli.main(["kfold", str(run / "uq_features.jsonl"), str(run / "kfold/kfold_summary.json"), "--k", "2", "--train", "2"])
    cli.main(["split", str(run / "uq_features.jsonl"), str(run / "splits.json"), "--counts", "2", "3", "3"])
    cli.main(["report", str(tmp_path / "runs"), "--output", f"{tmp_path}/report"])
    assert (run / "kfold/kfold_summary.csv").exists() and json.loads((run / "splits.json").read_text())["counts"]["train"] == 2
    assert document["n_examples"] == 8 and document["accuracy"] == 0.5 and "ecc" in document["features"]


class TinyBackend:
    """A model that prefers the token after the last prompt token; tokens are digits."""

    mask_id, pad_id, eos = 10, 0, (9,)

    def encode(self, text):
        return [int(c) for c in text if c.isdigit()]

    def decode(self, ids):
        return " ".join(str(i) for i in ids)

    def load(self):
        def model(x):
            out = np.zeros((*x.shape, 11))
            for row, o in zip(x, out, strict=True):
                known = [t for t in row if t != 10]
                o[:, (known[-1] + 1) % 9] = 3.0
            return out

        return model


def test_generate(spark):
    from lumenq.plans import generate

    asked = spark.createDataFrame([(0, "q 1", "e0"), (1, "q 4", "e1")], "prompt_id bigint, prompt_text string, id string")
    own = {"temperature": 1.0, "num_response_samples": 2, "generate_greedy": True, "max_gen_length": 2, "steps": 1, "block_size": None, "remasking": "lc", "top_k": 3, "seed": 1, "batch_size": 2}
    answers, tensors = generate.generate_answers(asked, TinyBackend(), own)
    rows = answers.orderBy("sample_id").collect()
    assert [r.sample_id for r in rows] == list(range(6)) and [r.generation_mode for r in rows[:3]] == ["greedy", "sampled", "sampled"]
    assert rows[0].raw_answer == "2 2" and rows[3].raw_answer == "5 5" and rows[3].qa_example_id == "e1" and rows[5].response_sample_id == 2
    assert tensors.count() == 6 * 2 * 3 and tensors.where("rank = 0").agg(F.min("logprob")).first()[0] < 0
    greedy, _ = generate.generate_answers(asked, TinyBackend(), own | {"temperature": 0.0})
    assert greedy.count() == 2
    built = pipeline.build_features(answers, tensors, per_prompt=3)
    assert built.count() == 0  # no record is labelled yet, so every prompt is ambiguous
    assert pipeline.build_features(answers.withColumn("label", F.lit(True)), tensors, per_prompt=3).where("msp is not null").count() == 2


def yes_judge():
    from lumenq.backends import ScriptedJudge

    return ScriptedJudge(lambda p: F.when(p.contains("Model response: x0"), "1").otherwise("0"))


class EqualScorer:
    """Entailment only between equal texts."""

    def score(self, pairs):
        same = F.col("premise") == F.col("hypothesis")
        p = F.when(same, 1.0).otherwise(0.0)
        return pairs.select("premise", "hypothesis", (1 - p).alias("p_contradiction"), F.lit(0.0).alias("p_neutral"), p.alias("p_entailment"), F.when(same, 2).otherwise(0).alias("cls"))


class PaddedBackend(TinyBackend):
    """Padding is the end of text, which is no digit."""

    pad_id = 9


def test_commands_with_models(spark, tmp_path):
    """The whole pipeline command: prompts, answers by a backend, a judge, a scorer, token ids, baselines, folds and report."""
    from lumenq import cli

    here = "tests.test_text_and_records"
    (tmp_path / "raw.jsonl").write_text("\n".join(json.dumps({"question": f"q{i}", "answer": f"#### {i}"}) for i in range(8)))
    run = tmp_path / "runs" / "one"
    own = config.generation_config("LLaDA", "gsm8k", 2, 1, block_size=None, num_response_samples=2, num_questions=8, seed=1, eos_token_ids=[9], mask_id=10)
    sinks.write_json(own, str(run / "config.json"))
    cli.main(["pipeline", str(run), "--stages", "prompts", "generate", "label", "features", "--source", f"{tmp_path}/raw.jsonl", "--backend", f"{here}:PaddedBackend", "--scorer", f"{here}:EqualScorer"])
    rows = spark.read.json(str(run / "uq_features.jsonl")).collect()
    assert len(rows) == 8 and all(r.msp is not None and r.n_visible_tokens <= 2 for r in rows)
    ids = [r.prompt_id for r in rows]
    (run / "trajectories.jsonl").write_text("\n".join(json.dumps({"prompt_id": p, "num_steps": 4, "response_sample_id": 0, "step_answers": ["a", f"b {p}", "c", f"d {p}"], "final_answer": f"d {p}"}) for p in ids[::-1]))
    cli.main(["pipeline", str(run), "--stages", "baseline", "split", "kfold", "evaluate", "report", "--bootstrap", "0", "--counts", "2", "2", "2", "--k", "2", "--train", "2", "--scorer", f"{here}:EqualScorer"])
    base = spark.read.json(str(run / "baseline_features.jsonl"))
    assert base.where("`full-ad` = 0.75").count() == 8 and "random-0-ecc" in base.columns  # three of four steps differ from the last
    assert (run / "kfold/kfold_summary.json").exists() and (run / "splits.json").exists() and (run / "uq_eval_metrics.json").exists()
    other = tmp_path / "runs" / "two"
    other.mkdir()
    sinks.write_json({"dataset": "triviaqa"}, str(other / "config.json"))
    (other / "answers.jsonl").write_text("\n".join(json.dumps({"qa_example_id": f"e{p}", "sample_id": p, "generation_mode": "greedy", "question": "q", "reference_answer": "1", "raw_answer": f"x{p}"}) for p in range(2)))
    cli.main(["label-all", str(tmp_path / "runs"), "--judge", f"{here}:yes_judge", "--exclude", "one"])
    assert {r.sample_id: r.label for r in spark.read.json(str(other / "answers.jsonl")).collect()} == {0: True, 1: False}


def test_special_ids_are_resolved():
    from lumenq.plans import generate

    class Bare:
        pass

    assert generate.resolved_ids(Bare(), {}) == {"mask_id": 126336, "pad_token_id": 126081, "eos_token_ids": [126081, 126348]}
    assert generate.resolved_ids(TinyBackend(), {}) == {"mask_id": 10, "pad_token_id": 0, "eos_token_ids": [9]}
    assert generate.resolved_ids(TinyBackend(), {"mask_id": 3, "eot_token_id": 8}) == {"mask_id": 3, "pad_token_id": 0, "eos_token_ids": [8]}


def test_prompts_are_prepared_one_by_one(spark, tmp_path, capsys):
    from lumenq import cli

    (tmp_path / "data/openai/gsm8k/main").mkdir(parents=True)
    (tmp_path / "data/openai/gsm8k/main/test.jsonl").write_text("\n".join(json.dumps({"question": f"q{i}", "answer": f"#### {i}"}) for i in range(4)))
    for name in ("xsum", "gsm8k"):
        sinks.write_json(config.generation_config("LLaDA", name), f"{tmp_path}/{name}.json")
    for _ in range(2):
        cli.main(["prepare-prompts", f"{tmp_path}/xsum.json", f"{tmp_path}/gsm8k.json", "--sources", f"{tmp_path}/data", "--output-dir", f"{tmp_path}/out"])
    said = capsys.readouterr().out
    assert said.count("xsum.json: ") == 2 and said.count("prompts.jsonl: written") == 1 and said.count("prompts.jsonl: is there") == 1
    assert spark.read.json(f"{tmp_path}/out/{config.derive_run_id(config.generation_config('LLaDA', 'gsm8k'))}/prompts.jsonl").count() == 4


def test_documents_on_another_file_system(spark, tmp_path):
    from lumenq.sources import places

    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.elsewhere.link./in", f"file://{tmp_path}")
    root = "viewfs://elsewhere/in"
    sinks.write_json({"n_examples": 2, "n_correct": 1, "features": {"msp": {"auroc": 0.5}}}, f"{root}/runs/a/uq_eval_metrics.json")
    sinks.write_json({"dataset": "xsum"}, f"{root}/runs/a/config.json")
    places.write_text(f"{root}/runs/a/answers.jsonl", "")
    assert places.exists(f"{root}/runs/a/config.json") and not places.exists(f"{root}/none") and files.run_config(f"{root}/runs/a") == {"dataset": "xsum"}
    found = files.find_metrics_files([f"{root}/runs", f"{root}/none"])
    assert len(found) == 1 and files.load_run_results(spark, found).first().dataset == "xsum"
    assert len(files.discover_runs(f"{root}/runs")) == 1 and files.discover_runs(f"{root}/runs", exclude=["a"]) == []
    assert places.above("s3a://b/x/y")[1] == "s3a://b/x"


def test_random_scopes_are_seeded_by_the_order_of_trajectories(spark):
    rows = spark.createDataFrame([("b",), ("a",)], "prompt_id string")
    steps = [f"{i} w" for i in range(9)]
    talks = spark.createDataFrame([("x", 0, 9, steps, "8 w"), ("b", 0, 9, steps, "8 w"), ("short", 0, 2, ["a", "b"], "b"), ("a", 0, 9, steps, "8 w")], "prompt_id string, response_sample_id int, num_steps int, step_answers array<string>, final_answer string").coalesce(1)
    seen = []
    from lumenq.operators import trajectory

    found = trajectory.random_scope_steps

    def spy(numbered, *rest):
        seen.append({r.prompt_id: r.idx for r in numbered.collect()})
        return found(numbered, *rest)

    trajectory.random_scope_steps = spy
    try:
        pipeline.baseline_features(rows, talks, random_scopes=1, random_steps=3).collect()
        pipeline.baseline_features(rows, talks, random_scopes=1, random_steps=3, excluded=spark.createDataFrame([("x",)], "prompt_id string")).collect()
    finally:
        trajectory.random_scope_steps = found
    assert seen == [{"b": 1, "a": 2}, {"b": 0, "a": 1}]


def test_sheets(spark, tmp_path):
    from lumenq.operators import sheets

    rows = [
        ("r1", "gsm8k", "GSAI-ML/LLaDA-1.5", "256", "8", "rd", 0.5, 10, 7.0, "msp", "prr", 0.2, 0.1), ("r1", "gsm8k", "GSAI-ML/LLaDA-1.5", "256", "8", "rd", 0.5, 10, 7.0, "ecc", "prr", 0.6, None),
        ("r2", "triviaqa", "GSAI-ML/LLaDA-1.5", "32", "8", "lc", 0.25, 10, 3.0, "msp", "prr", 0.4, None), ("r2", "triviaqa", "GSAI-ML/LLaDA-1.5", "32", "8", "lc", 0.25, 10, 3.0, "odd", "prr", 0.9, None),
        ("r3", "gsm8k", "other", "256", "8", "lc", 1.0, 1, 1.0, "msp", "prr", 0.1, None),
    ]
    schema = "run_dir string, dataset string, model_id string, max_gen_length string, steps string, remasking string, qa_accuracy double, weight bigint, mean_tokens double, feature string, metric string, value double, std double"
    results = spark.createDataFrame(rows, schema).withColumn("label_method", F.lit("exact_match"))
    cells = sheets.model_cells(results)
    got = {(r.row, r.col): (r.value, r.fill) for r in cells.collect()}
    assert {r.sheet for r in cells.select("sheet").distinct().collect()} == {"LLaDA1.5"}  # other models have no sheet
    assert [got[i, 2][0] for i in (1, 2, 3, 4)] == ["TriviaQA", "lc", "25.0%", "3.0"] and [got[i, 3][0] for i in (1, 2, 3, 4)] == ["GSM8K", "rd", "50.0%", "7.0"]
    assert [got[i, 1][0] for i in (6, 7, 9, 10)] == ["Token UQ", "msp", "IID Sample UQ", "ecc"] and (8, 1) not in got
    assert got[7, 2][0] == "0.400" and got[7, 3] == ("0.200 (0.100)", "F4CCCC") and got[10, 3] == ("0.600", "D9EAD3") and (10, 2) not in got
    by_set = {(r.sheet, r.row, r.col): r.value for r in sheets.dataset_cells(results, ["prr", "auroc"]).collect()}
    assert by_set["gsm8k", 1, 2] == "GSAI-ML/LLaDA-1.5" and by_set["gsm8k", 1, 4] == "other" and by_set["gsm8k", 6, 5] == "AUROC" and by_set["gsm8k", 7, 2] == "1"
    assert by_set["gsm8k", 11, 1] == "msp" and by_set["gsm8k", 12, 1] == "ecc" and by_set["gsm8k", 12, 4] == "N/A" and by_set["triviaqa", 12, 1] == "odd"
    where = sinks.write_sheets(cells, f"{tmp_path}/report.xlsx")
    assert where.endswith(".xlsx") or (tmp_path / "report/LLaDA1.5.csv").read_text().splitlines()[1] == ",lc,rd"
    assert sinks.write_sheets(cells.where("false"), f"{tmp_path}/none.xlsx")


def test_runs_in_a_view_of_their_steps(spark, tmp_path):
    (tmp_path / "trajectories.jsonl").write_text("\n".join(json.dumps({"prompt_id": p, "step_answers": ["a", "b"], "step_answers_xt": ["c"], "final_answer": "b"}) for p in range(2)))
    plain = files.read_run(spark, str(tmp_path)).orderBy("prompt_id").first()
    assert (plain.prompt_id, plain.num_steps, plain.response_sample_id, plain.step_answers, plain.final_answer) == ("0", 2, 0, ["a", "b"], "b")
    assert files.read_run(spark, str(tmp_path), "xt").first().step_answers == ["c"]
    with pytest.raises(ValueError):
        files.read_run(spark, str(tmp_path), "other")
