"""Stages composed: features of a run, trajectory features, evaluation and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenq.backends import EntailmentScorer
from lumenq.functions.text import is_valid_text
from lumenq.operators import graph, labeling, metrics, prompts, report, resample, tokens, trajectory
from lumenq.operators.features import SEMANTIC
from lumenq.operators.features import group as feature_group
from lumenq.operators.pair_cache import PairCache, prefetched
from lumenq.staging import staged

C = F.col


def build_features(answers: DataFrame, tensor: DataFrame | None, scorer: EntailmentScorer | None = None, special: Sequence[int] = (), eos: Sequence[int] = (), most: int = graph.MAX_ITEMS, per_prompt: int = 1, compat: bool = False) -> DataFrame:
    """A feature row for each prompt: token features of its greedy record, graph features and mcnse of its samples.

    compat=True repeats a known program's rows: every position counts as visible, and mcnse is null.
    Ambiguous prompts are left out. Without tensors the token features are null.
    """
    keyed = staged(prompts.partition_greedy(prompts.group_key(answers, per_prompt)), "answers")
    greedy = keyed.where("is_greedy").select("prompt_id", "sample_id", C("label").alias("is_correct"))
    sampled = keyed.where("not is_greedy")
    out = greedy
    if tensor is None:
        out = out.withColumns({**{c: F.lit(None).cast("double") for c in ("msp", "perplexity", "mte", "mcnse")}, "n_visible_tokens": F.lit(None).cast("int")})
    else:
        last = tokens.last_pass(tensor)
        seen = last if compat else tokens.visible_tokens(last, C("token_id").isin(*eos) if eos else F.lit(False), C("token_id").isin(*special) if special else F.lit(False))
        out = out.join(tokens.token_features(seen), "sample_id", "left")
        if compat:
            out = out.withColumn("mcnse", F.lit(None).cast("double"))
        else:
            own = seen.join(sampled.select("sample_id", "prompt_id"), "sample_id")
            out = out.join(tokens.negative_log_likelihood(own), "prompt_id", "left")
    texts = sampled.select("prompt_id", "sample_id", prompts.final_answer(answers.columns).alias("text"))
    found = graph.sampling_features(texts, scorer, most)
    named = found.select("prompt_id", *[C(f.replace("-", "_")).alias(f) for f in SEMANTIC])
    rows = out.join(named, "prompt_id", "left").select("prompt_id", "is_correct", "n_visible_tokens", "msp", "perplexity", "mte", "mcnse", *[C(f"`{f}`") for f in SEMANTIC])
    return labeling.without_ambiguous(rows, prompts.group_key(answers, per_prompt))


def baseline_features(rows: DataFrame, trajectories: DataFrame, scorer: EntailmentScorer | None = None, full_trajectory: bool = False, random_scopes: int = trajectory.RANDOM_SCOPES, random_steps: int = trajectory.RANDOM_STEPS, seed: int = 42, most: int = graph.MAX_ITEMS, excluded: DataFrame | None = None, cache: PairCache | None = None, draws: DataFrame | None = None) -> DataFrame:
    """rows with full-ad, random-<rep>-<feature>, and full-<feature> if asked, of each prompt's first trajectory.

    Trajectories of another than the most common number of steps, and of prompts that have no row, are left out. The
    draws of a prompt are seeded by its place among the kept prompts, in the order of the trajectories: by ord where
    there is such a column, else as they are read. excluded: prompts that do not take part in that order. cache: scores of earlier runs, which new ones are added to.
    draws: (prompt_id, rep, step) of the random scopes, each once, in place of drawn ones.
    """
    if "ord" not in trajectories.columns:
        trajectories = trajectories.withColumn("ord", F.monotonically_increasing_id())
    kept = staged(trajectory.modal_length(staged(trajectories, "trajectories")), "kept-trajectories")
    if excluded is not None:
        kept = kept.join(excluded.select("prompt_id"), "prompt_id", "left_anti")
    target = trajectory.target_trajectory(kept.select("prompt_id", "response_sample_id", "num_steps", "step_answers", "final_answer")).join(rows.select("prompt_id"), "prompt_id", "left_semi")
    target = staged(target, "target-trajectories")
    steps = trajectory.steps_of(target)
    scoped = None
    if random_scopes and draws is None:
        first = kept.groupBy("prompt_id").agg(F.min("ord").alias("__first"))
        numbered = prompts.numbered(first, "__first").select("prompt_id", C("at").alias("idx")).join(target.select("prompt_id", "num_steps"), "prompt_id")
        draws = trajectory.random_scope_steps(numbered, seed, random_steps, random_scopes)
    if random_scopes:
        scoped = staged(steps.join(draws, ["prompt_id", "step"]).where(is_valid_text(C("text"))).withColumn("scope", F.concat_ws("|", "prompt_id", "rep")), "random-scopes")
    # all scopes' pairs are asked for together, each once; a scope then selects its own
    asked = trajectory.needed_pairs(steps, [(steps, "prompt_id")] * full_trajectory + ([(scoped, "scope")] if random_scopes else []), most)
    scorer = prefetched(asked, scorer, cache)
    out = rows.join(trajectory.averaged_dissimilarity(trajectory.step_dissimilarities(steps, scorer)).withColumnRenamed("ad", "full-ad"), "prompt_id", "left")
    if full_trajectory:
        out = out.join(trajectory.trajectory_features(steps, "full", scorer, most), "prompt_id", "left")
    if random_scopes:
        found = graph.sampling_features(scoped, scorer, most, "scope", "step").join(scoped.select("scope", "prompt_id", "rep").distinct(), "scope")
        wide = found.groupBy("prompt_id").agg(*[F.max(F.when(C("rep") == r, C(f.replace("-", "_")))).alias(f"random-{r}-{f}") for r in range(random_scopes) for f in SEMANTIC])
        out = out.join(wide, "prompt_id", "left")
    return out


def weighted_features(rows: DataFrame, trajectories: DataFrame, scorer: EntailmentScorer | None = None, ridge: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(rows with weighted-ad, weights with their certificate): each prompt's steps weighed by how little they differ between trajectories.

    Trajectories of the most common number of steps take part; their steps' texts become vectors of hashed words, on which
    trajectory.step_weights works, all trajectories as one group. weighted-ad is the weighed dissimilarity of the first
    trajectory's steps from its final answer; prompts without a trajectory have none.
    """
    if "ord" not in trajectories.columns:
        trajectories = trajectories.withColumn("ord", F.monotonically_increasing_id())
    kept = staged(trajectory.modal_length(staged(trajectories, "trajectories")), "kept-trajectories")
    steps = trajectory.steps_of(kept, ("prompt_id", "response_sample_id")).select(F.lit(0).alias("all"), F.struct("prompt_id", "response_sample_id").alias("trajectory"), "step", "text")
    weights = staged(trajectory.step_weights(trajectory.hashed_vectors(steps, ("all", "trajectory", "step")), "all", ridge=ridge).drop("all"), "step-weights")
    target = trajectory.target_trajectory(kept.select("prompt_id", "response_sample_id", "num_steps", "step_answers", "final_answer")).join(rows.select("prompt_id"), "prompt_id", "left_semi")
    found = trajectory.averaged_dissimilarity(trajectory.step_dissimilarities(trajectory.steps_of(target), scorer), weights=weights)
    return rows.join(found.withColumnRenamed("ad", "weighted-ad"), "prompt_id", "left"), weights


def evaluate(rows: DataFrame, bootstrap: int = 0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(run summary, metrics of each feature)."""
    return metrics.run_summary(rows), metrics.evaluate_run(rows, bootstrap, seed)


def evaluate_folds(rows: DataFrame, folds: DataFrame, section: str = "baseline", id_col: str = "prompt_id") -> DataFrame:
    """Every fold's test rows evaluated in one plan, with the fold as a key, and aggregated over folds."""
    features = metrics.evaluated_features(rows)
    scores = metrics.long_scores(rows, features, id_col)
    test = folds.where("role = 'test'").select("fold", C("id").cast(rows.schema[id_col].dataType).alias(id_col))
    test = test.select("fold", metrics.numeric_id(test, id_col).alias("id"))
    each = metrics.evaluate_scores(scores.join(test, "id"), ["fold", "feature"])
    long = each.select("fold", "feature", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), C(m).alias("value")) for m in metrics.METRICS])).alias("m")).select("fold", "feature", "m.*")
    return resample.aggregate_folds(long.withColumn("section", F.lit(section)))


def performance_report(results: DataFrame, metric: str = "prr") -> dict[str, DataFrame]:
    """A feature x (dataset, strategy) matrix for each known model, features by report group."""
    rolled = report.model_rollup(results.where(C("feature").isNotNull()))
    out = {}
    for name in report.MODEL_IDS:
        own = rolled.where(C("model") == name)
        matrix = report.feature_matrix(own, metric, F.concat_ws(" ", "dataset", "remasking"))
        out[name] = matrix.withColumn("group", feature_group(C("feature"))).orderBy("group", "feature")
    return out


def cost_quality(results: DataFrame, latency: DataFrame, metric: str = "prr") -> DataFrame:
    """Performance and overhead of each feature by model, dataset and strategy, with on_front."""
    # runs count in the order of their paths: a row for each run
    order = results.select("run_dir").distinct().withColumn("ord", F.row_number().over(Window.orderBy("run_dir")))
    own = results.where(C("metric") == metric).join(order, "run_dir").withColumns({"model": report.model_name(C("model_id")), "is_selection": C("run_dir").endswith("/selection")})
    named = own.withColumn("feature", F.when(C("is_selection"), F.when(C("feature") == "ad", "weighted-ad").otherwise(F.concat(F.lit("selected-"), "feature"))).otherwise(C("feature")))
    both = report.performance_latency(named, latency.select("model", "dataset", "remasking", "feature", "overhead_mean", "family"))
    return report.pareto(both, "overhead_mean", "value", "feature", ("model", "dataset", "remasking"))
