"""More registered queries: files and documents, configuration, record handling, and composed plans."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenq import config
from lumenq.backends import JaccardScorer
from lumenq.functions import text
from lumenq.operators import denoise, graph, labeling, metrics, prompts, report, sheets, timing, tokens, trajectory
from lumenq.operators.pair_cache import PairCache
from lumenq.operators.prefix import prefix_sums
from lumenq.plans import pipeline
from lumenq.queries import CLUSTERS, DISTANCE, EDGES, JACCARD, RECORDS, STEPS, TALK, TOKENS, C, L, event_tokens, query, r6, seen_tokens, table, talk_pairs, talk_records, talk_steps, talk_trajectories, vector_edges
from lumenq.sources import files, places, sinks
from lumenq.sources.tensors import read_tensors, write_tensors
from lumenq.staging import shared_folder


def place(spark, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def nations(spark, sf_dir) -> dict[int, list[tuple[int, str]]]:
    """The 25 nations by region: fixtures for documents."""
    out: dict[int, list[tuple[int, str]]] = {}
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        out.setdefault(r.n_regionkey, []).append((r.n_nationkey, r.n_name))
    return out


# --- lines and documents ---------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def json_lines(spark, sf_dir):
    """Written as JSON lines with a blank line after each, and read again."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    path = place(spark, "json-lines")
    rows.select(F.explode(F.array(F.to_json(F.struct(*rows.columns)), L("  "))).alias("value")).write.text(path)
    return files.read_jsonl(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string")


@query("WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS number, CASE c_custkey % 7 WHEN 0 THEN '{\"a\": ' || c_custkey WHEN 1 THEN '[' || c_custkey || ']' WHEN 2 THEN '' ELSE '{\"a\": 1}' END AS line FROM customer) SELECT number, line FROM n WHERE c_custkey % 7 < 2")
def bad_json_lines(spark, sf_dir):
    """Lines of one file that are no JSON object, by their number."""
    k = C("c_custkey")
    line = F.when(k % 7 == 0, F.concat(L('{"a": '), k.cast("string"))).when(k % 7 == 1, F.concat(L("["), k.cast("string"), L("]"))).when(k % 7 == 2, "").otherwise('{"a": 1}')
    path = place(spark, "bad-lines")
    table(spark, sf_dir, "customer").repartition(1).sortWithinPartitions("c_custkey").select(line.alias("value")).write.text(path)
    return files.bad_lines(spark, path).select(C("number").cast("bigint").alias("number"), "line")


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price, o_orderstatus FROM orders")
def json_writer(spark, sf_dir):
    path = place(spark, "written")
    sinks.write_jsonl(table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("price"), "o_orderstatus"), path)
    return files.read_jsonl(spark, path, "o_orderkey bigint, price double, o_orderstatus string")


@query("SELECT 'gsm8k' AS dataset, 'Q: ' || p_name AS raw_prompt, p_name AS question, p_type AS reference_answer FROM part")
def loaded_prompts(spark, sf_dir):
    """A prompts file written and loaded: the data set of the first record, and records without the file's own keys."""
    path = place(spark, "prompts")
    sinks.write_prompts(table(spark, sf_dir, "part").select(C("p_partkey").alias("prompt_id"), L("gsm8k").alias("dataset"), F.concat(L("Q: "), "p_name").alias("prompt_text"), C("p_name").alias("question"), C("p_type").alias("reference_answer")), path)
    dataset, rows = prompts.load_prompts(spark, path)
    return rows.select(L(dataset).alias("dataset"), "raw_prompt", "question", "reference_answer")


@query("SELECT c.conv_id AS prompt_id, CAST(c.turn AS INT) AS sample_id, c.text AS raw_answer, c.turn = 0 AS label FROM conversations c")
def saved_answers(spark, sf_dir):
    """A run's answers saved, read, labelled and written over the folder that they came from."""
    rows = table(spark, sf_dir, "conversations").select(C("conv_id").cast("string").alias("qa_example_id"), C("turn").cast("int").alias("sample_id"), C("text").alias("raw_answer"))
    run = place(spark, "run")
    sinks.save_results(rows, None, {"dataset": "xsum"}, {"run_id": "r"}, run)
    sinks.replace_records(files.read_answers(spark, f"{run}/answers.jsonl").withColumn("label", C("sample_id") == 0), f"{run}/answers.jsonl")
    return files.read_answers(spark, f"{run}/answers.jsonl").select(C("qa_example_id").cast("bigint").alias("prompt_id"), "sample_id", "raw_answer", "label")


@query("SELECT 'r' || r_regionkey || '/uq_eval_metrics.json' AS file, r_regionkey = 2 AS twice FROM region WHERE r_regionkey <> 3")
def discovered_files(spark, sf_dir):
    """Metrics files below two roots that overlap, each once; those under skipped folders are not seen."""
    root = place(spark, "roots")
    for r in nations(spark, sf_dir):
        places.write_text(f"{root}/{'.git/' if r == 3 else ''}r{r}/uq_eval_metrics.json", "{}")
    found = files.find_metrics_files([root, f"{root}/r2", f"{root}/absent"])
    return spark.createDataFrame([(f.split("/roots-")[1].split("/", 1)[1], "/r2/" in f) for f in found], "file string, twice boolean")


_LATENCY = """n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey, n_nationkey % 3 ORDER BY n_nationkey DESC) AS k FROM nation)
SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'LLaDA1.5' ELSE 'other-' || n_regionkey END AS model, 'd' || (n_regionkey % 2) AS dataset, 'lc' AS remasking, 'f' || (n_nationkey % 3) AS feature, CAST(n_nationkey * 1.5 AS DOUBLE) AS overhead_mean, CAST(0 AS DOUBLE) AS time_nli_mean, '' AS family FROM n WHERE k = 1 AND n_regionkey IN (1, 3, 4)"""


@query(f"WITH {_LATENCY}")
def latency_profiles(spark, sf_dir):
    """Profiles beside their metadata: the last row of a feature and the last folder of equal ones count, absent numbers are 0."""
    root = place(spark, "latency")
    for r, own in nations(spark, sf_dir).items():
        sinks._write_rows(["feature", "overhead_mean"], [[f"f{k % 3}", k * 1.5] for k, _ in own], f"{root}/{r}/latency_summary.csv")
        sinks.write_json({"model_id": "GSAI-ML/LLaDA-1.5" if r % 2 == 0 else f"other-{r}", "dataset": f"d{r % 2}", "remasking": "lc"}, f"{root}/{r}/latency_metadata.json")
    return files.discover_latency(spark, root).select("model", "dataset", "remasking", "feature", "overhead_mean", "time_nli_mean", "family")


def run_folders(spark, sf_dir) -> str:
    """A run for each region: its nations are features. Odd regions have metadata over their configuration, and no accuracy."""
    root = place(spark, "runs")
    for r, own in nations(spark, sf_dir).items():
        features = {name: {"auroc": k / 100} | ({"auroc_bootstrap_mean": k / 50, "auroc_bootstrap_std": 0.5} if k % 2 == 0 else {}) for k, name in own}
        sinks.write_json({"n_examples": len(own), "n_correct": 2, "mean_visible_tokens": r * 1.0, "features": features} | ({"accuracy": r / 10} if r % 2 == 0 else {}), f"{root}/{r}/uq_eval_metrics.json")
        sinks.write_json({"dataset": f"d{r}", "model_id": "m", "steps": 8, "remasking": "lc"}, f"{root}/{r}/config.json")
        if r % 2:
            sinks.write_json({"run_config": {"steps": 16, "remasking": "rd"}}, f"{root}/{r}/metadata.json")
    return root


_RUN_RESULTS = """SELECT 'd' || n_regionkey AS dataset, CASE WHEN n_regionkey % 2 = 0 THEN '8' ELSE '16' END AS steps, CASE WHEN n_regionkey % 2 = 0 THEN 'lc' ELSE 'rd' END AS remasking, 'unknown' AS label_method,
CASE WHEN n_regionkey % 2 = 0 THEN n_regionkey / 10.0 ELSE 2.0 / count(*) OVER (PARTITION BY n_regionkey) END::DOUBLE AS qa_accuracy, count(*) OVER (PARTITION BY n_regionkey) AS weight, CAST(n_regionkey AS DOUBLE) AS mean_tokens,
n_name AS feature, 'auroc' AS metric, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 50.0 ELSE n_nationkey / 100.0 END::DOUBLE AS value, CASE WHEN n_nationkey % 2 = 0 THEN 0.5 END::DOUBLE AS std FROM nation"""
_RESULT = ("dataset", "steps", "remasking", "label_method", "qa_accuracy", "weight", "mean_tokens", "feature", "metric", "value", "std")


@query(_RUN_RESULTS)
def run_results(spark, sf_dir):
    """Metrics files with their configuration and the metadata over it; the bootstrap mean before the point estimate."""
    return files.load_run_results(spark, files.find_metrics_files([run_folders(spark, sf_dir)])).select(*_RESULT)


@query(
    f"WITH r AS ({_RUN_RESULTS}), b AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY feature) + 10 AS row, min(value) OVER w AS low, max(value) OVER w AS high FROM r WINDOW w AS (PARTITION BY dataset)), "
    "v AS (SELECT dataset AS sheet, CAST(row AS INT) AS row, CAST(1 AS INT) AS col, feature AS value, false AS best FROM b UNION ALL SELECT dataset, row, 2, CASE WHEN std IS NULL THEN printf('%.3f', value) ELSE printf('%.3f (%.3f)', value, std) END, value = high FROM b "
    "UNION ALL SELECT DISTINCT dataset, 3, 2, steps, false FROM r UNION ALL SELECT DISTINCT dataset, 6, 2, 'AUROC', false FROM r UNION ALL SELECT DISTINCT dataset, 8, 2, printf('%.1f%%', 100 * qa_accuracy), false FROM r) SELECT * FROM v"
)
def dataset_sheets(spark, sf_dir):
    """Cells of a workbook with a sheet for each data set: features, values, and some of the rows above; the best value is green."""
    cells = sheets.dataset_cells(files.load_run_results(spark, files.find_metrics_files([run_folders(spark, sf_dir)])), ["auroc"])
    return cells.where("row > 10 or (col = 2 and row in (3, 6, 8))").select("sheet", "row", "col", "value", F.coalesce(C("fill") == "D9EAD3", L(False)).alias("best"))


def fold_folders(spark, sf_dir) -> str:
    root = place(spark, "folds")
    for r, own in nations(spark, sf_dir).items():
        sinks.write_json({"n_folds": 2, "baseline": {name: {"auroc": {"mean": k / 100, "std": 0.25}} for k, name in own}, "selection": {"ad": {"prr": r / 4}}}, f"{root}/{r}/kfold/kfold_summary.json")
        sinks.write_json({"dataset": f"d{r}", "model_id": "m", "steps": 8}, f"{root}/{r}/config.json")
        for f in (0, 1):
            sinks.write_json({"n_correct": r, "n_examples": 5 + f, "mean_visible_tokens": 10.0 * f}, f"{root}/{r}/kfold/fold_{f}/baseline/uq_eval_metrics.json")
    return root


_FOLDED = "SELECT 'd' || n_regionkey AS dataset, 'baseline' AS section, CAST(2 * n_regionkey / 11.0 AS DOUBLE) AS qa_accuracy, CAST(11 AS BIGINT) AS weight, n_name AS feature, 'auroc' AS metric, CAST(n_nationkey / 100.0 AS DOUBLE) AS value, CAST(0.25 AS DOUBLE) AS std FROM nation UNION ALL SELECT 'd' || r_regionkey, 'selection', 2 * r_regionkey / 11.0, 11, 'ad', 'prr', r_regionkey / 4.0, NULL FROM region"


@query(f"SELECT dataset, section, round(qa_accuracy, 6) AS qa_accuracy, weight, feature, metric, value, std FROM ({_FOLDED})")
def fold_results(spark, sf_dir):
    """K-fold summaries by section, entries with a deviation or plain numbers; accuracy pooled over the folds."""
    found = files.load_kfold_results(spark, files.find_kfold_summaries([fold_folders(spark, sf_dir)]))
    return found.select("dataset", F.substring_index("run_dir", "/", -1).alias("section"), r6("qa_accuracy"), "weight", "feature", "metric", "value", "std")


@query("SELECT 'plain' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'folded', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)")
def plain_and_folded_results(spark, sf_dir):
    """Plain and folded results in one table, by names of columns; runs inside folded ones are left out."""
    folds = fold_folders(spark, sf_dir)
    plain = files.load_run_results(spark, files.find_metrics_files([run_folders(spark, sf_dir), folds]))
    other = files.load_kfold_results(spark, files.find_kfold_summaries([folds]))
    nested = spark.createDataFrame([(p.rsplit("/", 2)[0],) for p in files.find_kfold_summaries([folds])], "run_dir string")
    both = report.without_nested(plain, nested).withColumn("kind", L("plain")).unionByName(other.withColumn("kind", L("folded")), allowMissingColumns=True)
    return both.groupBy("kind").agg(F.count("*").alias("n"))


# --- configuration and names -----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, array_to_string(list_sort(list_distinct(CASE o_orderkey % 3 WHEN 0 THEN [o_orderkey, o_custkey, o_custkey + 1] WHEN 1 THEN [o_custkey] ELSE [] END::BIGINT[])), ',') AS eos, array_to_string(list_sort(list_distinct(list_concat(CASE o_orderkey % 3 WHEN 0 THEN [o_orderkey, o_custkey, o_custkey + 1] WHEN 1 THEN [o_custkey] ELSE [] END::BIGINT[], CASE WHEN o_orderstatus = 'O' THEN [7] ELSE [7, 100 + o_custkey % 5] END::BIGINT[]))), ',') AS special FROM orders")
def special_token_ids(spark, sf_dir):
    """Ends of text and turn gathered from several settings of each configuration, and special ids with mask and padding."""
    k = C("o_orderkey")
    eos = [F.when(k % 3 == 0, F.array(C("o_custkey"), C("o_custkey") + 1)), F.when(k % 3 == 0, F.array(k, C("o_custkey"))).when(k % 3 == 1, F.array(C("o_custkey"), C("o_custkey")))]
    other = [F.array(L(7)), F.when(C("o_orderstatus") != "O", F.array(100 + C("o_custkey") % 5, L(None)))]
    ids = config.special_ids_columns(eos, other)
    joined = lambda c: F.concat_ws(",", ids[c].cast("array<string>")).alias(c)
    return table(spark, sf_dir, "orders").select("o_orderkey", joined("eos"), joined("special"))


_SETTINGS = "(VALUES ('gsm8k', 256, 256, 32, 'exact_match'), ('triviaqa', 32, 32, 32, 'llm_judge'), ('wmt14_fr_en', 128, 128, 32, 'llm_judge'), ('xsum', 128, 128, 32, 'llm_judge'), ('samsum', 128, 128, 32, 'llm_judge'), ('hotpotqa', 64, 64, 32, 'llm_judge'), ('musique', 64, 64, 32, 'llm_judge')) AS d(dataset, len, steps, block, method)"


_ASKED = "SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'LLaDA' ELSE 'LLaDA1.5' END AS model, list_extract(['gsm8k', 'triviaqa', 'wmt14_fr_en', 'xsum', 'samsum', 'hotpotqa', 'musique', 'none'], CAST(1 + o_custkey % 8 AS INT)) AS dataset, CASE WHEN o_orderstatus = 'O' THEN 'lc' ELSE 'rd' END AS remasking, CASE WHEN o_custkey % 3 > 0 THEN 8 * (o_orderkey % 11) END AS own FROM orders"


@query(f"WITH a AS ({_ASKED}), g AS (SELECT model, dataset, remasking, CAST(len AS INT) AS max_gen_length, CAST(coalesce(own, d.steps) AS INT) AS steps, method AS label_method, model || '_' || dataset || '_l' || len || '_s' || coalesce(own, d.steps) || '_' || remasking || '_b' || block AS run_id FROM a JOIN {_SETTINGS} USING (dataset)) SELECT * FROM g WHERE run_id NOT IN (SELECT run_id FROM g WHERE steps % 5 = 0 AND remasking = 'rd')")
def config_grid(spark, sf_dir):
    """The models, data sets, strategies and step counts that orders ask for, with their settings, without run ids that exist already."""
    k = C("o_orderkey")
    names = F.array(*map(L, ["gsm8k", "triviaqa", "wmt14_fr_en", "xsum", "samsum", "hotpotqa", "musique", "none"]))
    dataset, steps = F.get(names, (C("o_custkey") % 8).cast("int")), F.when(C("o_custkey") % 3 > 0, 8 * (k % 11)).cast("int")
    asked = table(spark, sf_dir, "orders").select(F.when(k % 2 == 0, "LLaDA").otherwise("LLaDA1.5").alias("model"), dataset.alias("dataset"), F.when(C("o_orderstatus") == "O", "lc").otherwise("rd").alias("remasking"), steps.alias("steps")).distinct()
    existing = config.configured(asked).where("steps % 5 = 0 AND remasking = 'rd'")
    return config.configured(asked, existing).select("model", "dataset", "remasking", "max_gen_length", "steps", "label_method", "run_id")


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey WHEN o_orderkey % 3 = 0 THEN 64 ELSE 128 END AS INT) AS steps, CASE o_orderkey % 4 WHEN 0 THEN 'low_confidence' WHEN 1 THEN 'random' WHEN 2 THEN 'other' ELSE 'low_confidence' END AS remasking, CAST(CASE WHEN o_orderstatus = 'O' THEN 16 ELSE 8 END AS INT) AS batch_size, 64 AS top_k FROM orders")
def layered_config(spark, sf_dir):
    """What is given over a configuration over the defaults; strategies by their full names, unknown ones as they are."""
    k = C("o_orderkey")
    given = {"steps": F.when(k % 2 == 0, C("o_custkey")).cast("int"), "remasking": F.when(k % 4 == 0, "lc").when(k % 4 == 1, "rd").when(k % 4 == 2, "other")}
    own = {"steps": F.when(k % 3 == 0, 64), "batch_size": F.when(C("o_orderstatus") == "O", 16)}
    made = config.resolved_columns(given, own)
    return table(spark, sf_dir, "orders").select("o_orderkey", made["steps"].alias("steps"), config.remasking_name(made["remasking"]).alias("remasking"), made["batch_size"].alias("batch_size"), made["top_k"].alias("top_k"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'LLaDA' WHEN 1 THEN 'LLaDA1.5' WHEN 2 THEN 'LLaDA' ELSE 'm' || o_custkey END AS model FROM orders")
def model_names(spark, sf_dir):
    """By exact id, by the first name within the id whatever its case, else the id itself."""
    k = C("o_orderkey")
    given = F.when(k % 4 == 0, "GSAI-ML/LLaDA-8B-Instruct").when(k % 4 == 1, "GSAI-ML/LLaDA-1.5").when(k % 4 == 2, "local/my-LLADA1.5-run").otherwise(F.concat(L("m"), C("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", report.model_name(given).alias("model"))


_NAMES = "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN [' ', NULL] WHEN 2 THEN ['PRR', ' ece ,prr'] WHEN 3 THEN [CASE WHEN o_custkey % 2 = 0 THEN 'Auprc,brier' ELSE 'brier' END, 'AUPRC'] ELSE ['prr', lower(o_orderstatus)] END"


@query(f"WITH g AS (SELECT o_orderkey, list_filter(list_transform(string_split(array_to_string(list_filter(coalesce({_NAMES}, []), lambda m: m IS NOT NULL), ','), ','), lambda m: lower(trim(m))), lambda m: m <> '') AS n FROM orders), u AS (SELECT o_orderkey, CASE WHEN len(n) = 0 THEN ['auroc'] ELSE list_filter(n, lambda m, i: list_position(n, m) = i) END AS n FROM g) SELECT o_orderkey, CASE WHEN len(list_filter(n, lambda m: NOT list_contains(['auroc', 'auprc', 'prr', 'ece', 'brier', 'spearman_rho', 'kendall_tau'], m))) = 0 THEN array_to_string(n, ',') END AS names FROM u")
def report_metric_names(spark, sf_dir):
    """Names split at commas, in lower case, each once; the default without any; null for an unknown one."""
    k = C("o_orderkey")
    given = F.when(k % 5 == 1, F.array(L(" "), L(None))).when(k % 5 == 2, F.array(L("PRR"), L(" ece ,prr"))).when(k % 5 == 3, F.array(F.when(C("o_custkey") % 2 == 0, "Auprc,brier").otherwise("brier"), L("AUPRC"))).when(k % 5 == 4, F.array(L("prr"), F.lower("o_orderstatus")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(report.normalized_metrics(given), ",").alias("names"))


@query("SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 6 ELSE 7 END AS INT) AS dataset_place, CAST(CASE WHEN o_orderstatus = 'O' THEN 0 WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS INT) AS strategy_place FROM orders")
def report_places(spark, sf_dir):
    """Places in the fixed orders of data sets and strategies; unknown names come last."""
    k = C("o_orderkey")
    dataset = F.when(k % 4 == 0, "triviaqa").when(k % 4 == 1, "gsm8k").when(k % 4 == 2, "musique").otherwise("new")
    strategy = F.when(C("o_orderstatus") == "O", "lc").when(C("o_orderstatus") == "F", "rd").otherwise("x")
    return table(spark, sf_dir, "orders").select("o_orderkey", report.order_index(dataset, config.DATASETS).alias("dataset_place"), report.order_index(strategy, tuple(config.STRATEGIES)).alias("strategy_place"))


# --- records ---------------------------------------------------------------------------------------------------------


def marked_orders(spark, sf_dir) -> DataFrame:
    k = C("o_orderkey")
    raw = F.when(k % 5 == 0, " ").otherwise(F.concat(L("so #### "), (C("o_custkey") % 3).cast("string")))
    return table(spark, sf_dir, "orders").select(C("o_orderkey").alias("sample_id"), k.cast("string").alias("prompt_id"), raw.alias("raw_answer"), L("1").alias("reference_answer"), F.when(k % 2 == 0, L(True)).alias("label"), L("greedy").alias("generation_mode"))


@query("SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 2 = 0 THEN true ELSE o_orderkey % 5 <> 0 AND o_custkey % 3 = 1 END AS label, CASE WHEN o_orderkey % 2 = 1 THEN 'exact_match' END AS method FROM orders")
def label_what_has_none(spark, sf_dir):
    """Records that have a label keep it; the others are labelled."""
    return labeling.label_records(marked_orders(spark, sf_dir), "gsm8k").select("sample_id", "label", C("final.correctness_method").alias("method"))


@query("SELECT o_orderkey AS sample_id, o_orderkey % 5 <> 0 AND o_custkey % 3 = 1 AS label FROM orders")
def label_all_samples(spark, sf_dir):
    return labeling.label_samples(marked_orders(spark, sf_dir), "gsm8k").select("sample_id", "label")


@query("SELECT 'n' AS feature, count(*) FILTER (o_orderkey % 3 > 0) AS n, sum(CASE WHEN o_orderkey % 3 = 2 THEN 1 ELSE 0 END)::BIGINT AS errors FROM orders")
def labelled_scores(spark, sf_dir):
    """Rows without a label are left out; an error is an answer that is not correct."""
    rows = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("prompt_id"), F.when(C("o_orderkey") % 3 == 1, L(True)).when(C("o_orderkey") % 3 == 2, L(False)).alias("is_correct"), C("o_totalprice").alias("n"))
    return metrics.long_scores(rows, ["n"]).groupBy("feature").agg(F.count("*").alias("n"), F.sum(C("y").cast("bigint")).alias("errors"))


@query("SELECT o_custkey AS prompt_id, min(o_orderkey) AS response_sample_id, arg_min(o_orderstatus, o_orderkey) AS final_answer FROM orders GROUP BY 1")
def first_trajectory(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(C("o_custkey").alias("prompt_id"), C("o_orderkey").alias("response_sample_id"), C("o_orderstatus").alias("final_answer"))
    return trajectory.target_trajectory(rows).select("prompt_id", "response_sample_id", "final_answer")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'raw' || o_custkey WHEN 1 THEN 'answer' WHEN 2 THEN 'response' ELSE '' END AS final, CASE WHEN o_orderkey % 4 = 0 THEN 'raw' || o_custkey ELSE '' END AS response FROM orders")
def final_answers(spark, sf_dir):
    """The stripped raw answer, else the final record's; a judge is given the raw answer alone."""
    k = C("o_orderkey")
    raw = F.when(k % 4 == 0, F.concat(L("  raw"), C("o_custkey").cast("string"), L("\n")))
    final = F.struct(F.when(k % 4 == 1, " answer").alias("answer"), F.when(k % 4 == 2, "response ").alias("response"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw_answer"), final.alias("final"))
    return rows.select("o_orderkey", prompts.final_answer(rows.columns).alias("final"), labeling.response_text().alias("response"))


def ranked_tensor(spark, sf_dir) -> DataFrame:
    """Events as a tensor of three ranks: the first has the event's log-probability, the others one and two less."""
    rows = event_tokens(spark, sf_dir).withColumn("rank", F.explode(F.array(L(2), L(0), L(1))))
    return rows.select("sample_id", "pos", "rank", (C("pos") * 10 + C("rank")).alias("token_id"), (C("lp") - C("rank")).alias("logprob"))


@query(f"WITH {TOKENS}, a AS (SELECT DISTINCT sample_id FROM t UNION ALL SELECT -1) SELECT a.sample_id, t.pos, CAST(t.pos * 10 AS INT) AS token_id, round(lp, 6) AS lp, round(lp - 2, 6) AS third FROM a LEFT JOIN t USING (sample_id)")
def final_pass_logprobs(spark, sf_dir):
    """The first rank and all ranks of each position, met by answers; an answer without a tensor gets nulls."""
    last = tokens.last_pass(ranked_tensor(spark, sf_dir))
    answers = table(spark, sf_dir, "events").select(C("user_id").alias("sample_id")).distinct().unionByName(spark.createDataFrame([(-1,)], "sample_id bigint"))
    return answers.join(last, "sample_id", "left").select("sample_id", "pos", "token_id", r6("lp"), r6(F.get("top_lp", L(2)), "third"))


@query("SELECT CAST(p_partkey AS INT) AS sample_id, p_name AS question, 'a' || p_size AS raw_answer, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand END AS first_alias, CAST(NULL AS BOOLEAN) AS label FROM part")
def zipped_answers(spark, sf_dir):
    """Samples met by their answers by place; empty aliases become the reference answer."""
    p = table(spark, sf_dir, "part")
    aliases = F.when(C("p_size") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand"))
    samples = p.select(C("p_partkey").alias("ord"), C("p_name").alias("question"), C("p_type").alias("reference_answer"), aliases.alias("aliases"))
    answers = p.select(C("p_partkey").alias("ord"), F.concat(L("a"), C("p_size").cast("string")).alias("raw_answer"))
    return prompts.answer_records(samples, answers).select("sample_id", "question", "raw_answer", F.get("aliases", L(0)).alias("first_alias"), "label")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '1234' WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN '-3.5' ELSE '' END AS y FROM part")
def parsed_responses(spark, sf_dir):
    x = F.when(C("p_size") % 4 == 0, "so 7 #### 1,234").when(C("p_size") % 4 == 1, F.concat(L("The answer is 3 or "), C("p_size").cast("string"), L(".0"))).when(C("p_size") % 4 == 2, "-3.5").otherwise("no numbers here")
    return table(spark, sf_dir, "part").select("p_partkey", text.parse_response(x).alias("y"))


# --- plans -----------------------------------------------------------------------------------------------------------


@query(f"WITH {TOKENS} SELECT sample_id AS prompt_id, sample_id % 2 = 0 AS is_correct, CAST(count(*) AS INT) AS n_visible_tokens, round(exp(sum(lp)), 9) AS msp, round(exp(-avg(lp)), 6) AS perplexity, CAST(NULL AS DOUBLE) AS mcnse FROM t WHERE sample_id % 3 > 0 GROUP BY sample_id")
def run_features(spark, sf_dir):
    """Feature rows of a run without samples, as a known program makes them; prompts without a label are left out."""
    tensor = event_tokens(spark, sf_dir).select("sample_id", "pos", L(0).alias("rank"), C("pos").cast("int").alias("token_id"), C("lp").alias("logprob"))
    k = C("user_id")
    answers = table(spark, sf_dir, "events").select(k).distinct().select(k.alias("sample_id"), k.cast("string").alias("qa_example_id"), F.when(k % 3 > 0, k % 2 == 0).alias("label"), L("greedy").alias("generation_mode"), L("x").alias("raw_answer"))
    rows = pipeline.build_features(answers, tensor, compat=True)
    return rows.select(C("prompt_id").cast("bigint").alias("prompt_id"), "is_correct", "n_visible_tokens", F.round("msp", 9).alias("msp"), r6("perplexity"), "mcnse")


@query(f"WITH {DISTANCE}, m AS (SELECT t FROM fin GROUP BY t ORDER BY count(*) DESC, min(prompt_id) LIMIT 1), a AS (SELECT prompt_id, avg(d) AS ad FROM ds JOIN fin USING (prompt_id) JOIN m USING (t) GROUP BY prompt_id) SELECT doc_id AS prompt_id, round(ad, 5) AS ad FROM labels LEFT JOIN a ON prompt_id = doc_id")
def run_baselines(spark, sf_dir):
    """Rows with the averaged dissimilarity of their trajectory; those of another length, or without one, have null."""
    rows = table(spark, sf_dir, "labels").select(C("doc_id").cast("string").alias("prompt_id"))
    talks = talk_trajectories(spark, sf_dir).select(C("prompt_id").cast("string").alias("prompt_id"), L(0).alias("response_sample_id"), "num_steps", "step_answers", "final_answer", C("prompt_id").alias("ord"))
    return pipeline.baseline_features(rows, talks, random_scopes=0).select(C("prompt_id").cast("bigint").alias("prompt_id"), F.round("full-ad", 5).alias("ad"))


#: Scopes of the turns: in scope 0 and 1 of a trajectory lie about two thirds of its steps.
_DRAWN = "(i * 7 + rep * 3 + prompt_id) % 5 > 1"
#: From edges ed: the clusters' entropies ge and the eigenvalue score ev of each prompt.
_GRAPH = """ge AS (SELECT prompt_id, max(n) AS n, CASE WHEN count(*) = 1 THEN 0 ELSE -sum(c / CAST(n AS DOUBLE) * ln(c / CAST(n AS DOUBLE))) END AS m, sum(CASE WHEN c > 1 THEN c / CAST(n AS DOUBLE) * ln(c) ELSE 0 END) / nullif(ln(max(n)), 0) AS k FROM cs GROUP BY prompt_id),
ev AS (SELECT prompt_id, 1 - sum(CASE WHEN i <> j THEN greatest(w, 0) ELSE 0 END) / max(n) AS e FROM ed GROUP BY prompt_id)"""


@query(
    f"WITH RECURSIVE {STEPS}, mo AS (SELECT t FROM fin GROUP BY t ORDER BY count(*) DESC, min(prompt_id) LIMIT 1), "
    f"sc AS (SELECT prompt_id || '|' || rep AS prompt_id, CAST(row_number() OVER w - 1 AS INT) AS i, CAST(count(*) OVER (PARTITION BY prompt_id, rep) AS INT) AS n, text, ws FROM tk JOIN fin USING (prompt_id) JOIN mo USING (t), (VALUES (0), (1)) AS r(rep) WHERE {_DRAWN} AND text NOT IN ('', 'None') WINDOW w AS (PARTITION BY prompt_id, rep ORDER BY i)), "
    f"ed AS (SELECT a.prompt_id, a.n, a.i, b.i AS j, CASE WHEN a.i = b.i THEN 1 ELSE CAST(CAST({JACCARD} AS FLOAT) AS DOUBLE) END AS w FROM sc a JOIN sc b USING (prompt_id)){CLUSTERS[len(EDGES):]}, {_GRAPH}, "
    "f AS (SELECT prompt_id, round(m, 5) AS m, round(k, 5) AS k, round(e, 5) AS e FROM ge JOIN ev USING (prompt_id) WHERE n > 1) "
    "SELECT fin.prompt_id, CAST(rep AS INT) AS rep, f.m AS se_marginal, f.k AS se_conditional, f.e AS eigval FROM fin, (VALUES (0), (1)) AS r(rep) LEFT JOIN f ON f.prompt_id = fin.prompt_id || '|' || rep"
)
def run_baselines_scoped(spark, sf_dir):
    """Features of two scopes of each first trajectory, whose steps a rule picks in place of the generator."""
    talks = talk_trajectories(spark, sf_dir).select(C("prompt_id").cast("string").alias("prompt_id"), L(0).alias("response_sample_id"), "num_steps", "step_answers", "final_answer", C("prompt_id").alias("ord"))
    rep = F.explode(F.array(L(0), L(1))).alias("rep")
    draws = talk_steps(spark, sf_dir).select("prompt_id", C("step").alias("i"), rep).where(_DRAWN).select(C("prompt_id").cast("string").alias("prompt_id"), "rep", C("i").alias("step"))
    found = pipeline.baseline_features(talks.select("prompt_id"), talks, random_scopes=2, draws=draws)
    names = ("se-marginal", "se-conditional", "eigval")
    each = F.explode(F.array(*[F.struct(L(r).alias("rep"), *[F.round(f"random-{r}-{f}", 5).alias(f.replace("-", "_")) for f in names]) for r in (0, 1)])).alias("s")
    return found.select(C("prompt_id").cast("bigint").alias("prompt_id"), each).select("prompt_id", "s.*")


@query(
    f"WITH RECURSIVE {CLUSTERS}, {TOKENS}, {_GRAPH}, q AS (SELECT prompt_id, sample_id, avg(-lp) AS m FROM v GROUP BY ALL), f AS (SELECT 'se-marginal' AS feature, prompt_id AS id, m AS value FROM ge UNION ALL SELECT 'se-conditional', prompt_id, k FROM ge UNION ALL SELECT 'eigval', prompt_id, e FROM ev "
    "UNION ALL SELECT 'msp', sample_id, exp(sum(lp)) FROM v GROUP BY sample_id UNION ALL SELECT 'perplexity', sample_id, exp(-avg(lp)) FROM v GROUP BY sample_id UNION ALL SELECT 'mcnse', prompt_id, avg(m) FROM q GROUP BY prompt_id) SELECT feature, CAST(id AS BIGINT) AS id, round(value, 6) AS value, true AS took_time FROM f"
)
def timed_kernels(spark, sf_dir):
    """Values of timed features: a timed operator gives what the operator gives, and takes time."""
    edges, seen = vector_edges(spark, sf_dir), seen_tokens(spark, sf_dir)
    out = None
    for feature in ("se-marginal", "se-conditional", "eigval", "msp", "perplexity", "mcnse"):
        seconds, values = timing.timed_feature(feature, edges if feature in ("se-marginal", "se-conditional", "eigval") else seen)
        rows = values.select(L(feature).alias("feature"), C(values.columns[0]).cast("bigint").alias("id"), r6("value"), L(seconds > 0).alias("took_time"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT CAST(v.run AS VARCHAR) AS run, CAST(s AS INT) AS sample_id, CAST(i // 4 AS INT) AS pos, CAST(i % 4 AS INT) AS rank, CAST(label * 100 + i AS INT) AS token_id, round(CAST(embedding[i + 1] AS DOUBLE), 5) AS logprob FROM (SELECT vec_id // 100 AS run, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) - 1 AS s, label, embedding FROM embeddings WHERE len(embedding) = 64) v, (SELECT CAST(unnest(range(64)) AS INT) AS i) WHERE s >= 3")
def tensor_files(spark, sf_dir):
    """Vectors as tensors of 16 positions and 4 ranks, a hundred samples a run, written as array files and read in ranges."""
    run, path = (C("vec_id") / 100).cast("bigint"), place(spark, "tensors")
    vectors = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).withColumn("run", run)
    numbered = vectors.withColumn("sample_id", (F.row_number().over(Window.partitionBy("run").orderBy("vec_id")) - 1).cast("int"))
    long = numbered.select("run", "sample_id", "label", F.posexplode("embedding").alias("i", "logprob"))
    write_tensors(long.select("run", "sample_id", F.floor(C("i") / 4).cast("int").alias("pos"), (C("i") % 4).alias("rank"), (C("label") * 100 + C("i")).cast("int").alias("token_id"), "logprob"), path)
    read = read_tensors(spark, path, cells=1_000, low=3)
    return read.select(F.regexp_extract("run", "([^/]+)$", 1).alias("run"), "sample_id", "pos", "rank", "token_id", F.round(C("logprob").cast("double"), 5).alias("logprob"))


@query(
    f"WITH RECURSIVE {CLUSTERS}, g AS (SELECT prompt_id, max(n) AS n, CASE WHEN count(*) = 1 THEN 0 ELSE -sum(c / CAST(n AS DOUBLE) * ln(c / CAST(n AS DOUBLE))) END AS m, sum(CASE WHEN c > 1 THEN c / CAST(n AS DOUBLE) * ln(c) ELSE 0 END) / ln(max(n)) AS k FROM cs GROUP BY prompt_id), "
    "e AS (SELECT prompt_id, 1 - sum(CASE WHEN i <> j THEN greatest(w, 0) ELSE 0 END) / max(n) AS e FROM ed GROUP BY prompt_id) SELECT prompt_id, round(m, 6) AS se_marginal, round(k, 6) AS se_conditional, round(e, 6) AS eigval FROM g JOIN e USING (prompt_id)"
)
def graph_features(spark, sf_dir):
    """The driver of all graph features; those that SQL can express."""
    return graph.graph_features(vector_edges(spark, sf_dir)).select("prompt_id", r6("se_marginal"), r6("se_conditional"), r6("eigval"))


@query(f"WITH {STEPS} SELECT prompt_id, CAST(rep AS INT) AS rep, least(3, t) AS n, true AS distinct_and_within FROM fin, (VALUES (0), (1)) AS r(rep)")
def random_scope_counts(spark, sf_dir):
    """Random scopes of each prompt: as many steps as asked for or there are, distinct and within the trajectory."""
    talks = talk_trajectories(spark, sf_dir).withColumn("idx", C("prompt_id"))
    drawn = trajectory.random_scope_steps(talks, 42, 3, 2).join(talks.select("prompt_id", "num_steps"), "prompt_id")
    return drawn.groupBy("prompt_id", "rep").agg(F.count("*").cast("int").alias("n"), ((F.countDistinct("step") == F.count("*")) & (F.min("step") >= 0) & (F.max(C("step") - C("num_steps")) < 0)).alias("distinct_and_within"))


@query(f"WITH {TALK} SELECT a.prompt_id, a.i, b.i AS j, CASE WHEN a.text < b.text THEN 0.25 ELSE round(CAST(CAST({JACCARD} AS FLOAT) AS DOUBLE), 5) END::DOUBLE AS p FROM tk a JOIN tk b ON a.prompt_id = b.prompt_id")
def cached_pairs(spark, sf_dir):
    """Pairs whose premise comes first in order are in the cache, and keep its score; the others are scored."""
    asked = talk_pairs(spark, sf_dir)
    cache = asked.where("premise < hypothesis").select("premise", "hypothesis", L(0.5).alias("p_contradiction"), L(0.25).alias("p_neutral"), L(0.25).alias("p_entailment"), L(0).alias("cls"))
    return graph.scored_pairs(asked, JaccardScorer(), cache).select("prompt_id", "i", "j", F.round("p_entailment", 5).alias("p"))


class _Quarter:
    """A scorer that gives every pair a quarter, to be told from another."""

    def score(self, pairs: DataFrame) -> DataFrame:
        return pairs.select("premise", "hypothesis", L(0.5).alias("p_contradiction"), L(0.25).alias("p_neutral"), L(0.25).alias("p_entailment"), L(0).alias("cls"))


@query(
    f"WITH {TALK}, a AS (SELECT a.prompt_id, a.i, b.i AS j, a.text AS x, b.text AS y, {JACCARD} AS p FROM tk a JOIN tk b ON a.prompt_id = b.prompt_id), k AS (SELECT DISTINCT x, y FROM a WHERE i < j)"
    " SELECT prompt_id, i, j, CASE WHEN k.x IS NULL THEN round(CAST(CAST(p AS FLOAT) AS DOUBLE), 5) ELSE 0.25 END::DOUBLE AS p, (SELECT count(*) FROM (SELECT DISTINCT x, y FROM a)) AS stored, (SELECT count(*) FROM (SELECT DISTINCT x, y FROM a)) AS once FROM a LEFT JOIN k ON a.x IS NOT DISTINCT FROM k.x AND a.y IS NOT DISTINCT FROM k.y"
)
def pair_cache_runs(spark, sf_dir):
    """Two runs over one cache: pairs that look forward are scored in the first, and the second scores the others alone."""
    cache = PairCache(spark, place(spark, "pair-cache"), "talks", 4)
    asked = talk_pairs(spark, sf_dir)
    cache.scored(asked.where("i < j"), _Quarter()).count()
    found = cache.scored(asked, JaccardScorer())
    stored = cache.rows().count()
    cache.compact()
    return found.select("prompt_id", "i", "j", F.round("p_entailment", 5).alias("p"), L(stored).cast("bigint").alias("stored"), L(cache.rows().count()).cast("bigint").alias("once"))



@query("SELECT p_partkey, CASE WHEN 48 % b = 0 THEN CAST(48 // b AS INT) END AS blocks, CASE WHEN 48 % b = 0 THEN CAST(p_size // (48 // b) AS INT) END AS steps FROM (SELECT *, CASE WHEN p_size % 5 = 0 THEN 48 ELSE 1 + p_size % 7 END AS b FROM part)")
def block_counts(spark, sf_dir):
    """Blocks of a length and steps a block over a table of configurations; without a block size, one block."""
    made = denoise.block_counts(L(48), F.when(C("p_size") % 5 > 0, 1 + C("p_size") % 7), C("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", made["blocks"].alias("blocks"), made["steps"].alias("steps"))


@query("WITH w AS (SELECT vec_id, 1 + vec_id % 7 AS k, unnest(range(0, 12)) AS step, floor(unnest(embedding[1:12])::DOUBLE * 20) / 20 AS w FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, step) AS place FROM w) SELECT vec_id, CAST(step AS INT) AS step, CASE WHEN w > 0 AND place <= k THEN 1.0 / k ELSE 0 END::DOUBLE AS weight FROM r")
def binarized_weights(spark, sf_dir):
    """Weights of the k largest of twelve steps, from each vector's numbers, which are rounded so that some are equal."""
    weights = F.transform(F.slice("embedding", 1, 12), lambda v: F.floor(v.cast("double") * 20) / 20)
    made = trajectory.top_step_weights(weights, (1 + C("vec_id") % 7).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(made).alias("step", "weight"))


@query(
    "WITH p AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 4 AS step, embedding FROM embeddings), x AS (SELECT label, step, unnest(range(1, len(embedding) + 1)) AS k, unnest(embedding)::DOUBLE AS v FROM p), "
    "s AS (SELECT label, step, k, sum(v) AS v, sum(v * v) AS q, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT label, step, max(n) AS n, sum(q) AS q, sum(v * v) AS vv FROM s GROUP BY ALL) SELECT label, round(sum(q / n - (vv - q) / (n * (n - 1))), 4) AS trace FROM t GROUP BY label"
)
def kernel_trace(spark, sf_dir):
    """The trace of C - A_U: mean squared lengths less mean products of different trajectories, step by step."""
    vectors = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", L(1).alias("one"))
    placed = prefix_sums(vectors, ["label"], "vec_id", ["one"]).withColumnRenamed("one_before", "at")
    points = placed.select("label", F.floor(C("at") / 4).alias("trajectory"), (C("at") % 4).alias("step"), "embedding")
    return trajectory.kernel_matrices_by_group(points, "label").select("label", F.round("trace", 4).alias("trace"))
