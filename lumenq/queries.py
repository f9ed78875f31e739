"""The registered queries: every operator bound to the driver's tables, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenq.backends import JaccardScorer, ScriptedJudge
from lumenq.config import MODEL_IDS, run_id_column
from lumenq.functions import arrays, text
from lumenq.operators import denoise, features, graph, labeling, metrics, prompts, report, resample, tokens, trajectory
from lumenq.operators.prefix import prefix_sums

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
C, L = F.col, F.lit


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str, name: str | None = None) -> Column:
    c = C(x) if isinstance(x, str) else x
    return F.round(c.cast("double"), 6).alias(name or x)


# --- scores as error detectors ---------------------------------------------------------------------------------------

FEATURES = ("n_chars", "n_chars_mod", "spaces", "toxic")
BASE = """f AS (SELECT d.doc_id AS id, CAST(1 - l.quality AS INT) AS y, CAST(d.n_chars AS DOUBLE) AS a, CAST(d.n_chars % 50 AS DOUBLE) AS b,
      CAST(length(d.text) - length(replace(d.text, ' ', '')) AS DOUBLE) AS c, CAST(l.toxic AS DOUBLE) AS t FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
base AS (SELECT 'n_chars' AS feature, id, y, a AS s FROM f UNION ALL SELECT 'n_chars_mod', id, y, b FROM f
      UNION ALL SELECT 'spaces', id, y, c FROM f UNION ALL SELECT 'toxic', id, y, t FROM f)"""
RANKED = f"""{BASE},
rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY s) + (count(*) OVER (PARTITION BY feature, s) - 1) / CAST(2 AS DOUBLE) AS ar,
      rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / CAST(2 AS DOUBLE) AS ary, count(*) OVER (PARTITION BY feature, s) AS tie FROM base),
tot AS (SELECT feature, count(*) AS n, CAST(sum(y) AS BIGINT) AS p, sum(CASE WHEN y = 1 THEN ar ELSE 0 END) AS rs, sum((tie - 1) / CAST(2 AS DOUBLE)) AS ts, corr(ar, ary) AS rho FROM rk GROUP BY feature),
auc AS (SELECT feature, (rs - p * (p + 1) / CAST(2 AS DOUBLE)) / nullif(CAST(p * (n - p) AS DOUBLE), 0) AS auroc FROM tot),
g AS (SELECT feature, s, sum(y) AS p, count(*) AS c FROM base GROUP BY feature, s),
cum AS (SELECT feature, p, sum(p) OVER w AS tp, sum(c) OVER w AS al, sum(p) OVER (PARTITION BY feature) AS total FROM g WINDOW w AS (PARTITION BY feature ORDER BY s DESC)),
ap AS (SELECT feature, sum(p / CAST(total AS DOUBLE) * (tp / CAST(al AS DOUBLE))) AS auprc FROM cum GROUP BY feature),
tau AS (SELECT feature, (2 * (rs - p * (p + 1) / CAST(2 AS DOUBLE)) - p * (n - p)) / nullif(sqrt((n * (n - 1) / CAST(2 AS DOUBLE) - ts) * CAST(p * (n - p) AS DOUBLE)), 0) AS kendall_tau FROM tot)"""
CURVE = f"""{BASE},
o AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY s, id) AS rn, row_number() OVER (PARTITION BY feature ORDER BY y, id) AS ro, count(*) OVER (PARTITION BY feature) AS n FROM base),
cv AS (SELECT CAST(unnest([1.0, 0.9, 0.8, 0.7, 0.6, 0.5]) AS DOUBLE) AS coverage),
ck AS (SELECT o.*, coverage, greatest(1, CAST(round_even(coverage * n, 0) AS BIGINT)) AS k FROM o, cv),
curve AS (SELECT feature, coverage, max(k) AS k, avg(CASE WHEN rn <= k THEN y END) AS risk, avg(CASE WHEN ro <= k THEN y END) AS best, avg(y) AS base_risk FROM ck GROUP BY feature, coverage),
tr AS (SELECT feature, (lead(coverage) OVER w - coverage) AS dx, (lead(risk) OVER w + risk) / 2 AS m, (lead(best) OVER w + best) / 2 AS b, base_risk FROM curve WINDOW w AS (PARTITION BY feature ORDER BY coverage)),
pr AS (SELECT feature, (sum(dx * base_risk) - sum(dx * m)) / (sum(dx * base_risk) - sum(dx * b)) AS prr FROM tr GROUP BY feature)"""
SCALED = """sc AS (SELECT feature, id, y, (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) AS u FROM base WINDOW w AS (PARTITION BY feature)),
bn AS (SELECT feature, y, u, CAST(len(list_filter(range(1, 10), lambda i: u >= i * CAST(0.1 AS DOUBLE))) AS INT) AS bin FROM sc),
bb AS (SELECT feature, bin, count(*) AS c, abs(avg(y) - avg(u)) AS gap FROM bn GROUP BY feature, bin),
ec AS (SELECT feature, sum(c * gap) / sum(c) AS ece FROM bb GROUP BY feature),
br AS (SELECT feature, avg((u - y) * (u - y)) AS brier FROM sc GROUP BY feature)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scores of labelled documents in long form; an error is a document of quality 0."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    values = {"n_chars": C("n_chars"), "n_chars_mod": C("n_chars") % 50, "spaces": F.length("text") - F.length(F.replace("text", L(" "), L(""))), "toxic": C("toxic")}
    wide = d.join(l, "doc_id").select(C("doc_id").alias("id"), (1 - C("quality")).cast("int").alias("y"), *[v.cast("double").alias(k) for k, v in values.items()])
    return wide.unpivot(["id", "y"], list(FEATURES), "feature", "s").where("s is not null")


@query(f"WITH {RANKED} SELECT feature, round(auroc, 6) AS auroc FROM auc")
def auroc(spark, sf_dir):
    return metrics.rank_metrics(scores(spark, sf_dir)).select("feature", r6("auroc"))


@query(f"WITH {RANKED} SELECT feature, round(auprc, 6) AS auprc FROM ap")
def auprc(spark, sf_dir):
    return metrics.rank_metrics(scores(spark, sf_dir)).select("feature", r6("auprc"))


@query(f"WITH {RANKED} SELECT feature, round(rho, 6) AS spearman_rho FROM tot")
def spearman(spark, sf_dir):
    return metrics.rank_metrics(scores(spark, sf_dir)).select("feature", r6("spearman_rho"))


@query(f"WITH {RANKED} SELECT feature, round(kendall_tau, 6) AS kendall_tau FROM tau")
def kendall_tau_b(spark, sf_dir):
    return metrics.rank_metrics(scores(spark, sf_dir)).select("feature", r6("kendall_tau"))


@query(f"WITH {CURVE} SELECT feature, round(prr, 6) AS prr FROM pr")
def prr(spark, sf_dir):
    return metrics.rejection_ratio(scores(spark, sf_dir)).select("feature", r6("prr"))


@query(f"WITH {CURVE} SELECT feature, coverage, k, round(risk, 6) AS risk FROM curve")
def risk_curve(spark, sf_dir):
    return metrics.risk_curve(scores(spark, sf_dir)).select("feature", "coverage", "k", r6("risk"))


@query(f"WITH {BASE}, {SCALED} SELECT feature, round(ece, 6) AS ece FROM ec")
def ece(spark, sf_dir):
    return metrics.calibration(scores(spark, sf_dir)).select("feature", r6("ece"))


@query(f"WITH {BASE}, {SCALED} SELECT feature, round(brier, 6) AS brier FROM br")
def brier(spark, sf_dir):
    return metrics.calibration(scores(spark, sf_dir)).select("feature", r6("brier"))


@query(f"WITH {BASE}, {SCALED} SELECT feature, id, round(u, 6) AS u FROM sc")
def minmax(spark, sf_dir):
    return metrics.minmax(scores(spark, sf_dir)).select("feature", "id", r6("u"))


@query(
    f"WITH {BASE}, m AS (SELECT id, CASE feature WHEN 'n_chars' THEN 'msp' WHEN 'n_chars_mod' THEN 'full-ecc' WHEN 'spaces' THEN 'random-2-se-conditional' ELSE 'mte' END AS feature, s FROM base) "
    "SELECT id, feature, CASE WHEN feature = 'mte' THEN s ELSE -s END AS s FROM m"
)
def orient(spark, sf_dir):
    names = {"n_chars": "msp", "n_chars_mod": "full-ecc", "spaces": "random-2-se-conditional", "toxic": "mte"}
    renamed = scores(spark, sf_dir).replace(names, subset=["feature"])
    return features.oriented(renamed, "feature", "s").select("id", "feature", "s")


@query(
    f"WITH {RANKED}, {CURVE.split(BASE + ',')[1].strip()}, {SCALED} SELECT feature, n, tot.p AS pos, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(prr, 6) AS prr, round(ece, 6) AS ece, round(brier, 6) AS brier, "
    "round(rho, 6) AS spearman_rho, round(kendall_tau, 6) AS kendall_tau FROM tot JOIN auc USING (feature) JOIN ap USING (feature) JOIN pr USING (feature) JOIN ec USING (feature) JOIN br USING (feature) JOIN tau USING (feature)"
)
def evaluate_all_features(spark, sf_dir):
    return metrics.evaluate_scores(scores(spark, sf_dir)).select("feature", "n", "pos", *[r6(m) for m in metrics.METRICS])


@query("SELECT count(*) AS n_examples, count(*) FILTER (quality = 1) AS n_correct, count(*) FILTER (quality <> 1) AS n_wrong, round(avg(CAST(quality AS DOUBLE)), 6) AS accuracy, round(avg(n_chars), 6) AS mean_visible_tokens FROM documents JOIN labels USING (doc_id)")
def run_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select((C("quality") == 1).alias("is_correct"), C("n_chars").alias("n_visible_tokens"))
    return metrics.run_summary(rows).select("n_examples", "n_correct", "n_wrong", r6("accuracy"), r6("mean_visible_tokens"))


BOOT = 20
DRAWN = f"""{BASE},
pl AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY feature) AS n FROM base),
dr AS (SELECT feature, n, pos AS draw, unnest(range(0, {BOOT})) AS rep FROM pl),
rs AS (SELECT dr.feature, dr.rep, dr.draw AS id, pl.y, pl.s FROM dr JOIN pl ON pl.feature = dr.feature AND pl.pos = CAST('0x' || substring(md5(concat_ws('-', 0, dr.rep, dr.draw)), 1, 8) AS BIGINT) % dr.n)"""


@query(
    f"WITH {DRAWN}, rk AS (SELECT *, rank() OVER (PARTITION BY feature, rep ORDER BY s) + (count(*) OVER (PARTITION BY feature, rep, s) - 1) / CAST(2 AS DOUBLE) AS ar FROM rs), "
    "a AS (SELECT feature, rep, CAST(sum(y) AS BIGINT) AS p, count(*) AS n, sum(CASE WHEN y = 1 THEN ar ELSE 0 END) AS r FROM rk GROUP BY feature, rep), "
    "v AS (SELECT feature, (r - p * (p + 1) / CAST(2 AS DOUBLE)) / (p * (n - p)) AS v FROM a WHERE p > 0 AND p < n) "
    f"SELECT feature, {BOOT} AS n_bootstrap, count(*) AS valid_bootstrap, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high FROM v GROUP BY feature"
)
def bootstrap_ci(spark, sf_dir):
    out = resample.bootstrap_metrics(scores(spark, sf_dir), BOOT, 0, metrics=["auroc"], measure=metrics.rank_metrics)
    return out.select("feature", "n_bootstrap", "valid_bootstrap", r6("auroc_bootstrap_mean", "mean"), r6("auroc_bootstrap_std", "std"), r6("auroc_ci_low", "ci_low"), r6("auroc_ci_high", "ci_high"))


@query()
def bootstrap_generator_draws(spark, sf_dir):
    n = table(spark, sf_dir, "labels").count()
    return resample.generator_draws(spark, n, 3).groupBy("rep").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("n_distinct"))


@query(
    "WITH m AS (SELECT CASE WHEN o_orderstatus = 'O' THEN 'plain' ELSE 'random-' || (o_custkey % 3) || '-p' || substring(o_orderpriority, 1, 1) END AS feature, avg(o_totalprice) AS v FROM orders GROUP BY 1) "
    "SELECT CASE WHEN feature = 'plain' THEN feature ELSE 'random-' || substring(feature, 10) END AS feature, round(avg(v), 4) AS auroc, nullif(count(*) FILTER (feature <> 'plain'), 0) AS n_random_selections FROM m GROUP BY 1"
)
def random_rep_average(spark, sf_dir):
    name = F.when(C("o_orderstatus") == "O", "plain").otherwise(F.concat(L("random-"), (C("o_custkey") % 3).cast("string"), L("-p"), F.substring("o_orderpriority", 1, 1)))
    rows = table(spark, sf_dir, "orders").groupBy(name.alias("feature")).agg(F.avg("o_totalprice").alias("auroc"))
    return metrics.fold_random(rows, ["auroc"]).select("feature", F.round("auroc", 4).alias("auroc"), "n_random_selections")


@query(
    "WITH v AS (SELECT o_orderstatus AS section, substring(o_orderpriority, 1, 1) AS feature, o_custkey % 5 AS fold, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3) "
    "SELECT section, feature, 'auroc' AS metric, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, CAST(count(*) AS INT) AS n_folds, round(arg_min(value, fold), 4) AS first_fold FROM v GROUP BY section, feature"
)
def kfold_aggregate(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(C("o_orderstatus").alias("section"), F.substring("o_orderpriority", 1, 1).alias("feature"), (C("o_custkey") % 5).alias("fold")).agg(F.avg("o_totalprice").alias("value"))
    out = resample.aggregate_folds(rows.withColumn("metric", L("auroc")))
    return out.select("section", "feature", "metric", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.size("per_fold").alias("n_folds"), F.round(F.get("per_fold", L(0)), 4).alias("first_fold"))


# --- tokens ----------------------------------------------------------------------------------------------------------

TOKENS = """t AS (SELECT user_id AS sample_id, user_id % 10 AS prompt_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS pos, -ln(1 + value) AS lp, event_type FROM events),
e AS (SELECT sample_id, min(pos) FILTER (event_type = 'error') AS stop FROM t GROUP BY sample_id),
v AS (SELECT t.* FROM t JOIN e USING (sample_id) WHERE (stop IS NULL OR pos < stop) AND event_type <> 'signup')"""


def event_tokens(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(C("user_id").alias("sample_id"), (C("user_id") % 10).alias("prompt_id"), (F.row_number().over(w) - 1).alias("pos"), (-F.ln(1 + C("value"))).alias("lp"), "event_type")


def seen_tokens(spark, sf_dir) -> DataFrame:
    return tokens.visible_tokens(event_tokens(spark, sf_dir), C("event_type") == "error", C("event_type") == "signup")


@query(f"WITH {TOKENS} SELECT sample_id, pos FROM v")
def visible_tokens(spark, sf_dir):
    return seen_tokens(spark, sf_dir).select("sample_id", "pos")


@query(f"WITH {TOKENS}, n AS (SELECT sample_id, max(pos) + 1 AS n FROM t GROUP BY sample_id) SELECT sample_id, CAST(count(v.pos) AS INT) AS n_visible, coalesce(CAST(sum(v.pos) AS BIGINT), 0) AS position_sum FROM n LEFT JOIN v USING (sample_id) GROUP BY sample_id")
def visible_positions_array(spark, sf_dir):
    code = F.when(C("event_type") == "error", 50).when(C("event_type") == "signup", 99).otherwise(1)
    ids = event_tokens(spark, sf_dir).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", code.alias("id")))), lambda p: p["id"]).alias("ids"))
    seen = tokens.visible_positions(C("ids"), [99], [50])
    return ids.select("sample_id", F.size(seen).alias("n_visible"), F.aggregate(seen, L(0).cast("bigint"), lambda s, x: s + x).alias("position_sum"))


@query(f"WITH {TOKENS} SELECT sample_id, round(exp(sum(lp)), 9) AS msp FROM v GROUP BY sample_id")
def msp(spark, sf_dir):
    return tokens.msp(seen_tokens(spark, sf_dir)).select("sample_id", F.round("msp", 9).alias("msp"))


@query(f"WITH {TOKENS} SELECT sample_id, round(exp(-avg(lp)), 6) AS perplexity FROM v GROUP BY sample_id")
def perplexity(spark, sf_dir):
    return tokens.perplexity(seen_tokens(spark, sf_dir)).select("sample_id", r6("perplexity"))


ENTROPY = """x AS (SELECT label, list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE))) AS w FROM embeddings),
h AS (SELECT label, -list_sum(list_transform(w, lambda v: CASE WHEN v > 0 THEN v / list_sum(w) * ln(v / list_sum(w)) ELSE 0 END)) AS h FROM x)"""


@query(f"WITH {ENTROPY} SELECT label, round(avg(h), 6) AS mte FROM h GROUP BY label")
def mte(spark, sf_dir):
    return tokens.mean_token_entropy(table(spark, sf_dir, "embeddings"), ["label"], "embedding").select("label", r6("mte"))


@query(f"WITH {TOKENS}, s AS (SELECT prompt_id, sample_id, avg(-lp) AS m FROM v GROUP BY ALL) SELECT prompt_id, round(avg(m), 6) AS mcnse FROM s GROUP BY prompt_id")
def mcnse(spark, sf_dir):
    return tokens.negative_log_likelihood(seen_tokens(spark, sf_dir)).select("prompt_id", r6("mcnse"))


@query("SELECT event_id, round(CASE WHEN x < -745 THEN 0 WHEN x > 709 THEN 1e308 ELSE exp(x) END / 1e290, 6) AS scaled FROM (SELECT event_id, value * 3 - 760 AS x FROM events)")
def safe_exp(spark, sf_dir):
    x = arrays.safe_exp(C("value") * 3 - 760)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.when(x == float("inf"), 1e308).otherwise(x) / 1e290, 6).alias("scaled"))


# --- similarity graphs -----------------------------------------------------------------------------------------------

PICKED = """nb AS (SELECT label AS prompt_id, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS total FROM embeddings),
pk AS (SELECT DISTINCT prompt_id, CAST(round_even(k * (total - 1) / CAST(19 AS DOUBLE), 0) AS BIGINT) AS r FROM (SELECT DISTINCT prompt_id, total FROM nb), (SELECT unnest(range(0, 20)) AS k)),
it AS (SELECT nb.prompt_id, vec_id, embedding, CAST(row_number() OVER (PARTITION BY nb.prompt_id ORDER BY r) - 1 AS INT) AS i, CAST(count(*) OVER (PARTITION BY nb.prompt_id) AS INT) AS n FROM nb JOIN pk USING (prompt_id, r))"""
COSINE = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
EDGES = f"""{PICKED},
nm AS (SELECT *, sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))) AS norm FROM it),
ed AS (SELECT a.prompt_id, a.n, a.i, b.i AS j, CASE WHEN a.i = b.i THEN 1 ELSE {COSINE} / (a.norm * b.norm) END AS w FROM nm a JOIN nm b ON a.prompt_id = b.prompt_id)"""
CLUSTERS = f"""{EDGES},
mr AS (SELECT prompt_id, n, i, list(w ORDER BY j) AS row FROM ed GROUP BY ALL),
mx AS (SELECT prompt_id, n, list(row ORDER BY i) AS m FROM mr GROUP BY ALL),
st AS (SELECT prompt_id, n, m, 0 AS j, [0] AS led FROM mx
  UNION ALL SELECT prompt_id, n, m, j + 1, list_append(led, CAST(coalesce(list_filter(range(0, j + 1), lambda i: led[i + 1] = i AND m[i + 1][j + 2] >= 0.5)[1], j + 1) AS INT)) FROM st WHERE j + 1 < n),
ld AS (SELECT prompt_id, n, unnest(led) AS leader, unnest(range(0, n)) AS i FROM st WHERE j + 1 = n),
cl AS (SELECT prompt_id, n, CAST(i AS INT) AS i, CAST(dense_rank() OVER (PARTITION BY prompt_id ORDER BY leader) - 1 AS INT) AS cluster FROM ld),
cs AS (SELECT prompt_id, n, cluster, count(*) AS c FROM cl GROUP BY ALL)"""


def vector_items(spark, sf_dir) -> DataFrame:
    return graph.subsample(table(spark, sf_dir, "embeddings").withColumnRenamed("label", "prompt_id"), 20, "prompt_id", "vec_id")


def vector_edges(spark, sf_dir) -> DataFrame:
    asked = graph.pairs(vector_items(spark, sf_dir), "embedding").withColumn("p_entailment", arrays.cosine(C("premise"), C("hypothesis")))
    return graph.symmetric(asked)


@query(f"WITH {PICKED} SELECT prompt_id, vec_id, i, n FROM it")
def subsample(spark, sf_dir):
    return vector_items(spark, sf_dir).select("prompt_id", "vec_id", "i", "n")


@query(f"WITH {EDGES} SELECT prompt_id, i, j, round(w, 6) AS w FROM ed")
def symmetric_weights(spark, sf_dir):
    return vector_edges(spark, sf_dir).select("prompt_id", "i", "j", r6("w"))


@query(f"WITH RECURSIVE {CLUSTERS} SELECT prompt_id, i, cluster FROM cl")
def semantic_clusters(spark, sf_dir):
    return graph.clusters(vector_edges(spark, sf_dir)).select("prompt_id", "i", "cluster")


@query(f"WITH RECURSIVE {CLUSTERS} SELECT prompt_id, round(CASE WHEN count(*) = 1 THEN 0 ELSE -sum(c / CAST(n AS DOUBLE) * ln(c / CAST(n AS DOUBLE))) END, 6) AS se_marginal FROM cs GROUP BY prompt_id")
def se_marginal(spark, sf_dir):
    return graph.cluster_entropy(graph.clusters(vector_edges(spark, sf_dir))).select("prompt_id", r6("se_marginal"))


@query(f"WITH RECURSIVE {CLUSTERS} SELECT prompt_id, round(sum(CASE WHEN c > 1 THEN c / CAST(n AS DOUBLE) * ln(c) ELSE 0 END) / ln(max(n)), 6) AS se_conditional FROM cs GROUP BY prompt_id")
def se_conditional(spark, sf_dir):
    return graph.cluster_entropy(graph.clusters(vector_edges(spark, sf_dir))).select("prompt_id", r6("se_conditional"))


@query(f"WITH {EDGES} SELECT prompt_id, i, round(sum(CASE WHEN i <> j THEN greatest(w, 0) ELSE 0 END), 6) AS degree FROM ed GROUP BY prompt_id, i")
def laplacian_degree(spark, sf_dir):
    return graph.degrees(vector_edges(spark, sf_dir)).select("prompt_id", "i", r6("degree"))


@query(f"WITH {EDGES}, d AS (SELECT prompt_id, i, sum(CASE WHEN i <> j THEN greatest(w, 0) ELSE 0 END) AS d FROM ed GROUP BY ALL) SELECT prompt_id, i, j, round(CASE WHEN i = j THEN d ELSE -greatest(w, 0) END, 6) + 0.0 AS value FROM ed JOIN d USING (prompt_id, i)")
def laplacian(spark, sf_dir):
    return graph.laplacian(vector_edges(spark, sf_dir)).select("prompt_id", "i", "j", r6(C("value") + 0.0, "value"))


@query(f"WITH {EDGES} SELECT prompt_id, round(1 - sum(CASE WHEN i <> j THEN greatest(w, 0) ELSE 0 END) / max(n), 6) AS eigval FROM ed GROUP BY prompt_id")
def eigval(spark, sf_dir):
    return graph.eigval(vector_edges(spark, sf_dir)).select("prompt_id", r6("eigval"))


@query()
def spectral(spark, sf_dir):
    return graph.spectral(vector_edges(spark, sf_dir)).select("prompt_id", r6("ecc"), r6("kle_heat"), r6("kle_matern"))


@query(
    f"WITH {EDGES}, e AS (SELECT prompt_id, i, j, CASE WHEN i <> j THEN greatest(w, 0) ELSE 0 END AS w FROM ed), d AS (SELECT prompt_id, i, sum(w) AS d FROM e GROUP BY ALL),"
    " l AS (SELECT prompt_id, i, j, CASE WHEN i = j THEN d ELSE 0 END - w AS v FROM e JOIN d USING (prompt_id, i)),"
    " l2 AS (SELECT a.prompt_id, a.i, b.j, sum(a.v * b.v) AS v FROM l a JOIN l b ON a.prompt_id = b.prompt_id AND a.j = b.i GROUP BY ALL), l3 AS (SELECT a.prompt_id, a.i, b.j, sum(a.v * b.v) AS v FROM l2 a JOIN l b ON a.prompt_id = b.prompt_id AND a.j = b.i GROUP BY ALL),"
    " t AS (SELECT prompt_id, i, j, l.v AS a, l2.v AS b, l3.v AS c FROM l JOIN l2 USING (prompt_id, i, j) JOIN l3 USING (prompt_id, i, j))"
    " SELECT prompt_id, " + ", ".join(f"round(sum({x}), 4) AS power_{k}" for k, x in enumerate(("CASE WHEN i = j THEN a ELSE 0 END", "a * a", "a * b", "b * b", "b * c", "c * c"), 1)) + ", 0::DOUBLE AS residual FROM t GROUP BY prompt_id"
)
def spectral_moments(spark, sf_dir):
    """Power sums of the eigenvalues behind spectral: traces of powers of the Laplacian."""
    found = graph.spectral_moments(vector_edges(spark, sf_dir))
    return found.select("prompt_id", *(F.round(f"power_{k}", 4).alias(f"power_{k}") for k in range(1, 7)), r6("residual"))


WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda w: w <> ''))"
TALK = f"tk AS (SELECT conv_id AS prompt_id, CAST(turn AS INT) AS i, text, {WORDS.format('text')} AS ws FROM conversations)"
JACCARD = "CASE WHEN len(a.ws) = 0 AND len(b.ws) = 0 THEN 1 ELSE len(list_intersect(a.ws, b.ws)) / CAST(len(list_distinct(list_concat(a.ws, b.ws))) AS DOUBLE) END"


def talk_pairs(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "conversations").select(C("conv_id").alias("prompt_id"), C("turn").cast("int").alias("i"), "text", F.count("*").over(Window.partitionBy("conv_id")).cast("int").alias("n"))
    return graph.pairs(items)


@query(f"WITH {TALK} SELECT a.prompt_id, a.i, b.i AS j, round(CAST(CAST({JACCARD} AS FLOAT) AS DOUBLE), 5) AS p FROM tk a JOIN tk b ON a.prompt_id = b.prompt_id")
def pair_similarity(spark, sf_dir):
    return graph.scored_pairs(talk_pairs(spark, sf_dir), JaccardScorer()).select("prompt_id", "i", "j", F.round("p_entailment", 5).alias("p"))


@query(f"WITH {TALK}, p AS (SELECT a.text AS x, b.text AS y FROM tk a JOIN tk b ON a.prompt_id = b.prompt_id) SELECT count(*) AS n_pairs, (SELECT count(*) FROM (SELECT DISTINCT x, y FROM p)) AS n_scored FROM p")
def pair_dedupe(spark, sf_dir):
    asked = talk_pairs(spark, sf_dir)
    distinct = asked.select("premise", "hypothesis").distinct()
    return asked.agg(F.count("*").alias("n_pairs")).crossJoin(distinct.agg(F.count("*").alias("n_scored")))  # one row each


# --- trajectories ----------------------------------------------------------------------------------------------------

STEPS = f"{TALK}, fin AS (SELECT prompt_id, arg_max(text, i) AS final, arg_max(ws, i) AS fws, CAST(count(*) AS INT) AS t FROM tk GROUP BY prompt_id)"
DISTANCE = f"{STEPS}, ds AS (SELECT b.prompt_id, b.i AS step, CASE WHEN b.text = '' OR f.final = '' OR b.text = 'None' OR f.final = 'None' OR b.text = f.final THEN 0 ELSE 1 - CAST(CAST({JACCARD.replace('a.ws', 'f.fws')} AS FLOAT) AS DOUBLE) END AS d FROM tk b JOIN fin f USING (prompt_id))"


def talk_trajectories(spark, sf_dir) -> DataFrame:
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    return table(spark, sf_dir, "conversations").groupBy(C("conv_id").alias("prompt_id")).agg(texts.alias("step_answers")).select("prompt_id", "step_answers", F.element_at("step_answers", -1).alias("final_answer"), F.size("step_answers").alias("num_steps"))


@query(f"WITH {DISTANCE} SELECT prompt_id, step, round(d, 5) AS d FROM ds")
def step_dissimilarity(spark, sf_dir):
    return trajectory.step_dissimilarities(trajectory.steps_of(talk_trajectories(spark, sf_dir))).select("prompt_id", "step", F.round("d", 5).alias("d"))


@query(f"WITH {DISTANCE} SELECT prompt_id, round(avg(d), 5) AS ad FROM ds GROUP BY prompt_id HAVING bool_and(true)")
def averaged_dissimilarity(spark, sf_dir):
    found = trajectory.averaged_dissimilarity(trajectory.step_dissimilarities(trajectory.steps_of(talk_trajectories(spark, sf_dir))))
    return found.select("prompt_id", F.round("ad", 5).alias("ad"))


@query("WITH n AS (SELECT conv_id AS prompt_id, CAST(count(*) AS INT) AS num_steps FROM conversations GROUP BY 1), b AS (SELECT num_steps FROM n GROUP BY num_steps ORDER BY count(*) DESC, min(prompt_id) LIMIT 1) SELECT prompt_id, num_steps FROM n JOIN b USING (num_steps)")
def modal_length(spark, sf_dir):
    return trajectory.modal_length(talk_trajectories(spark, sf_dir), order="prompt_id").select("prompt_id", "num_steps")


def talk_steps(spark, sf_dir) -> DataFrame:
    return talk_trajectories(spark, sf_dir).select("prompt_id", C("num_steps").alias("t"), F.posexplode("step_answers").alias("step", "text"))


@query(f"WITH {STEPS}, s AS (SELECT prompt_id, t, least(3, t) AS k, i AS step FROM tk JOIN fin USING (prompt_id)) SELECT prompt_id, step FROM s WHERE step >= round_even(1 * (t - k) / CAST(2 AS DOUBLE), 0) AND step < round_even(1 * (t - k) / CAST(2 AS DOUBLE), 0) + k")
def select_range_steps(spark, sf_dir):
    return trajectory.in_scope(talk_steps(spark, sf_dir), C("t"), 3, "range", 1, 3).select("prompt_id", "step")


@query(f"WITH {STEPS}, s AS (SELECT prompt_id, t, i AS step, least(3, t - 1) AS m FROM tk JOIN fin USING (prompt_id) WHERE t > 1) SELECT prompt_id, step FROM s WHERE list_contains(list_transform(range(0, greatest(m, 1)), lambda i: CAST(coalesce(round_even(i * (t - 2) / nullif(CAST(m - 1 AS DOUBLE), 0), 0), 0) AS INT)), step)")
def uniform_steps(spark, sf_dir):
    return trajectory.in_scope(talk_steps(spark, sf_dir), C("t"), 3, "uniform").select("prompt_id", "step")


@query(f"WITH {STEPS} SELECT prompt_id, i AS step FROM tk JOIN fin USING (prompt_id) WHERE i >= greatest(t - 3, 0) AND i < t - 1")
def last_steps(spark, sf_dir):
    return trajectory.in_scope(talk_steps(spark, sf_dir), C("t"), 2, "last").select("prompt_id", "step")


@query()
def random_scope(spark, sf_dir):
    prompt = talk_trajectories(spark, sf_dir).withColumn("idx", C("prompt_id"))
    drawn = trajectory.random_scope_steps(prompt, 42, 3, 2)
    scoped = talk_steps(spark, sf_dir).join(drawn, ["prompt_id", "step"]).withColumn("scope", F.concat_ws("|", "prompt_id", "rep"))
    return graph.sampling_features(scoped, key="scope", order="step").select("scope", *[r6(c) for c in ("se_marginal", "se_conditional", "ecc", "eigval", "kle_heat", "kle_matern")])


SIDES = "sd AS (SELECT vec_id, label % 2 AS label, embedding FROM embeddings)"
DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
SQUARE = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))"


def _mmd_sql(kernel: str, unbiased: bool) -> str:
    off = " AND a.vec_id <> b.vec_id" if unbiased else ""
    return f"WITH {SIDES}, k AS (SELECT a.label AS x, b.label AS y, a.vec_id = b.vec_id AS own, {kernel} AS k FROM sd a, sd b) SELECT round(avg(k) FILTER (x = 0 AND y = 0{off and ' AND NOT own'}) + avg(k) FILTER (x = 1 AND y = 1{off and ' AND NOT own'}) - 2 * avg(k) FILTER (x = 0 AND y = 1), 5) AS mmd2 FROM k"


def _sides(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.when(C("label") % 2 == 0, "x").otherwise("y").alias("side"), C("vec_id").alias("owner"), "embedding")


for _name, _unbiased, _gamma in (("mmd_biased", False, None), ("mmd_unbiased", True, None), ("mmd_rbf", False, 0.05), ("mmd_rbf_unbiased", True, 0.05)):
    query(_mmd_sql(DOT if _gamma is None else f"exp(-{_gamma} * {SQUARE})", _unbiased), _name)(lambda spark, sf_dir, u=_unbiased, g=_gamma: trajectory.mmd2(_sides(spark, sf_dir), u, g).select(F.round("mmd2", 5).alias("mmd2")))


@query(_mmd_sql(f"exp(-0.05 * {SQUARE})", False).replace("AS mmd2 FROM k", "AS exact, round(4 * sqrt(ln(2 / 0.01::DOUBLE) / (2 * 128 * 8)), 6) AS bound, TRUE AS holds FROM k"))
def mmd_fourier(spark, sf_dir):
    """The Gaussian discrepancy by random Fourier features, linear in the points: whether the exact one lies within its bound."""
    near = trajectory.mmd2_fourier(_sides(spark, sf_dir), 0.05)
    exact = trajectory.mmd2(_sides(spark, sf_dir), False, 0.05).withColumnRenamed("mmd2", "exact")
    return near.crossJoin(exact).select(F.round("exact", 5).alias("exact"), r6("bound"), (F.abs(C("mmd2") - C("exact")) <= C("bound")).alias("holds"))  # one row each


@query(f"SELECT a.label, round(avg({DOT}), 5) AS mean_dot FROM embeddings a JOIN embeddings b ON a.label = b.label GROUP BY a.label")
def pair_means(spark, sf_dir):
    return trajectory.pair_means(table(spark, sf_dir, "embeddings")).select("label", F.round("mean_dot", 5).alias("mean_dot"))


@query("SELECT label, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS count FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings) GROUP BY label")
def finite_summary(spark, sf_dir):
    value = F.get("embedding", L(0)).cast("double")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(*trajectory.finite_summary(value)).select("label", r6("mean"), r6("std"), "count")


@query()
def kernel_psd(spark, sf_dir):
    """C - A_U of all vectors of each label, dealt to trajectories of four steps by the order of vec_id; the last may have fewer."""
    return trajectory.kernel_matrices_by_group(label_trajectories(spark, sf_dir, 4), "label").select("label", "is_psd", r6("min_eigenvalue"), r6("trace"))


def label_trajectories(spark, sf_dir, steps: int) -> DataFrame:
    """All vectors of each label, dealt to trajectories of so many steps by the order of vec_id; the last may have fewer."""
    vectors = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", L(1).alias("one"))
    placed = prefix_sums(vectors, ["label"], "vec_id", ["one"]).withColumnRenamed("one_before", "at")
    return placed.select("label", F.floor(C("at") / steps).alias("trajectory"), (C("at") % steps).cast("int").alias("step"), "embedding")


def _points_sql(steps: int) -> str:
    return f"pt AS (SELECT label, (row_number() OVER w - 1) // {steps} AS tr, (row_number() OVER w - 1) % {steps} AS st, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))"


def _sums_sql(kernel: str, steps: int) -> str:
    """C and A_U by label and two steps, from all pairs."""
    both = "FROM pt a JOIN pt b ON a.label IS NOT DISTINCT FROM b.label GROUP BY ALL"
    raw = f"raw AS (SELECT a.label, a.st AS s, b.st AS t, avg({kernel}) FILTER (a.tr = b.tr) AS own, avg({kernel}) FILTER (a.tr <> b.tr) AS other {both})"
    return f"{_points_sql(steps)}, {raw}, ku AS (SELECT label, s, t, coalesce(own, 0) AS c, coalesce(other, own, 0) AS u FROM raw)"


RBF = "exp(-0.05 * list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
STEP_DOT = "list_dot_product(a.e, b.e)"


@query(f"WITH {_sums_sql(RBF, 4)} SELECT label, round(sum(c - u), 5) AS trace FROM ku WHERE s = t GROUP BY label")
def kernel_trace_rbf(spark, sf_dir):
    """The trace of C - A_U with a Gaussian kernel, over all pairs of vectors of a label, tile by tile."""
    found = trajectory.kernel_matrices_by_group(label_trajectories(spark, sf_dir, 4), "label", "rbf", 0.05)
    return found.select("label", F.round("trace", 5).alias("trace"))


@query(f"WITH {_sums_sql(RBF, 4)} SELECT label, CAST(s AS INT) AS step, CAST(t AS INT) AS other, round(c, 6) AS c, round(u, 6) AS a_u FROM ku")
def kernel_sums_rbf(spark, sf_dir):
    """The matrices themselves, a row for each two steps."""
    found = trajectory.kernel_sums(label_trajectories(spark, sf_dir, 4), "label", "rbf", 0.05)
    return found.select("label", "step", "other", r6("c"), r6("a_u"))


@query()
def kernel_psd_rbf(spark, sf_dir):
    """The least eigenvalue of C - A_U with a Gaussian kernel, over all vectors of each label."""
    return trajectory.kernel_matrices_by_group(label_trajectories(spark, sf_dir, 4), "label", "rbf", 0.05).select("label", "is_psd", r6("min_eigenvalue"), r6("trace"))


#: The quadratic programme of three steps, solved by trying every set of steps: the least objective of those that are feasible.
SUPPORTS = (
    "cand AS (SELECT label, a * 1.0 AS f, [1.0, 0, 0]::DOUBLE[] AS w FROM mm UNION ALL SELECT label, d, [0, 1.0, 0]::DOUBLE[] FROM mm UNION ALL SELECT label, h, [0, 0, 1.0]::DOUBLE[] FROM mm"
    " UNION ALL SELECT label, (a * d - b * b) / (a + d - 2 * b), [(d - b) / (a + d - 2 * b), (a - b) / (a + d - 2 * b), 0] FROM mm UNION ALL SELECT label, (a * h - g * g) / (a + h - 2 * g), [(h - g) / (a + h - 2 * g), 0, (a - g) / (a + h - 2 * g)] FROM mm"
    " UNION ALL SELECT label, (d * h - q * q) / (d + h - 2 * q), [0, (h - q) / (d + h - 2 * q), (d - q) / (d + h - 2 * q)] FROM mm"
    " UNION ALL SELECT label, det / (x + y + z), [x / (x + y + z), y / (x + y + z), z / (x + y + z)] FROM (SELECT label, (d * h - q * q) + (g * q - b * h) + (b * q - g * d) AS x, (g * q - b * h) + (a * h - g * g) + (b * g - a * q) AS y, (b * q - g * d) + (b * g - a * q) + (a * d - b * b) AS z, a * (d * h - q * q) - b * (b * h - q * g) + g * (b * q - d * g) AS det FROM mm))"
)


@query(
    f"WITH {_sums_sql(STEP_DOT, 3)}, m AS (SELECT a.label, a.s, a.t, (a.c - a.u + b.c - b.u) / 2 + CASE WHEN a.s = a.t THEN 0.1::DOUBLE ELSE 0 END AS v FROM ku a JOIN ku b ON a.label IS NOT DISTINCT FROM b.label AND a.s = b.t AND a.t = b.s),"
    " mm AS (SELECT label, " + ", ".join(f"max(v) FILTER (s = {s} AND t = {t}) AS {n}" for n, s, t in (("a", 0, 0), ("b", 0, 1), ("g", 0, 2), ("d", 1, 1), ("q", 1, 2), ("h", 2, 2))) + " FROM m GROUP BY label),"
    f" {SUPPORTS}, best AS (SELECT label, arg_min(w, f) AS w, min(f) AS f FROM cand WHERE list_min(w) >= 0 GROUP BY label)"
    " SELECT label, CAST(s AS INT) AS step, round(w[s + 1], 5) AS weight, round(f, 6) AS objective, 0::DOUBLE AS gap, 0::DOUBLE AS residual, 1::DOUBLE AS total FROM best, range(3) r(s)"
)
def step_weights(spark, sf_dir):
    """Weights of three steps that let labels' trajectories differ least, with what certifies them."""
    found = trajectory.step_weights(label_trajectories(spark, sf_dir, 3), "label", ridge=0.1)
    total = F.sum("weight").over(Window.partitionBy("label"))
    return found.select("label", "step", F.round("weight", 5).alias("weight"), r6("objective"), (r6("gap") + 0.0).alias("gap"), (r6("residual") + 0.0).alias("residual"), r6(total, "total"))


# --- text and labels -------------------------------------------------------------------------------------------------

NOISY = "o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'Score: ' || (o_orderkey % 3) WHEN 1 THEN (o_orderkey % 13) || '.' WHEN 2 THEN ' 1 ' WHEN 3 THEN 'no idea' WHEN 4 THEN '10 of 0' WHEN 5 THEN NULL ELSE '0' END AS x"


def noisy(spark, sf_dir) -> DataFrame:
    k = C("o_orderkey")
    x = F.when(k % 7 == 0, F.concat(L("Score: "), (k % 3).cast("string"))).when(k % 7 == 1, F.concat((k % 13).cast("string"), L("."))).when(k % 7 == 2, " 1 ").when(k % 7 == 3, "no idea").when(k % 7 == 4, "10 of 0").when(k % 7 == 5, None).otherwise("0")
    return table(spark, sf_dir, "orders").select("o_orderkey", x.alias("x"))


@query(f"SELECT o_orderkey, CASE nullif(regexp_extract(coalesce(x, ''), '(^|[^0-9])([01])([^0-9]|$)', 2), '') WHEN '1' THEN true WHEN '0' THEN false END AS label FROM (SELECT {NOISY} FROM orders)")
def judge_score(spark, sf_dir):
    return noisy(spark, sf_dir).select("o_orderkey", text.judge_score(C("x")).alias("label"))


NAMED = "'  ' || p_name || chr(9) || chr(10) || '  ' || p_type || '.! ' AS x"


def named(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(L("  "), "p_name", L("\t\n  "), "p_type", L(".! ")).alias("x"), "p_size", "p_name", "p_type", "p_brand")


@query(f"SELECT p_partkey, regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS y FROM (SELECT p_partkey, {NAMED} FROM part)")
def normalize_text(spark, sf_dir):
    return named(spark, sf_dir).select("p_partkey", text.normalize_text(C("x")).alias("y"))


@query("SELECT p_partkey, lower(p_name) || ' ' || lower(p_type) AS y FROM part")
def normalize_key(spark, sf_dir):
    return named(spark, sf_dir).select("p_partkey", text.normalize_key(C("x")).alias("y"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS y FROM events")
def text_response(spark, sf_dir):
    value = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("content")))
    return table(spark, sf_dir, "events").select("event_id", text.parse_text_response(value).alias("y"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS INT) AS n, p_name AS first FROM part")
def aliases(spark, sf_dir):
    listed = F.when(C("p_size") % 2 == 0, F.array(F.concat(L(" "), "p_name"), L(" "), "p_type", L(None).cast("string"))).otherwise(F.array("p_name", L("")))
    found = text.normalize_aliases(listed)
    return named(spark, sf_dir).select("p_partkey", F.size(found).alias("n"), F.get(found, L(0)).alias("first"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) || '.5' END AS marked, CASE WHEN o_orderkey % 3 = 0 THEN '-' || o_custkey ELSE '7' END AS last FROM orders")
def marked_and_last_number(spark, sf_dir):
    k = C("o_orderkey").cast("string")
    marked = F.when(C("o_orderkey") % 3 == 0, "none 12").otherwise(F.concat(L("a\n#### 1\nb\n#### $"), k, L(".5 apples 9\nend 3")))
    last = F.when(C("o_orderkey") % 3 == 0, F.concat(L("so 3, then\n\nAnswer: 12 and -"), C("o_custkey").cast("string"), L(".\n"))).otherwise("x #### 5, 7")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.marked_number(marked).alias("marked"), text.extract_last_number(last).alias("last"))


@query("SELECT p_partkey, p_brand || '{' || p_size || '}' AS boxed, CASE WHEN p_size % 2 = 0 THEN p_name END AS open FROM part")
def boxed_content(spark, sf_dir):
    inside = F.concat(L("first \\boxed{no} then \\boxed{ "), "p_brand", L("{"), C("p_size").cast("string"), L("} } tail"))
    maybe = F.when(C("p_size") % 2 == 0, F.concat(L("\\boxed{"), "p_name", L("}"))).otherwise(F.concat(L("\\boxed{"), "p_name"))
    return named(spark, sf_dir).select("p_partkey", text.boxed_content(inside).alias("boxed"), text.boxed_content(maybe).alias("open"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN printf('%.3f', p_retailprice / 1000) ELSE printf('%.3f (%.3f)', p_retailprice / 1000, CAST(p_size AS DOUBLE)) END AS y FROM part")
def format_mean_std(spark, sf_dir):
    mean = F.when(C("p_size") % 5 != 0, C("p_retailprice") / 1000)
    std = F.when(C("p_size") % 5 != 1, C("p_size").cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", text.format_mean_std(mean, std).alias("y"))


@query(
    "WITH r AS (SELECT p_partkey, greatest(0, least(1, (p_size - 5) / CAST(40 AS DOUBLE))) AS q FROM part) "
    "SELECT p_partkey, printf('%02X%02X%02X', CAST(round_even(244 - 27 * q, 0) AS INT), CAST(round_even(204 + 30 * q, 0) AS INT), CAST(round_even(204 + 7 * q, 0) AS INT)) AS fill FROM r"
)
def performance_fill(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.performance_fill(C("p_size"), L(5), L(45)).alias("fill"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN false WHEN p_size % 4 = 2 THEN p_size = 10 ELSE p_size % 4 = 0 END AS label FROM part")
def exact_match(spark, sf_dir):
    size = C("p_size").cast("string")
    raw = F.when(C("p_size") % 4 == 3, " ").when(C("p_size") % 4 == 1, "no mark").otherwise(F.concat(L("so #### "), size))
    ref = F.when(C("p_size") % 4 == 2, "10").otherwise("0")
    alias = F.when(C("p_size") % 4 == 0, F.array(L("x"), size)).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", raw.alias("raw_answer"), ref.alias("reference_answer"), alias.alias("aliases"))
    return labeling.exact_match(rows, text.marked_number).select("p_partkey", "label")


RETRY = f"""n AS (SELECT o_orderkey, x, CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE 'unclear' END AS again, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE 'text' END AS response FROM (SELECT {NOISY} FROM orders)),
p AS (SELECT *, nullif(regexp_extract(coalesce(x, ''), '(^|[^0-9])([01])([^0-9]|$)', 2), '') AS a, nullif(regexp_extract(again, '(^|[^0-9])([01])([^0-9]|$)', 2), '') AS b FROM n),
l AS (SELECT o_orderkey, response <> ' ' AND a IS NULL AS retried, CASE WHEN response = ' ' THEN false ELSE coalesce(a, b) = '1' END AS label FROM p)"""


def retried_rows(spark, sf_dir) -> DataFrame:
    rows = noisy(spark, sf_dir).withColumns({"again": F.when(C("o_orderkey") % 2 == 0, "1").otherwise("unclear"), "response": F.when(C("o_orderkey") % 11 == 0, " ").otherwise("text")})
    return labeling.retry_labels(rows, "response", "x", "again")


@query(f"WITH {RETRY} SELECT o_orderkey, label, retried FROM l")
def judge_retry(spark, sf_dir):
    return retried_rows(spark, sf_dir).select("o_orderkey", "label", "retried")


@query(f"WITH {RETRY} SELECT CASE WHEN label IS NULL THEN 'llm_judge_ambiguous' WHEN retried THEN 'llm_judge_retry' ELSE 'llm_judge' END AS method, count(*) AS n FROM l GROUP BY 1")
def label_methods(spark, sf_dir):
    return retried_rows(spark, sf_dir).groupBy("method").agg(F.count("*").alias("n"))


def talk_records(spark, sf_dir) -> DataFrame:
    """Turns as samples: turn 0 is greedy in even conversations; labels from documents of the same number."""
    rows = table(spark, sf_dir, "conversations").select(C("conv_id").alias("prompt_id"), C("turn").alias("sample_id"), "text", C("text").alias("raw_answer"), (C("conv_id") * 100 + C("turn")).alias("key"))
    rows = rows.withColumn("generation_mode", F.when((C("sample_id") == 0) & (C("prompt_id") % 2 == 0), "greedy").otherwise("sampled"))
    quality = table(spark, sf_dir, "labels").select(C("doc_id").alias("prompt_id"), (C("quality") == 1).alias("label"))
    return rows.join(quality, "prompt_id", "left")


RECORDS = "rc AS (SELECT c.conv_id AS prompt_id, c.turn AS sample_id, c.text, CASE WHEN c.turn = 0 AND c.conv_id % 2 = 0 THEN 'greedy' ELSE 'sampled' END AS generation_mode, l.quality = 1 AS label FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id)"


@query(f"WITH {RECORDS} SELECT prompt_id, sample_id FROM rc WHERE generation_mode <> 'sampled'")
def select_to_label(spark, sf_dir):
    return labeling.select_to_label(talk_records(spark, sf_dir)).select("prompt_id", "sample_id")


@query(f"WITH {RECORDS} SELECT prompt_id, min(sample_id) AS sample_id FROM rc WHERE generation_mode = 'sampled' GROUP BY prompt_id")
def select_first_sampled(spark, sf_dir):
    return labeling.select_to_label(talk_records(spark, sf_dir).where("generation_mode = 'sampled'")).select("prompt_id", "sample_id")


@query(f"WITH {RECORDS}, amb AS (SELECT DISTINCT prompt_id FROM rc WHERE generation_mode <> 'sampled' AND label IS NULL) SELECT prompt_id, sample_id FROM rc WHERE prompt_id NOT IN (SELECT prompt_id FROM amb)")
def ambiguous_anti(spark, sf_dir):
    rows = talk_records(spark, sf_dir)
    return labeling.without_ambiguous(rows, rows).select("prompt_id", "sample_id")


@query("SELECT source, count(*) FILTER (quality = 1) AS n_correct, count(*) FILTER (quality = 0) AS n_incorrect, count(*) FILTER (quality IS NULL) AS n_ambiguous, round(avg(CAST(quality AS DOUBLE)), 6) AS accuracy FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def label_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("source", (C("quality") == 1).alias("label"))
    return labeling.label_accuracy(rows, "source").select("source", "n_correct", "n_incorrect", "n_ambiguous", r6("accuracy"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN false WHEN p_size % 3 = 1 THEN true END AS label, CASE WHEN p_size % 3 = 2 THEN 'llm_judge_ambiguous' ELSE 'llm_judge' END AS method FROM part")
def label_records_judge(spark, sf_dir):
    """A scripted judge over triviaqa prompts: 0 or 1 by the answer in the prompt, unclear for others; blank answers are never asked."""
    raw = F.when(C("p_size") % 3 == 0, " ").when(C("p_size") % 3 == 1, "yes").otherwise("hm")
    rows = table(spark, sf_dir, "part").select(C("p_partkey").alias("sample_id"), C("p_partkey").cast("string").alias("prompt_id"), "p_partkey", C("p_name").alias("question"), C("p_type").alias("reference_answer"), F.array().cast("array<string>").alias("aliases"), raw.alias("raw_answer"), L(None).cast("boolean").alias("label"), L("greedy").alias("generation_mode"))
    judge = ScriptedJudge(lambda p: F.when(p.contains("Model response: yes"), "1").otherwise("unclear"))
    out = labeling.label_records(rows, "triviaqa", judge)
    return out.select("p_partkey", "label", C("final.correctness_method").alias("method"))


# --- prompts ---------------------------------------------------------------------------------------------------------

ASKED, SHOTS = 40, 2


def raw_rows(spark, sf_dir, dataset: str) -> DataFrame:
    """Rows of a dataset's shape from parts; names with blanks around them."""
    p = table(spark, sf_dir, "part")
    name, kind, brand, size = F.concat(L(" "), "p_name", L("\n")), C("p_type"), C("p_brand"), C("p_size").cast("string")
    key = C("p_partkey").cast("string")
    if dataset == "gsm8k":
        columns = [name.alias("question"), F.concat("p_type", L("\n#### 1,"), size).alias("answer")]
    elif dataset == "triviaqa":
        columns = [C("p_name").alias("question"), key.alias("question_id"), F.struct(kind.alias("value"), F.array(brand, L("")).alias("aliases")).alias("answer")]
    elif dataset == "wmt14_fr_en":
        columns = [F.struct(name.alias("fr"), kind.alias("en")).alias("translation")]
    elif dataset in ("xsum", "samsum"):
        columns = [name.alias("document" if dataset == "xsum" else "dialogue"), kind.alias("summary"), key.alias("id")]
    elif dataset == "hotpotqa":
        some = F.when(C("p_partkey") % 5 == 1, F.array().cast("array<string>")).otherwise(F.array(brand, kind))
        context = F.struct(some.alias("title"), F.when(F.size(some) > 0, F.array(F.array(L("a "), size), F.array(L("b")))).otherwise(F.array().cast("array<array<string>>")).alias("sentences"))
        columns = [name.alias("question"), kind.alias("answer"), key.alias("id"), context.alias("context")]
    else:
        columns = [name.alias("question"), kind.alias("answer"), key.alias("id"), F.array(brand).alias("answer_aliases"), F.array(F.struct(brand.alias("title"), size.alias("paragraph_text"))).alias("paragraphs")]
    return p.select(C("p_partkey").alias("ord"), *columns)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _prompt_sql(dataset: str) -> str:
    """The same prompts by string concatenation; shots are the first rows."""
    q = _quoted
    docs = {"hotpotqa": f"'Document 0: ' || p_brand || {q(chr(10))} || 'a ' || p_size || {q(chr(10) * 2)} || 'Document 1: ' || p_type || {q(chr(10))} || 'b' || {q(chr(10) * 2)}", "musique": f"'Document 0: ' || p_brand || {q(chr(10))} || p_size || {q(chr(10) * 2)}"}
    kind = {"xsum": "text", "samsum": "dialogue"}.get(dataset)
    first = {"xsum": prompts._ONE_SENTENCE, "samsum": prompts._DIALOGUE}.get(dataset)
    shown = f"{q(f'Here' + chr(39) + f's the {kind}:' + chr(10))} || p_name || {q(chr(10) + f'(End of {kind}).' + chr(10) * 2 + 'Summary:')}" if kind else ""
    shot = {
        "gsm8k": f"'Question: ' || p_name || {q(chr(10))} || 'Answer: ' || p_type || {q(chr(10))} || '#### 1,' || p_size",
        "wmt14_fr_en": f"'Original: ' || p_name || {q(chr(10))} || 'Translation: ' || p_type || {q(chr(10) * 2)}",
        "xsum": f"{shown} || ' ' || p_type",
        "samsum": f"{shown} || ' ' || p_type",
    }.get(dataset, f"'Question: ' || p_name || {q(chr(10))} || 'Answer: ' || p_type || {q(chr(10) * 2)}")
    between = q(chr(10) * 2) if dataset in ("gsm8k", "xsum", "samsum") else "''"
    title = {"gsm8k": "Here are a few examples of questions and answers:\n", "wmt14_fr_en": "Here are a few examples:\n\n", "xsum": "Here are some examples:\n", "samsum": "Here are some examples:\n"}.get(dataset, "")
    prefix = f"{q(title)} || (SELECT string_agg(shot, {between} ORDER BY place) FROM sh)" + (f" || {q(chr(10) * 2)}" if dataset == "gsm8k" else "")
    question = f"'Question: ' || p_name || {q(chr(10) + 'Answer:')}"
    body = {
        "gsm8k": f"{q(prompts._REASON)} || {prefix} || {question}",
        "triviaqa": f"{prefix} || {question}",
        "wmt14_fr_en": f"{q(prompts._TRANSLATE)} || {prefix} || 'Original: ' || p_name || {q(chr(10) + 'Translation:')}",
        "xsum": f"{q((first or '') + chr(10) * 2)} || {prefix} || {q(chr(10) * 2)} || {shown}",
        "samsum": f"{q((first or '') + chr(10) * 2)} || {prefix} || {q(chr(10) * 2)} || {shown}",
    }.get(dataset, f"{q(prompts._GIVEN)} || {docs.get(dataset)} || {q(prompts._STRICTLY)} || {prefix} || {question}")
    keep = "WHERE p_partkey % 5 <> 1" if dataset == "hotpotqa" else ""
    return f"WITH p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part {keep}), sh AS (SELECT place, {shot} AS shot FROM p WHERE place < {SHOTS}) SELECT place - {SHOTS} AS prompt_id, {body} AS prompt_text FROM p WHERE place >= {SHOTS} AND place < {SHOTS + ASKED}"


for _d in prompts.ADAPTERS:
    query(_prompt_sql(_d), f"prompts_{_d}")(lambda spark, sf_dir, d=_d: prompts.build_prompts(raw_rows(spark, sf_dir, d), d, SHOTS, ASKED).select("prompt_id", "prompt_text"))


def _judge_sql(dataset: str) -> str:
    q, n = _quoted, chr(10)
    qa = lambda refs, label: f"{q(prompts._QA_JUDGE)} || 'Question: ' || p_name || {q(n)} || {q(label)} || {refs} || {q(n)} || 'Model response: ' || p_brand || {q(n)} || {q(prompts._QA_JUDGE_END)}"
    summary = lambda word, title: f"{q(f'Task : You evaluate the consistency of a summary with the source {word}.' + n * 2)} || {q(f'{title}: ' + n)} || p_name || {q(n * 2 + 'Summary: ')} || p_brand || {q(n * 2)} || {q(prompts._CONSISTENT)}"
    body = {
        "triviaqa": qa("p_brand", "Acceptable response(s): "),
        "hotpotqa": qa("p_type", "Acceptable response: "),
        "musique": qa("p_type || ', ' || p_brand", "Acceptable response(s): "),
        "wmt14_fr_en": f"{q(prompts._TRANSLATION_JUDGE)} || 'French original: ' || p_name || {q(n)} || 'English translation: ' || p_brand || {q(n)} || {q(prompts._TRANSLATION_JUDGE_END)}",
        "xsum": summary("document", "Document"),
        "samsum": summary("dialogue", "Dialogue"),
    }[dataset]
    keep = " WHERE p_partkey % 5 <> 1" if dataset == "hotpotqa" else ""
    return f"SELECT {body} AS judge_prompt FROM part{keep}"


for _d in prompts.ADAPTERS:
    if prompts.ADAPTERS[_d].judge:
        query(_judge_sql(_d), f"judge_prompt_{_d}")(
            lambda spark, sf_dir, d=_d: prompts.judge_prompts(_with_answer(spark, sf_dir, d), d).select("judge_prompt")
        )


def _with_answer(spark, sf_dir, dataset: str) -> DataFrame:
    """Samples of a dataset with the part's brand as the response."""
    raw = raw_rows(spark, sf_dir, dataset)
    brand = table(spark, sf_dir, "part").select(C("p_partkey").alias("ord"), C("p_brand").alias("raw_answer"))
    return prompts._carry(raw, prompts.adapter(dataset), "ord").join(brand, "ord")


@query(
    "WITH e AS (SELECT conv_id, unnest(range(0, 4)) AS k FROM (SELECT DISTINCT conv_id FROM conversations)) "
    "SELECT conv_id AS prompt_id, CAST(k AS INT) AS response_sample_id, CASE WHEN k = 0 THEN 'greedy' ELSE 'sampled' END AS generation_mode, 'c' || conv_id || '::sample_' || k AS sample_example_id FROM e"
)
def expand_samples(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(C("conv_id").alias("prompt_id"), F.concat(L("c"), C("conv_id").cast("string")).alias("question_id"), L(" ").alias("id")).distinct()
    return prompts.expand_samples(rows, 3).select("prompt_id", "response_sample_id", "generation_mode", "sample_example_id")


@query(f"WITH {RECORDS}, g AS (SELECT prompt_id, coalesce(max(sample_id) FILTER (generation_mode = 'greedy'), min(sample_id)) AS g FROM rc GROUP BY prompt_id) SELECT prompt_id, sample_id, sample_id = g AS is_greedy FROM rc JOIN g USING (prompt_id)")
def partition_greedy(spark, sf_dir):
    return prompts.partition_greedy(talk_records(spark, sf_dir)).select("prompt_id", "sample_id", "is_greedy")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'x' || o_custkey ELSE CAST(o_orderkey // 4 AS VARCHAR) END AS prompt_id FROM orders")
def group_by_prompt(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("qa_example_id", F.when(C("o_orderkey") % 3 == 0, F.concat(L("x"), C("o_custkey").cast("string"))))
    return prompts.group_key(rows, 4, "o_orderkey").select("o_orderkey", "prompt_id")


@query("SELECT o_orderkey, 'LLaDA1.5_gsm8k_l' || (o_custkey % 3) || '_s8_lc' || CASE WHEN o_orderkey % 2 = 0 THEN '_b32' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN '_t0p7' ELSE '' END || CASE WHEN o_orderkey % 3 > 0 THEN '_fs' || (o_orderkey % 3) ELSE '' END AS run_id FROM orders")
def run_ids(spark, sf_dir):
    k = C("o_orderkey")
    columns = {"model": L("LLaDA1.5"), "dataset": L("gsm8k"), "max_gen_length": C("o_custkey") % 3, "steps": L(8), "remasking": L("lc"), "block_size": F.when(k % 2 == 0, 32), "temperature": F.when(k % 5 == 0, 0.7), "fewshot_k": (k % 3).cast("int")}
    return table(spark, sf_dir, "orders").select("o_orderkey", run_id_column(columns).alias("run_id"))


@query(
    "WITH a AS (SELECT p_partkey - 1 AS q, row_number() OVER (ORDER BY p_partkey) - 1 AS ord, p_name FROM part), s AS (SELECT ord, p_name FROM a) "
    "SELECT CAST(ord * 3 AS BIGINT) AS sample_id, 'g' || p_name AS raw_answer FROM s UNION ALL SELECT CAST(ord * 3 + k AS BIGINT), 's' || k || p_name FROM s, (SELECT unnest([1, 2]) AS k)"
)
def interleave_answers(spark, sf_dir):
    p = prompts.numbered(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    greedy = p.select(C("at").alias("ord"), F.concat(L("g"), "p_name").alias("raw_answer"))
    sampled = p.withColumn("k", F.explode(F.array(L(0), L(1)))).select((C("at") * 2 + C("k")).alias("ord"), F.concat(L("s"), (C("k") + 1).cast("string"), "p_name").alias("raw_answer"))
    return prompts.interleave(greedy, sampled, 2).select("sample_id", "raw_answer")


# --- splits ----------------------------------------------------------------------------------------------------------

DEALT = "dl AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(concat_ws('-', 42, c_custkey)), c_custkey) - 1 AS place FROM customer)"


@query(f"WITH {DEALT} SELECT c_custkey AS prompt_id, CASE WHEN place < 10 THEN 'train' WHEN place < 40 THEN 'val' ELSE 'test' END AS split FROM dl WHERE place < 80")
def split_counts(spark, sf_dir):
    return resample.split_prompts(table(spark, sf_dir, "customer").select(C("c_custkey").alias("prompt_id")), 10, 30, 40)


@query(
    f"WITH {DEALT}, f AS (SELECT c_custkey, place, place % 5 AS own, unnest(range(0, 5)) AS fold FROM dl), o AS (SELECT *, row_number() OVER (PARTITION BY fold, own = fold ORDER BY place) - 1 AS r FROM f) "
    "SELECT CAST(fold AS INT) AS fold, CASE WHEN own = fold THEN 'test' WHEN r < 20 THEN 'train' ELSE 'val' END AS role, c_custkey AS id FROM o"
)
def kfold(spark, sf_dir):
    return resample.kfold_splits(table(spark, sf_dir, "customer").select(C("c_custkey").alias("prompt_id")), 5, 20)


@query("WITH n AS (SELECT c_mktsegment, count(*) AS n, count(*) OVER () AS g FROM customer GROUP BY 1), t AS (SELECT count(*) AS total FROM customer) SELECT c_mktsegment, true AS even FROM n")
def kfold_stratified(spark, sf_dir):
    """Whether each segment's share of every role is within .02 of its share of all customers."""
    ids = table(spark, sf_dir, "customer").select(C("c_custkey").alias("prompt_id"), "c_mktsegment")
    n = ids.count()
    folds = resample.kfold_splits(ids, 3, n // 2, label="c_mktsegment").join(ids.withColumnRenamed("prompt_id", "id"), "id")
    counts = folds.groupBy("fold", "role", "c_mktsegment").agg(F.count("*").alias("c"))
    shares = counts.withColumn("share", C("c") / F.sum("c").over(Window.partitionBy("fold", "role")))
    overall = ids.groupBy("c_mktsegment").agg((F.count("*") / L(n)).alias("overall"))
    return shares.join(overall, "c_mktsegment").groupBy("c_mktsegment").agg(F.bool_and(F.abs(C("share") - C("overall")) < 0.02 + L(3.0) / (n / 3.0)).alias("even"))


# --- reports ---------------------------------------------------------------------------------------------------------

RUNS = "rn AS (SELECT c_mktsegment AS dataset, o_orderpriority AS model_id, o_orderstatus AS remasking, 'run' || o_orderkey % 50 AS run_dir, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice / 1000 END AS value, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 10 AS INT) END AS weight FROM orders JOIN customer ON c_custkey = o_custkey)"
WEIGHTED = "coalesce(sum(value * weight) FILTER (weight > 0) / sum(weight) FILTER (weight > 0 AND value IS NOT NULL), avg(value))"


def runs(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(C("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    k = C("o_orderkey")
    return o.select(C("c_mktsegment").alias("dataset"), C("o_orderpriority").alias("model_id"), C("o_orderstatus").alias("remasking"), F.concat(L("run"), (k % 50).cast("string")).alias("run_dir"), F.when(k % 9 != 0, C("o_totalprice") / 1000).alias("value"), F.when(k % 4 != 0, (C("o_custkey") % 10).cast("int")).alias("weight"))


@query(f"WITH {RUNS} SELECT dataset, model_id, remasking, count(*) AS run_count, round({WEIGHTED}, 4) AS qa_accuracy, round(avg(value), 4) AS value FROM rn GROUP BY ALL")
def competitor_rollup(spark, sf_dir):
    rows = runs(spark, sf_dir).withColumns({"qa_accuracy": C("value"), "mean_tokens": C("value")})
    out = report.competitor_rollup(rows, ["value"], ("dataset", "model_id", "remasking"))
    return out.select("dataset", "model_id", "remasking", "run_count", F.round("qa_accuracy", 4).alias("qa_accuracy"), F.round("value", 4).alias("value"))


@query(f"WITH {RUNS} SELECT model_id, round({WEIGHTED}, 4) AS v FROM rn GROUP BY ALL")
def weighted_mean(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("model_id").agg(F.round(report.weighted_mean(C("value"), C("weight")), 4).alias("v"))


@query(f"WITH {RUNS} SELECT CASE WHEN model_id LIKE '1%' THEN 'LLaDA' WHEN model_id LIKE '2%' THEN 'LLaDA' ELSE model_id END AS model, dataset, remasking, round(avg(value), 4) AS mean, count(value) AS n FROM rn GROUP BY ALL")
def model_matrix(spark, sf_dir):
    ids = list(MODEL_IDS.values())
    named_ids = F.when(C("model_id").startswith("1"), ids[0]).when(C("model_id").startswith("2"), F.concat(L("local/"), L(ids[1].split("/")[1]))).otherwise(C("model_id"))
    rows = runs(spark, sf_dir).withColumns({"model_id": named_ids, "feature": L("msp"), "metric": L("prr"), "std": L(None).cast("double")})
    return report.model_rollup(rows).select("model", "dataset", "remasking", F.round("mean", 4).alias("mean"), "n")


@query(f"WITH {RUNS} SELECT dataset, model_id, remasking, 'msp' AS feature, round(avg(value), 4) AS mean_prr, count(DISTINCT run_dir) AS run_count FROM rn GROUP BY ALL")
def summary_columns(spark, sf_dir):
    rows = runs(spark, sf_dir).withColumns({"feature": L("msp"), "metric": L("prr")})
    return report.summary_columns(rows).select("dataset", "model_id", "remasking", "feature", F.round("mean_prr", 4).alias("mean_prr"), "run_count")


@query(f"WITH {RUNS} SELECT dataset, model_id, remasking, round(avg(value), 4) AS mean, count(*) AS n, CAST(grouping_id(dataset, model_id, remasking) AS BIGINT) AS level FROM rn GROUP BY ROLLUP (dataset, model_id, remasking)")
def rollup_levels(spark, sf_dir):
    return report.levels(runs(spark, sf_dir)).select("dataset", "model_id", "remasking", F.round("mean", 4).alias("mean"), "n", C("level").cast("bigint").alias("level"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 2.5 ELSE CAST(o_custkey AS DOUBLE) END AS value FROM orders")
def metric_precedence(spark, sf_dir):
    k = C("o_orderkey")
    nested = F.when(k % 3 == 0, "1.5").when(k % 3 == 1, "NaN")
    flat = F.when(k % 3 == 2, "text").otherwise("2.5")
    return table(spark, sf_dir, "orders").select("o_orderkey", report.first_numeric(nested, flat, C("o_custkey").cast("string")).alias("value"))


@query(
    "WITH o AS (SELECT p_partkey, p_brand, max(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_size DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above, p_size FROM part) "
    "SELECT p_partkey, p_brand, above IS NULL OR p_size > above AS on_front FROM o"
)
def pareto(spark, sf_dir):
    points = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    return report.pareto(points, "p_retailprice", "p_size", "p_partkey", ["p_brand"]).select("p_partkey", "p_brand", "on_front")


@query(
    f"WITH {RUNS}, pf AS (SELECT model_id AS model, dataset, remasking, CASE WHEN count(*) FILTER (run_dir = 'run7') > 0 THEN arg_max(value, o) FILTER (run_dir = 'run7') ELSE arg_min(value, o) END AS value FROM (SELECT *, value AS o FROM rn WHERE value IS NOT NULL) GROUP BY ALL), "
    "lt AS (SELECT o_orderpriority AS model, c_mktsegment AS dataset, o_orderstatus AS remasking, max(o_orderkey) AS overhead FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' GROUP BY ALL) "
    "SELECT model, dataset, remasking, value, overhead FROM pf JOIN lt USING (model, dataset, remasking)"
)
def perf_latency_join(spark, sf_dir):
    rows = runs(spark, sf_dir).select(C("model_id").alias("model"), "dataset", "remasking", L("msp").alias("feature"), "value", (C("run_dir") == "run7").alias("is_selection"), C("value").alias("ord"))
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").join(table(spark, sf_dir, "customer").select(C("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    latency = o.groupBy(C("o_orderpriority").alias("model"), C("c_mktsegment").alias("dataset"), C("o_orderstatus").alias("remasking")).agg(F.max("o_orderkey").alias("overhead")).withColumn("feature", L("msp"))
    return report.performance_latency(rows, latency).select("model", "dataset", "remasking", "value", "overhead")


@query(
    "WITH n AS (SELECT n_nationkey AS node, sum(s_acctbal) + 100000 AS a, CAST(count(*) AS DOUBLE) AS b, max(s_suppkey) + 1 AS c FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1), "
    "s AS (SELECT node, round(100 * (0.5 * a / max(a) OVER () + 0.35 * b / max(b) OVER () + 0.15 * c / max(c) OVER ()), 1) AS score FROM n) "
    "SELECT node, score, CAST(row_number() OVER (ORDER BY score DESC, node) AS INT) AS rank, CASE WHEN score >= 95 THEN 'prefer' WHEN score < 80 THEN 'avoid' ELSE 'ok' END AS tier FROM s"
)
def node_score(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").groupBy(C("s_nationkey").alias("node")).agg((F.sum("s_acctbal") + 100000).alias("matmul"), F.count("*").cast("double").alias("clone"), (F.max("s_suppkey") + 1).alias("copy"))
    return report.node_scores(nodes)


@query(
    "WITH t AS (SELECT l_returnflag AS family, l_linestatus AS feature, l_quantity AS g, l_discount AS n, l_tax AS m FROM lineitem) "
    "SELECT family, feature, count(*) AS n_prompts, round(avg(g), 6) AS gen_mean, round(coalesce(stddev_samp(g), 0), 6) AS gen_std, round(avg(g + n + m), 6) AS total_mean, round(coalesce(stddev_samp(g + n + m), 0), 6) AS total_std FROM t GROUP BY ALL"
)
def timing_aggregate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(C("l_returnflag").alias("family"), C("l_linestatus").alias("feature"), C("l_quantity").alias("time_gen"), C("l_discount").alias("time_nli"), C("l_tax").alias("time_math"), L(1).alias("n_extra_gen"), L(1).alias("n_nli_pairs"))
    return report.timing_aggregate(rows).select("family", "feature", "n_prompts", r6("time_gen_mean", "gen_mean"), r6("time_gen_std", "gen_std"), r6("time_total_mean", "total_mean"), r6("time_total_std", "total_std"))


@query("SELECT o_orderpriority AS run_dir, round(sum(o_custkey) / CAST(sum(o_orderkey) AS DOUBLE), 6) AS qa_accuracy, CAST(sum(o_orderkey) AS BIGINT) AS weight, round(sum(o_totalprice * o_orderkey) / sum(o_orderkey), 3) AS mean_tokens FROM orders GROUP BY 1")
def pooled_folds(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(C("o_orderpriority").alias("run_dir"), C("o_custkey").alias("n_correct"), C("o_orderkey").alias("n_examples"), C("o_totalprice").alias("mean_visible_tokens"))
    return report.pooled_folds(rows).select("run_dir", r6("qa_accuracy"), "weight", F.round("mean_tokens", 3).alias("mean_tokens"))


@query("SELECT o_orderkey FROM orders WHERE NOT (o_custkey % 4 = 0)")
def without_nested_runs(spark, sf_dir):
    path = F.concat_ws("/", L("out"), F.concat(L("r"), (C("o_custkey") % 4).cast("string")), C("o_orderkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", path.alias("run_dir"))
    return report.without_nested(rows, spark.createDataFrame([("out/r0",)], "run_dir string")).select("o_orderkey")


# --- denoising -------------------------------------------------------------------------------------------------------

SCHEDULE = "sq AS (SELECT o_orderkey, o_custkey % 17 AS masked, 1 + o_orderkey % 5 AS steps FROM orders)"


@query(f"WITH {SCHEDULE}, e AS (SELECT *, unnest(range(0, steps)) AS step FROM sq) SELECT o_orderkey, step, CAST(masked // steps + CASE WHEN step < masked % steps THEN 1 ELSE 0 END AS INT) AS transfer FROM e")
def transfer_schedule(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (C("o_custkey") % 17).alias("masked"), (1 + C("o_orderkey") % 5).alias("steps"))
    return denoise.transfer_schedule(rows).select("o_orderkey", "step", "transfer")


LOGITS = "lg AS (SELECT vec_id AS sample_id, CAST(unnest(range(0, 64)) AS INT) AS token_id, CAST(unnest(embedding) AS DOUBLE) AS logit FROM embeddings)"


def vector_logits(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(C("vec_id").alias("sample_id"), F.posexplode("embedding").alias("token_id", "v")).select("sample_id", "token_id", C("v").cast("double").alias("logit"))


@query(f"WITH {LOGITS} SELECT sample_id, token_id, round(logit / 2 + (1.5 + 1) * (logit - logit / 2), 6) AS logit FROM lg")
def guidance(spark, sf_dir):
    return vector_logits(spark, sf_dir).select("sample_id", "token_id", r6(denoise.guided(C("logit"), C("logit") / 2, 1.5), "logit"))


UNIFORM = "(CAST('0x' || substring(md5(concat_ws('-', 7, sample_id, token_id)), 1, 8) AS BIGINT) + 1) / CAST(4294967297 AS DOUBLE)"


@query(f"WITH {LOGITS}, s AS (SELECT *, exp(logit) / pow(-ln({UNIFORM}), 0.8) AS score FROM lg), m AS (SELECT sample_id, sum(exp(logit)) AS z FROM lg GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, token_id) AS k FROM s) SELECT sample_id, token_id, round(exp(logit) / z, 6) AS probability FROM r JOIN m USING (sample_id) WHERE k = 1")
def gumbel_argmax(spark, sf_dir):
    u = (resample.digest_number(L(7), C("sample_id"), C("token_id")) + 1) / L(4294967297.0)
    scored = vector_logits(spark, sf_dir).withColumn("score", denoise.noisy(C("logit"), u, 0.8))
    return denoise.chosen_tokens(scored, ["sample_id"]).select("sample_id", "token_id", r6("probability"))


@query(f"WITH {LOGITS}, r AS (SELECT sample_id, token_id AS pos, row_number() OVER (PARTITION BY sample_id ORDER BY logit DESC, token_id) AS k FROM lg WHERE token_id % 3 > 0 AND token_id < 48) SELECT sample_id, pos FROM r WHERE k <= 1 + sample_id % 5")
def commit_topk(spark, sf_dir):
    rows = vector_logits(spark, sf_dir).select("sample_id", C("token_id").alias("pos"), C("logit").alias("confidence"), (C("token_id") % 3 > 0).alias("is_masked"))
    counts = table(spark, sf_dir, "embeddings").select(C("vec_id").alias("sample_id"), (1 + C("vec_id") % 5).alias("transfer"))
    return denoise.committed(rows, counts, 48).select("sample_id", "pos")


@query(f"WITH {LOGITS}, z AS (SELECT sample_id, ln(sum(exp(logit))) AS z FROM lg GROUP BY 1), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY logit DESC, token_id) - 1 AS INT) AS rank FROM lg) SELECT sample_id, rank, token_id, round(logit - z, 6) AS logprob FROM r JOIN z USING (sample_id) WHERE rank < 5")
def logsoftmax_topk(spark, sf_dir):
    return denoise.log_softmax_top_k(vector_logits(spark, sf_dir), 5, ["sample_id"]).select("sample_id", "rank", "token_id", r6("logprob"))


@query("WITH p AS (SELECT o_orderkey AS sample_id, 1 + o_custkey % 4 AS n FROM orders), w AS (SELECT sample_id, n, unnest(range(0, 7)) AS pos FROM p) SELECT sample_id, CAST(pos AS INT) AS pos, CAST(CASE WHEN pos < 4 - n THEN -1 WHEN pos < 4 THEN 5 ELSE 9 END AS INT) AS token_id, pos < 4 AS is_prompt FROM w")
def masked_sequences(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("sample_id"), F.array_repeat(L(5), (1 + C("o_custkey") % 4).cast("int")).alias("ids"))
    return denoise.masked_sequences(rows, 3, 9, -1)


#: The denoising loop over embeddings: 8 positions of 8 tokens a vector, prompts of up to 3 tokens by label.
LENGTH, VOCABULARY, MASK, PAD, LAST = 8, 8, 8, 9, 7


def denoising_model(spark, sf_dir):
    """A model that is a table: a vector's numbers are logits by position and token, and neighbours' tokens add to them."""
    own = table(spark, sf_dir, "embeddings").select(C("vec_id").alias("sample_id"), F.posexplode("embedding").alias("k", "v"))
    own = own.select("sample_id", (3 + F.floor(C("k") / VOCABULARY)).cast("int").alias("pos"), (C("k") % VOCABULARY).alias("token_id"), (4 * C("v").cast("double")).alias("own"))

    def model(state: DataFrame, asked: DataFrame) -> DataFrame:
        w = Window.partitionBy("sample_id").orderBy("pos")
        beside = state.select("sample_id", "pos", F.lag("token_id").over(w).alias("left"), F.lead("token_id").over(w).alias("right"))
        logit = C("own") + F.when(C("left") == C("token_id"), 1.0).otherwise(0.0) - F.when(C("right") == C("token_id"), 0.5).otherwise(0.0)
        return asked.join(beside, ["sample_id", "pos"]).join(own, ["sample_id", "pos"]).select("sample_id", "pos", "token_id", logit.alias("logit"))

    return model


def denoising_prompts(spark, sf_dir) -> DataFrame:
    label = F.coalesce("label", L(0))
    ids = F.slice(F.array(label % 8, (label + 3) % 8, (label + 5) % 8), L(1), 1 + label % 3)
    return denoise.masked_sequences(table(spark, sf_dir, "embeddings").select(C("vec_id").alias("sample_id"), ids.cast("array<int>").alias("ids")), LENGTH, MASK, PAD)


def _denoising_sql(block: int, steps: int, temperature: float, scale: float, chance: bool, seed: int) -> str:
    """The loop's steps written out, a state for each."""
    u = lambda *keys: f"(CAST('0x' || substring(md5(concat_ws('-', {seed}, {', '.join(keys)})), 1, 8) AS BIGINT) + 1) / CAST(4294967297 AS DOUBLE)"
    near = lambda prompt: f"CASE WHEN l.token_id = o.t {prompt} THEN 1.0::DOUBLE ELSE 0 END - CASE WHEN r.token_id = o.t THEN 0.5::DOUBLE ELSE 0 END"
    beside = "LEFT JOIN {0} l ON l.sample_id = o.sample_id AND l.pos = o.pos - 1 LEFT JOIN {0} r ON r.sample_id = o.sample_id AND r.pos = o.pos + 1"
    ctes = [
        f"o AS (SELECT vec_id AS sample_id, 3 + k // {VOCABULARY} AS pos, k % {VOCABULARY} AS t, 4 * embedding[k + 1]::DOUBLE AS own FROM embeddings, range({LENGTH * VOCABULARY}) x(k))",
        "p AS (SELECT vec_id AS sample_id, coalesce(label, 0) AS label, 1 + coalesce(label, 0) % 3 AS n FROM embeddings)",
        f"s0 AS (SELECT sample_id, pos, CASE WHEN pos >= 3 THEN {MASK} WHEN pos < 3 - n THEN {PAD} ELSE (label + [0, 3, 5][pos - (3 - n) + 1]) % 8 END AS token_id, pos < 3 AS is_prompt FROM p, range({3 + LENGTH}) x(pos))",
    ]
    at, blocks = 0, LENGTH // block
    for b in range(blocks):
        end, first = 3 + (b + 1) * block, at
        for step in range(steps // blocks):
            sure = u(str(b), str(step), "sample_id", "pos") if chance else "exp(logit) / sum(exp(logit)) OVER (PARTITION BY sample_id, pos)"
            noise = f"exp(logit) / pow(-ln({u(str(b), str(step), 'sample_id', 'pos', 't')}), {temperature})" if temperature else "logit"
            ctes += [
                f"g{at} AS (SELECT o.sample_id, o.pos, o.t, own + {near('')} AS c, own + {near('AND NOT l.is_prompt')} AS bare FROM o JOIN s{at} s USING (sample_id, pos) {beside.format(f's{at}')} WHERE s.token_id = {MASK} AND o.pos < {end} AND o.t <> {LAST})",
                f"l{at} AS (SELECT sample_id, pos, t, bare + ({scale} + 1) * (c - bare) AS logit FROM g{at})",
                f"c{at} AS (SELECT sample_id, pos, t, {sure} AS sure, row_number() OVER (PARTITION BY sample_id, pos ORDER BY {noise} DESC, t) AS k FROM l{at})",
                f"w{at} AS (SELECT sample_id, count(*) AS n FROM s{first} WHERE token_id = {MASK} AND pos >= {end - block} AND pos < {end} GROUP BY 1)",
                f"k{at} AS (SELECT sample_id, pos, t, row_number() OVER (PARTITION BY sample_id ORDER BY sure DESC, pos) AS place FROM c{at} WHERE k = 1)",
                f"s{at + 1} AS MATERIALIZED (SELECT s.sample_id, s.pos, coalesce(k.t, s.token_id) AS token_id, s.is_prompt FROM s{at} s LEFT JOIN (SELECT k{at}.* FROM k{at} JOIN w{at} USING (sample_id) WHERE place <= n // {steps // blocks} + CASE WHEN {step} < n % {steps // blocks} THEN 1 ELSE 0 END) k USING (sample_id, pos))",
            ]
            at += 1
    ctes += [
        f"f AS (SELECT o.sample_id, o.pos, o.t, own + {near('')} AS logit, s.token_id FROM o JOIN s{at} s USING (sample_id, pos) {beside.format(f's{at}')})",
        "h AS (SELECT *, logit - ln(sum(exp(logit)) OVER (PARTITION BY sample_id, pos)) AS lp, row_number() OVER (PARTITION BY sample_id, pos ORDER BY logit DESC, t) AS k FROM f)",
    ]
    return f"WITH {', '.join(ctes)} SELECT sample_id, CAST(pos AS INT) AS pos, CAST(token_id AS INT) AS token_id, CAST(k - 1 AS INT) AS rank, CAST(t AS INT) AS top_id, round(lp, 6) AS logprob FROM h WHERE k <= 2"


def _denoising(spark, sf_dir, block: int, steps: int, temperature: float, scale: float, strategy: str, seed: int) -> DataFrame:
    model = denoising_model(spark, sf_dir)
    made = denoise.denoised(denoising_prompts(spark, sf_dir), model, MASK, LENGTH, steps, block, temperature, scale, strategy, (LAST,), logits_eos_inf=True, seed=seed)
    top = denoise.final_log_probabilities(made, model, 2).withColumnRenamed("token_id", "top_id")
    return made.join(top, ["sample_id", "pos"]).select("sample_id", "pos", "token_id", "rank", "top_id", r6("logprob"))


@query(_denoising_sql(4, 6, 0.0, 0.5, False, 1))
def denoised_answers(spark, sf_dir):
    """Two blocks of three steps, with guidance, an end token that is never chosen, and the most confident first."""
    return _denoising(spark, sf_dir, 4, 6, 0.0, 0.5, "low_confidence", 1)


@query(_denoising_sql(8, 3, 0.6, 0.0, True, 5))
def denoised_at_random(spark, sf_dir):
    """One block of three steps, with noise, in a random order."""
    return _denoising(spark, sf_dir, 8, 3, 0.6, 0.0, "random", 5)


@query(f"WITH {DISTANCE}, ok AS (SELECT prompt_id, max(step) AS last FROM ds GROUP BY 1) SELECT prompt_id, round(sum(d * CASE step WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.2 END), 5) AS ad FROM ds JOIN ok USING (prompt_id) WHERE last = 2 GROUP BY prompt_id")
def weighted_dissimilarity(spark, sf_dir):
    weights = spark.createDataFrame([(0, 0.5), (1, 0.3), (2, 0.2)], "step int, weight double")
    found = trajectory.averaged_dissimilarity(trajectory.step_dissimilarities(trajectory.steps_of(talk_trajectories(spark, sf_dir))), weights=weights)
    return found.where("ad is not null").select("prompt_id", F.round("ad", 5).alias("ad"))


_BARE = "list_extract(['msp', 'perplexity', 'mte', 'mcnse', 'se-marginal', 'se-conditional', 'ecc', 'eigval', 'kle-heat', 'kle-matern', 'ad', 'odd'], CAST(1 + p_partkey % 12 AS INT))"
_SCOPE = "CASE p_size % 6 WHEN 0 THEN 'full-' WHEN 1 THEN 'selected-' WHEN 2 THEN 'random-' WHEN 3 THEN 'random-' || (p_size % 10) || '-' WHEN 4 THEN 'weighted-' ELSE '' END"


@query(
    f"WITH p AS (SELECT p_partkey, {_BARE} AS bare, {_SCOPE} AS scope FROM part), f AS (SELECT *, scope || bare AS feature FROM p), s AS (SELECT *, bare IN ('se-marginal', 'se-conditional', 'ecc', 'eigval', 'kle-heat', 'kle-matern') AS graph FROM f)"
    " SELECT p_partkey, feature, CASE WHEN scope = 'selected-' OR feature = 'weighted-ad' THEN 'selected' WHEN scope = 'full-' THEN 'full' WHEN scope LIKE 'random-%' THEN 'random' WHEN feature IN ('msp', 'perplexity', 'mte') THEN 'token' ELSE 'iid' END AS family,"
    " CASE WHEN feature IN ('full-ad', 'weighted-ad') THEN 'Trajectory AD' WHEN scope = '' AND bare IN ('msp', 'perplexity', 'mte') THEN 'Token UQ' WHEN scope = '' AND (graph OR bare = 'mcnse') THEN 'IID Sample UQ' WHEN scope = 'full-' AND graph THEN 'Full Trajectory UQ' WHEN scope = 'selected-' AND graph THEN 'Selected Step UQ' WHEN scope = 'random-' AND graph THEN 'Random Scope UQ' WHEN scope IN ('full-', 'selected-') OR scope LIKE 'random-%' THEN 'trajectory' ELSE 'other' END AS grp,"
    " CASE WHEN scope <> 'weighted-' AND bare IN ('msp', 'se-conditional', 'ecc') THEN -1 ELSE 1 END::DOUBLE AS direction FROM s"
)
def feature_families(spark, sf_dir):
    """Families, report groups and directions of names put together from parts: known and unknown features in every scope."""
    names = F.array(*map(L, [*features.BASE, *features.SAMPLING, "ad", "odd"]))
    size = C("p_size") % 6
    scope = F.when(size == 0, "full-").when(size == 1, "selected-").when(size == 2, "random-").when(size == 3, F.concat(L("random-"), (C("p_size") % 10).cast("string"), L("-"))).when(size == 4, "weighted-").otherwise("")
    named = table(spark, sf_dir, "part").select("p_partkey", F.concat(scope, F.get(names, (C("p_partkey") % 12).cast("int"))).alias("feature"))
    return named.select("p_partkey", "feature", features.family(C("feature")).alias("family"), features.group(C("feature")).alias("grp"), features.orientation(C("feature")).alias("direction"))


from lumenq import file_queries  # noqa: E402,F401  registers the queries over files and plans
