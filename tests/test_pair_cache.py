"""The pair cache across runs and versions, and one look-up for all scopes."""

import re

from pyspark.sql import functions as F

from lumenq.backends import JaccardScorer
from lumenq.operators.pair_cache import PairCache, ScoredPairs, prefetched
from lumenq.plans import pipeline


class Counting:
    """Counts calls and pairs on the way to another scorer."""

    def __init__(self, shift=0.0):
        self.calls, self.pairs, self.shift = 0, 0, shift

    def score(self, pairs):
        self.calls, self.pairs = self.calls + 1, self.pairs + pairs.count()
        return JaccardScorer().score(pairs).withColumn("p_entailment", F.col("p_entailment") + self.shift)


def frame(spark, pairs):
    return spark.createDataFrame([(*p, k) for k, p in enumerate(pairs)], "premise string, hypothesis string, k int")


def test_a_second_run_scores_new_pairs_alone(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    first, second, other = Counting(), Counting(0.25), Counting()
    a = [("a b", "b c"), ("a b", "b c"), ("x", None), (None, "x"), ("", "x")]
    got = {r.k: r.p_entailment for r in PairCache(spark, path, "v1", 3).scored(frame(spark, a), first).collect()}
    assert len(got) == 5 and first.pairs == 4 and abs(got[0] - 1 / 3) < 1e-6
    later = PairCache(spark, path, "v1")  # another run finds the number of buckets
    assert later.buckets == 3
    got = {r.k: r.p_entailment for r in later.scored(frame(spark, [*a, ("new", "new"), ("b c", "a b")]), second).collect()}
    assert second.pairs == 2 and abs(got[0] - 1 / 3) < 1e-6 and got[5] == 1.25 and abs(got[6] - 1 / 3 - 0.25) < 1e-6
    PairCache(spark, path, "v2").scored(frame(spark, a), other).count()
    assert other.pairs == 4  # another version has no scores yet
    later._append(spark.table(later._table(later.folder)).where("version = 'v1'"), later.folder)  # a run that was repeated
    assert later.rows().count() == 6 and spark.table(later._table(later.folder)).count() == 16
    old = later.folder
    later.compact()
    assert later.folder != old and spark.table(later._table(later.folder)).count() == 10 and PairCache(spark, path, "v1").rows().count() == 6
    again = Counting()
    assert later.scored(frame(spark, a), again).count() == 5 and again.pairs == 0
    assert later.scored(frame(spark, a[:0] or [("a", "b")]).limit(0), again).count() == 0


def test_the_cache_is_not_shuffled(spark, tmp_path):
    cache = PairCache(spark, f"file://{tmp_path}/cache", "v1", 4)
    asked = frame(spark, [(f"a {i}", f"b {i % 7}") for i in range(100)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = cache.scored(asked)
        assert found.count() == 100
        plan = found._jdf.queryExecution().executedPlan().toString()
        initial = plan.split("Initial Plan")[-1] if "Initial Plan" in plan else plan
        assert len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", initial)) == 1 and "Bucketed: true" in initial  # the asked side alone
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_all_scopes_ask_once(spark, tmp_path):
    rows = spark.createDataFrame([(str(p), p % 2 == 0) for p in range(5)], "prompt_id string, is_correct boolean")
    talks = spark.createDataFrame([(str(p), k, 6, [f"w{(p + i * k) % 4} x" for i in range(5)] + ["w1 x"], "w1 x") for p in range(5) for k in range(2)], "prompt_id string, response_sample_id int, num_steps int, step_answers array<string>, final_answer string")
    plain, cached, warm = Counting(), Counting(), Counting()
    ordered = lambda scorer, **more: pipeline.baseline_features(rows, talks, scorer, full_trajectory=True, random_scopes=2, random_steps=3, **more).orderBy("prompt_id").collect()
    want = ordered(plain)
    texts = {(a, b) for r in talks.where("response_sample_id = 0").collect() for a in r.step_answers for b in r.step_answers}
    assert plain.calls == 1 and plain.pairs <= len(texts)
    assert ordered(cached, cache=PairCache(spark, f"file://{tmp_path}/c", "v", 2)) == want and cached.pairs == plain.pairs
    assert ordered(warm, cache=PairCache(spark, f"file://{tmp_path}/c", "v", 2)) == want and warm.pairs == 0


def test_prefetched_is_a_scorer(spark):
    asked = frame(spark, [("a", "b"), ("a", "a")])
    found = prefetched([asked, asked.limit(1)], Counting())
    assert isinstance(found, ScoredPairs) and found.score(asked.select("premise", "hypothesis")).count() == 2


def test_buckets_grow_with_what_is_asked(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lumenq.operators.pair_cache.ROWS_A_BUCKET", 10)
    path = f"file://{tmp_path}/cache"
    cache = PairCache(spark, path, "v1", 2)
    pairs = [(f"a {i}", f"b {i % 7}") for i in range(30)]
    first, second = Counting(), Counting()
    early = cache.scored(frame(spark, pairs[:15]), first)
    assert cache.buckets == 2 and early.count() == 15
    got = cache.scored(frame(spark, [*pairs, *pairs]), second)  # repeats count: a task would get their rows
    assert cache.buckets == 8 and got.count() == 60 and first.pairs == second.pairs == 15
    assert early.count() == 15 and cache.rows().count() == 30  # tables made before read the old files
    again = PairCache(spark, path, "v1")
    assert again.buckets == 8 and again.scored(frame(spark, pairs), second).count() == 30 and second.pairs == 15
