"""Timers, batch search and step decoding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenq.operators import graph, timing, tokens


def test_timer_is_set_when_it_raises():
    t = timing.Timer()
    with pytest.raises(ValueError), t:
        raise ValueError
    assert t.elapsed >= 0


def test_largest_working():
    def run(n):
        if n > 32:
            raise RuntimeError("out of memory")

    assert timing.largest_working([8, 64, 32, 128], run) == 32
    with pytest.raises(RuntimeError):
        timing.largest_working([64], run)


def test_timed_and_overhead(spark):
    seconds, rows = timing.timed(spark.range, 3)
    assert seconds >= 0 and rows == 3
    profile = spark.createDataFrame([("msp", 1.0, 1.5, 0.1)], "feature string, time_gen_mean double, time_total_mean double, time_total_std double")
    got = timing.with_overhead(profile).withColumn("x", F.lit(1)).first()
    assert got.overhead_mean == 0.5 and got.family == "token"


def test_decode_steps():
    ids = np.arange(12).reshape(1, 3, 4)
    assert timing.decode_steps(lambda s: f" {s[0]} ", ids, 0) == ["0", "4", "8"]
    assert timing.decode_steps(str, ids, 1) == [] == timing.decode_steps(str, ids[0], 0)


def test_timed_features_equal_their_operators(spark):
    weights = [[1.0, 0.9, 0.1], [0.9, 1.0, 0.3], [0.1, 0.3, 1.0]]
    edges = spark.createDataFrame([("p", 3, i, j, weights[i][j]) for i in range(3) for j in range(3)], "prompt_id string, n int, i int, j int, w double")
    seen = spark.createDataFrame([(s, "p", k, -0.1 * (k + 1) * (s + 1), [0.0, -1.0]) for s in range(2) for k in range(4)], "sample_id int, prompt_id string, pos int, lp double, top_lp array<double>")
    whole = graph.graph_features(edges).first()
    for feature in ("se-marginal", "se-conditional", "ecc", "eigval", "kle-heat", "kle-matern"):
        seconds, values = timing.timed_feature(feature, edges)
        assert seconds > 0 and values.first().value == pytest.approx(whole[feature.replace("-", "_")])
    own = {r.sample_id: r for r in tokens.token_features(seen).collect()}
    for feature in ("msp", "perplexity", "mte"):
        assert {r.sample_id: r.value for r in timing.timed_feature(feature, seen)[1].collect()} == pytest.approx({k: r[feature] for k, r in own.items()})
    assert timing.timed_feature("mcnse", seen)[1].first().value == pytest.approx(0.375)
    with pytest.raises(ValueError):
        timing.timed_feature("other", edges)


def test_latency_profile(spark):
    seen = spark.createDataFrame([(0, -0.5), (0, -1.5)], "sample_id int, lp double")
    rows = {r.feature: r for r in timing.latency_profile({"msp": seen, "perplexity": seen}, 2, 3.0).collect()}
    assert set(rows) == {"msp", "perplexity"} and all(r.family == "token" and r.time_gen_mean == 3.0 for r in rows.values())
    assert all(r.overhead_mean == pytest.approx(r.time_math_mean) and r.time_total_mean > 3.0 and r.time_math_std >= 0 for r in rows.values())
