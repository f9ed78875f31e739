"""Tensor files: read in ranges of rows, pruned by sample, written run by run."""

import numpy as np
import pytest

from lumenq.sources import tensors


@pytest.fixture
def arrays():
    draw = np.random.default_rng(1)
    return draw.normal(size=(11, 5, 3)).astype(np.float32), draw.integers(0, 1000, (11, 5, 3))


def values(df):
    rows = sorted((r.sample_id, r.pos, r.rank, r.token_id, r.logprob) for r in df.collect())
    return np.array([r[3] for r in rows]), np.array([r[4] for r in rows], np.float32)


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
@pytest.mark.parametrize("layout", ["C", "F"])
def test_ranges_make_the_whole(spark, tmp_path, arrays, save, layout):
    lp, ids = arrays
    save(tmp_path / "topk_logprobs.npz", topk_logprobs=np.asarray(lp, order=layout), topk_token_ids=ids)
    got = tensors.read_tensors(spark, str(tmp_path), cells=12)
    tasks = got.rdd.getNumPartitions()
    # 4 rows a range of 55 rows; of compressed arrays at most eight ranges; an array by columns has one
    assert tasks == (1 if layout == "F" else 14 if save is np.savez else 8)
    found = values(got)
    assert np.array_equal(found[0], ids.ravel()) and np.array_equal(found[1], lp.ravel())
    assert {r.run for r in got.select("run").distinct().collect()} == {str(tmp_path)}


def test_samples_are_chosen_by_range(spark, tmp_path, arrays):
    lp, ids = arrays
    np.savez(tmp_path / "topk_logprobs.npz", topk_logprobs=lp.astype(np.float64), topk_token_ids=ids)
    for low, high, samples in ((4, 5, [4]), (2, 7, range(2, 7)), (9, None, [9, 10]), (0, 1, [0]), (-3, 2, [0, 1]), (40, None, []), (5, 5, []), (7, 3, [])):
        read = tensors.read_tensors(spark, str(tmp_path), 15, low, high)
        found = values(read)
        assert np.array_equal(found[0], ids[list(samples)].ravel()) and np.array_equal(found[1], lp[list(samples)].ravel()), (low, high)
        assert read.rdd.getNumPartitions() == max(1, len(samples))


@pytest.mark.parametrize("pushdown", ["true", "false"])
def test_one_table_serves_many_filters(spark, tmp_path, arrays, pushdown):
    np.savez(tmp_path / "topk_logprobs.npz", topk_logprobs=arrays[0], topk_token_ids=arrays[1])
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", pushdown)
    try:
        read = tensors.read_tensors(spark, str(tmp_path), cells=15)
        assert [read.where(c).count() for c in ("sample_id = 4", "sample_id in (2, 6)", "sample_id >= 9", "pos = 0")] == [15, 30, 30, 33] and read.count() == 165
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_no_files_and_wrong_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert tensors.read_tensors(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="(?i)not ?found|absent"):
        tensors.read_tensors(spark, str(tmp_path / "absent")).count()
    np.savez(tmp_path / "none" / "a.npz", topk_logprobs=np.zeros((1, 2, 3)), topk_token_ids=np.zeros((1, 2, 2)))
    with pytest.raises(Exception, match="shapes"):
        tensors.read_tensors(spark, str(tmp_path / "none")).count()
    (tmp_path / "empty").mkdir()
    np.savez(tmp_path / "empty" / "a.npz", topk_logprobs=np.zeros((0, 2, 3)), topk_token_ids=np.zeros((0, 2, 3)))
    assert tensors.read_tensors(spark, str(tmp_path / "empty")).count() == 0


@pytest.mark.parametrize("compressed", [True, False])
def test_written_files_are_plain_arrays(spark, tmp_path, compressed):
    cells = [(run, s, p, r, s * 100 + p * 10 + r, -0.5 * r - s) for run, n in (("a", 3), ("b", 2)) for s in range(n) for p in range(4) for r in range(2)]
    long = spark.createDataFrame(cells[::-1], "run string, sample_id int, pos int, rank int, token_id int, logprob float")
    tensors.write_tensors(long, f"file:{tmp_path}/out", compressed)
    loaded = np.load(tmp_path / "out" / "a" / "topk_logprobs.npz")
    assert loaded["topk_logprobs"].shape == (3, 4, 2) and loaded["topk_logprobs"].dtype == np.float32 and loaded["topk_token_ids"].dtype == np.int32
    assert loaded["topk_token_ids"][2, 3, 1] == 231 and loaded["topk_logprobs"][2, 3, 1] == -2.5
    back = tensors.read_tensors(spark, f"file:{tmp_path}/out")
    assert sorted(map(tuple, back.selectExpr("regexp_extract(run, '([^/]+)$', 1)", "sample_id", "pos", "rank", "token_id", "logprob").collect())) == sorted(cells)
    assert sorted(p.name for p in (tmp_path / "out" / "a").iterdir()) == ["topk_logprobs.npz"]
    for wrong in (long.where("not (run = 'b' and pos = 2 and rank = 0)"), long.unionByName(long.where("run = 'b' and pos = 3"))):
        with pytest.raises(Exception, match="gaps or repeats"):
            tensors.write_tensors(wrong, f"{tmp_path}/wrong", compressed)


def test_many_ranges_share_tasks(spark, tmp_path, arrays, monkeypatch):
    monkeypatch.setattr(tensors, "MOST_TASKS", 4)
    lp, ids = arrays
    for run, save in (("a", np.savez), ("b", np.savez_compressed)):
        (tmp_path / run).mkdir()
        save(tmp_path / run / "topk_logprobs.npz", topk_logprobs=lp, topk_token_ids=ids)
    planned = tensors.TensorReader(str(tmp_path), 12).partitions()  # 14 ranges and 8
    assert [len(p.parts) for p in planned] == [1, 1, 2, 1] and sum(r.last - r.first for p in planned for r in p.parts) == 110
    read = [(r["run"][-1], r["sample_id"], r["pos"], r["rank"], r["token_id"]) for p in planned for b in tensors.TensorReader(str(tmp_path), 12).read(p) for r in b.to_pylist()]
    assert read == [(run, s, p, k, ids[s, p, k]) for run in "ab" for s in range(11) for p in range(5) for k in range(3)]
