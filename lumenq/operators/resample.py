"""Bootstrap, folds and splits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenq.operators.metrics import METRICS, evaluate_scores
from lumenq.operators.prefix import prefix_sums
from lumenq.sources import places
from lumenq.staging import staged

CONFIDENCE = 0.95


def digest_number(*parts: Column) -> Column:
    """A number of 32 bits from md5 of the parts joined by dashes: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")


def positions(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """scores with pos, the place of a row by id within its keys from 0, and n, how many there are."""
    counted = prefix_sums(scores.withColumn("__one", F.lit(1).cast("bigint")), list(keys), "id", ["__one"])
    sizes = scores.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.join(sizes, list(keys)).withColumn("pos", F.col("__one_before")).drop("__one", "__one_before")


def resamples(scores: DataFrame, reps: int, seed: int = 0, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """(keys, rep, id, y, s): n draws with replacement for each rep; draw j of a rep takes position digest(seed, rep, j) mod n.

    Every row makes its own draws, one for each rep, so that nothing is generated on the driver; a draw then meets its
    row by (keys, position). Both sides are shuffled, whatever their files' size lets Spark guess: the rows grow with the
    table, and as a broadcast they would have to fit the driver.
    """
    keys = list(keys)
    placed = staged(positions(scores, keys), "positions")
    draws = placed.select(*keys, "n", F.col("pos").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    draws = draws.select(*keys, "rep", "draw", (digest_number(F.lit(seed), F.col("rep"), F.col("draw")) % F.col("n")).alias("pos"))
    return draws.join(placed.select(*keys, "pos", "y", "s").hint("merge"), [*keys, "pos"]).select(*keys, "rep", F.col("draw").alias("id"), "y", "s")


def _raw_words(seed: int, first: int, count: int) -> np.ndarray:
    """Words first to first + count of the generator's stream of 32-bit words; first and count are even."""
    bits = np.random.PCG64(np.random.SeedSequence(seed))
    bits.advance(first // 2)
    return bits.random_raw(count // 2).astype("<u8").view("<u4")  # the low half of each number comes first


def generator_draws(spark: SparkSession, n: int, reps: int, seed: int = 0, slice_words: int = 1 << 20) -> DataFrame:
    """(rep, draw, pos) by numpy's PCG64 generator, one stream for all reps in order: the draws a numpy program makes.

    A draw below n takes a 32-bit word by Lemire's method, which refuses some words; whether a word is refused depends
    on it alone. So tasks jump into the stream: one pass counts the words that slices of it accept, one pass gives them
    their places. The work is linear in n x reps, and a task holds a slice. n is below 2**32.
    """
    if not 0 < n < 1 << 32:
        raise ValueError(f"{n} positions")
    result = "rep bigint, draw bigint, pos bigint"
    if n == 1:  # nothing to draw
        return spark.range(reps).select(F.col("id").alias("rep"), F.lit(0).cast("bigint").alias("draw"), F.lit(0).cast("bigint").alias("pos"))
    total, refused = n * reps, ((1 << 32) - n) % n

    def accepted(k: int) -> np.ndarray:
        product = _raw_words(seed, k * slice_words, slice_words).astype(np.uint64) * np.uint64(n)
        return (product >> np.uint64(32))[(product & np.uint64(0xFFFFFFFF)) >= np.uint64(refused)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(accepted(k)) for k in ids], pa.int64())], ["id", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, before in zip(batch.column("id").to_pylist(), batch.column("before").to_pylist(), strict=True):
                drawn = accepted(k)[: max(0, total - before)].astype(np.int64)
                at = np.arange(before, before + len(drawn))
                yield pa.RecordBatch.from_arrays([pa.array(at // n), pa.array(at % n), pa.array(drawn)], ["rep", "draw", "pos"])

    # a word is accepted with a chance of at least one half: slices enough, and one more for the last
    share = 1 - refused / (1 << 32)
    slices = int(total / share / slice_words * 1.02) + 2
    counts = sorted((r.id, r.n) for r in spark.range(slices).mapInArrow(counted, "id bigint, n bigint").collect())  # two numbers a slice
    ends = np.cumsum([c for _, c in counts])
    if not len(ends) or ends[-1] < total:
        raise RuntimeError("the generator's slices hold too few words")
    begun = [(int(k), int(end - c)) for (k, c), end in zip(counts, ends, strict=True) if end - c < total]
    return spark.createDataFrame(begun, "id bigint, before bigint").repartition(min(len(begun), 4096), "id").mapInArrow(rows, result)


def percentile_interval(value: Column, confidence: float = CONFIDENCE) -> tuple[Column, Column]:
    """The ends of a percentile interval by linear interpolation; null without values."""
    tail = (1 - confidence) / 2
    return F.percentile(value, tail), F.percentile(value, 1 - tail)


def bootstrap_metrics(scores: DataFrame, reps: int = 1000, seed: int = 0, keys: Sequence[str] = ("feature",), metrics: Sequence[str] = METRICS, measure=evaluate_scores) -> DataFrame:
    """For each metric its mean, sample deviation, valid count and interval over resamples that have both classes.

    The scores are written once, since their positions are counted in several passes.
    """
    keys = list(keys)
    scores = staged(scores.select(*keys, "id", "y", "s"), "bootstrap-scores")
    each = measure(resamples(scores, reps, seed, keys), [*keys, "rep"]).where("pos > 0 and pos < n")
    columns = [F.lit(reps).alias("n_bootstrap"), F.count("*").alias("valid_bootstrap")]
    for m in metrics:
        value = F.when(~F.isnan(m) & (F.abs(F.col(m)) < float("inf")), F.col(m))
        low, high = percentile_interval(value)
        columns += [F.avg(value).alias(f"{m}_bootstrap_mean"), F.when(F.count(value) > 1, F.stddev_samp(value)).alias(f"{m}_bootstrap_std"), F.count(value).alias(f"{m}_bootstrap_valid"), low.alias(f"{m}_ci_low"), high.alias(f"{m}_ci_high")]
    return each.groupBy(*keys).agg(*columns)


def aggregate_folds(values: DataFrame) -> DataFrame:
    """(section, feature, metric) -> mean, population std and per_fold list from rows with fold and value.

    Values that are no finite number count in per_fold alone; a missing fold shifts the ones after it.
    """
    number = F.col("value").cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    ordered = F.transform(F.array_sort(F.collect_list(F.when(number.isNotNull(), F.struct("fold", number.alias("v"))))), lambda p: p["v"])
    return values.groupBy("section", "feature", "metric").agg(F.avg(finite).alias("mean"), F.stddev_pop(finite).alias("std"), ordered.alias("per_fold")).where(F.size("per_fold") > 0)


def _ordered(ids: DataFrame, id_col: str, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """ids with place: their order by (digest of seed and id, id) within keys, from 0."""
    keyed = ids.withColumns({"__digest": F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(id_col).cast("string"))), "__one": F.lit(1).cast("bigint")})
    # the first 15 digits order the blocks; the whole digest and the id order the rows of a block
    number = F.conv(F.substring("__digest", 1, 15), 16, 10).cast("bigint")
    keyed = keyed.withColumn("__number", number).withColumn("__bucket", F.shiftright("__number", 48).cast("int"))
    counts = keyed.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = keyed.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy("__digest", id_col)) - 1)
    return inside.join(before.drop("__n"), [*keys, "__bucket"]).withColumn("place", F.col("__before") + F.col("__rank")).select(*ids.columns, "place")


def split_prompts(ids: DataFrame, train: int, val: int, test: int, seed: int = 42, id_col: str = "prompt_id") -> DataFrame:
    """ids with split: the first train by their seeded order, then val, then test; an error if there are too few."""
    have, want = ids.count(), train + val + test
    if want > have:
        raise ValueError(f"{want} prompts asked for, {have} there")
    place = F.col("place")
    role = F.when(place < train, "train").when(place < train + val, "val").when(place < want, "test")
    return _ordered(ids, id_col, seed).withColumn("split", role).where("split is not null").drop("place")


def kfold_splits(ids: DataFrame, k: int, n_train: int, seed: int = 42, id_col: str = "prompt_id", label: str | None = None) -> DataFrame:
    """(fold, role, id): test parts share out all ids, sizes differing by one at most; n_train of the rest train, others are val.

    With a label, ids are dealt class by class, so that each role of a fold keeps the classes' shares.
    """
    n = ids.count()
    if k < 2 or k > n:
        raise ValueError(f"{k} folds of {n} prompts")
    if n_train > n - -(-n // k):
        raise ValueError(f"{n_train} training prompts asked for, {n - -(-n // k)} outside a test fold")
    folds = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")
    if label is None:
        placed = _ordered(ids, id_col, seed)
        rows = placed.select(F.col(id_col).alias("id"), "place", F.pmod(F.col("place"), F.lit(k)).cast("int").alias("own"), folds)
        # the place among the rows outside a fold's test part, in closed form
        outside = F.col("place") - F.floor((F.col("place") + F.lit(k - 1) - F.col("fold")) / k)
        role = F.when(F.col("own") == F.col("fold"), "test").when(outside < n_train, "train").otherwise("val")
        return rows.select("fold", role.alias("role"), "id")
    # Test parts: class after class is dealt out, each going on where the one before ended, so sizes differ by one at most.
    w = Window.orderBy(F.col("__label").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ids.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__size"))  # a row for each class
    sizes = sizes.withColumn("__start", F.coalesce(F.sum("__size").over(w), F.lit(0))).withColumn("__class", F.dense_rank().over(Window.orderBy(F.col("__label").asc_nulls_first())))
    own = _ordered(ids, id_col, seed, [label])
    dealt = own.join(sizes, own[label].eqNullSafe(sizes["__label"])).select(F.col(id_col).alias("id"), "place", "__size", "__start", "__class", folds)
    in_fold = lambda before: F.floor((F.col("__start") + before - 1 - F.col("fold")) / k) - F.floor((F.col("__start") - 1 - F.col("fold")) / k)
    is_test = F.pmod(F.col("__start") + F.col("place"), F.lit(k)) == F.col("fold")
    # The rest of a fold: classes are interleaved by the share of themselves that has passed, and the first n_train train.
    share = (F.col("place") - in_fold(F.col("place")) + 0.5) / (F.col("__size") - in_fold(F.col("__size")))
    # 52 bits of the share, then the class: distinct for classes of up to 2**51 rows
    share = (share * F.lit(float(1 << 52))).cast("decimal(20,0)") * F.lit(1 << 16).cast("decimal(10,0)") + F.col("__class")
    rest = dealt.where(~is_test).select("fold", "id", share.alias("__share"), F.lit(1).cast("bigint").alias("__one"))
    trained = prefix_sums(rest, ["fold"], "__share", ["__one"]).select("fold", F.when(F.col("__one_before") < n_train, "train").otherwise("val").alias("role"), "id")
    return dealt.where(is_test).select("fold", F.lit("test").alias("role"), "id").unionByName(trained)


def save_splits(splits: DataFrame, path: str, **about) -> None:
    """Folds or splits as one JSON document; ids are collected, as the file holds them all."""
    import json

    groups: dict = {}
    for r in splits.collect():
        row = r.asDict()
        groups.setdefault(row.get("fold"), {}).setdefault(row.get("role") or row.get("split"), []).append(row.get("id", row.get("prompt_id")))
    roles = lambda g: {k: sorted(v) for k, v in sorted(g.items())}
    document = dict(about)
    if None in groups:
        document |= {"counts": {k: len(v) for k, v in sorted(groups[None].items())}, **roles(groups[None])}
    else:
        document |= {"k": len(groups), "folds": [roles(groups[f]) for f in sorted(groups)]}
    places.write_text(path, json.dumps(document, indent=2) + "\n")


def load_splits(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(splits, what else the document says) as saved."""
    import json

    document = json.loads(places.read_text(path))
    names = ("train", "val", "test")
    if "folds" in document:
        rows = [(i, role, str(x)) for i, fold in enumerate(document["folds"]) for role in names for x in fold.get(role, [])]
        return spark.createDataFrame(rows, "fold int, role string, id string"), {k: v for k, v in document.items() if k != "folds"}
    rows = [(role, str(x)) for role in names for x in document.get(role, [])]
    return spark.createDataFrame(rows, "split string, prompt_id string"), {k: v for k, v in document.items() if k not in names}
