"""Near-duplicate documents: universal hash minima, bands, signature verification, exact confirmation, components.

1. A pass over the texts makes each document's set of five-word shingles, its fingerprint and its band keys.
2. Documents with the same set fold into one class, so that copies cost nothing later.
3. Classes that share a band key are tied to the smallest of them; the components of these ties are the candidate
   groups. Two documents over the threshold share a band but for a chance below 1e-6; a lower one takes more bands.
   The sets of candidates are written; texts are not needed any more.
4. Every member is compared with its group's pivot, the class that shares most bands, in tasks that hold two sets at a
   time. That links all of most groups, however large.
5. What is left over is compared with everything else of its group: in tasks that take a block of it and a block of the
   others, whose size is bounded. Members linked to the pivot are connected already and not compared among each other.
   Within a task, prefix filtering finds the pairs that may pass, signatures refuse those far below the threshold, and
   whole sets confirm the rest; pairs already connected are skipped.
6. Components of the confirmed links, by alternating large-star and small-star.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.llm._shared import discard, modest_batches, narrow, partitions_for, read_table, slices, staged, text_key, text_of
from lumenq.llm.components import connected_components
from lumenq.llm.shingles import Minima, distinct, mix, shared_count, shingle_hashes

#: Bands, at least, of so many minima each, and the chance that a pair at the threshold shares none.
BANDS, ROWS, MISSED = 32, 6, 1e-6
#: Minima of the signature that pairs are verified by, and how many standard deviations below the threshold it may lie.
SIGNATURE, SLACK = 64, 5.0
#: Shingles of a block; a task takes two blocks at most, unless a single document has more.
GROUP_SHINGLES = 200_000

SIGNED = "doc_id bigint, text_key bigint, n_shingles bigint, set_key binary, bands array<bigint>"
SETS = "cid bigint, component bigint, shingles binary"


def bands_for(percent: int) -> int:
    """Bands with which a pair at the threshold shares none with a chance of at most MISSED."""
    met = (percent / 100) ** ROWS
    return BANDS if met >= 1 else max(BANDS, math.ceil(math.log(MISSED) / math.log1p(-met)))


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_bands: int = BANDS) -> DataFrame:
    """Set size, set fingerprint and band keys of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = Minima(n_bands * ROWS)
        salt = np.arange(n_bands, dtype=np.uint64)
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                sets = [distinct(shingle_hashes(t)) for t in part.column("text").to_pylist()]
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                bands: list = [[] for _ in sets]
                if len(full):
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    rows_of = minima.of(np.concatenate([sets[i] for i in full]), starts).reshape(len(full), n_bands, ROWS).astype(np.uint64)
                    keys = np.broadcast_to(salt, rows_of.shape[:2])
                    for k in range(ROWS):
                        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows_of[:, :, k])
                    for i, key in zip(full, keys.view(np.int64).tolist(), strict=True):
                        bands[i] = key
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(sizes, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "set_key", "bands"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(text_col).alias("text_key"), text_of(text_col).alias("text")).mapInArrow(rows, SIGNED)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as sorted sets of shingles."""
    for batch in batches:
        for part in slices(batch, "text", 1_000_000):
            found = [distinct(shingle_hashes(t)).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("cid"), part.column("component"), pa.array(found, pa.binary())], ["cid", "component", "shingles"])


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * |x & y| >= percent * |x | y|."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    shared = shared_count(x, y)
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _pivot_links(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pivot, cid) of the members that are linked to their pivot."""
        for batch in batches:
            out, pivot = [], None
            for cid, own, p, theirs in zip(*(batch.column(c) for c in ("cid", "shingles", "pivot", "pivot_shingles")), strict=True):
                if pivot is None or pivot[0] != p.as_py():
                    pivot = (p.as_py(), np.frombuffer(theirs.as_py(), np.uint64))
                if _linked(np.frombuffer(own.as_py(), np.uint64), pivot[1], percent):
                    out.append((pivot[0], cid.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["u", "v"])

    return rows


def links_of(ids: list[int], sets: list[np.ndarray], percent: int, minima: Minima, joined: list[bool] | None = None, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a task with 100 * |x & y| >= percent * |x | y|.

    Shingles are ordered from rare to common within the task. Two sets over the threshold share one of the first
    |x| - ceil(percent * |x| / 100) + 1 shingles of each, so only documents that meet there are compared.
    joined: members that are connected already, and are not compared with each other. sides: where given, only members
    of different sides are compared.
    """
    joined, sides = joined or [False] * len(sets), sides or [0] * len(sets)
    cross = len(set(sides)) > 1
    _, rank, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum([len(s) for s in sets])
    signatures = minima.of(np.concatenate(sets), np.concatenate([[0], ends[:-1]]))
    least = percent / 100 - SLACK * (percent / 100 * (1 - percent / 100) / len(minima.a)) ** 0.5
    root = np.arange(len(sets))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = next((i for i, j in enumerate(joined) if j), None)
    for i, j in enumerate(joined):
        if j:
            root[i] = first
    posting: dict[int, list[int]] = defaultdict(list)
    out = []
    for q in sorted(range(len(sets)), key=lambda i: (not joined[i], -sides[i], len(sets[i]), ids[i])):
        n = len(sets[q])
        own = rank[ends[q] - n : ends[q]]
        own = own[np.lexsort((own, counts[own]))][: n - -(-percent * n // 100) + 1]
        own = own[counts[own] > 1].tolist()
        # members joined already, and one of two sides, are only looked up by the others
        asks = not joined[q] and (not cross or sides[q] == 0)
        met = np.array(sorted({c for t in own for c in posting[t]}), np.int64) if asks else ()
        if not asks or not cross:
            for t in own:
                posting[t].append(q)
        if not len(met):
            continue
        met = met[(signatures[met] == signatures[q]).mean(1) >= least]
        for c in met.tolist():
            if find(c) != find(q) and _linked(sets[c], sets[q], percent):
                root[find(q)] = find(c)
                out.append((ids[c], ids[q]))
    return out


def _grouped_links(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each run of rows with the same (component, a, b); a task's run is held at a time, and its size is bounded."""
        minima = Minima(SIGNATURE, seed=11)
        key, members = None, {}

        def flush() -> pa.RecordBatch:
            found = []
            if len(members) > 1:
                sets, joined, sides = zip(*members.values(), strict=True)
                found = links_of(list(members), list(sets), percent, minima, list(joined), list(sides))
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["u", "v"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("component", "a", "b", "cid", "joined", "side", "shingles"))
            for component, a, b, cid, joined, side, shingles in zip(*columns, strict=True):
                if key != (component, a, b):
                    if key is not None:
                        yield flush()
                    key, members = (component, a, b), {}
                members.setdefault(cid, (np.frombuffer(shingles, np.uint64), joined, side))
        if key is not None:
            yield flush()

    return rows


def _tasks(rest: DataFrame, joined: DataFrame, block_shingles: int) -> DataFrame:
    """(component, cid, joined, a, b, side): the tasks of every member of groups that have some left over.

    Left-over members are dealt to blocks a; a task (a, b) compares two of these, or one with block b - blocks of joined
    members. A group that is no larger than a block is the task (0, 0) as a whole.
    """
    size = F.sum("n_shingles")
    groups = rest.groupBy("component").agg(size.alias("left")).join(joined.groupBy("component").agg(size.alias("linked")), "component", "left")
    whole = F.col("left") + F.coalesce("linked", F.lit(0)) <= block_shingles
    count = lambda c: F.when(whole, 1).otherwise(F.greatest(F.ceil(F.coalesce(c, F.lit(0)) / block_shingles), F.lit(1))).cast("int")
    groups = groups.select("component", whole.alias("whole"), count(F.col("left")).alias("blocks"), count(F.col("linked")).alias("others"))
    block = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    other = F.explode(F.when(F.col("whole"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") + F.col("others") - 1)))
    mine = rest.join(groups, "component").withColumn("own", block(F.col("blocks"))).withColumn("other", other)
    inside = F.col("other") < F.col("blocks")
    mine = mine.select("component", "cid", F.lit(False).alias("joined"), F.when(inside, F.least("own", "other")).otherwise(F.col("own")).alias("a"), F.when(inside, F.greatest("own", "other")).otherwise(F.col("other")).alias("b"), (inside & (F.col("own") > F.col("other"))).cast("int").alias("side"))
    theirs = joined.join(groups, "component").withColumn("own", block(F.col("others"))).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    theirs = theirs.select("component", "cid", F.lit(True).alias("joined"), "a", F.when(F.col("whole"), 0).otherwise(F.col("blocks") + F.col("own")).alias("b"), F.when(F.col("whole"), 0).otherwise(1).alias("side"))
    return mine.unionByName(theirs)


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key, stays of every row of docs.

    Null, empty and wordless texts have 0 shingles and are their own component; fewer than five words are one shingle.
    Very long texts are read whole. component_id is the smallest doc_id reachable over links; a null doc_id counts as
    greater than all, so it is null only in components without any id. kept says that the row's doc_id is component_id,
    so rows that repeat it, a null id among them, are all marked. stays tells them apart by text_key, a fingerprint of
    the text: it is true for the one row of a component that stays, and for rows equal to it in id and text. Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    log = staged(signed(docs, id_col, text_col, bands_for(percent)), "signed")
    # of each group the row of smallest id, and any key of its; numbers alone are aggregated by hashing, without a sort
    first = lambda i, k: (F.min(i).alias("h_id"), F.coalesce(F.min_by(k, i), F.min(k)).alias("h_key"))
    classes = log.where("n_shingles > 0").groupBy("set_key").agg(*first("doc_id", "text_key"), F.max("n_shingles").alias("n_shingles"))
    # numbers of the classes; once written, they are fixed
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    heads = classes.select("cid", "set_key", "h_id", "h_key")
    own_row = (log.set_key == heads.set_key) & log.doc_id.eqNullSafe(heads.h_id) & (log.text_key == heads.h_key)
    banded = log.join(heads, own_row).select("cid", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("cid").alias("hub"), F.count("*").alias("n")).where("n > 1")
    tied = staged(banded.join(hubs, "band").select("hub", "cid", "n"), "band-ties")
    candidates = staged(connected_components(tied.select(F.col("hub").alias("u"), F.col("cid").alias("v")), "candidate-stars"), "candidates")
    degree = tied.groupBy(F.col("cid").alias("node")).agg(F.sum("n").alias("degree"))
    members = candidates.join(degree, "node").join(classes.select(F.col("cid").alias("node"), "n_shingles", "h_id", "h_key"), "node").withColumnRenamed("node", "cid")
    members = staged(members, "members")
    pivots = staged(members.groupBy("component").agg(F.max_by("cid", "degree").alias("pivot")), "pivots")

    # the sets of candidates, from one row of each class
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(text_col).alias("text_key"), text_of(text_col).alias("text"))
    wanted = narrow(members.select("cid", "component", "h_id", "h_key"), members.count())
    sets = staged(texts.join(wanted, texts.doc_id.eqNullSafe(F.col("h_id")) & (texts.text_key == F.col("h_key"))).select("cid", "component", "text").mapInArrow(_sets, SETS), "candidate-sets")

    # a row for each member, beside its group's pivot; both sides of the join are plain shuffles, which can be split at a hot group
    theirs = sets.join(narrow(pivots.select("pivot"), pivots.count()), F.col("cid") == F.col("pivot")).select("component", "pivot", F.col("shingles").alias("pivot_shingles"))
    if sets.count() > members.count():  # rows equal in id and text gave a set each
        theirs = theirs.dropDuplicates(["pivot"])
    theirs = staged(theirs, "pivot-sets")
    pairs = sets.join(theirs, "component").where("cid <> pivot").select("cid", "shingles", "pivot", "pivot_shingles")
    by_pivot = staged(pairs.mapInArrow(_pivot_links(percent), "u bigint, v bigint"), "pivot-links")

    linked = by_pivot.select(F.col("v").alias("cid")).distinct()
    known = linked.unionByName(pivots.select(F.col("pivot").alias("cid")))
    sized = members.select("component", "cid", "n_shingles")
    rest = staged(sized.join(known, "cid", "left_anti"), "left-over")
    joined = sized.join(linked, "cid", "left_semi").join(rest.select("component").distinct(), "component", "left_semi")
    tasks = staged(_tasks(rest, joined, group_shingles), "tasks")
    grouped = sets.select("cid", "shingles").join(narrow(tasks, tasks.count()), "cid").select("component", "a", "b", "cid", "joined", "side", "shingles")
    grouped = grouped.repartition(partitions_for(spark), "component", "a", "b").sortWithinPartitions("component", "a", "b")
    links = staged(grouped.mapInArrow(_grouped_links(percent), "u bigint, v bigint"), "other-links")

    components = staged(connected_components(by_pivot.unionByName(links)), "components")
    # the row that stays of each component, then of each class
    in_groups = classes.join(components.select(F.col("node").alias("cid"), "component"), "cid")
    best = in_groups.groupBy("component").agg(*first("h_id", "h_key")).withColumnsRenamed({"h_id": "best_id", "h_key": "best_key"})
    best = components.join(best, "component").select(F.col("node").alias("cid"), "best_id", "best_key")
    # written, so that the last join's sides are plain shuffles and can be split at a hot set
    alone = F.col("best_key").isNull()
    labelled = staged(classes.join(best, "cid", "left").select("set_key", F.when(alone, F.col("h_id")).otherwise(F.col("best_id")).alias("best_id"), F.coalesce("best_key", "h_key").alias("best_key")), "labelled")
    discard(tied, candidates, members, pivots, sets, theirs, rest, tasks, by_pivot, links, components, classes)
    worded = F.col("best_key").isNotNull()
    own = F.when(worded, F.col("best_id")).otherwise(F.col("doc_id"))
    stays = ~worded | (F.col("best_id").eqNullSafe(F.col("doc_id")) & (F.col("best_key") == F.col("text_key")))
    return log.join(labelled, "set_key", "left").select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "text_key", stays.alias("stays"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of every document at 85 percent."""
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("text_key", "stays")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.x, p.y FROM p JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 100 * k >= 85 * (a.n + b.n - k)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(m.y, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS y FROM r GROUP BY x) m USING (doc_id)
"""
