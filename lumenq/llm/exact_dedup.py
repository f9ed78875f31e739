"""Exact dedup over an extendible-hash index on shared files.

Every text, freed of white space, becomes a key record (digest, doc_id, length). A directory over the leading bits of
the digest is grown by doubling until no bucket that can still be split holds more than its capacity. Records are
written to shared files in the order of buckets and digests, and owner tasks read the files: runs of equal digests
become partial groups, with the record that stays and a count, so no task holds a group. Buckets that cannot be split,
such as one text that makes a third of all rows, overflow into pages dealt by record; the partial groups of pages, and
of files that are read in parts, are merged. Texts are fetched for digests with two records or more alone, and compared
byte by byte; different texts under one digest are chained apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.llm._shared import SPACE, modest_batches, narrow, partitions_for, read_table, staged, text_key, text_of

#: Records of a bucket before it is split, and leading digest bits that the directory may use: at most 2**MAX_DEPTH entries.
BUCKET_RECORDS = 50_000
MAX_DEPTH = 14
PARTIAL = "digest binary, n bigint, n_points bigint, doc_id bigint, text_key bigint"


@dataclass
class Bucket:
    depth: int
    records: int
    number: int = 0
    pages: int = 1


@dataclass
class Directory:
    """Extendible-hash directory: entry i of 2**depth names the bucket of the digests that begin with the bits of i."""

    capacity: int
    max_depth: int
    counts: dict[int, int]
    depth: int = 0
    entries: list[Bucket] = field(default_factory=list)

    def grow(self) -> Directory:
        """Split overfull buckets, doubling when a bucket is as deep as the directory, from the counts at max_depth bits."""
        self.entries = [Bucket(0, sum(self.counts.values()))]
        i = 0
        while i < len(self.entries):
            bucket = self.entries[i]
            if bucket.records <= self.capacity or bucket.depth == self.max_depth:
                i += 1
                continue
            if bucket.depth == self.depth:  # doubling: each entry is now two that name the same bucket
                self.entries = [b for b in self.entries for _ in (0, 1)]
                self.depth += 1
                i = 2 * i
            self._split(i)
        for n, bucket in enumerate(dict.fromkeys(map(id, self.entries))):
            next(b for b in self.entries if id(b) == bucket).number = n
        for bucket in self.entries:
            bucket.pages = max(1, -(-bucket.records // self.capacity))
        return self

    def _split(self, i: int) -> None:
        bucket = self.entries[i]
        span = 1 << (self.depth - bucket.depth)
        start, half = i // span * span, span // 2
        for at in (start, start + half):
            shift = self.max_depth - bucket.depth - 1
            prefix = at >> (self.depth - bucket.depth - 1)
            new = Bucket(bucket.depth + 1, sum(self.counts.get(k, 0) for k in range(prefix << shift, (prefix + 1) << shift)))
            self.entries[at : at + half] = [new] * half

    def rows(self) -> list[tuple[int, int, int]]:
        """(entry at max_depth bits, bucket, pages): the directory spelled out for lookups."""
        shift = self.max_depth - self.depth
        return [(e, self.entries[e >> shift].number, self.entries[e >> shift].pages) for e in range(1 << self.max_depth)]


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(text_of(text_col), SPACE + "+", "")


def _prefix(digest: Column, bits: int) -> Column:
    return F.shiftright(F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("bigint"), 32 - bits).cast("int")


def build_index(keys: DataFrame, capacity: int = BUCKET_RECORDS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Key records (digest, n_points, doc_id, text_key) as files in the shared folder, in the order of buckets and digests.

    Within a digest the record that stays comes first: most code points, then smallest doc_id, null before all.
    """
    spark = keys.sparkSession
    log = staged(keys, "dedup-log")
    counts = {r[0]: r[1] for r in log.groupBy(_prefix(F.col("digest"), max_depth).alias("entry")).count().collect()}  # at most 2**max_depth rows
    directory = Directory(capacity, max_depth, counts).grow()
    # at most 2**max_depth rows of three numbers
    lookup = F.broadcast(spark.createDataFrame(directory.rows(), "entry int, bucket int, pages int"))
    page = F.pmod(F.xxhash64("doc_id", "text_key", "n_points"), "pages").cast("int")
    routed = log.withColumn("entry", _prefix(F.col("digest"), max_depth)).join(lookup, "entry").select(*keys.columns, "bucket", page.alias("page"))
    owners = max(partitions_for(spark), min(len({id(b) for b in directory.entries}), 1 << max_depth))
    order = ["bucket", "page", "digest", F.col("n_points").desc(), F.col("doc_id").asc_nulls_first(), "text_key"]
    return staged(routed.repartition(owners, "bucket", "page").sortWithinPartitions(*order), "dedup-index")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's pass over index records: a row for each run of equal digests, with its count and its first record."""
    open_run: tuple | None = None  # digest, count, first record

    def rows(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], ["digest", "n", "n_points", "doc_id", "text_key"])

    for batch in batches:
        if not batch.num_rows:
            continue
        digests = batch.column("digest").to_pylist()
        starts = [0, *(i for i in range(1, len(digests)) if digests[i] != digests[i - 1])]
        firsts = batch.take(pa.array(starts, pa.int64()))
        lengths = np.diff([*starts, len(digests)]).tolist()
        found = list(zip(firsts.column("digest").to_pylist(), lengths, *(firsts.column(c).to_pylist() for c in ("n_points", "doc_id", "text_key")), strict=True))
        if open_run is not None:
            if open_run[0] == found[0][0]:
                found[0] = (open_run[0], open_run[1] + found[0][1], *open_run[2:])
            else:
                found.insert(0, open_run)
        open_run = found.pop()
        if found:
            yield rows(found)
    if open_run is not None:
        yield rows([open_run])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, capacity: int = BUCKET_RECORDS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, text_key, stays of every row of docs.

    Null and empty texts are equal to each other; very long texts are digested whole. The text with the most code
    points stays, ties going to the smallest doc_id; a null doc_id counts as the smallest. Other columns are ignored;
    an empty table gives an empty result.
    kept says that the row's doc_id is the one that stays, so rows that repeat it, a null id among them, are all marked.
    stays tells them apart by text_key, a fingerprint of the original text: it is true for the one row that stays, and
    for rows equal to it in id and text.
    digest_bits: leading bits of the digest that key the index; fewer only to provoke collisions in tests.
    """
    modest_batches(docs.sparkSession)
    norm = normalised(text_col)
    # never null, so that joins by it need no filter that would digest every text once more
    sha = F.coalesce(F.unhex(F.sha2(norm, 256)), F.lit(b""))
    # a digest of fewer bits: these bits, then zeros
    key = sha if digest_bits == 256 else F.unhex(F.rpad(F.lpad(F.hex(F.shiftleft(F.shiftright(F.conv(F.hex(F.substring(sha, 1, 4)), 16, 10).cast("bigint"), 32 - digest_bits), 32 - digest_bits)), 8, "0"), 64, "0"))
    record = [F.char_length(text_of(text_col)).cast("bigint").alias("n_points"), F.col(id_col).cast("bigint").alias("doc_id"), text_key(text_col).alias("text_key")]
    index = build_index(docs.select(key.alias("digest"), *record), capacity, max_depth)
    first = F.min(F.struct((-F.col("n_points")).alias("order"), F.col("doc_id"), F.col("text_key")))
    partial = index.select("digest", "n_points", "doc_id", "text_key").mapInArrow(_runs, PARTIAL)
    # written before they are joined: both sides of the join are then plain shuffles, which can be split at a hot text
    groups = staged(partial.groupBy("digest").agg(F.sum("n").alias("group_size"), first.alias("keep")).where("group_size > 1"), "dedup-groups")
    # Bytes are compared in the sets: equal texts of a map task fold into one before the shuffle, so a hot text is sent
    # once by each task; a digest with more than one text gets a chain.
    shared = narrow(groups.select("digest"), groups.count())
    texts = docs.select(key.alias("digest"), norm.alias("norm")).join(shared, "digest", "left_semi").groupBy("digest").agg(F.collect_set("norm").alias("chain"))
    chains = staged(texts.where(F.size("chain") > 1).select("digest", F.posexplode(F.array_sort("chain")).alias("link", "norm")), "dedup-chains")
    if chains.isEmpty():
        rows, by = index, ["digest"]
    else:
        linked = docs.select(key.alias("digest"), sha.alias("sha"), norm.alias("norm"), *record).join(chains, ["digest", "norm"], "left")
        rows, by = staged(linked.select("digest", "sha", "n_points", "doc_id", "text_key", F.coalesce("link", F.lit(0)).alias("link")), "dedup-linked"), ["digest", "link"]
        groups = staged(rows.groupBy(*by).agg(F.count("*").alias("group_size"), first.alias("keep")).where("group_size > 1"), "dedup-groups")
    if digest_bits != 256 and chains.isEmpty():
        rows = docs.select(key.alias("digest"), sha.alias("sha"), *record)
    out = rows.join(groups, by, "left")
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id"))
    stays = alone | ((F.col("keep.order") == -F.col("n_points")) & F.col("keep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keep.text_key") == F.col("text_key")))
    sha256 = F.lower(F.hex("sha" if "sha" in rows.columns else "digest"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), sha256.alias("text_sha256"), "text_key", stays.alias("stays"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of every document by its text without white space."""
    return exact_duplicates(read_table(spark, sf_dir, "documents")).drop("text_key", "stays")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
k AS (SELECT doc_id, n, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size
      FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM k
"""
