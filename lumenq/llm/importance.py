"""Importance resampling towards a target: hashed n-gram buckets by external sort-count, and a Gumbel draw.

A document's words and pairs of words become a stream of bucket numbers of two bytes each. Streams are written once, in
pieces of many documents with the number of words of each, and every run of them is sorted and run-length encoded for
counts. From the counts of the corpus and of the target a gain for each bucket follows; it is gathered along the written
streams and summed between the documents' offsets. Gumbel noise by a hash of the id makes the highest scores a draw
without replacement; ranks come from ranges of the ordered scores, counted one by one.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.llm._shared import modest_batches, partitions_for, read_table, slices, staged, text_of

BUCKETS = 10_000
#: Percent of the documents with MIN_WORDS words or more that are drawn, and the seed in the noise's hash.
PERCENT, MIN_WORDS, SEED = 25, 20, 7
#: Bytes of text in a piece, and features that are sorted at a time.
PIECE_BYTES, RUN_FEATURES = 256 << 10, 4_000_000
#: Words a worker remembers, and the longest that tables combine; longer ones are hashed pair by pair.
MEMO_WORDS, TABLE_BYTES = 100_000, 63
#: A-Z to a-z; all other bytes below 0x80 but digits and a-z to a space. Bytes from 0x80 on belong to words.
WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def _shift_tables() -> np.ndarray:
    """[n, k, v]: what value v in byte k of a crc32 becomes when n zero bytes follow; a crc is the xor over its bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    steps = [np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]]
    for _ in range(TABLE_BYTES + 1):
        steps.append((steps[-1] >> np.uint32(8)) ^ table[steps[-1] & np.uint32(255)])
    return np.array(steps)


class Features:
    """Buckets of words and pairs of words. Remembers words' checksums; emptied beyond a bound."""

    def __init__(self, buckets: int):
        self.buckets, self.shift = np.uint32(buckets), _shift_tables()
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.alone, self.second, self.length = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.number.get, words))
        if None in found:
            if len(self.number) > MEMO_WORDS:
                self._forget()
            new = [w for w in dict.fromkeys(words) if w not in self.number]
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.alone = np.append(self.alone, np.fromiter(map(zlib.crc32, new), np.uint32, len(new)))
            self.second = np.append(self.second, np.fromiter((zlib.crc32(b" " + w) for w in new), np.uint32, len(new)))
            self.length = np.append(self.length, np.fromiter(map(len, new), np.int64, len(new)))
            found = list(map(self.number.__getitem__, words))
        return np.array(found, np.int64)

    def __call__(self, texts: list[list[bytes]]) -> np.ndarray:
        """The buckets of all texts, one after the other: each word, followed by its pair with the next word."""
        words = list(chain.from_iterable(texts))
        sizes = np.array(list(map(len, texts)), np.int64)
        ids = self._numbers(words)
        last = np.zeros(len(ids), bool)
        last[np.cumsum(sizes)[sizes > 0] - 1] = True
        left = np.flatnonzero(~last)
        crc, behind = self.alone[ids[left]], self.length[ids[left + 1]] + 1
        short = np.minimum(behind, TABLE_BYTES + 1)
        pair = self.second[ids[left + 1]]
        for k in range(4):
            pair = pair ^ self.shift[short, k, crc >> np.uint32(8 * k) & np.uint32(255)]
        for i in np.flatnonzero(behind > TABLE_BYTES + 1):
            pair[i] = zlib.crc32(words[left[i]] + b" " + words[left[i] + 1])
        at = 2 * np.arange(len(ids)) - (np.cumsum(last) - last)
        out = np.empty(len(ids) + len(left), np.uint16)
        out[at] = self.alone[ids] % self.buckets
        out[at[left] + 1] = pair % self.buckets
        return out


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets, sorted, and how often each is in the stream."""
    ordered = np.sort(stream)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    return ordered[first], np.diff(first, append=len(ordered))


def streams(table: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Pieces of ids, numbers of words and the packed stream; a piece that ends a run has the run's counts."""
    made = table.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
    schema = T.StructType([T.StructField("ids", T.ArrayType(made.schema["id"].dataType)), *T.StructType.fromDDL("words array<bigint>, stream binary, run_buckets binary, run_counts binary").fields])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        ids, texts, size, run, total, kind = [], [], 0, [], 0, None

        def piece(ends_run: bool) -> pa.RecordBatch:
            nonlocal run, total
            stream = features(texts)
            run.append(stream)
            total += len(stream)
            found = (None, None)
            if ends_run or total >= RUN_FEATURES:
                found = tuple(v.tobytes() for v in run_lengths(np.concatenate(run)))
                run, total = [], 0
            values = [pa.array([ids], pa.list_(kind)), pa.array([list(map(len, texts))], pa.list_(pa.int64()))] + [pa.array([v], pa.binary()) for v in (zstandard.compress(stream.tobytes(), 1), *found)]
            return pa.RecordBatch.from_arrays(values, schema.names)

        for batch in batches:
            kind = batch.schema.field("id").type
            for part in slices(batch, "text"):
                for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if texts and size + len(text) > PIECE_BYTES:
                        yield piece(False)
                        ids, texts, size = [], [], 0
                    ids.append(key)
                    texts.append(words_of(text))
                    size += len(text)
        if texts:
            yield piece(True)

    return made.mapInArrow(rows_of, schema)


def bucket_counts(made: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket: runs are added within each task, tasks by bucket; buckets numbers come to the driver."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for found, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[np.frombuffer(found, np.uint16)] += np.frombuffer(counts, np.int64)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["bucket", "n"])

    rows = made.select("run_buckets", "run_counts").where("run_buckets is not null").mapInArrow(rows_of, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the target's smoothed share of a bucket over the corpus's, in doubles."""
    s_all, t_all, k = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def weights(made: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document of the pieces."""
    kind = made.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL("n_words bigint, n_features bigint, weight bigint").fields])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column("words")[i].values.to_numpy()
                features = np.maximum(2 * words - 1, 0)
                stream = np.frombuffer(zstandard.decompress(batch.column("stream")[i].as_py()), np.uint16)
                weight, filled = np.zeros(len(words), np.int64), words > 0
                if filled.any():
                    weight[filled] = np.add.reduceat(gain[stream], (np.cumsum(features) - features)[filled]) // features[filled]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(words), pa.array(features), pa.array(weight)], schema.names)

    return made.select("ids", "words", "stream").mapInArrow(rows_of, schema)


def numbered(rows: DataFrame, *order) -> DataFrame:
    """rows with their place, from 1, in the given order: ranges are sorted and counted, and begin after those before them."""
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("part int, inside bigint").fields])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(done + 1, done + n + 1))], schema.names)
            done += n

    spark = rows.sparkSession
    ranged = staged(rows.repartitionByRange(partitions_for(spark), *order).sortWithinPartitions(*order).mapInArrow(count, schema), "numbered")
    sizes = sorted((r.part, r.n) for r in ranged.groupBy("part").agg(F.max("inside").alias("n")).collect())  # a row for each partition
    before = np.cumsum([0] + [n for _, n in sizes])
    begins = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, before, strict=False)], "part int, before bigint")
    return ranged.join(F.broadcast(begins), "part").withColumn("place", F.col("before") + F.col("inside")).drop("part", "before", "inside")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank is null for rows that are not drawn.

    buckets: at most 65,536. Of N rows with min_words words or more, floor(percent * N / 100) are drawn. Ties of score go
    to the smaller id, null first; then to the smaller weight and the fewer features; rows that are equal in all these are
    drawn in any order. Null, empty and blank texts have no features, weight 0, and are never drawn. Repeated rows count
    and are drawn each. A null id is hashed as an empty one. Very long texts are read whole. An empty table gives an
    empty result, an empty target counts nothing. Other columns are ignored, whatever they are called.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must be numbers of two bytes")
    modest_batches(docs.sparkSession)
    made = staged(streams(docs, id_col, text_col, buckets), "resample-streams")
    aim = staged(streams(target.withColumns({"__none": F.lit(0)}), "__none", target_text, buckets), "resample-target")
    gain = gains(bucket_counts(made, buckets), bucket_counts(aim, buckets))
    unit = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = weights(made, gain).withColumns({"score": (F.col("weight") + F.floor(-1000 * F.log(-F.log(unit)))).cast("bigint"), "fits": F.col("n_words") >= min_words})
    scored = staged(scored, "resample-scores")
    drawn = scored.where("fits").count() * percent // 100
    # the last column spreads rows that are equal in all others over ranges
    order = (F.col("fits").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("weight").asc(), F.col("n_features").asc(), F.col("spread").asc())
    placed = numbered(scored.withColumns({"spread": F.monotonically_increasing_id()}), *order)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).cast("bigint").alias("rank"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's distribution of words and pairs."""
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _counted(table: str) -> str:
    return f"SELECT crc % {BUCKETS} AS bucket, sum(n) AS n FROM (SELECT f, count(*) AS n FROM {table} GROUP BY f) JOIN crcs USING (f) GROUP BY 1"


OP12_SQL = re.sub(r"\s+", " ", rf"""
WITH steps AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS tab FROM range(256) r(i)),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
fs AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)),
crcs AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::BIGINT)), lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295) AS crc FROM fs, steps),
cs AS ({_counted("df")}), ct AS ({_counted("bf")}),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM cs) + {BUCKETS})::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM ct) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM (SELECT unnest(range({BUCKETS})) AS bucket) LEFT JOIN cs s USING (bucket) LEFT JOIN ct t USING (bucket)),
w AS (SELECT k, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM df JOIN crcs USING (f) JOIN g ON bucket = crc % {BUCKETS} GROUP BY k),
s AS (SELECT k, doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, len(w) >= {MIN_WORDS} AS fits FROM d LEFT JOIN w USING (k)),
r AS (SELECT *, row_number() OVER (PARTITION BY fits ORDER BY score DESC, doc_id, weight, n_features) AS place, count(*) FILTER (fits) OVER () AS n FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN fits AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM r
""").strip()
