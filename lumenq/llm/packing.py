"""Best-fit packing of token sequences by length patterns.

The documents' piece lengths are reduced to a histogram of at most max_tokens bins. Patterns of up to three lengths
that fill a sequence exactly are enumerated, and non-negative least squares fits how often each repeats; the counts are
rounded down to what the histogram holds, and what is left is packed by best fit over the histogram. The plan is a list
of runs (pattern, repeats), whose size depends on max_tokens alone; pieces then find their places by their rank within
their length. Neither the plan nor any task grows with the number of documents.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenq.llm._shared import modest_batches, partitions_for, read_table, slices, staged, text_of

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Characters on which the rank-file encoder and the JSON tokenizer are tested to agree; other texts go to the latter.
COMMON = re.compile("[\x00-ɏ‐-‧€一-龥ぁ-ゖァ-ヺ가-힣Ѐ-џΑ-ΡΣ-ω]*")
#: Texts over this many characters with a longer run of one kind go to the JSON tokenizer, whose merges stay near linear.
LONG_RUN = re.compile(r"\S{4000}|\s{4000}")


class Encoder:
    """Token ids of a text as the JSON tokenizer gives them, by the faster rank-file encoder where both agree."""

    def __init__(self, json_path: str, ranks_path: str | None):
        self.json_path = json_path
        with open(json_path, encoding="utf-8") as f:
            text = f.read()
        found = re.search(r'"added_tokens"\s*:\s*(?=\[)', text)  # the list alone: the whole file holds the vocabulary
        added = [t["content"] for t in json.JSONDecoder().raw_decode(text, found.end())[0]] if found else []
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def tokenizer(self):
        """Loaded when a text first needs it: most workers never hold two vocabularies."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and COMMON.fullmatch(text) and not self.special.search(text) and not (len(text) > 4000 and LONG_RUN.search(text)):
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(2)
def encoder(json_path: str, ranks_path: str | None) -> Encoder:
    return Encoder(json_path, ranks_path)


def tokenised_pieces(docs: DataFrame, json_path: str, ranks_path: str | None, max_tokens: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of at most max_tokens ids; only a longer document is cut, its first piece taking what does not fill one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, ranks_path)
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[list] = [[], [], [], [], []]
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                    cuts = [0, *range((len(ids) - 1) % max_tokens + 1, len(ids) + 1, max_tokens)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for column, value in zip(out, (doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    modest_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(rows, PIECES)


def patterns(size: int, present: np.ndarray) -> np.ndarray:
    """All ways to fill size with one, two or three present lengths, descending, as rows padded with zeros."""
    have = np.zeros(size + 1, bool)
    have[present] = True
    found = [[(size, 0, 0)]] if have[size] else []
    a = np.arange(size // 2, size)[::-1]
    a = np.array([x for x in range(size - 1, (size - 1) // 2, -1)])
    pairs = a[have[a] & have[size - a] & (a >= size - a)]
    found.append(np.column_stack([pairs, size - pairs, np.zeros_like(pairs)]))
    for first in range(size - 2, (size + 2) // 3 - 1, -1):
        if have[first]:
            second = np.arange(min(first, size - first - 1), (size - first - 1) // 2, -1)
            third = size - first - second
            ok = have[second] & have[third] & (second >= third) & (third > 0)
            found.append(np.column_stack([np.full(ok.sum(), first), second[ok], third[ok]]))
    return np.concatenate([np.asarray(f, np.int64).reshape(-1, 3) for f in found])


def repeat_counts(rows: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative least squares of pattern repeats against the histogram, by accelerated projected gradient.

    Weights make a place left over cost what it is long: short leftovers fill gaps, long ones open sequences.
    """
    size = len(histogram) - 1
    weight = 0.1 + np.arange(size + 1) / size
    use = rows > 0

    def places(x):
        return sum(np.bincount(rows[:, k][use[:, k]], x[use[:, k]], size + 1) for k in range(3))

    def back(r):
        r = r.copy()
        r[0] = 0
        return r[rows].sum(1)

    v = np.random.default_rng(0).random(len(rows))
    for _ in range(20):  # power iteration for the step length
        v = back(weight**2 * places(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(weight**2 * (places(y) - histogram)) / (1.02 * norm))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_runs(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of sequences that hold every piece of the histogram exactly once."""
    size = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    runs: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        runs.append(((size,), int(left[size])))
        left[size] = 0
    present = np.flatnonzero(left)
    rows = patterns(size, present) if len(present) else np.zeros((0, 3), np.int64)
    if len(rows):
        fit = repeat_counts(rows, left.astype(float))
        for i in np.argsort(-fit, kind="stable"):
            want = int(np.ceil(fit[i] - 0.25))  # rounded; the histogram bounds it below
            if want <= 0:
                if fit[i] <= 0.01:
                    break
                want = 1
            lengths = tuple(int(v) for v in rows[i] if v)
            need = defaultdict(int)
            for v in lengths:
                need[v] += 1
            times = min([want, *(int(left[v]) // k for v, k in need.items())])
            if times > 0:
                runs.append((lengths, times))
                for v, k in need.items():
                    left[v] -= k * times
    return runs + best_fit(left)


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: whole runs of like sequences are filled at once."""
    size = len(left) - 1
    open_runs: dict[int, list[list]] = defaultdict(list)  # space left -> [lengths, how many]
    spaces: list[int] = []
    for length in range(size, 0, -1):
        count = int(left[length])
        while count:
            fits = [s for s in spaces if s >= length and open_runs[s]]
            if fits:
                space = min(fits)
                lengths, many = open_runs[space].pop()
                used = min(many, count)
                if many > used:
                    open_runs[space].append([lengths, many - used])
            else:
                per = size // length  # new sequences take as many of this length as fit
                lengths, space = (), size
                used = count // per if count >= per else 1
                fill = min(per, count)
                lengths, space = (length,) * (fill - 1), size - length * (fill - 1)
                count -= used * (fill - 1)
            count -= used
            if space - length not in open_runs or space - length not in spaces:
                spaces.append(space - length)
            open_runs[space - length].append([(*lengths, length), used])
            spaces = [s for s in spaces if open_runs[s]]
    return [(tuple(lengths), many) for runs in open_runs.values() for lengths, many in runs]


def slots(runs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset): where the pieces of a length go, by their rank in it."""
    out, used, sequence = [], defaultdict(int), 0
    for lengths, times in runs:
        offset = 0
        for length in lengths:
            out.append((length, used[length], used[length] + times - 1, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return out


def pack(pieces: DataFrame, max_tokens: int = 2048) -> DataFrame:
    """pieces with sequence_id and offset; pieces has doc_id, piece and length in 1..max_tokens, and may have more.

    Repeated rows are packed each for themselves, equal lengths in the order of doc_id and piece within a rank block.
    An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    blocks = partitions_for(spark)
    block = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int")
    log = staged(pieces.withColumn("block", block), "pieces")
    counts = log.groupBy("length", "block").agg(F.count("*").alias("n"))
    histogram = np.zeros(max_tokens + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most max_tokens rows
        histogram[length] = n
    table = slots(plan_runs(histogram))
    # A length's ranks run through its blocks, so that a hot length is ranked by many tasks.
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = log.withColumn("in_block", F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before.drop("n"), ["length", "block"]).withColumn("rank", F.col("before") + F.col("in_block"))
    # The slots of a length as one sorted array, looked up by binary search: one row for each of at most max_tokens lengths
    by_length = defaultdict(list)
    for length, first, last, sequence, offset in table:
        by_length[length].append((first, last, sequence, offset))
    lookup = _Lookup({k: np.array(v, np.int64) for k, v in by_length.items()})

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length, rank):
        import pandas as pd

        return pd.DataFrame(lookup(length.to_numpy(), rank.to_numpy()), columns=["sequence_id", "offset"])

    return ranked.withColumn("place", place("length", "rank")).select(*pieces.columns, "place.sequence_id", "place.offset")


class _Lookup:
    """Slot of (length, rank). Its size is bounded by the plan, which grows with max_tokens and not with the pieces."""

    def __init__(self, tables: dict[int, np.ndarray]):
        self.tables = tables

    def __call__(self, lengths: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        out = np.empty((len(lengths), 2), np.int64)
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            table = self.tables[int(length)]
            row = table[np.searchsorted(table[:, 0], ranks[at], "right") - 1]
            out[at, 0] = row[:, 2] + ranks[at] - row[:, 0]
            out[at, 1] = row[:, 3]
        return out


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, max_tokens: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs.

    Null and empty texts are the single end_id; very long texts are tokenised whole and cut only into pieces of max_tokens.
    Repeated rows are documents of their own; a null doc_id stays null. Pieces of one length are alike to the plan, so ties
    between them are free. Other columns are ignored; an empty table gives an empty result.
    """
    return pack(tokenised_pieces(docs, json_path, ranks_path, max_tokens, end_id, id_col, text_col), max_tokens)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as byte_bpe_50k ids and an end mark, packed into sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
