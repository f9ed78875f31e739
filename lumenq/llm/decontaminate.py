"""Benchmark decontamination: size-partitioned MinHash containment search, confirmed by exact containment.

Test items are partitioned by the size of their shingle sets. For a partition of items of at most B shingles, every
document is seen as windows of two adjacent blocks of B shingles, so that an item's passage lies in one window and
takes a fixed share of it however long the document is. An item and a window that agree in any of the hash minima
make the document a candidate for that item; then the item's whole set is counted in the document's whole set.
At 80 percent containment a window shares at least 0.19 of its union with the item, so 64 minima miss with a chance
below 2e-6.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.llm._shared import modest_batches, read_table, slices, text_of
from lumenq.llm.shingles import Minima, distinct, shingle_hashes

MINIMA = 64
#: Bytes of benchmark text that are searched for in one pass; a larger benchmark takes further passes.
PASS_BYTES = 16_000_000
FOUND = "doc_id bigint, item_id bigint, n_shared bigint, n_item bigint, containment double"


class Items:
    """Test items of a pass, by size partition: their sets, and for each hash function their minima in order."""

    def __init__(self, items: list[tuple[int, str]], percent: int):
        self.percent = percent
        self.minima = Minima(MINIMA, seed=3)
        self.ids, self.sets = [], []
        by_size: dict[int, list[int]] = defaultdict(list)
        for item_id, text in items:
            own = distinct(shingle_hashes(text))
            if len(own):
                by_size[max(8, 1 << (len(own) - 1).bit_length())].append(len(self.ids))
                self.ids.append(item_id)
                self.sets.append(own)
        self.partitions = []
        for block, members in sorted(by_size.items()):
            own = [self.sets[i] for i in members]
            minima = self.minima.of(np.concatenate(own), np.concatenate([[0], np.cumsum([len(s) for s in own])[:-1]]))
            order = np.argsort(minima, axis=0, kind="stable")
            self.partitions.append((block, np.array(members), np.take_along_axis(minima, order, 0), order))

    def search(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text's index, item's index, shared shingles) of every item that a text contains to the percentage."""
        runs = [shingle_hashes(t) for t in texts]
        sizes = np.array([len(r) for r in runs], np.int64)
        if not sizes.sum():
            return []
        values = np.concatenate(runs)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        pairs: set[tuple[int, int]] = set()
        for block, members, minima, order in self.partitions:
            counts = -(-sizes // block)
            owner = np.repeat(np.arange(len(runs)), counts)
            first = np.concatenate([[0], np.cumsum(counts)[:-1]])
            starts = begin[owner] + (np.arange(len(owner)) - first[owner]) * block
            follows = np.append(owner[1:] == owner[:-1], False)
            of_blocks = self.minima.of(values, starts)
            windows = of_blocks.copy()
            at = np.flatnonzero(follows)
            windows[at] = np.minimum(of_blocks[at], of_blocks[at + 1])
            for k in range(MINIMA):
                column = np.ascontiguousarray(windows[:, k])
                low, high = np.searchsorted(minima[:, k], column), np.searchsorted(minima[:, k], column, "right")
                for h in np.flatnonzero(high > low).tolist():
                    pairs.update((int(owner[h]), int(members[order[i, k]])) for i in range(low[h], high[h]))
        return list(self._confirmed(runs, pairs))

    def _confirmed(self, runs: list[np.ndarray], pairs: set[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        whole: dict[int, np.ndarray] = {}
        for w, i in sorted(pairs):
            if w not in whole:
                whole = {w: distinct(runs[w])}
            own = self.sets[i]
            at = np.minimum(np.searchsorted(whole[w], own), len(whole[w]) - 1)
            shared = int((whole[w][at] == own).sum())
            if 100 * shared >= self.percent * len(own):
                yield w, i, shared


def _passes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in parts of about PASS_BYTES, so that what is sent to the executors is bounded."""
    modest_batches(benchmark.sparkSession)
    items = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), text_of(text_col).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // PASS_BYTES))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()  # a benchmark part of bounded size
        yield sorted((r.item_id, r.text) for r in rows if r.item_id is not None)


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every document and test item it contains to percent or more.

    Null, empty and wordless texts contain nothing and are contained in nothing; an item under five words is one
    shingle, so only a text of just these words has it. Items with a null id are left out. Repeated rows are reported
    each, and so is every item of equal text. Very long texts are searched and compared whole. A containment of exactly
    percent counts. Other columns are ignored; empty tables give an empty result.
    """
    found = None
    for items in _passes(benchmark, item_id_col, item_text_col):
        search = Items(items, percent)

        def rows(batches: Iterator[pa.RecordBatch], search: Items = search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", 1_000_000):
                    ids = part.column("doc_id").to_pylist()
                    hits = search.search(part.column("text").to_pylist())
                    sizes = [len(search.sets[i]) for _, i, _ in hits]
                    columns = ([ids[w] for w, _, _ in hits], [search.ids[i] for _, i, _ in hits], [n for *_, n in hits], sizes)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([h[2] / n for h, n in zip(hits, sizes, strict=True)], pa.float64())], ["doc_id", "item_id", "n_shared", "n_item", "containment"])

        part = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(rows, FOUND)
        found = part if found is None else found.unionByName(part)
    return found


def _flagger(search: Items):
    def has(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), bool)
        all_texts, start, total = texts.tolist(), 0, 0
        for i, t in enumerate(all_texts):
            total += len(t)
            if total >= 1_000_000 or i + 1 == len(all_texts):
                for w, _, _ in search.search(all_texts[start : i + 1]):
                    out[start + w] = True
                start, total = i + 1, 0
        return pd.Series(out)

    return has


def is_contaminated(benchmark: DataFrame, text_col: str = "text", percent: int = 80, item_id_col: str = "item_id", item_text_col: str = "text") -> Column:
    """A column that says whether a text contains a test item, for filters that keep all columns and need no join."""
    flag = F.lit(False)
    for items in _passes(benchmark, item_id_col, item_text_col):
        search = Items(items, percent)

        has = F.pandas_udf(_flagger(search), "boolean")
        flag = flag | has(text_of(text_col))
    return flag


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that contains a benchmark item, with the item."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH t AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (SELECT k, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM t),
s AS (SELECT DISTINCT k, id, array_to_string(ws[i : i + 4], ' ') AS g
      FROM (SELECT k, id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT id, count(*) AS n FROM s WHERE k = 'i' GROUP BY id),
p AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS c FROM s d JOIN s i ON d.g = i.g AND d.k = 'd' AND i.k = 'i' GROUP BY ALL)
SELECT doc_id, item_id, CAST(c AS BIGINT) AS n_shared, CAST(n AS BIGINT) AS n_item, c / CAST(n AS DOUBLE) AS containment
FROM p JOIN n ON n.id = p.item_id WHERE 100 * c >= 80 * n
"""
