"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators of n-grams of hashed words and of word shapes are scaled by the log-count ratio of the two classes, and a
linear hinge-loss model is fitted to them by dual coordinate descent on a bounded sample of labelled rows. Shapes tell
case, length, marks, repeats of a word and of a line; their n-grams count once for each share of the text they reach,
so that an indicator can say "nearly all words are followed by marks". Margins become scores by a logistic fit on
margins of rows left out of the training.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.llm._shared import discard, modest_batches, read_table, slices, staged, text_of
from lumenq.llm.shingles import distinct, mix

#: Hash buckets of the indicators, and labelled rows that the model is fitted to at most, taken by a hash of their id.
BUCKETS = 1 << 18
TRAINING_ROWS = 8_000
#: Indicators of all rows that the model is fitted to at most; the sample ends before, where its texts are very long.
TRAINING_INDICATORS = 12_000_000
#: Words that a worker remembers.
MEMO_WORDS = 50_000
#: Shares of a text that a shape n-gram's indicators stand for.
SHARES = np.array([0.0, 0.02, 0.1, 0.3, 0.6, 0.9])
THRESHOLD = 0.7


def _shape(word: str) -> int:
    tail = word.rstrip("!?.,;:*%$&#|")
    marks = len(word) - len(tail)
    if tail.isalpha():  # most words: marks are neither letters nor digits
        letters, digits = len(tail), 0
    else:
        letters, digits = sum(map(str.isalpha, tail)), sum(map(str.isdigit, tail))
    case = 0 if not letters else 1 if word.isupper() and letters > 1 else 2 if word[0].isupper() else 3
    kind = 0 if not letters and not digits else 1 if digits > letters else 2
    return ((case * 3 + kind) * 4 + min(marks, 3)) * 6 + min(len(tail) // 3, 5)


class Words:
    """Numbers of the words that a worker has met, with the hash and the shape of each; emptied beyond a bound."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.hashes = np.zeros(0, np.uint64)
        self.shapes = np.zeros(0, np.uint64)

    def __call__(self, words: list[str]) -> np.ndarray:
        found = list(map(self.number.get, words))
        if None in found:
            if len(self.number) > MEMO_WORDS:
                self.__init__()
            new = [w for w in dict.fromkeys(words) if w not in self.number]
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.hashes = np.append(self.hashes, np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace").lower()) for w in new), np.uint64, len(new)))
            self.shapes = np.append(self.shapes, np.fromiter(map(_shape, new), np.uint64, len(new)))
            found = list(map(self.number.__getitem__, words))
        return np.array(found, np.int64)


def _line_facts(text: str) -> tuple[int, int]:
    """Lines that are not blank, and how many different ones there are."""
    lines = [line for line in text.split("\n") if line.strip()]
    return len(lines), len(set(lines))


def indicators(texts: list[str], known: Words) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, ends): the sorted buckets of the indicators that each text has, one text's after the other's.

    A text without words has one indicator of its own. All texts are done at once: the word of every place is a number,
    and the place's text goes along as the high bits of what is sorted.
    """
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    ids = known(list(itertools.chain.from_iterable(split)))
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
    follows = owner[1:] == owner[:-1]
    hashes = known.hashes[ids]
    seen = [(owner, mix(hashes)), (owner[1:][follows], mix(hashes[1:] * np.uint64(31) + hashes[:-1])[follows])]

    filled = np.flatnonzero(sizes)
    lines, kinds = np.array([_line_facts(texts[i]) for i in filled], np.int64).reshape(-1, 2).T
    pairs = distinct(owner << np.uint64(32) | ids.astype(np.uint64))
    variety = np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=len(texts))[filled] / sizes[filled]
    again = 1 - kinds / np.maximum(lines, 1)
    bits = np.frexp(sizes[filled].astype(float))[1]
    whole = [1000 + (10 * again).astype(np.int64), 2000 + (10 * variety).astype(np.int64), 3000 + np.minimum(12, bits), 4000 + np.minimum(12, (4 * np.log2(1 + sizes[filled] / np.maximum(1, lines))).astype(np.int64) // 4)]
    seen += [(filled.astype(np.uint64), mix(w.astype(np.uint64))) for w in whole]

    same = np.append(False, (ids[1:] == ids[:-1]) & follows)[: len(ids)]
    shapes = known.shapes[ids] * np.uint64(2) + same.astype(np.uint64)
    for n in (1, 2, 3):
        if len(ids) < n:
            continue
        gram = np.full(len(ids) - n + 1, n, np.uint64)
        for k in range(n):
            gram = gram * np.uint64(1009) + shapes[k : len(ids) - n + 1 + k]
        inside = owner[: len(gram)] == owner[n - 1 :]  # within one text; a gram is below 2**33
        keys = np.sort((owner[: len(gram)] << np.uint64(33) | gram)[inside])
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        counts, keys = np.diff(first, append=len(keys)), keys[first]
        at, values = keys >> np.uint64(33), keys & np.uint64((1 << 33) - 1)
        shares = counts / (sizes[at.astype(np.int64)] - n + 1)
        for level, share in enumerate(SHARES):
            over = shares > share
            seen.append((at[over], mix(values[over] * np.uint64(64) + np.uint64(level + 7))))
    seen.append((np.flatnonzero(sizes == 0).astype(np.uint64), np.zeros((sizes == 0).sum(), np.uint64)))
    found = distinct(np.concatenate([o << np.uint64(32) | v % np.uint64(BUCKETS) for o, v in seen]))
    ends = np.cumsum(np.bincount((found >> np.uint64(32)).astype(np.int64), minlength=len(texts)))
    return (found & np.uint64(BUCKETS - 1)).astype(np.int64), ends


def parts_of(texts: list[str], max_chars: int = 100_000) -> Iterator[list[str]]:
    """Runs of texts of about max_chars characters."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > max_chars:
            yield texts[start:i]
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield texts[start:]


@dataclass
class Model:
    """Weights by bucket, and the logistic that turns a margin into a score."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, buckets: np.ndarray) -> float:
        return float(self.weights[buckets].sum() / np.sqrt(len(buckets)) + self.bias)

    def scores(self, texts: list[str], known: Words) -> np.ndarray:
        out = [np.zeros(0)]
        for part in parts_of(texts):
            buckets, ends = indicators(part, known)
            starts = np.append(0, ends[:-1])
            margins = np.add.reduceat(self.weights[buckets], starts) / np.sqrt(ends - starts) + self.bias
            out.append(1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30))))
        return np.concatenate(out)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = [np.full(BUCKETS, smooth) for _ in (0, 1)]
    for row, label in zip(rows, labels, strict=True):
        counts[int(label)][row] += 1
    one, zero = counts[1] / counts[1].sum(), counts[0] / counts[0].sum()
    return np.log(one / zero)


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights (ratios folded in) and bias of the L1-loss linear support vector machine over scaled indicators.

    Each class's cost is divided by its share, and a row is scaled by the root of its number of indicators.
    """
    sign = np.where(labels > 0, 1.0, -1.0)
    share = np.array([np.mean(sign < 0), np.mean(sign > 0)])
    upper = cost * 0.5 / np.maximum(share[(sign > 0).astype(int)], 1e-9)
    ratios = ratios.astype(np.float32)
    values = [ratios[r] / np.float32(np.sqrt(len(r))) for r in rows]
    squares = np.array([float(v @ v) + 1 for v in values])
    w, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            row, value = rows[i], values[i]
            gradient = sign[i] * (w[row] @ value + bias) - 1
            new = min(max(alpha[i] - gradient / squares[i], 0.0), upper[i])
            change = (new - alpha[i]) * sign[i]
            if change:
                alpha[i] = new
                w[row] += change * value
                bias += change
                worst = max(worst, abs(change))
        if worst < 1e-4:
            break
    return w * ratios, bias


def logistic_fit(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """slope and shift of P(label 1) = logistic(slope * margin + shift), by Newton's method with a small ridge."""
    x = np.column_stack([margins, np.ones(len(margins))])
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    b = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p) - 1e-6 * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """The model of labelled rows; without both classes, one that scores every text by the share of label 1."""
    if len(set(labels.tolist())) < 2:
        p = float(labels.mean()) if len(labels) else 0.5
        return Model(np.zeros(BUCKETS), 0.0, 0.0, float(np.log((p + 1e-3) / (1 - p + 1e-3))))
    fold = np.arange(len(rows)) % 3
    margins = np.zeros(len(rows))
    for k in range(3):
        inside = np.flatnonzero(fold != k)
        if len(set(labels[inside].tolist())) < 2:
            continue
        part = [rows[i] for i in inside]
        m = Model(*dual_coordinate_descent(part, labels[inside], log_count_ratios(part, labels[inside])))
        for i in np.flatnonzero(fold == k):
            margins[i] = m.margin(rows[i])
    model = Model(*dual_coordinate_descent(rows, labels, log_count_ratios(rows, labels)))
    model.slope, model.shift = logistic_fit(margins, labels)
    return model


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def training_sample(labels: DataFrame, label: str, allowed: Column, rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most rows labelled ids that are allowed, by the order of a hash of the id; a repeated id counts once."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).where(allowed)
    return known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, held_out: Column, rows: int = TRAINING_ROWS, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of at most rows labelled documents that are not held out. Texts become indicators on the executors."""
    spark = docs.sparkSession
    modest_batches(spark)
    chosen = {r.doc_id: r.label for r in training_sample(labels, label, ~held_out, rows).collect()}  # at most rows pairs
    sample = F.broadcast(spark.createDataFrame([(int(k),) for k in chosen], "doc_id bigint"))  # at most rows ids
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text")).join(sample, "doc_id")
    # one row of each sampled id: repeats of a row would break the sample's bound
    texts = texts.groupBy("doc_id").agg(F.max("text").alias("text"))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                buckets, ends = indicators(part.column("text").to_pylist(), known)
                found = [b.astype(np.int32).tobytes() for b in np.split(buckets, ends[:-1])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends, prepend=0)), pa.array(found, pa.binary())], ["doc_id", "n", "buckets"])

    made = staged(texts.mapInArrow(rows_of, "doc_id bigint, n bigint, buckets binary"), "quality-sample")
    # very long texts have very many indicators: the sample ends where there are indicators enough
    order = sorted(((r.doc_id, r.n) for r in made.select("doc_id", "n").collect()), key=lambda r: (zlib.crc32(str(r[0]).encode() + b"order"), r[0]))  # at most rows pairs
    ids = [i for (i, _), total in zip(order, np.cumsum([n for _, n in order]), strict=True) if total <= TRAINING_INDICATORS]
    if len(ids) < len(order):
        made = made.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "doc_id bigint")), "doc_id", "left_semi")
    got = {r.doc_id: np.frombuffer(r.buckets, np.int32) for r in made.collect()}  # at most TRAINING_INDICATORS numbers
    discard(made)
    return fit([got[i] for i in ids], np.array([chosen[i] for i in ids]))


@functools.lru_cache(1)
def _words() -> Words:
    """One for each worker process."""
    return Words()


def scorer(model: Model):
    """A column function from text to score."""
    keep = np.flatnonzero(model.weights).astype(np.int32)
    packed = (keep, model.weights[keep].astype(np.float32), model.bias, model.slope, model.shift)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        weights = np.zeros(BUCKETS)
        weights[packed[0]] = packed[1]
        return pd.Series(Model(weights, *packed[2:]).scores(texts.tolist(), _words()), dtype="float64")

    return lambda column: score(column)


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; learned from labelled rows that are not held out.

    Null, empty and blank texts are scored as the empty text; very long texts are scored whole. Repeated rows get a row
    each, but train once, by the greatest of their texts. A null doc_id is not held out and never trains. Labels other
    than 0 and 1 are ignored; without any, every score is 0.5. Other columns are ignored; an empty table gives an empty
    result.
    """
    model = train(docs, labels, remainder("doc_id", 4) == 2, rows, "quality", id_col, text_col)
    scored = docs.select(F.col(id_col).alias("doc_id"), scorer(model)(text_of(text_col)).alias("score"))
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
