"""Language-model scores by context-tree weighting over bytes.

A text becomes its words, A-Z lower-cased, joined by one space and closed by an end mark, so that its bytes can be read
back into the same tokens. Each byte is eight binary choices; a choice has a node for each depth of context, from none
to DEPTH bytes, with counts of zeros and ones of the training texts. A node's block probability is half its own
Krichevsky-Trofimov estimate and half the product over the contexts that are one byte longer; what these halves weigh
after training mixes the estimates of all depths into the probability of a choice. A text's score is the sum over its
choices, in log10, under the tree as the training left it; bytes before the text are end marks.

A gram is a byte with its context, one number. Texts are kept in blocks; each block asks once for every distinct gram
and word it has. Requests go to ranges of contexts, where counts of all blocks meet, the deep part of the tree is
computed and every gram gets its answer, which goes back to the block. What depths below SPLIT say is a small table of
bounded size. Arrays travel packed, and ranges and blocks are read as streams, so that a task holds the distinct grams of
one range or of one block.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenq.llm._shared import modest_batches, read_table, slices, staged, text_of
from lumenq.llm.quality import remainder
from lumenq.llm.shingles import mix

#: Bytes of context of a gram, at most 7. Depths below SPLIT are merged over all ranges: at most 256**2 contexts.
DEPTH = 6
SPLIT = 3
#: The end mark, also what stands before a text; white space, so that no word holds it.
END = 0x0A
#: Bytes of normalised text in a piece (one row; a longer document is a piece of its own), in a block, and for each range.
PIECE_BYTES = 256 << 10
BLOCK_BYTES = 16 << 20
RANGE_BYTES, MAX_RANGES = 4 << 20, 1024
#: Grams of a range whose tree is computed at a time, and positions of a text that are looked at at a time.
TREE_GRAMS = 100_000
SLICE = 1 << 20

#: Kinds of the rows that travel, in the order in which a task meets them.
MODEL_GRAMS, MODEL_WORDS, GRAMS, WORDS, PIECE, SHALLOW = range(6)
#: at: the range or block a row goes to; origin: where it comes from; a, b: packed arrays; n, total: words and their sum.
ROW = "at bigint, kind int, origin bigint, a binary, b binary, n bigint, total bigint"


def pack(values: np.ndarray) -> bytes:
    """An array as compressed planes of its bytes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.compress(b" ".join(words), 1)


def unpack_words(data: bytes) -> list[bytes]:
    return zstandard.decompress(data).split()


def normalised(text: bytes) -> bytes:
    """Words of UTF-8 text, A-Z lower-cased, joined by one space, then the end mark; no other byte is one."""
    return b" ".join(text.lower().split()) + bytes([END])


def gram_slices(codes: bytes, sizes: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, grams, where each document's begin) of documents that lie one after the other in codes.

    A gram has the last context byte on top and the byte itself at the bottom: sorted grams have contexts together.
    Documents come together while they are short; a long one comes in several slices.
    """
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        start = int(ends[first] - sizes[first])
        last = max(first + 1, int(np.searchsorted(ends, start + SLICE, "right")))
        starts = ends[first:last] - sizes[first:last]
        for s in range(start, int(ends[last - 1]), SLICE):
            e = min(s + SLICE, int(ends[last - 1]))
            head = min(depth, s)
            window = bytes([END]) * (depth - head) + codes[s - head : e] + bytes(8)
            # eight bytes from each place on: the context, the byte itself, and then what is cut off
            eight = np.ndarray((e - s,), "<u8", window, 0, (1,)).astype(np.uint64)
            keys = (eight & np.uint64((1 << 8 * depth) - 1)) << np.uint64(8) | (eight >> np.uint64(8 * depth)) & np.uint64(255)
            for behind in range(depth):  # contexts stop at the document's begin
                lacking = depth - behind
                mask = np.uint64(((1 << 8 * lacking) - 1) << 8)
                pad = np.uint64(int.from_bytes(bytes([END]) * lacking, "big") << 8)
                at = starts[sizes[first:last] > behind] + behind - s
                at = at[(at >= 0) & (at < e - s)]
                keys[at] = keys[at] & ~mask | pad
            yield first, keys, np.maximum(starts - s, 0)
        first = last


def ranges_of(keys: np.ndarray, depth: int, ranges: int) -> np.ndarray:
    """The range of each gram, by its last SPLIT context bytes."""
    return (mix(keys >> np.uint64(8 * (depth + 1 - SPLIT))) % np.uint64(ranges)).astype(np.int64)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after arguments below 8 have been raised by 8."""
    low = x < 8
    y = np.where(low, x + 8, x)
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    raised = np.ones_like(y)
    for k in range(8):
        raised *= np.where(low, x + k, 1.0)
    return series - np.log(raised)


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a block of zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


def weigh(zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log block probability, weight of the own estimate, its probability of a one) of inner nodes.

    longer: sums of the log block probabilities over contexts one byte longer; one that training never saw has 0.
    """
    own = log_estimate(zeros, ones)
    block = np.logaddexp(own, longer) - np.log(2)
    return block, np.exp(own - block) / 2, (ones + 0.5) / (zeros + ones + 1)


def deep_tree(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Grams of whole SPLIT-byte contexts, sorted, with training counts (0 for grams of other texts).

    Gives the probability of each gram's eight choices by depths from SPLIT on, and nodes of depth SPLIT - 1 without
    weights: (last context bytes and place in the byte, zeros, ones, log block probability of the contexts below).
    """
    chosen = np.empty((len(keys), 8), np.float32)
    context, byte = keys >> np.uint64(8), keys & np.uint64(255)
    shallow = []
    for j in range(8):
        place = np.uint64(1 << j) | byte >> np.uint64(8 - j)  # the choices made before, a one on top
        bit = (byte >> np.uint64(7 - j) & np.uint64(1)).astype(bool)
        node = context << np.uint64(8) | place
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        zeros, ones = (np.add.reduceat(np.where(bit == b, counts, 0), first).astype(float) for b in (False, True))
        block, node = log_estimate(zeros, ones), node[first]
        one = (ones + 0.5) / (zeros + ones + 1)
        up = np.arange(len(node))  # of each deepest node, the node of the depth that is looked at
        for level in range(depth - 1, SPLIT - 2, -1):
            parents, parent = np.unique(node >> np.uint64(16) << np.uint64(8) | node & np.uint64(255), return_inverse=True)
            zeros, ones, longer = (np.bincount(parent, v, len(parents)) for v in (zeros, ones, block))
            node = parents
            if level < SPLIT:
                shallow.append((node, zeros, ones, longer))
                break
            block, weight, own = weigh(zeros, ones, longer)
            up = parent[up]
            one = weight[up] * own[up] + (1 - weight[up]) * one
        one = np.repeat(one, np.diff(first, append=len(keys)))
        chosen[:, j] = np.where(bit, one, 1 - one)
    return chosen, tuple(map(np.concatenate, zip(*shallow, strict=True)))


class Shallow:
    """What depths below SPLIT say: the probability of a one is given + passed * (what the longer contexts say)."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray):
        """Nodes of depth SPLIT - 1, distinct and sorted."""
        levels = []
        while True:
            block, weight, own = weigh(zeros, ones, longer)
            levels.append((node, weight, own))
            if len(levels) == SPLIT:
                break
            node, zeros, ones, longer = _sums(node >> np.uint64(16) << np.uint64(8) | node & np.uint64(255), zeros, ones, block)
        self.node = levels[0][0]
        self.given, self.passed = np.zeros(len(self.node)), np.ones(len(self.node))
        for up, (node, weight, own) in zip(range(SPLIT - 1, -1, -1), reversed(levels), strict=True):
            at = np.searchsorted(node, self.node >> np.uint64(8 + 8 * up) << np.uint64(8) | self.node & np.uint64(255))
            self.given += self.passed * weight[at] * own[at]
            self.passed *= 1 - weight[at]

    def log10(self, keys: np.ndarray, chosen: np.ndarray, depth: int) -> np.ndarray:
        """log10 of the probability of each gram, from that of its choices by the deeper contexts."""
        context, byte = keys >> np.uint64(8 * (depth + 2 - SPLIT)), keys & np.uint64(255)
        out = np.zeros(len(keys))
        for j in range(8):
            at = np.searchsorted(self.node, context << np.uint64(8) | np.uint64(1 << j) | byte >> np.uint64(8 - j))
            bit = (byte >> np.uint64(7 - j) & np.uint64(1)).astype(bool)
            given = np.where(bit, self.given[at], 1 - self.passed[at] - self.given[at])
            out += np.log10(given + self.passed[at] * chosen[:, j])
        return out.astype(np.float32)


class Lookup:
    """Values of grams by hashing: grams that meet in a slot go on to the next table, the last few to binary search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.tables = keys, values, []
        left = np.arange(len(keys), dtype=np.int32)
        for k in range(4):
            if not len(left):
                break
            bits = max(4, int(np.ceil(np.log2(len(left) + 1))) + 1)
            slots = np.zeros(1 << bits, np.int32)
            at = self._slots(keys[left], k, bits)
            slots[at] = left
            self.tables.append((bits, slots))
            left = left[slots[at] != left]
        self.order = left[np.argsort(keys[left])]
        self.rest = keys[self.order]

    def _slots(self, keys: np.ndarray, k: int, bits: int) -> np.ndarray:
        odd = np.uint64((0x9E3779B97F4A7C15 + 0x6A09E667F3BCC908 * k) & (1 << 64) - 1 | 1)
        return (keys * odd) >> np.uint64(64 - bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        for k, (bits, slots) in enumerate(self.tables):
            at = slots[self._slots(keys, k, bits)]
            hit = self.keys[at] == keys
            out[left[hit]] = self.values[at[hit]]
            left, keys = left[~hit], keys[~hit]
        if len(left):
            out[left] = self.values[self.order[np.searchsorted(self.rest, keys)]]
        return out


ROW_ARROW = pa.schema([("at", pa.int64()), ("kind", pa.int32()), ("origin", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64()), ("total", pa.int64())])


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, ROW_ARROW)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _groups(rows: Iterator[dict]) -> Iterator[tuple[int, Iterator[dict]]]:
    return itertools.groupby(rows, lambda row: row["at"])


def pieces(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Normalised texts in rows of about PIECE_BYTES, dealt to blocks of about BLOCK_BYTES."""
    made = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), text_of(text_col).cast("binary").alias("text"))
    id_type = made.schema["doc_id"].dataType
    schema = T.StructType.fromDDL("at bigint, kind int, origin bigint, a binary, held array<boolean>, sizes array<bigint>, train_docs bigint, bytes bigint").add("ids", T.ArrayType(id_type))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        block = filled = number = 0
        ids, held, texts, size = [], [], [], 0
        arrow = None

        def row() -> pa.RecordBatch:
            sizes = [len(t) for t in texts]
            values = {"at": [task + block], "kind": [PIECE], "origin": [number], "a": [zstandard.compress(b"".join(texts), 1)], "held": [held], "sizes": [sizes], "train_docs": [len(held) - sum(held)], "bytes": [size]}
            types = {"at": pa.int64(), "kind": pa.int32(), "origin": pa.int64(), "a": pa.binary(), "held": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int64()), "train_docs": pa.int64(), "bytes": pa.int64(), "ids": pa.list_(arrow)}
            return pa.RecordBatch.from_arrays([pa.array((values | {"ids": [ids]})[k], t) for k, t in types.items()], list(types))

        for batch in batches:
            arrow = batch.schema.field("doc_id").type
            for part in slices(batch, "text"):
                for key, out, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
                    code = normalised(text)
                    if texts and size + len(code) > PIECE_BYTES:
                        yield row()
                        number, filled = number + 1, filled + size
                        if filled >= BLOCK_BYTES:
                            block, filled = block + 1, 0
                        ids, held, texts, size = [], [], [], 0
                    ids.append(key)
                    held.append(out)
                    texts.append(code)
                    size += len(code)
        if texts:
            yield row()

    return made.mapInArrow(rows_of, schema)


def requests(made: DataFrame, depth: int, ranges: int) -> DataFrame:
    """For each block and range, the distinct grams and the distinct words of the block with their training counts."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _groups(_each(batches)):
            keys, counts, pending, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
            words: Counter = Counter()
            others: set[bytes] = set()

            def merged(keys=None, counts=None, pending=None):
                return _sums(np.concatenate([keys, *(k for k, _ in pending)]), np.concatenate([counts, *(n for _, n in pending)]))

            for row in rows:
                codes, sizes, held = zstandard.decompress(row["a"]), np.array(row["sizes"]), np.array(row["held"])
                for first, grams, starts in gram_slices(codes, sizes, depth):
                    lengths = np.diff(starts, append=len(grams))
                    out = np.repeat(held[first : first + len(starts)], lengths)
                    for trained, part in ((1, grams[~out]), (0, grams[out])):
                        part = np.sort(part)
                        at = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
                        pending.append((part[at], np.diff(at, append=len(part)) * trained))
                        waiting += len(at)
                if waiting > max(1_000_000, len(keys)):
                    keys, counts = merged(keys, counts, pending)
                    pending, waiting = [], 0
                ends = np.cumsum(sizes)
                for size, end, out in zip(sizes.tolist(), ends.tolist(), held.tolist(), strict=True):
                    found = codes[end - size : end].split()
                    if out:
                        others.update(found)
                    else:
                        words.update(found)
            keys, counts = merged(keys, counts, pending)
            for word in others:
                words[word] += 0
            dealt = ranges_of(keys, depth, ranges)
            order = np.argsort(dealt, kind="stable")
            cuts = np.searchsorted(dealt[order], np.arange(ranges + 1))
            texts: list[list[bytes]] = [[] for _ in range(ranges)]
            for word in words:
                texts[xxhash.xxh3_64_intdigest(word) % ranges].append(word)
            for r in range(ranges):
                at = order[cuts[r] : cuts[r + 1]]
                out = []
                if len(at):
                    out.append({"at": r, "kind": GRAMS, "origin": block, "a": pack_sorted(keys[at]), "b": pack(counts[at])})
                if texts[r]:
                    out.append({"at": r, "kind": WORDS, "origin": block, "a": pack_words(texts[r]), "b": pack(np.array([words[w] for w in texts[r]], np.int64))})
                if out:
                    yield _rows(out)

    return made.select("at", "kind", "origin", "a", "held", "sizes").mapInArrow(rows_of, ROW)


def by_group(rows: DataFrame) -> DataFrame:
    """Rows of a range, block or first context byte together, in the order of their kinds."""
    return rows.repartition("at").sortWithinPartitions("at", "kind", "origin")


def models(asked: DataFrame, depth: int) -> DataFrame:
    """For each range, its grams with the choices' probabilities by deep contexts, its words with their counts, and
    nodes of depth SPLIT - 1 by the last byte of context.
    """

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, rows in _groups(_each(batches)):
            keys, counts, pending, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
            words: dict[bytes, int] = {}
            for row in rows:
                if row["kind"] == GRAMS:
                    pending.append((unpack_sorted(row["a"]), unpack(row["b"], np.int64)))
                    waiting += len(pending[-1][0])
                    if waiting > max(1_000_000, len(keys)):
                        keys, counts = _sums(np.concatenate([keys, *(k for k, _ in pending)]), np.concatenate([counts, *(n for _, n in pending)]))
                        pending, waiting = [], 0
                else:
                    for word, n in zip(unpack_words(row["a"]), unpack(row["b"], np.int64).tolist(), strict=True):
                        words[word] = words.get(word, 0) + n
            keys, counts = _sums(np.concatenate([keys, *(k for k, _ in pending)]), np.concatenate([counts, *(n for _, n in pending)]))
            pending = []
            if words:
                seen = np.fromiter(words.values(), np.int64, len(words))
                yield _rows([{"at": r, "kind": MODEL_WORDS, "a": pack_words(list(words)), "b": pack(seen), "n": int((seen > 0).sum()), "total": int(seen.sum())}])
            begins = np.flatnonzero(np.diff(keys >> np.uint64(8 * (depth + 1 - SPLIT)), prepend=np.uint64((1 << 64) - 1))[: len(keys)])
            begins = np.append(begins, len(keys))
            start, shallow = 0, []
            while start < len(keys):
                end = int(begins[min(np.searchsorted(begins, start + TREE_GRAMS), len(begins) - 1)])
                chosen, above = deep_tree(keys[start:end], counts[start:end], depth)
                shallow.append(above)
                yield _rows([{"at": r, "kind": MODEL_GRAMS, "origin": start, "a": pack_sorted(keys[start:end]), "b": pack(chosen.ravel())}])
                start = end
            if shallow:
                node, *sums = _sums(*map(np.concatenate, zip(*shallow, strict=True)))
                top = (node >> np.uint64(8 * (SPLIT - 1))).astype(np.int64)
                for c in np.unique(top):
                    part = top == c
                    yield _rows([{"at": int(c), "kind": SHALLOW, "origin": r, "a": pack_sorted(node[part]), "b": pack(np.concatenate([s[part] for s in sums]))}])

    return by_group(asked).mapInArrow(rows_of, ROW)


def shallow_tree(rows: DataFrame) -> Shallow:
    """Depths below SPLIT from the nodes of all ranges, merged by the last byte of context, then on the driver.

    At most 256 rows with 256 contexts of 255 nodes each come to the driver, whatever the corpus.
    """

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, rows in _groups(_each(batches)):
            node, sums = np.zeros(0, np.uint64), np.zeros((3, 0))
            for row in rows:
                more = unpack_sorted(row["a"])
                both = np.concatenate([sums, unpack(row["b"], np.float64).reshape(3, -1)], axis=1)
                node, *sums = _sums(np.concatenate([node, more]), *both)
                sums = np.array(sums)
            yield _rows([{"at": c, "a": pack_sorted(node), "b": pack(sums.ravel())}])

    got = [(unpack_sorted(r.a), unpack(r.b, np.float64).reshape(3, -1)) for r in by_group(rows).mapInArrow(merged, ROW).orderBy("at").collect()]
    if not got:
        return Shallow(np.zeros(0, np.uint64), *np.zeros((3, 0)))
    return Shallow(np.concatenate([n for n, _ in got]), *np.concatenate([s for _, s in got], axis=1))


def answers(model: DataFrame, asked: DataFrame, shallow: Shallow, depth: int) -> DataFrame:
    """For each request, log10 of the probability of each gram, or the training count of each word."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, rows in _groups(_each(batches)):
            keys, logs, words = [], [], {}
            whole = None
            for row in rows:
                if row["kind"] == MODEL_GRAMS:
                    keys.append(unpack_sorted(row["a"]))
                    logs.append(shallow.log10(keys[-1], unpack(row["b"], np.float32).reshape(-1, 8), depth))
                elif row["kind"] == MODEL_WORDS:
                    words = dict(zip(unpack_words(row["a"]), unpack(row["b"], np.int64).tolist(), strict=True))
                elif row["kind"] == GRAMS:
                    whole = whole or (np.concatenate(keys), np.concatenate(logs))
                    found = whole[1][np.searchsorted(whole[0], unpack_sorted(row["a"]))]
                    yield _rows([{"at": row["origin"], "kind": GRAMS, "origin": r, "a": row["a"], "b": pack(found)}])
                else:
                    found = np.array([words[w] for w in unpack_words(row["a"])], np.int64)
                    yield _rows([{"at": row["origin"], "kind": WORDS, "origin": r, "a": row["a"], "b": pack(found)}])

    return by_group(model.unionByName(asked.withColumns({"b": F.lit(None).cast("binary")}))).mapInArrow(rows_of, ROW)


def scores(made: DataFrame, answered: DataFrame, depth: int, train_words: int, train_docs: int, known_words: int) -> DataFrame:
    """A row for each document of the pieces, from its block's answers."""
    total, kinds = train_words + train_docs, known_words + (train_docs > 0)
    schema = T.StructType([T.StructField("doc_id", made.schema["ids"].dataType.elementType)] + T.StructType.fromDDL("held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").fields)

    def base(counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (total + 0.5 * (kinds + 1)))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(_each(batches)):
            keys, logs, words, lookup = [], [], {}, None
            for row in rows:
                if row["kind"] == GRAMS:
                    keys.append(unpack_sorted(row["a"]))
                    logs.append(unpack(row["b"], np.float32))
                    continue
                if row["kind"] == WORDS:
                    words.update(zip(unpack_words(row["a"]), unpack(row["b"], np.int64).tolist(), strict=True))
                    continue
                if lookup is None:
                    lookup, keys, logs = Lookup(np.concatenate(keys), np.concatenate(logs)), [], []
                codes, sizes = zstandard.decompress(row["a"]), np.array(row["sizes"])
                score = np.zeros(len(sizes))
                for first, grams, starts in gram_slices(codes, sizes, depth):
                    score[first : first + len(starts)] += np.add.reduceat(lookup(grams), starts)
                found = [codes[e - s : e].split() for s, e in zip(sizes.tolist(), np.cumsum(sizes).tolist(), strict=True)]
                lengths = np.array([len(f) for f in found])
                counts = np.fromiter((words[w] for f in found for w in f), np.int64, lengths.sum())
                owner = np.repeat(np.arange(len(found)), lengths)
                n_known = np.bincount(owner, counts > 0, len(found)).astype(np.int64) + (train_docs > 0)
                plain = np.bincount(owner, base(counts), len(found)) + base(np.array(train_docs))
                ids = pa.array(row["ids"], schema_arrow.field("doc_id").type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(row["held"]), pa.array(lengths + 1), pa.array(n_known), pa.array(np.full(len(found), total)), pa.array(plain), pa.array(score)], schema_arrow.names)

    schema_arrow = to_arrow_schema(schema)
    both = made.select("at", "kind", "origin", "a", "ids", "held", "sizes").unionByName(answered.select("at", "kind", "origin", "a", "b"), allowMissingColumns=True)
    return by_group(both).mapInArrow(rows_of, schema)


def score_texts(docs: DataFrame, held_out=None, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs, learned from rows not held out.

    held_out: a boolean column of docs; crc32 of the id modulo 5 is 1, if None. A null verdict, as for a null id, is not
    held out. Null, empty and blank texts are the end alone. Repeated rows count and are scored each. Very long texts are
    read whole, in slices. An empty table gives an empty result; with no training rows every choice has probability a
    half and base_score is 0. Other columns are ignored, whatever they are called.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    held_out = F.coalesce(remainder(id_col, 5) == 1 if held_out is None else held_out, F.lit(False))
    made = staged(pieces(docs, held_out, id_col, text_col), "lm-pieces")
    size, train_docs = made.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("train_docs"), F.lit(0))).first()
    ranges = int(min(MAX_RANGES, max(8, size // RANGE_BYTES)))
    asked = staged(requests(made, depth, ranges), "lm-requests")
    model = staged(models(asked, depth), "lm-model")
    shallow = shallow_tree(model.where(F.col("kind") == SHALLOW))
    known, total = model.where(F.col("kind") == MODEL_WORDS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    answered = answers(model.where(F.col("kind") < GRAMS), asked, shallow, depth)
    return scores(made, answered, depth, total, train_docs, known)


def op11_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learned from those whose crc32(doc_id) mod 5 is not 1."""
    return score_texts(read_table(spark, sf_dir, "documents"))
