"""Vector code compression: a product quantiser fitted by whole numbers, with an exponion search for nearest entries.

Vectors are cut into parts; each part position has a codebook. A part starts at its previous entry, of which it knows the
squared distance d. An entry that is nearer, or as near, lies within twice the distance from that entry, so of the
entry's neighbours, sorted by distance, only those with a squared distance of at most 4 d are looked at; ties go to the
lower index. Distances are sums of squares of whole numbers: doubles hold them exactly while they are below 2**53, and
Python's whole numbers do the work beyond.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lumenq.llm._shared import discard, narrow, read_table, staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Doubles hold whole numbers below this; sums are carried in digits of this base.
EXACT, BASE = 1 << 53, 1 << 32
#: Parts whose distances are computed at a time.
BLOCK = 256


def is_kept(vector: str) -> Column:
    """Vectors that are there and hold only finite numbers, also after scaling."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * SCALE) == float("inf"))
    return F.coalesce(~F.exists(F.col(vector), bad), F.lit(False))


def _exact(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where distances, and all sums on the way, are exact in them; else as Python's whole numbers."""
    most = max((int(np.abs(x).max()) for x in (values, book) if x.size), default=0)
    if 4 * most * most * max(1, values.shape[1]) < EXACT:
        return values.astype(float), book.astype(float)
    return tuple(x if x.dtype == object else np.array([[int(y) for y in row] for row in x.tolist()], object).reshape(x.shape) for x in (values, book))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, exact in the types that _exact gives."""
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]


def nearest(values: np.ndarray, book: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry of book that is nearest to each row, by exponion search from previous."""
    values, book = _exact(values, book)
    between = squares(book, book)
    start = ((values - book[previous]) ** 2).sum(1)
    best, distance = previous.copy(), start.copy()
    for entry in np.unique(previous):
        neighbours = np.argsort(between[entry], kind="stable")
        radii = between[entry][neighbours]
        rows = np.flatnonzero(previous == entry)
        reach = np.searchsorted(radii, 4 * start[rows], "right")  # its neighbours that may be nearer or as near
        order = np.argsort(reach, kind="stable")
        for at in range(0, len(rows), BLOCK):
            block = rows[order[at : at + BLOCK]]
            near = np.sort(neighbours[: reach[order[min(at + BLOCK, len(rows)) - 1]]])
            found = squares(values[block], book[near])
            place = np.argmin(found, axis=1)  # the first of equals: the lower index
            best[block], distance[block] = near[place], found[np.arange(len(block)), place]
    return best, distance


def _digits(value: int) -> list[int]:
    """value in digits of BASE, lowest first, the last one with the sign."""
    out = []
    while abs(value) >= BASE << 8:
        out.append(value % BASE)
        value //= BASE
    return [*out, value]


def _sums(values: np.ndarray, at: np.ndarray, entries: int) -> np.ndarray:
    """Sums of the rows of each entry, as Python's whole numbers if they may be large."""
    if values.size and int(np.abs(values).max()) * len(values) < EXACT:
        return np.stack([np.bincount(at, values[:, i], entries) for i in range(values.shape[1])], axis=1).astype(np.int64)
    out = np.zeros((entries, values.shape[1]), object)
    np.add.at(out, at, np.array([[int(x) for x in row] for row in values.tolist()], object).reshape(values.shape))
    return out


def _packed(vectors: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(vectors.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(data: bytes, rows: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view(float).reshape(rows, -1)


def chunks(kept: DataFrame) -> DataFrame:
    """Vectors as whole numbers, many in a row, each part at entry 0."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(kept.schema["vec_id"].dataType)), T.StructField("labels", T.ArrayType(kept.schema["label"].dataType)), *T.StructType.fromDDL("n bigint, vectors binary, codes binary").fields])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = batch.num_rows
                vectors = np.floor(batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float) * SCALE).reshape(n, -1)
                lists = [pa.ListArray.from_arrays([0, n], batch.column(c)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([n]), pa.array([_packed(vectors)]), pa.array([bytes(PARTS * n)])], schema.names)

    return kept.mapInArrow(rows_of, schema)


def assigned(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The chunks with new codes; and, as rows of their own, each task's counts and sums by part and entry, in digits."""
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("part int, entry int, position int, digit int, value bigint").fields])
    arrow = [pa.int32()] * 4 + [pa.int64()]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[np.ndarray | None] = [None] * len(books)
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("n")[i].as_py()
                vectors = _unpacked(batch.column("vectors")[i].as_py(), n)
                codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(n, -1).copy()
                for p, (values, book) in enumerate(zip(np.split(vectors, PARTS, axis=1), books, strict=True)):
                    found, _ = nearest(values, book, codes[:, p].astype(np.int64))
                    codes[:, p] = found
                    more = _sums(np.column_stack([values, np.ones(n)]), found, len(book))
                    sums[p] = more.astype(object) if sums[p] is None else sums[p] + more
                one = batch.slice(i, 1)
                kept = [one.column(c) for c in ("ids", "labels", "n", "vectors")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([codes.tobytes()]), *(pa.nulls(1, t) for t in arrow)], schema.names)
        found = [(p, entry, position, digit, value) for p, s in enumerate(sums) if s is not None for entry, row in enumerate(s.tolist()) if row[-1] for position, whole in enumerate(row) for digit, value in enumerate(_digits(int(whole)))]
        if found:
            nothing = [pa.nulls(len(found), t) for t in kept_types]
            yield pa.RecordBatch.from_arrays([*nothing, *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), arrow, strict=True))], schema.names)

    kept_types = [to_arrow_type(f.dataType) for f in rows.schema.fields]
    return rows.mapInArrow(rows_of, schema)


def updated(books: list[np.ndarray], made: DataFrame) -> list[np.ndarray]:
    """Each entry replaced by the floored mean of its parts; unused entries stay. Sums of all tasks meet by key in Spark."""
    sums: dict[tuple[int, int], dict[int, int]] = {}
    rows = made.where("part is not null").groupBy("part", "entry", "position", "digit").agg(F.sum("value").alias("value"))
    for r in rows.collect():  # at most a few numbers for each number of the codebooks
        found = sums.setdefault((r.part, r.entry), {})
        found[r.position] = found.get(r.position, 0) + r.value * BASE**r.digit
    out = [[[int(x) for x in row] for row in book.tolist()] for book in books]
    for (part, entry), found in sums.items():
        count = found[len(out[part][entry])]
        out[part][entry] = [found[i] // count for i in range(len(out[part][entry]))]
    return [np.array(b, object).reshape(books[p].shape) for p, b in enumerate(out)]


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that is kept.

    Vectors that are null, or hold a null, a NaN or an infinite number (also after scaling by 1024), are dropped. All
    others must have one length, a multiple of 4; else this fails. The codebooks start with the 256 smallest ids, a null id
    last, repeats of an id in the order of their vectors; with fewer vectors they have fewer entries. Repeated vectors and
    ids are coded each. Null labels are one label. Errors beyond a long are null, and so are sums with them. An empty table gives an empty result.
    Other columns are ignored, whatever they are called.
    """
    spark = vectors.sparkSession
    kept = vectors.where(is_kept(vector_col)).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    first = [r.vector for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()]
    sizes = {(r.lo, r.hi) for r in kept.agg(F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi")).collect() if r.lo is not None}
    if any(lo != hi or lo % PARTS for lo, hi in sizes):
        raise ValueError(f"vectors must have one length, a multiple of {PARTS}: {sizes}")
    schema = T.StructType([T.StructField("vec_id", kept.schema["vec_id"].dataType), T.StructField("label", kept.schema["label"].dataType), *T.StructType.fromDDL("code string, error bigint").fields])
    if not first:
        return spark.createDataFrame([], schema).select("vec_id", "code", "error", F.lit(None).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    begin = np.floor(np.array(first, float).reshape(len(first), -1) * SCALE)
    books = [b.copy() for b in np.split(begin, PARTS, axis=1)]
    rows = staged(chunks(kept), "vector-chunks")
    for _ in range(ROUNDS):
        made = staged(assigned(rows, books), "vector-round")
        discard(rows)
        books = updated(books, made)
        rows = made.where("part is null").select("ids", "labels", "n", "vectors", "codes")
    digest = hashlib.sha256(",".join(str(int(x)) for book in books for row in book.tolist() for x in row).encode()).hexdigest()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("n")[i].as_py()
                values = np.split(_unpacked(batch.column("vectors")[i].as_py(), n), PARTS, axis=1)
                codes = np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(n, -1).astype(np.int64)
                found = [nearest(v, b, codes[:, p]) for p, (v, b) in enumerate(zip(values, books, strict=True))]
                text = [bytes(c).hex() for c in np.stack([f for f, _ in found], axis=1).astype(np.uint8)]
                errors = [sum(map(int, e)) for e in zip(*(d.tolist() for _, d in found), strict=True)]
                errors = pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(text), errors], schema.names)

    out = staged(rows.mapInArrow(coded, schema), "vector-codes")
    sums = staged(out.groupBy(F.col("label").alias("__label")).agg(F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("label_error")), "vector-labels")
    joined = out.join(narrow(sums, sums.count()), F.col("label").eqNullSafe(F.col("__label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings."""
    return compress(read_table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds written out; entries and parts as rows of (part, index, components)."""
    distance = "list_sum(list_transform(list_zip(x.c, e.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    ctes = [
        "kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS k, vec_id, label, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        "x AS (SELECT k, vec_id, label, p, q[p * (len(q) // 4) + 1:(p + 1) * (len(q) // 4)] AS c FROM kept, range(4) r(p))",
        f"e0 AS (SELECT p, k - 1 AS i, c FROM x WHERE k <= {ENTRIES})",
    ]
    for n in range(ROUNDS + 1):
        # packs distance and index into one number: the least is the nearest, ties to the lower index
        ctes.append(f"a{n} AS MATERIALIZED (SELECT x.k, x.p, min({distance}::HUGEINT * {ENTRIES} + e.i) AS m FROM x JOIN e{n} e USING (p) GROUP BY x.k, x.p)")
        if n < ROUNDS:
            ctes.append(f"m{n} AS (SELECT p, i, list(v ORDER BY d) AS c FROM (SELECT x.p, m % {ENTRIES} AS i, d, CAST(floor(sum(c[d])::HUGEINT / count(*)) AS BIGINT) AS v FROM x JOIN a{n} USING (k, p), (SELECT unnest(range(1, len(q) // 4 + 1)) AS d FROM kept WHERE k = 1) GROUP BY ALL) GROUP BY p, i)")
            ctes.append(f"e{n + 1} AS MATERIALIZED (SELECT e.p, e.i, coalesce(m.c, e.c) AS c FROM e{n} e LEFT JOIN m{n} m ON e.p = m.p AND e.i = m.i)")
    last = ROUNDS
    ctes.append(f"f AS (SELECT k, vec_id, label, string_agg(printf('%02x', (m % {ENTRIES})::INT), '' ORDER BY p) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM x JOIN a{last} USING (k, p) GROUP BY k, vec_id, label)")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, i)) FROM e{last}) AS codebooks_sha256 FROM f"


OP13_SQL = re.sub(r"\s+", " ", _sql())
