"""Token counts with a digest cache.

Texts are normalised only in ways that cannot change the count, digested, and looked up under
(content digest, tokenizer-version digest) in a Parquet cache. Only distinct contents that the cache
lacks are encoded; their counts are appended to it, so a later run over overlapping data encodes the rest.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lumenq.llm._shared import modest_batches, narrow, read_table, slices, staged, staged_path, text_key, text_of

CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens bigint"
#: Words whose counts a worker remembers.
MEMO_WORDS = 200_000
_LOADED: dict = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file, the library's version and this module's normalisation."""
    library = __import__("tokenizers" if path.endswith(".json") else "sentencepiece")
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library.__name__}|{library.__version__}|{_drops_space(path)}".encode()).hexdigest()


def _drops_space(path: str) -> bool:
    """Whether words between white space are encoded apart, with the white space lost.

    True only for a tokenizer whose normaliser folds \\s+ and whose single split keeps no white space; then the
    count of a text is the sum over its words, and folding white space cannot change it.
    """
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    folds = any(n.get("type") == "Replace" and n.get("pattern") == {"Regex": "\\s+"} for n in (spec.get("normalizer") or {}).get("normalizers", []))
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
    return bool(folds and plain and first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and "[^\\s" in first["pattern"].get("Regex", ""))


class Counter:
    """Counts tokens of texts as the tokenizer's library gives them."""

    def __init__(self, path: str):
        self.by_word = _drops_space(path)
        self.memo: dict[str, int] = {}
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.encode = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]

    def __call__(self, texts: list[str]) -> list[int]:
        return [self._words(t) for t in texts] if self.by_word else self.encode(texts)

    def _words(self, text: str) -> int:
        # str.split also splits at U+001C to U+001F, which the tokenizers keep
        words = text.split() if not re.search("[\x1c-\x1f]", text) else [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        counts = list(map(self.memo.get, words))
        if None in counts:
            missing = list({w for w, n in zip(words, counts, strict=True) if n is None})
            found = dict(zip(missing, self.encode(missing), strict=True))
            if len(self.memo) < MEMO_WORDS:  # then it stays as it is: common words are met early
                self.memo.update(found)
            counts = [found[w] if n is None else n for w, n in zip(words, counts, strict=True)]
        return sum(counts)


def counter(path: str) -> Counter:
    """One tokenizer for each worker process."""
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def _read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """Stored counts of this tokenizer version; an absent cache is empty. Repeated appends of a digest count once."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "content_digest string, n_tokens bigint")
    return stored.where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache_path: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs.

    Null texts count as empty: 0 bytes, 0 tokens. Very long texts are encoded whole. Repeated rows each get a row. A
    null doc_id keeps its row. Columns besides id_col and text_col are ignored. An empty table gives an empty result.
    cache_path: Parquet folder of stored counts, appended to; a fresh one in the shared folder if None.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    cache_path = cache_path or staged_path(spark, "token-cache")
    version = tokenizer_digest(path)
    content = text_of(text_col)
    if _drops_space(path):
        content = F.trim(F.regexp_replace(content, r"[\x20\x09-\x0D]+", " "))
    digest, row_key = F.sha2(content, 256), F.xxhash64(F.col(id_col), text_key(text_col))
    # small rows: a digest and a row key for each document
    log = staged(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text_of(text_col)).cast("bigint").alias("n_bytes"), digest.alias("content_digest"), row_key.alias("row_key")), "token-digests")
    known = _read_cache(spark, cache_path, version)
    contents = log.groupBy("content_digest").agg(F.min("row_key").alias("row_key"))
    # of each content that the cache lacks one row is encoded: a hot content is found by one row key
    misses = staged(contents.join(known.select("content_digest"), "content_digest", "left_anti"), "token-misses")
    n_rows, n_misses = log.count(), misses.count()
    texts = docs.select(digest.alias("content_digest"), row_key.alias("row_key"), text_of(text_col).alias("text"))
    if 2 * n_misses <= n_rows:  # few rows are to be encoded: they are picked
        picked = misses.select(F.col("row_key").alias("__key"), F.col("content_digest").alias("__digest"))
        encode = texts.join(narrow(picked, n_misses), (F.col("row_key") == F.col("__key")) & (F.col("content_digest") == F.col("__digest")), "left_semi")
    else:  # few are not: they are left out, and texts need not meet the larger table
        done = log.join(misses.select("row_key", "content_digest"), ["row_key", "content_digest"], "left_anti").select(F.col("row_key").alias("__key"), F.col("content_digest").alias("__digest"))
        done = staged(done.distinct(), "token-known")
        encode = texts.join(narrow(done, done.count()), (F.col("row_key") == F.col("__key")) & (F.col("content_digest") == F.col("__digest")), "left_anti")
    encode = encode.select("content_digest", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                digests = part.column("content_digest").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array([version] * len(digests)), pa.array(count(part.column("text").to_pylist()), pa.int64())], ["content_digest", "tokenizer_digest", "n_tokens"])

    encode.mapInArrow(rows, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # the counts of this run's contents, written so that the join's sides are plain shuffles and can be split at a hot content
    counts = staged(_read_cache(spark, cache_path, version).join(contents.select("content_digest"), "content_digest", "left_semi"), "token-counts", n_rows)
    return log.join(counts, "content_digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by word_bpe_49k.json, through a cache of its own: every count is made in this run."""
    return count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
