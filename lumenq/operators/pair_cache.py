"""A table of scored pairs that lives across runs, and one look-up for the pairs of many scopes.

A model's scores of text pairs are dear. The cache is a Parquet table bucketed by a pair's digest: a run's new pairs are
appended, a join reads it bucket by bucket without shuffling it, and a scorer's version keeps scores of different models
apart. Appends that repeat a pair are harmless; compacting rewrites the table without them in a folder of its own, which
a small document then names as the current one, so that readers see either the old files or the new.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.backends import EntailmentScorer, JaccardScorer
from lumenq.sources import places
from lumenq.staging import staged

#: Files that a new table is dealt to, and rows, stored or asked, for which a bucket is meant: with more, buckets double.
BUCKETS, ROWS_A_BUCKET = 64, 100_000
SCORES = ("p_contradiction", "p_neutral", "p_entailment", "cls")
SCHEMA = "pair_digest string, version string, p_contradiction float, p_neutral float, p_entailment float, cls int"


def pair_digest(premise: Column | str = "premise", hypothesis: Column | str = "hypothesis") -> Column:
    """Tells ordered pairs of texts apart; a null text is a text of its own."""
    part = lambda x: F.coalesce(F.sha2((F.col(x) if isinstance(x, str) else x).cast("binary"), 256), F.lit("-"))
    return F.sha2(F.concat(part(premise), part(hypothesis)).cast("binary"), 256)


class PairCache:
    """The cache in a folder, for one version of a scorer."""

    def __init__(self, spark: SparkSession, path: str, version: str = "1", buckets: int = BUCKETS):
        self.spark, self.path, self.version = spark, path.rstrip("/"), version
        about = f"{self.path}/current.json"
        if not places.exists(about):
            self._point_to(f"pairs-{uuid.uuid4().hex}", buckets)
        known = json.loads(places.read_text(about))
        self.folder, self.buckets = known["folder"], known["buckets"]

    def _point_to(self, folder: str, buckets: int) -> None:
        places.write_text(f"{self.path}/current.json", json.dumps({"folder": folder, "buckets": buckets}))

    def _table(self, folder: str) -> str:
        """The folder as a bucketed table of this session; it stays a plain folder of Parquet files to all others."""
        name = "lumenq_" + folder.replace("-", "_")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA}) USING parquet CLUSTERED BY (pair_digest) SORTED BY (pair_digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'")
        self.spark.sql(f"REFRESH TABLE {name}")
        return name

    def _append(self, rows: DataFrame, folder: str) -> None:
        # dealt like the table, so that a run adds at most one file to a bucket
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows.repartition(self.buckets, "pair_digest").select(*names).write.insertInto(self._table(folder))

    def rows(self) -> DataFrame:
        """pair_digest and scores of this version, each pair once: the aggregate keeps to the buckets."""
        known = self.spark.table(self._table(self.folder)).where(F.col("version") == self.version)
        return known.groupBy("pair_digest").agg(F.max(F.struct(*SCORES)).alias("s")).select("pair_digest", "s.*")

    def _grow(self, asked: int) -> None:
        """As many buckets as the stored and the asked rows need: a join's task holds a bucket of the one and of the other."""
        needed, buckets = max(asked, self.spark.table(self._table(self.folder)).count()) / ROWS_A_BUCKET, self.buckets
        while buckets < needed:
            buckets *= 2
        if buckets > self.buckets:
            self.compact(buckets)

    def scored(self, asked: DataFrame, scorer: EntailmentScorer | None = None) -> DataFrame:
        """asked (premise, hypothesis and more) with its scores; pairs that the cache lacks are scored once and appended.

        Where a bucket's share of the rows would be too much for a task, the table is first dealt to more of them.
        """
        counted = staged(asked.groupBy("premise", "hypothesis").agg(F.count("*").alias("n")), "asked-pairs")
        self._grow(counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        distinct = counted.select("premise", "hypothesis").withColumn("pair_digest", pair_digest())
        fresh = staged(distinct.join(self.rows().select("pair_digest"), "pair_digest", "left_anti").select("premise", "hypothesis"), "fresh-pairs")
        made = (scorer or JaccardScorer()).score(fresh)
        self._append(made.select(pair_digest().alias("pair_digest"), F.lit(self.version).alias("version"), *(F.col(c).cast("float").alias(c) for c in SCORES[:3]), F.col("cls").cast("int").alias("cls")), self.folder)
        double = [F.col(c).cast("double").alias(c) for c in SCORES[:3]]
        return asked.withColumn("pair_digest", pair_digest()).join(self.rows().select("pair_digest", *double, "cls"), "pair_digest").drop("pair_digest")

    def compact(self, buckets: int | None = None) -> None:
        """Each pair of each version once, in new files, of so many buckets if asked; the old ones are left to readers that still use them."""
        rows = self.spark.table(self._table(self.folder)).groupBy("pair_digest", "version").agg(F.max(F.struct(*SCORES)).alias("s")).select("pair_digest", "version", "s.*")
        folder = f"pairs-{uuid.uuid4().hex}"
        self.buckets = buckets or self.buckets
        self._append(rows, folder)
        self._point_to(folder, self.buckets)
        self.folder = folder


class ScoredPairs:
    """A scorer that looks pairs up in a table of scores, made once for all that will ask."""

    def __init__(self, table: DataFrame):
        self.table = table

    def score(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.table, ["premise", "hypothesis"]).select("premise", "hypothesis", *SCORES)


def prefetched(asked: list[DataFrame], scorer: EntailmentScorer | None = None, cache: PairCache | None = None) -> ScoredPairs:
    """The union of all tables' (premise, hypothesis), each pair scored once, through the cache if there is one; written."""
    union = asked[0].select("premise", "hypothesis")
    for more in asked[1:]:
        union = union.unionByName(more.select("premise", "hypothesis"))
    distinct = staged(union.distinct(), "asked-pairs")
    made = cache.scored(distinct, scorer) if cache is not None else (scorer or JaccardScorer()).score(distinct)
    return ScoredPairs(staged(made.select("premise", "hypothesis", *SCORES), "scored-pairs"))
