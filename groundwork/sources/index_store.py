"""A retrieval index on disk: versions, segments, a model's tag, and updates that touch changed documents alone.

    path/manifest/*.json            a line for each version: its number, model and segments in order
    path/segments/<id>/changes      (key, status) of what the segment was made for
    path/segments/<id>/documents    (key, sha256, dl, deleted)
    path/segments/<id>/postings     (term, key, dl, tf), by bucket of the term
    path/segments/<id>/vectors      (key, embedding), where the index has vectors

A document counts as the last segment that names it has it. A version exists from the moment its
line does, and the line is written last, so a reader sees a whole version or the one before it; a
run that dies leaves a segment that no line names. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.functions import text as T
from groundwork.operators import retrieval as R
from groundwork.sources.shared import settled

MANIFEST = "version long, model string, segments array<string>, n_changed long, n_removed long"
#: Folders over which a segment's terms are dealt; a search opens those of its words.
BUCKETS = 32


class ModelMismatch(ValueError):
    """The index was built with another model than the one that is to be added or asked with."""


class IndexStore:
    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # -- versions

    def versions(self) -> DataFrame:
        """The manifest's lines; none if there is no index yet."""
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def current(self) -> tuple[int, str | None, list[str]]:
        """Number, model and segments of the newest version; 0 if there is none."""
        row = self.versions().orderBy(F.desc("version")).first()
        return (row.version, row.model, list(row.segments)) if row else (0, None, [])

    def mismatches(self, model: str) -> DataFrame:
        """(version, indexed, wanted) if the newest version was built with another model; no row if not."""
        newest = self.versions().orderBy(F.desc("version")).limit(1)
        return newest.where(F.col("model") != model).select("version", F.col("model").alias("indexed"), F.lit(model).alias("wanted"))

    # -- writing

    def build(self, docs: DataFrame, model: str, embed: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """A new version of docs (key, text) alone, whatever stood there; embed gives (key, embedding) of (key, text)."""
        version, _, _ = self.current()
        return self._commit(version, model, [self._segment(docs, docs.select(self.key, F.lit("new").alias("status")), embed)], [])

    def update(self, docs: DataFrame, model: str, embed: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """A new version after docs, the whole corpus as it is now: what is new or changed is read into a segment of its own.

        Texts are compared by their hash; documents that are no longer there are marked deleted. Keys
        are unique, null keys are left out, a null text is empty. Without any change no version is made.
        """
        version, indexed, segments = self.current()
        if indexed is not None and indexed != model:
            raise ModelMismatch(f"indexed with {indexed}, wanted {model}: build anew")
        now = docs.where(F.col(self.key).isNotNull()).select(self.key, _sha().alias("now"))
        both = now.join(self.documents().select(self.key, "sha256"), self.key, "full")
        status = F.when(F.col("now").isNull(), "removed").when(F.col("sha256").isNull(), "new").when(F.col("now") == F.col("sha256"), "same").otherwise("changed")
        changes = both.select(self.key, status.alias("status")).where("status <> 'same'")
        segment = self._segment(docs, changes, embed)
        return self._commit(version, model, [segment], segments) if not self._read(segment, "changes").isEmpty() else version

    def compact(self) -> int:
        """The newest version as a single segment: rows that still count are copied, nothing is read anew."""
        version, model, segments = self.current()
        to, live = self._folder(), self.documents()
        live.select(self.key, F.lit("new").alias("status")).write.parquet(f"{to}/changes")
        live.select(self.key, "sha256", "dl", "deleted").write.parquet(f"{to}/documents")
        self._write_postings(self.postings(), to)
        if self._has_vectors(segments):
            self.vectors().write.parquet(f"{to}/vectors")
        return self._commit(version, model, [to.rpartition("/")[2]], [])

    def _folder(self) -> str:
        return f"{self.path}/segments/{uuid.uuid4().hex}"

    def _segment(self, docs: DataFrame, changes: DataFrame, embed: Callable[[DataFrame], DataFrame] | None) -> str:
        to = self._folder()
        changes.write.parquet(f"{to}/changes")
        changes = self.spark.read.parquet(f"{to}/changes")
        added = docs.select(self.key, F.coalesce("text", F.lit("")).alias("text")).join(changes.where("status <> 'removed'").select(self.key), self.key, "left_semi")
        words = added.select(self.key, T.tokens(F.col("text")).alias("t"), _sha().alias("sha256"))
        removed = changes.where("status = 'removed'").select(self.key, F.lit(None).cast("string").alias("sha256"), F.lit(0).alias("dl"), F.lit(True).alias("deleted"))
        words.select(self.key, "sha256", F.size("t").alias("dl"), F.lit(False).alias("deleted")).unionByName(removed).write.parquet(f"{to}/documents")
        self._write_postings(words.select(self.key, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", self.key, "dl").agg(F.count("*").alias("tf")), to)
        if embed is not None:
            embed(added).select(self.key, "embedding").write.parquet(f"{to}/vectors")
        return to.rpartition("/")[2]

    def _write_postings(self, rows: DataFrame, to: str) -> None:
        # Frequent terms would make one bucket's file large: a bucket is dealt over tasks by the documents as well.
        spread = rows.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64(self.key), F.lit(16)))
        spread.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{to}/postings")

    def _commit(self, before: int, model: str | None, added: list[str], kept: list[str]) -> int:
        changes = reduce(DataFrame.unionByName, (self._read(s, "changes") for s in added))
        counted = changes.agg(F.count_if(F.col("status") != "removed").alias("n_changed"), F.count_if(F.col("status") == "removed").alias("n_removed"))
        line = counted.select(F.lit(before + 1).cast("long").alias("version"), F.lit(model).alias("model"), F.array(*map(F.lit, [*kept, *added])).alias("segments"), "n_changed", "n_removed")
        line.coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return before + 1

    # -- reading

    def _read(self, segment: str, name: str) -> DataFrame:
        reader = self.spark.read
        if name == "postings":  # a segment that only deletes has none, so no file to tell their columns
            kind = dict(self._read(segment, "documents").dtypes)[self.key]
            reader = reader.schema(f"term string, {self.key} {kind}, dl int, tf long, bucket int")
        return reader.parquet(f"{self.path}/segments/{segment}/{name}")

    def _has_vectors(self, segments: list[str]) -> bool:
        try:
            return bool(segments) and self._read(segments[0], "vectors") is not None
        except AnalysisException:
            return False

    def _all(self, name: str) -> DataFrame:
        _, _, segments = self.current()
        return reduce(DataFrame.unionByName, (self._read(s, name).withColumn("segment", F.lit(k)) for k, s in enumerate(segments)))

    def documents(self) -> DataFrame:
        """(key, sha256, dl, deleted, segment) of the documents that count."""
        if not self.current()[2]:
            return self.spark.createDataFrame([], f"{self.key} long, sha256 string, dl int, deleted boolean, segment int")
        newest = Window.partitionBy(self.key).orderBy(F.desc("segment"))
        return self._all("documents").withColumn("n", F.row_number().over(newest)).where("n = 1 and not deleted").drop("n")

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.documents().select(self.key, "segment"), [self.key, "segment"], "left_semi").drop("segment")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, key, dl, tf) of the documents that count, of the given terms (term) or of all; only their buckets are opened."""
        rows = self._all("postings")
        if terms is not None:
            rows = rows.join(terms.select("term").distinct().withColumn("bucket", _bucket(F.col("term"))), ["bucket", "term"], "left_semi")
        return self._live(rows).select("term", self.key, "dl", "tf")

    def vectors(self) -> DataFrame:
        return self._live(self._all("vectors")).select(self.key, "embedding")

    def search(self, questions: DataFrame, query: str, k: int = R.TOP_K) -> DataFrame:
        """``retrieval.bm25`` (query, text) over the index; texts are not looked at."""
        asked = settled(R.asked_words(questions, query), "asked")
        totals = self.documents().agg(F.struct(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).alias("x"))
        return R.bm25_of(asked, settled(self.postings(asked), "postings"), totals, query, self.key, k)

    def nearest(self, questions: DataFrame, query: str, k: int = R.TOP_K) -> DataFrame:
        """``retrieval.dense`` (query, embedding) over the index's vectors."""
        return R.dense(questions, self.vectors(), query, self.key, "embedding", k, others_only=False)


def _sha() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")
