"""Results of a long run, written as it goes: a run that dies is taken up where it stopped, and nothing is written twice.

    path/epochs/epoch=<n>    the rows of a wave or micro-batch, each epoch a folder that it overwrites
    path/report              the rows in golden order, written once
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class ResultSink:
    """Rows with a unique key; of a key that comes again, in a later epoch, the first one holds."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def written(self) -> DataFrame | None:
        """All rows so far with their epoch, a row for each key; None if there is none."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/epochs")
        except AnalysisException as missing:
            # No folder yet, or only ones without a whole file.
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        first = Window.partitionBy(self.key).orderBy("epoch")
        return rows.withColumn("epoch", F.col("epoch").cast("long")).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")

    def write(self, rows: DataFrame, epoch: int) -> None:
        """An epoch's rows in place of what an earlier try of the same epoch left; repeated keys come down to one."""
        rows.dropDuplicates([self.key]).write.mode("overwrite").parquet(f"{self.path}/epochs/epoch={epoch}")

    def drain(self, stream: DataFrame, checkpoint: str) -> None:
        """All that a stream has now; a micro-batch that is run again after a failure overwrites its own epoch."""
        writer = stream.writeStream.foreachBatch(lambda rows, epoch: self.write(rows, epoch)).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()

    def remaining(self, golden: DataFrame) -> DataFrame:
        """The golden rows (with the key) without a result yet."""
        done = self.written()
        return golden if done is None else golden.join(done.select(self.key), self.key, "left_anti")

    def run(self, golden: DataFrame, score: Callable[[DataFrame], DataFrame], waves: int) -> None:
        """score(golden rows) for all rows without a result, in `waves` waves, each written before the next begins.

        score gives a row for each key. Waves are dealt by the key's hash, so a resumed run's waves
        hold what is left of the same ones; those with nothing left are not run.
        """
        wave = F.pmod(F.xxhash64(self.key), F.lit(waves)).cast("int")
        left = {r.wave for r in self.remaining(golden).select(wave.alias("wave")).distinct().collect()}
        done = self.written()
        start = 0 if done is None else done.agg(F.max("epoch")).first()[0] + 1
        for epoch, w in enumerate(sorted(left), start):
            self.write(score(self.remaining(golden).where(wave == w)), epoch)

    def ordered(self, golden: DataFrame, place: str) -> DataFrame:
        """Every result with its golden row's place, in that order; results that the golden set has no row for come last."""
        done = self.written()
        if done is None:
            raise ValueError(f"no results at {self.path}")
        at = golden.select(self.key, F.col(place).alias(place))
        return done.drop("epoch").join(at, self.key, "left").orderBy(F.col(place).asc_nulls_last(), self.key)

    def report(self, golden: DataFrame, place: str, summary: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """summary(rows in golden order), written once: a report that is there already is read, not made again."""
        to = f"{self.path}/report"
        if self.remaining(golden).isEmpty():
            summary(self.ordered(golden, place)).write.mode("ignore").json(to)
            return self.spark.read.json(to)
        raise ValueError("the run is not finished")
