"""Progressive clustering: each micro-batch of points updates the state, which can be asked after every batch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering
from ..plans.shared import numbered, written
from ..sources.points import projected, slices


class Progressive:
    """State of the clusters of one zoom (exact) or of all levels (approximate), updated by foreachBatch.

    With a store (a folder that driver and executors share) each batch writes its state under its id, with the points seen
    so far, and then a mark; a new object on that store goes on from the last marked batch. A batch that comes again (same
    id) is passed over, so a restarted stream counts no point twice. Points get their seq after all earlier ones, by time
    and tid within a batch; late points come with a later batch.
    """

    def __init__(self, spark: SparkSession, zoom: int | None = None, max_zoom: int = 17, store: str | None = None):
        self.spark, self.zoom, self.max_zoom, self.store = spark, zoom, max_zoom, store
        self.state: DataFrame | None = None
        self.seen, self.last = 0, -1
        if store is not None:
            self._restore()

    def _restore(self) -> None:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.store}/marks")
        if not fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
            return
        mark = self.spark.read.schema("batch long, seen long").parquet(f"{self.store}/marks").orderBy(F.desc("batch")).first()
        if mark is not None:
            self.last, self.seen = mark["batch"], mark["seen"]
            if self.seen:
                self.state = self.spark.read.parquet(f"{self.store}/state-{self.last}")

    def update(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last:
            return
        rows = numbered(projected(batch.filter("x is not null and y is not null")), F.asc("create_at"), F.asc("tid"))
        rows = written(rows.withColumn("seq", F.col("seq") + self.seen), "progressive-batch")
        n = rows.count()
        if n:
            if self.zoom is None:
                self.state = clustering.approximate(self.state, rows, self.max_zoom)
            elif self.state is None:
                self.state = written(clustering.clusters_at(rows, self.zoom), "progressive-state")
            else:
                self.state = written(clustering.extended(self.state, rows, self.zoom), "progressive-state")
        self.seen, self.last = self.seen + n, batch_id
        if self.store is not None:
            if self.state is not None:
                self.state.write.mode("overwrite").parquet(f"{self.store}/state-{batch_id}")
                self.state = self.spark.read.parquet(f"{self.store}/state-{batch_id}")
            self.spark.createDataFrame([(batch_id, self.seen)], "batch long, seen long").write.mode("append").parquet(f"{self.store}/marks")

    def run(self, stream: DataFrame, checkpoint: str):
        """Starts the query on a stream of points; awaitTermination() ends with the input (available now)."""
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def by_slices(table: DataFrame, start: datetime, end: datetime, days: int, zoom: int | None = None, max_zoom: int = 17, cumulative: bool = False):
    """Yields (progress in per cent, state) for each time slice of a table of points (tid, create_at, text, x, y).

    Each slice updates the state with its own points; cumulative clusters all points so far anew. Slices are half open.
    """
    spark, at = table.sparkSession, Progressive(table.sparkSession, zoom, max_zoom)
    for k, low, high, progress in slices(start, end, days):
        if cumulative:
            at, low = Progressive(spark, zoom, max_zoom), start
        at.update(table.filter((F.col("create_at") >= F.lit(low)) & (F.col("create_at") < F.lit(high))), k)
        yield progress, at.state
