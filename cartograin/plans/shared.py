"""Tables in the shared folder: intermediate results that cut lineage and survive a lost executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A session on one machine may lack it and gets a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cartograin-"))
        place = spark.sparkContext.getCheckpointDir()
    return place.rstrip("/")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def removed(table: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    spark = table.sparkSession
    for place in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None, append: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, or at a path."""
    path = path or place(df.sparkSession, name)
    df.write.mode("append" if append else "error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order, name: str = "seq") -> DataFrame:
    """df with a dense number from 0 in the given order, without sorting in one task.

    Rows are range-partitioned and sorted within partitions; the number is the place in the partition plus the rows of all
    partitions before. The driver gets one count per partition. Equal rows are numbered in any order.
    """
    at = "_at"
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    sorted_ = written(sorted_, "numbered")
    part = F.shiftright(at, 33)
    before, offsets = 0, []
    for r in sorted_.groupBy(part.alias("p")).count().orderBy("p").collect():
        offsets.append((r["p"], before))
        before += r["count"]
    if not offsets:
        return sorted_.withColumn(name, F.lit(0).cast("long")).drop(at)
    starts = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    joined = sorted_.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_before") + F.col(at).bitwiseAND((1 << 33) - 1)).drop(at, "_part", "_before")
