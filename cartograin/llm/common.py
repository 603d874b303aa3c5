"""Small helpers shared by the operators: tables in the shared folder, words and hashes of whole texts."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than these; UTF-8 continuation bytes are never among them.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1 << 32, 1 << 63, 256).astype(np.uint64) | np.uint64(1)
#: Texts are hashed in pieces of about so many bytes, so that a task's memory does not depend on its input.
CHUNK = 1 << 20
#: Postings in one range, and members of a bucket beyond which its edges are dealt to parts of about so many.
RANGE, HOT = 1 << 21, 4096
#: Parts that the rows of a hot key are dealt to in a join with a few rows for each key.
SALT = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A session on one machine may lack it and gets a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cartograin-"))
        place = spark.sparkContext.getCheckpointDir()
    return place.rstrip("/")


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives a lost executor, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """written(), with rows dealt to buckets by key: groups by key read them where they are, without a shuffle."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    place = df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}")
    place.bucketBy(shuffle_parts(spark), key).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files are outside the warehouse
    return table


def removed(table: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges_for(spark: SparkSession, postings: int) -> int:
    """Ranges that postings are dealt to: as many as keep each, which one task holds, at about RANGE of them, and two for each shuffle partition."""
    return max(32, 2 * shuffle_parts(spark), -(-postings // RANGE))


def fresh(*taken: list[str], name: str) -> str:
    """A column name that none of the given lists has."""
    while any(name in names for names in taken):
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(max(n, CHUNK * 3 // 2), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def chunks(column: pa.Array, size: int = CHUNK):
    """(first row, offsets, bytes) for successive runs of rows of a string column, each of about size bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        at = to


def words(offsets: np.ndarray, data: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the place of its first word among them (and the total)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~space[data]
    before = np.concatenate(([False], inside[:-1]))
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True
    starts = np.flatnonzero(inside & (~before | edges))
    ends = np.flatnonzero(before & (~inside | edges))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(offsets: np.ndarray, data: np.ndarray, lower: bool = False, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words() and a 64-bit hash of each word's bytes (A-Z as a-z if lower)."""
    starts, ends, firsts = words(offsets, data, space)
    power, inverse = _power(len(data) + 1)
    summed = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * power[:-1], out=summed[1:])
    return starts, ends, firsts, mix((summed[ends] - summed[starts]) * inverse[starts])


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of width consecutive word hashes (of one text)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _power(len(hashes))
    summed = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power, out=summed[1:])
    return mix((summed[width:] - summed[:n]) * inverse[:n] + np.uint64(width))


def _without_hot_buckets(edges: DataFrame, name: str) -> DataFrame:
    """edges (node, bucket) with each bucket of over HOT members as parts, and the smallest member of each part in the bucket."""
    hot = written(edges.groupBy("bucket").agg(F.ceil(F.count("*") / HOT).alias("parts")).filter("parts > 1"), name)
    if not hot.limit(1).count():
        return edges
    salt = lambda: F.pmod(F.xxhash64("node"), F.lit(SALT))
    hot = hot.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    dealt = edges.withColumn("salt", salt()).join(hot, ["bucket", "salt"], "left")
    part = F.xxhash64("bucket", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")))
    dealt = written(dealt.select("node", "bucket", F.when(F.col("parts").isNotNull(), part).alias("part")), name)
    up = dealt.filter("part is not null").groupBy("part", "bucket").agg(F.min("node").alias("node")).select("node", "bucket")
    return dealt.select("node", F.coalesce("part", "bucket").alias("bucket")).unionByName(up)


def components(pairs: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the smallest node that shares a bucket with node, directly or through others.

    pairs: (node, bucket), both long. Smallest labels go from buckets to nodes and back until none changes, two steps of
    aggregates with partial sums and joins in each round; every round is written to the shared folder, the one before goes.
    A bucket with very many members is dealt to parts first. Only one number a round reaches the driver. Nulls in either
    column are left out; repeated rows count once; an empty table gives none.
    """
    edges = written(pairs.select("node", "bucket").na.drop().distinct(), name)
    edges = written(_without_hot_buckets(edges, name).withColumn("label", F.col("node")), name)
    while True:
        low = edges.groupBy("bucket").agg(F.min("label").alias("low"))
        label = edges.join(low, "bucket").groupBy("node").agg(F.min("low").alias("label"))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("root"))
        label = label.join(jump, "label").select("node", F.col("root").alias("label"))
        after = written(edges.withColumnRenamed("label", "was").join(label, "node"), name)
        changed = after.filter("was <> label").limit(1).count()
        removed(edges)
        edges = after.drop("was")
        if not changed:
            return edges.select("node", "label").distinct()
