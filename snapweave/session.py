"""Session helpers: reading tables, shared work folder, written intermediate tables, size-checked joins."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only below this many (estimated) bytes; above it the join shuffles.
BROADCAST_LIMIT = 32 << 20

_OWN: list[str] = []  # the folder of a local session without the setting; deleted when Python ends


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; one of our own only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="snapweave-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        root = _OWN[0]
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{work_root(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives the loss of executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows of ``df`` as they lie in memory: 8 per column and the lengths of texts and binaries, 24 per row on top."""
    long = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    return df.agg(F.coalesce(F.sum(sum(long, F.lit(24 + 8 * len(df.columns)))), F.lit(0)).cast("long")).first()[0]


def written_small(df: DataFrame, tag: str, limit: int | None = None) -> tuple[DataFrame, bool]:
    """``df`` written, and whether its measured bytes stay below the broadcast limit."""
    out = written(df, tag)
    return out, measured_bytes(out) <= (BROADCAST_LIMIT if limit is None else limit)


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Intermediate tables of one computation, deleted together when it has been written down elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        path = new_path(self.spark, tag)
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        for path in self.paths:
            delete_path(self.spark, path)
        self.paths = []


def maybe_broadcast(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def pieces(amount: float, per_piece: float, least: int = 1) -> int:
    return max(least, math.ceil(amount / per_piece))
