"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="joinwright-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class Workspace:
    """One folder of Parquet tables for one call of an operator.

    A table written here cuts the lineage: a lost executor costs only the step
    that was running. ``drop`` removes a table as soon as no later step reads
    it; what the returned DataFrame reads stays.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.options(**options).mode("overwrite").parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def smallest_hashes(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows with the smallest hash of ``key``: a bounded sample that reruns repeat.

    Rows are counted first, so that only about twice as many as are asked for
    are sorted or sent on, however many tasks there are.
    """
    whole = 1 << 31
    turn = F.pmod(F.xxhash64(key), F.lit(whole))
    n = rows.count()
    if n > 4 * most:
        rows = rows.where(turn < int(whole * (2 * most + 200) / n))
    return rows.orderBy(turn, key).limit(most)
