"""Intermediate tables in the folder that all executors share.

A table written here cuts lineage the way ``checkpoint()`` does: it survives lost executors because it is
plain Parquet in the folder named by ``spark.checkpoint.dir``.  Only where that setting is unset (tests,
local runs) a temporary folder of this machine is used instead.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI or path without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL[app] = tempfile.mkdtemp(prefix="leadloom-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Names, writes and drops intermediate tables under one fresh folder.

    Frames that an operator returns read these tables when they run, so a folder stays until its user closes it, or
    until ``clean`` is called at the end of a job; a machine's own temporary folder goes with the process.
    """

    made: list[str] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        Scratch.made.append(self.root)

    def close(self) -> None:
        """Delete all tables under this folder; frames that read them can't run any more."""
        _delete(self.spark, self.root)
        if self.root in Scratch.made:
            Scratch.made.remove(self.root)

    @classmethod
    def clean(cls, spark: SparkSession) -> int:
        """Delete every folder that this process has made and not closed; how many."""
        gone = len(cls.made)
        for root in cls.made:
            _delete(spark, root)
        cls.made.clear()
        return gone

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write df once and return the table that was written; the write is committed atomically by Spark."""
        path = self.path(name)
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def save_by(self, df: DataFrame, key: str, name: str, compression: str = "snappy") -> DataFrame:
        """Write df in buckets of ``key``, as many as Spark shuffles to: joins and groups by it don't shuffle the table again.

        Its entry in the session's catalog goes at once; the table that is returned reads its files only.
        """
        path, entry = self.path(name), f"spark_catalog.default.leadloom_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").option("compression", compression).option("path", path).bucketBy(buckets, key).saveAsTable(entry)
        out = self.spark.table(entry).select(*df.columns)
        self.spark.sql(f"DROP TABLE {entry}")
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that save() returned and that nothing reads any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(self.spark, path)
