"""Cutting lineage: intermediate tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where that is unset (local runs)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="loomtext-"))


class Store:
    """Tables of one run below the shared folder.

    ``drop`` and ``only`` remove those no longer read. What a result still reads goes when the application ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/loomtext/{what}-{uuid.uuid4().hex}"
        self.n = 0
        self.made: list[DataFrame] = []
        path, files = self._place(self.root)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _place(self, path: str):
        sc = self.spark.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(sc._jsc.hadoopConfiguration())

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return a DataFrame that reads it back."""
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loomtext_path = path
        self.made.append(out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables made by ``cut`` and let their shuffle files go."""
        for df in frames:
            path, files = self._place(df._loomtext_path)
            files.delete(path, True)
            self.made = [m for m in self.made if m is not df]

    def only(self, *frames: DataFrame) -> None:
        """Delete all tables made by ``cut`` but these."""
        self.drop(*[m for m in self.made if all(m is not f for f in frames)])
