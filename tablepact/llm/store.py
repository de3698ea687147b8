"""Tables that cut lineage, in the folder that every machine of the cluster shares.

The folder is the one named by ``spark.checkpoint.dir``. Where a session names none, a folder of this
machine serves if the session runs on this machine alone (``local`` master: tests, a laptop); elsewhere that is an error. Files are written and removed
through Spark and Hadoop, so any file system that Spark can reach will do.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_collecting: list[list[Scratch]] = []


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines of the cluster share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def collecting() -> Iterator[list[Scratch]]:
    """Gathers the folders that operators open meanwhile, so that a caller who has written their results can remove them."""
    made: list[Scratch] = []
    _collecting.append(made)
    try:
        yield made
    finally:
        _collecting.remove(made)


class Scratch:
    """A run's own folder below the shared one; holds the tables that cut lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        for made in _collecting:
            made.append(self)

    def remove(self) -> None:
        """Removes the folder with all of its tables."""
        self.drop(self.path)

    def write(self, df: DataFrame, name: str = "t", codec: str = "zstd") -> str:
        """Writes ``df`` as Parquet and returns its path."""
        self._n += 1
        path = f"{self.path}/{name}-{self._n}"
        df.write.option("compression", codec).parquet(path)
        return path

    def table(self, df: DataFrame, name: str = "t", codec: str = "zstd") -> DataFrame:
        """Writes ``df`` and returns what was written, free of its lineage."""
        schema = df.schema
        return self.spark.read.schema(schema).parquet(self.write(df, name, codec))

    def drop(self, *tables: DataFrame | str) -> None:
        """Removes tables that no later step reads."""
        jvm = self.spark._jvm
        for t in tables:
            paths = [t] if isinstance(t, str) else {f.rsplit("/", 1)[0] for f in t.inputFiles()}
            for p in paths:
                p = jvm.org.apache.hadoop.fs.Path(p)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
