"""Intermediate tables in the shared folder that the cluster names, so that lost executors cost a re-read only."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

BATCH_BYTES = 8 << 20


class Scratch:
    """Writes and drops intermediate Parquet tables under spark.checkpoint.dir.

    Only where that setting and the context's checkpoint folder are both unset a local session takes a temporary folder;
    on a cluster, whose executors could not share it, that is an error. Tables that are not dropped before go when the
    session's file system closes.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="docspark-")
            spark.conf.set("spark.checkpoint.dir", base)
        # Arrow batches of chunk rows are held several times over, in the JVM and in Python: 8 MB instead of 64
        batch = "spark.sql.execution.arrow.maxBytesPerBatch"
        if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
            spark.conf.set(batch, f"{BATCH_BYTES}b")
        self.base = f"{base.rstrip('/')}/docspark-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}
        path = self._path(self.base)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes `df` and returns it as read again."""
        path = f"{self.base}/{name}-{len(self._paths)}"
        df.write.parquet(path)
        self._paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            path = self._path(self._paths[name])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def integer_id(docs: DataFrame, id_col: str) -> Column:
    """The identifier as `id`, a long; other than whole numbers are refused before any work is done."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers, not {kind.simpleString()}")
    return docs[id_col].cast("long").alias("id")


def row_keyed(docs: DataFrame, scratch: Scratch, names: tuple[str, str]) -> DataFrame:
    """`docs` with two longs that name each row, the same whenever it is read: a hash of its file's path and its place in the
    file. What isn't simply read from files is written first."""
    place = [F.xxhash64("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])]
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            return docs.select("*", *place)
        except AnalysisException:  # a source without places
            pass
    return scratch.table(docs, "rows").select("*", *place)
