"""Cut lineage of iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PIECE_MB = 8


def pieces(df: DataFrame, mb: float = PIECE_MB) -> int:
    """How many partitions df is dealt over so that each gets mb MB of it as stored, and no fewer than Spark's own number.

    For tables read from files, whose size is known; what Spark would only guess (a join's size is a product) gets its own number."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(own, -(-size // int(mb * 2**20))) if size < 2**40 else own


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Where it is unset, a local session gets one of its own and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="orbweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/orbweave-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder (spark.checkpoint.dir) and read back; a lost executor costs nothing then.

    One file a task: merging tasks into a number of files that the cores fix makes each of them hold more as tables grow. Small tables have few tasks by Spark's own merging."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_LOADED: dict[tuple, DataFrame] = {}


def loaded_once(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that build makes, stored at its first use in this application and read by later ones, as a graph is loaded once for many questions."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _LOADED:
        _LOADED[key] = stored(build(), "loaded")
    return _LOADED[key]
