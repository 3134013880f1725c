"""Intermediate tables in the folder that the cluster shares.

Iterative operators cut their lineage by writing a table below
``spark.checkpoint.dir`` and reading it back: the copy survives lost executors,
and its file sizes give Catalyst true statistics for the joins that follow.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; where none is set the warehouse's, and a temporary one only if all runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    alone = spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/textloom")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if not spark.sparkContext._jsc.sc().isStopped():
            _remove(spark, path)
    except Exception:  # the session may be gone by then; the folder belongs to the cluster
        return


#: Rows of a file, and the fewest files, of a narrow table whose size is known before it is written.
FILE_ROWS, FEWEST = 250_000, 8


class Stored:
    """A table written once and read back; ``drop`` removes it when a later one replaces it.

    With ``rows``, about how many rows there will be, it is dealt into files of FILE_ROWS first: iterations over small tables would
    else write a file for each shuffle partition every round.
    """

    def __init__(self, df: DataFrame, name: str, rows: int | None = None):
        spark = df.sparkSession
        if rows is not None:
            df = df.repartition(max(FEWEST, -(-rows // FILE_ROWS)))
        self.spark = spark
        self.path = f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        atexit.register(_remove_at_exit, spark, self.path)

    def drop(self) -> None:
        _remove(self.spark, self.path)


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written below the shared folder and read back, with its lineage cut; ``rows`` as for ``Stored``."""
    return Stored(df, name, rows).df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
