"""Arrow batches small enough for whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame

_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch; the default of 10,000 whole texts would hold tens of MB in the JVM and again in each worker.
ROWS = 500


def bounded(df: DataFrame) -> DataFrame:
    """``df`` itself, after the session's batches are set to ROWS at most; smaller settings are left alone."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_KEY, "10000")) <= ROWS:
        conf.set(_KEY, str(ROWS))
    return df
