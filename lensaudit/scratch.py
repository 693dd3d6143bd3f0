"""Tables that a plan starts from again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


#: With this on, Spark deletes a plan's shuffle files when its action ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def discard(table: DataFrame) -> None:
    """Deletes a table of settled()."""
    spark = table.sparkSession
    for at in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def settled(df: DataFrame, kind: str = "points", replaces: DataFrame | None = None) -> DataFrame:
    """Cut the lineage by a table in the folder of spark.checkpoint.dir; a local session without one gets a temporary folder.

    A table and not checkpoint(), which keeps the estimated size of the plan before it: through rounds of joins that number gets more digits than the driver can multiply.
    Shuffle files go when the table is written; so does the table of settled() that it replaces.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="lensaudit-"))
    at = f"{context._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(at)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    if replaces is not None:
        discard(replaces)
    return df.sparkSession.read.parquet(at)
