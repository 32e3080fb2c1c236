"""Session construction and the two ways this library cuts lineage.

Intermediate results that are read more than once are written to the folder named by
``spark.checkpoint.dir``, which every executor shares, so a lost executor costs a
re-read and never a recomputation from the source. A private temporary folder is used
only where that setting is absent and Spark runs in local mode.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Upper bound of one Arrow batch sent to Python, so long texts cannot pile up in a worker.
ARROW_BATCH_ROWS = "2000"
ARROW_BATCH_BYTES = "16m"


def build_session(master: str = "local[*]", app: str = "ledgermill", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC time and Arrow batches bounded in rows and bytes."""
    builder = SparkSession.builder.master(master).appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgermill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="ledgermill-"), "ledgermill.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(archive)  # Spark's file server hands it out
    sc._ledgermill_shipped = True


def tune(spark: SparkSession) -> SparkSession:
    """Ship the package, and turn on Arrow with bounded batches, in a session made elsewhere."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; private only in local mode."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="ledgermill-")
    sc.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of that table.

    An application's tables lie in one folder named by its id, to be deleted after it ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgermill-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgermill_path = path
    return out


def release(staged: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    path = getattr(staged, "_ledgermill_path", None)
    if path:
        sc = staged.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
