"""Session helpers: a local session for tests and the shared checkpoint folder."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "strataspark") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package (once per session), so that queries run from any folder and on any machine."""
    import zipfile
    from pathlib import Path
    sc = spark.sparkContext
    if getattr(sc, "_strataspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-code-")) / "strataspark.zip"  # read by the driver only, which serves it to the executors
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(target))
    sc._strataspark_shipped = True


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that the cluster names in ``spark.checkpoint.dir``; None where it is unset and the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not folder and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the cluster's shared folder (``spark.checkpoint.dir``).

    Only in a local session without that setting (tests) is a temporary folder used; a cluster without it is an error."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark) or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint(eager=True)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder next to the checkpoints (shared on a cluster, temporary in tests)."""
    import uuid
    base = shared_folder(spark)
    return f"{base}/scratch-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="spark-")


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder whose rows nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
