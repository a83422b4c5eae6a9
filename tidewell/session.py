"""Session defaults, and the library's own code for Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(name: str = "tidewell", **more: str) -> SparkSession:
    """A session with the library's defaults; the cluster's own settings win where it was started with them."""
    return SparkSession.builder.appName(name).config(map=DEFAULTS | more).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, of spark.checkpoint.dir. A local session that names none gets one of its own; a cluster must name one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tidewell-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each context, whatever their working folder is."""
    context = spark.sparkContext
    if getattr(context, "_tidewell_shipped", False):
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tidewell-code-")) / "tidewell_code.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, f"{top.name}/{source.relative_to(top)}")
    context.addPyFile(str(path))
    context._tidewell_shipped = True
