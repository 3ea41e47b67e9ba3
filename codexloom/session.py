"""What a session needs for Python functions and cut lineage: this package on the executors, and the cluster's shared folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED = "_codexloom_shipped"


def ship(spark: SparkSession) -> None:
    """Let executors import this package, whether it is installed there or not: once a context, as an archive that the driver serves."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="codexloom-")) / "codexloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    setattr(context, _SHIPPED, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session that has none, as in tests, gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="codexloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")
