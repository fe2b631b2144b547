"""What Python code needs of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, of ``spark.checkpoint.dir``; a temporary one only where it is unset and the session runs on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="weft-")
    return folder.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once; they may have no path to the driver's files."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="weft-"), "weft.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    z.write(file, os.path.relpath(file, os.path.dirname(here)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
