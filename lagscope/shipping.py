"""Send this package to executors, so that Python tasks can import it there."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark import SparkContext
from pyspark.sql import SparkSession

_sent: set[str] = set()


def archive() -> str:
    """A zip of the package's modules, made on the driver; Spark copies it to each executor."""
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lagscope-package-"), "lagscope.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    return path


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable on the session's executors. Once for each application."""
    context: SparkContext = spark.sparkContext
    if context.applicationId not in _sent:
        context.addPyFile(archive())
        _sent.add(context.applicationId)
    return spark
