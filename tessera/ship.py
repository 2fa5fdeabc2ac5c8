"""Hands the package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once a session: the package's sources as a zip that Spark serves to every worker.

    Sessions that have the package on all workers (``--py-files``, an installation) lose nothing by it.
    """
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), f"tessera_{context.applicationId.replace('-', '_')}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(home):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, home)))
    context.addPyFile(path)
    context._tessera_shipped = True
