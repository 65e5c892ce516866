"""The package for Python workers that start in another folder or on another machine."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers of the session's context, once for each context.

    Functions are pickled by reference to their module, so workers must be able to import it.
    """
    context = spark.sparkContext
    if getattr(context, "_planmark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "planmark.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
    # runners of stateful streams start on the driver's machine and do not see added files
    known = context.environment.get("PYTHONPATH")
    context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(root), known]))
    context._planmark_shipped = True
