"""Send the package to the executors, for sessions started without it."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package as a zip file to the application, once.

    The file lies in the driver's own temporary folder; Spark's file server hands it out.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    with tempfile.TemporaryDirectory() as folder:
        for path, _, names in os.walk(os.path.join(root, "wardlake")):
            for name in names:
                if name.endswith(".py"):
                    source = os.path.join(path, name)
                    target = os.path.join(folder, os.path.relpath(source, root))
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    shutil.copyfile(source, target)
        base = os.path.join(tempfile.mkdtemp(prefix="wardlake-"), "wardlake_package")
        context.addPyFile(shutil.make_archive(base, "zip", folder))
    _SHIPPED.add(context.applicationId)
