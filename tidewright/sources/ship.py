"""Sending the package to the workers of an application that doesn't have it installed."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession

from tidewright.sources import folders

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes ``tidewright`` importable on all workers, once a Spark application.

    Operators that run Python in tasks need the package there. Either it is installed on every
    node (``pip install``), or this is called first: the package goes to the workers as a zip in
    the shared folder, so they need no path of the driver's disk.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(folders.put(spark, "tidewright.zip", held.getvalue()))
    _shipped.add(sc.applicationId)
