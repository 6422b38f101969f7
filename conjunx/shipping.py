"""Sends this package to the executors of a session, so that Python workers can import it wherever they run."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application.  Spark serves the archive from the driver to executors, also later ones."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = Path(__file__).parent
    with tempfile.TemporaryDirectory() as top:
        shutil.copytree(root, f"{top}/all/{root.name}", ignore=shutil.ignore_patterns("__pycache__"))
        folder = tempfile.mkdtemp(prefix="package-")  # of the driver alone, which serves the archive from there
        archive = shutil.make_archive(os.path.join(folder, root.name), "zip", f"{top}/all")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(archive)
    _SENT.add(context.applicationId)
