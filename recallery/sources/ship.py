"""Make this package known to Python workers that can't import it by themselves."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once for each application, unless the workers' path has it already."""
    package = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _shipped or str(package.parent) in {os.path.realpath(p) for p in known if p}:
        return
    _shipped.add(app)
    target = Path(tempfile.mkdtemp(prefix="recallery-ship-")) / "recallery"
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
    shutil.make_archive(str(target), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(f"{target}.zip")
