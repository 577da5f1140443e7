"""Make this package importable on the executors, wherever it lies on the driver."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors as a zip, once per application.

    Python workers don't inherit the driver's search path; those of a cluster
    may have no copy of the package at all.
    """
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="corvane-ship-")) / "corvane-package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _DONE.add(app)
