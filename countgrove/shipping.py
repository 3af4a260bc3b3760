"""Sending the package to executors that do not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> str:
    """Adds this package to the Python path of every executor; returns the archive's path.

    Workers load kernels by module name, so call this once per session where the package is
    neither installed on the executors nor on their PYTHONPATH. The archive is built in the
    driver's temporary folder and served to executors by the session itself.
    """
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="countgrove-")) / "countgrove.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    return str(archive)
