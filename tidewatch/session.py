"""Sending the package to the executors, where it isn't on their path yet."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once, unless workers find it through PYTHONPATH or their folder.

    The archive is served by the driver, so executors need no folder in common with it.
    """
    home = str(ROOT.parent)
    if home in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == home or getattr(spark.sparkContext, "_tidewatch", False):
        return
    path = Path(tempfile.mkdtemp(prefix="tidewatch-")) / "tidewatch.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(path))
    spark.sparkContext._tidewatch = True
