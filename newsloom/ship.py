"""Takes this package to the Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    here = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="newsloom-zip-")) / "newsloom.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, Path("newsloom") / f.relative_to(here))
    spark.sparkContext.addPyFile(str(at))
    _sent.add(app)
