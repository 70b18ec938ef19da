"""The package itself for the executors' Python workers, where it may not be installed."""
from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's source as a zip to this application, once."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="freqforge-src-"), "freqforge_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, str(Path(_PACKAGE.name) / f.relative_to(_PACKAGE)))
    sc.addPyFile(path)  # Spark serves it to the executors
    _SHIPPED.add(sc.applicationId)
