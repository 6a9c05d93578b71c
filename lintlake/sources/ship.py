"""Making the package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers once an application, unless PYTHONPATH names its folder already."""
    root = Path(__file__).resolve().parents[2]
    named = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    application = spark.sparkContext.applicationId
    if str(root) in named or application in _DONE:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="lintlake-"), "lintlake.zip")
    with zipfile.ZipFile(path, "w") as packed:
        for source in sorted((root / "lintlake").rglob("*.py")):
            packed.write(source, source.relative_to(root))
    spark.sparkContext.addPyFile(path)
    _DONE.add(application)
