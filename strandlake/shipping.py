"""The package on the executors.

Functions that run in Python workers import this package there. Where it is not installed on the executors, it is sent
once a session as a zip file by Spark's own file server.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Make the package importable in this session's Python workers."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or (app := spark.sparkContext.applicationId) in _sent:
        return
    _sent.add(app)
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # already running from such a file
        return
    path = Path(tempfile.mkdtemp(prefix="strandlake-")).resolve() / "strandlake.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
