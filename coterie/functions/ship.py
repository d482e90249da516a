"""Make this package importable in Python workers wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand the package's sources to every executor through Spark's own file distribution, once per application."""
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="coterie-src-")) / "coterie_src.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(archive))
    _DONE.add(app)
