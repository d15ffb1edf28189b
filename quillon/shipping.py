"""Makes the package importable on executors that do not have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands the package to Spark's file server once for each application, unless Python's path has it already."""
    sc = spark.sparkContext
    here = str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.master.startswith("local[") and Path.cwd() == ROOT
    if here or sc.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="quillon-")) / "quillon.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "quillon").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
