"""Session helpers: reaching this package from Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run.

    Local masters share the file system, so a path is enough; on a cluster the
    package goes out as a zip file, once per context."""
    sc = spark.sparkContext
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if str(ROOT.parent) in paths:
        return
    sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in [str(ROOT.parent), *paths] if p)
    if not sc.master.startswith("local"):
        out = Path(tempfile.mkdtemp()) / "granthika.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(ROOT.rglob("*.py")):
                z.write(p, p.relative_to(ROOT.parent))
        sc.addPyFile(str(out))
