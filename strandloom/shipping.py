"""Making the package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's code along where PYTHONPATH does not already lead to it."""
    root = Path(__file__).resolve().parents[1]
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    sc = spark.sparkContext
    if str(root) in on_path or getattr(sc, "_strandloom_shipped", False):
        return
    bundle = os.path.join(tempfile.mkdtemp(prefix="strandloom-"), "strandloom_code.zip")
    with zipfile.ZipFile(bundle, "w") as z:
        for p in sorted((root / "strandloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(bundle)
    sc._strandloom_shipped = True
