"""Python workers import this package: send it to the executors where they would not find it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once, unless PYTHONPATH or the working folder has it."""
    app = spark.sparkContext.applicationId
    found = [Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    if app in _shipped or ROOT in found or any((p / "lodestone").is_dir() for p in found):
        return
    name = os.path.join(tempfile.mkdtemp(), "lodestone.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted((ROOT / "lodestone").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)
