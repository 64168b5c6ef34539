"""Makes the package importable for Python workers that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors once a session, unless PYTHONPATH has them."""
    context = spark.sparkContext
    if context.applicationId in _sent or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = Path(tempfile.mkdtemp(prefix="package-")) / "lodestone.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted((ROOT / "lodestone").rglob("*.py")):
            out.write(file, file.relative_to(ROOT))
    context.addPyFile(str(target))
    _sent.add(context.applicationId)
