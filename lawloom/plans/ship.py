"""The package's way to the workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the session's Python workers, once, so that it need not be installed where they run."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    if root.is_dir():  # otherwise it came in an archive, and is on its way already
        archive = Path(tempfile.mkdtemp(prefix="lawloom-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
