"""Makes this package importable for Python workers, wherever the driver was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application; Spark serves the file from the driver."""
    context = spark.sparkContext
    if getattr(context, "_kinweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        archive = Path(tempfile.mkdtemp()) / "kinweave_package.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*")):
                if path.is_file() and "__pycache__" not in path.parts:
                    out.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
    context._kinweave_shipped = True
