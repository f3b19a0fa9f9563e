"""The package for executors that don't have it."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Hand the package's source to the executors, once a Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_querylens_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = os.path.join(sc._temp_dir, "querylens.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, f"{package.name}/{p.relative_to(package)}")
    sc.addPyFile(target)
    sc._querylens_shipped = True
