"""Gives executors this package, so that it needn't be installed there."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="boundwise-")) / f"{top.name}.zip"
        with zipfile.ZipFile(path, "w") as out:
            for source in sorted(top.rglob("*.py")):
                out.write(source, source.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)


def arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """df.mapInArrow, where f is in this package."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)
