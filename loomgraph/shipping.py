"""Sends this package to the executors, whose Python workers import it wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's files, once a SparkContext."""
    context = spark.sparkContext
    if getattr(context, "_loomgraph_shipped", False):
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="loomgraph-code-")) / "loomgraph.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(path))
    context._loomgraph_shipped = True
