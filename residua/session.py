"""Sessions, and the package on their executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "residua") -> SparkSession:
    """A session with adaptive execution; other settings are the cluster's."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, unless their path has it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = Path(tempfile.mkdtemp(prefix="spark-package-")) / "residua.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "residua").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
