"""Session construction with the settings the operators are planned for."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any size. Partition counts come from the cluster; AQE coalesces and splits at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for local use and tests; on a cluster the submitted configuration wins."""
    builder = SparkSession.builder.appName("cuewright")
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or "local[*]")
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false"} | extra
    return ship(builder.config(map=conf).getOrCreate())


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the executors, once per application, so that their Python workers need no installation of it."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="cuewright-")) / "cuewright.zip"
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(at))
        _SHIPPED.add(app)
    return spark


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after the package is where it runs."""

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(ship(spark), folder)

    return run
