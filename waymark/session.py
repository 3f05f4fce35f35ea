"""Sessions, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def build_session(name: str = "waymark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this engine's settings; `conf` adds to them (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=settings | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once per Spark context, so that Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_waymark_shipped", False):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="waymark-"), "waymark_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(Path("waymark") / p.relative_to(PACKAGE)))
    sc.addPyFile(path)
    sc._waymark_shipped = True
    return spark
