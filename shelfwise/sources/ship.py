"""Make this package importable on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
BATCH_ROWS = 2_000  # rows sent to a Python worker at once; texts may be long


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to all workers, once for each application.

    Also lowers the rows of an Arrow batch, where the session has Spark's default: batches
    of 10,000 whole texts take much of an executor's memory.
    """
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size) == "10000":
        spark.conf.set(size, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        home = Path(__file__).resolve().parents[1]
        fd, path = tempfile.mkstemp(prefix="shelfwise-", suffix=".zip")
        with os.fdopen(fd, "wb") as raw, zipfile.ZipFile(raw, "w") as z:
            for p in sorted(home.rglob("*.py")):
                z.write(p, p.relative_to(home.parent))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark
