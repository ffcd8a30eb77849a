"""Session set-up: UTC, adaptive execution, and shipping of this package to the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: dict[str, tempfile.TemporaryDirectory] = {}
#: Rows of an Arrow batch where the session leaves Spark's default: rows may hold texts of many kilobytes.
ARROW, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20)


def ship(spark: SparkSession) -> SparkSession:
    """Prepares a session: sends this package to its Python workers, once an application (as --py-files would), and
    sees to it that Arrow batches of long texts stay small."""
    if spark.conf.get(ARROW) == "10000":
        spark.conf.set(ARROW, ARROW_ROWS)
        spark.conf.set(*ARROW_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped[app] = folder = tempfile.TemporaryDirectory(prefix="tidemark-code-")
        here, archive = Path(__file__).resolve().parent, Path(folder.name) / "tidemark_code.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(here.rglob("*.py")):
                z.write(source, source.relative_to(here.parent))
        spark.sparkContext.addPyFile(str(archive))
    return spark


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidemark")
    settings = {
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()
