"""Session helpers: a local session for tests and benches, and the package for executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: str = "8", memory: str = "8g", **conf: str) -> SparkSession:
    """A single-JVM session in UTC with adaptive execution."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("folio")
    settings = {
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows of an Arrow batch, where the session has not said: a row can be a whole document.
BATCH_ROWS, _DEFAULT_ROWS = "1000", "10000"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Tasks that list folders, where the session has not said: Spark's default is one for each folder, up to 10000.
_LISTERS, _DEFAULT_LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "10000"


def ship_package(spark: SparkSession) -> SparkSession:
    """Gives this package to the executors' Python (as --py-files would), once per application, and
    bounds Arrow batches and the tasks that list folders."""
    if spark.conf.get(_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(_ROWS, BATCH_ROWS)
    if spark.conf.get(_LISTERS) == _DEFAULT_LISTERS:
        spark.conf.set(_LISTERS, str(4 * spark.sparkContext.defaultParallelism))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="folio-"), "folio.zip")
        with zipfile.ZipFile(target, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        spark.sparkContext.addPyFile(target)
        _SHIPPED.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own if unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else ""
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not root:  # tests and local runs
        root = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Written once as a table in the shared folder and read again, for what is used more than once."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deals a table out to all cores if it lies in fewer partitions: for small files and much work a row. A table of
    more partitions is left as it is, so that nothing large is ever shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().executedPlan().execute().getNumPartitions() < cores else df
