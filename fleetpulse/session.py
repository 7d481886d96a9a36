"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", app: str = "fleetpulse", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="fleetpulse-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/fleetpulse/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "zstd", dictionary: bool = True, block_rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back; without a dictionary where few values repeat.

    Readers decode up to 4,096 rows of a row group at once, so wide rows need `block_rows`, the most that a row group holds.

    Used where several later steps read the same result. It cuts the lineage, so a lost
    executor costs a re-read and not a re-computation, and the columnar copy keeps column
    pruning and filter pushdown for its readers.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", compression)
    if block_rows is not None:
        writer = writer.option("parquet.block.row.count.limit", str(block_rows))
    (writer if dictionary else writer.option("parquet.enable.dictionary", "false")).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Not needed where the package is installed on the cluster or passed with --py-files.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    source = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="fleetpulse-code-")) / "fleetpulse.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(source.rglob("*.py")):
            out.write(file, file.relative_to(source.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
