"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(app: str = "vacantlens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC time and adaptive execution; everything else is the cluster's choice."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers, once per application, so that functions run there
    wherever the driver was started. Returns the session."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="run-")) / f"{package.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, str(file.relative_to(package.parent)))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    Only a local-mode session may do without the setting (tests, laptops): one
    temporary root per application. On a cluster a machine-local folder would be
    lost with its executor, so the setting is required there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_roots.get(context.applicationId)
        if not root:
            root = _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="run-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to a fresh scratch table and read again: cuts lineage in a way that
    outlives lost executors, and runs ``df`` once however often the result is used."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Input of costly work over at least one partition per core. The rows are dealt out
    anew; costs one shuffle of them, so narrow the columns first."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
