"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: The JVM leaves longer methods to its interpreter, so Spark should not generate them.
COMPILED_BYTES = "8000"


def build_session(
    app_name: str = "oddsloom",
    *,
    master: str | None = None,
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
) -> SparkSession:
    """A session with the settings every operator here assumes.

    On a cluster leave ``master``, ``shuffle_partitions`` and ``driver_memory``
    to the submit command; they are arguments for local runs only.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.hugeMethodLimit", COMPILED_BYTES)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Recording the call site of every column costs more than planning.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def use_utc(spark: SparkSession) -> SparkSession:
    """All clocks in this package are UTC; make naive casts agree with that. Wide rows get code that the JVM compiles."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master without the setting falls back to a folder of its own;
    on a cluster a missing setting is an error, because a machine-local folder
    would be lost with the machine.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    known = context.getCheckpointDir()
    if known:
        return known
    folder = os.path.join(tempfile.gettempdir(), f"oddsloom-{uuid.uuid4().hex}")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used between rounds of an iteration and for intermediates read several
    times: the plan restarts from files, so losing an executor costs a re-read
    and not a recomputation of the whole lineage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Steps that run Python on executors import the package there; a worker whose
    path does not hold it gets the archive from the driver.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root, name = os.path.split(package)
    target = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, files in os.walk(package):
            for file in sorted(files):
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    archive.write(path, os.path.relpath(path, root))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
