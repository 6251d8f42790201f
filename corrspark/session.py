"""Session helpers."""

from __future__ import annotations

import pathlib
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corrspark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are tested under."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers of the application, once.

    Needed where it is not installed on the executors: a driver that found it on
    its own path does not pass that path on.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = pathlib.Path(__file__).parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="corrspark-")) / "corrspark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a part of a scan that comes in fewer splits than cores.

    Only small or unsplittable files are moved, by a hash of the key; a table in
    many splits, as any large one is, is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by a hash of their keys, in as many parts as the session shuffles into.

    The parts of a shuffle that a join or an aggregate asks for are merged by their
    packed bytes, and sorted numbers pack so well that one task would get tens of
    millions of rows. These parts are left as they are.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names a folder every executor can reach. Without it a
    session in local mode (tests) takes a temporary folder, since all its tasks
    run on this machine; on a cluster the missing setting is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = shared or tempfile.mkdtemp(prefix="corrspark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to shared storage and read back: cuts lineage, survives executor loss."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
