"""Spark session and table helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HERE = Path(__file__).resolve().parent


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loppis")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Rows dealt anew by their key, so that all cores share costly work on each of them: a file of some million short rows
    is few bytes, and is otherwise read, and worked on, by one task."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *key)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, under spark.checkpoint.dir; the session's end removes it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="loppis-shared-")
    folder = f"{named}/loppis-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, unless PYTHONPATH gives it to them already."""
    if str(HERE.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_loppis_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="loppis-")) / "loppis.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(HERE.rglob("*.py")):
            z.write(f, f.relative_to(HERE.parent))
    sc.addPyFile(str(archive))
    sc._loppis_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package sent ahead."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
