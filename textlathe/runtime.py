"""Session, table and lineage helpers shared by all operators."""

from __future__ import annotations

import io
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; `sf_dir` may be any path or URI that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder shared by all executors that `spark.checkpoint.dir` names.

    Only a session on one machine (tests, local runs) may be without one and gets a
    temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="textlathe-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Make sure that Python workers can import this package, once a context.

    Where they can't (the folder isn't on their path), a zip of it is put into the shared
    folder and handed to them.
    """
    sc = spark.sparkContext
    if getattr(sc, "_textlathe_shipped", False):
        return

    def importable(_):
        import importlib.util

        yield importlib.util.find_spec("textlathe") is not None

    tasks = max(2, sc.defaultParallelism)
    if not all(sc.parallelize(range(tasks), tasks).mapPartitions(importable).collect()):
        home, buffer = Path(__file__).resolve().parent, io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent).as_posix())
        target = sc._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/textlathe.zip")
        out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
        out.write(bytearray(buffer.getvalue()))
        out.close()
        sc.addPyFile(target.toString())
    sc._textlathe_shipped = True


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Give a CPU-heavy stage enough tasks when its input has fewer than the cores.

    A scan that already has `per_core` tasks for each core is left alone, so inputs of
    more files than cores are never shuffled for it: only a small file that can't be cut
    (Parquet of one row group) would else leave cores idle. Only for plans without a shuffle: counting another
    plan's partitions would run it.
    """
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("textlathe")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
