"""Session helpers: tables, the shared folder, materialised intermediates."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One delivered table; parquet, so filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, taken from spark.checkpoint.dir.

    Only in local mode, where one machine holds all executors, an unset value is replaced by a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="orelith-")
        atexit.register(shutil.rmtree, _LOCAL, True)
    return _LOCAL


_LOCAL: str | None = None


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder among the application's own, which are deleted when the driver ends."""
    own = f"{shared_dir(spark)}/orelith-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_forget, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended before; then the folder is left to whoever keeps the share
        pass


_OWN: set[str] = set()


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def widen(df: DataFrame) -> DataFrame:
    """Spreads an input that arrived in fewer splits than there are cores; a larger one is left as it lies. For frames that come straight from a scan: counting the partitions of a shuffled one would run its shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash partitions by cols, as many as the session shuffles into or has cores: a later grouping by cols moves nothing, and work on its rows keeps all cores busy."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *cols)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, where they cannot import it from their own path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="orelith-code-")) / "orelith.zip"
    atexit.register(shutil.rmtree, path.parent, True)
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


_SHIPPED: set[str] = set()
