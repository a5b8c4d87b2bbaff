"""Spark session defaults and lineage helpers.

The library never creates a cluster configuration of its own: on a real
cluster the session comes from ``spark-submit`` and only missing settings
are filled in here. Tests and ``bench.py`` call :func:`local_session`.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in this package relies on; applied only when unset.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batch size bounds the rows a Python scorer sees at once.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "taintrank") -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on)."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g")
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Fill in DEFAULT_CONF keys the cluster did not set."""
    for k, v in DEFAULT_CONF.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a local one only when unset.

    A fallback under the system temp folder is acceptable only for local
    sessions (tests); a cluster must name a shared folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = fallback or tempfile.mkdtemp(prefix="taintrank-ckpt-")
    os.makedirs(path, exist_ok=True)
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as a parquet table under the shared checkpoint folder
    and return a frame reading it back.

    One job computes the input (an RDD checkpoint would compute it twice
    unless cached), the result survives executor loss, and the re-read scan
    carries file statistics, so later joins are planned on real sizes.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = os.path.join(root, "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    _TABLES.append(path)
    return spark.read.parquet(path)


_TABLES: list[str] = []


def release_tables(spark: SparkSession) -> int:
    """Delete the tables that :func:`cut_lineage` and :class:`Scratch` wrote in this process; returns how many.

    A frame that an operator returns still reads its tables, so only the caller knows when they may go: call
    this after the last action on such frames (``bench.py`` does after each query).
    """
    n = len(_TABLES)
    while _TABLES:
        delete_path(spark, _TABLES.pop())
    return n


class Scratch:
    """Intermediate tables of one operator call, under the shared checkpoint folder.

    ``table`` writes a frame once and reads it back; ``drop`` deletes tables that
    nothing reads any more (through Hadoop's file system, so any store works).
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = os.path.join(ensure_checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")
        self._count = 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self._count += 1
        path = os.path.join(self.root, f"{self._count:03d}-{name}")
        df.write.mode("overwrite").parquet(path)
        # the schema is known: reading needs no footer job
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        _TABLES.append(path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete the tables behind ``frames``; only once every reader has finished."""
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                delete_path(self.spark, path)
                _TABLES.remove(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lives on."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``taintrank`` importable in local Python workers (as ``--py-files`` would).

    Local sessions only: zips the package once per SparkContext and registers
    it with ``addPyFile``. Needed by the ``mapInPandas`` scorers when the
    session was started without the package on the workers' path.
    """
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    if not sc.master.startswith("local"):
        # On a cluster the package travels with the job (``--py-files`` or an
        # installed wheel); no driver-local folder is used.
        _SHIPPED.add(key)
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="taintrank-pkg-"), "taintrank.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def prepare(spark: SparkSession) -> SparkSession:
    """Defaults, shared checkpoint folder and the package on the executors."""
    apply_defaults(spark)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark
