"""Session helpers: time zone, adaptive execution and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every entry point relies on.  Event times are epoch milliseconds, so all
# date/hour arithmetic is defined in UTC; AQE re-plans joins and coalesces shuffle
# partitions at run time and splits skewed join partitions.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a union that claims the partitioning of its parts fails where adaptive execution has merged the
    # partitions of one of them ("Can't zip RDDs with unequal numbers of partitions")
    "spark.sql.unionOutputPartitioning": "false",
    # keyed streaming state (the ordering buffer) lives in RocksDB, incrementally
    # checkpointed; it also allows several state variables per key
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the library depends on (idempotent)."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Only when the session has none (local tests) is a scratch folder under /tmp
    created and registered.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    local = tempfile.mkdtemp(prefix="tracehound-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tracehound") -> SparkSession:
    """A local session for tests and the benchmark (UI off, UTC, AQE on)."""
    # Python workers started by the JVM (streaming state processors) import this
    # package; on a cluster the same is achieved with --py-files.
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *paths])
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TRACEHOUND_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (needed only by the few
    Python-side operators, e.g. the streaming ordering buffer).

    The package is zipped once per session and distributed with ``addPyFile``, the
    standard way to ship code to executors.
    """
    import shutil
    from pathlib import Path

    app_id = spark.sparkContext.applicationId
    if app_id in _SHIPPED:
        return
    pkg_dir = Path(__file__).resolve().parent
    out_dir = tempfile.mkdtemp(prefix="tracehound-pyfiles-", dir="/tmp")
    archive = shutil.make_archive(
        os.path.join(out_dir, "tracehound"), "zip", root_dir=pkg_dir.parent, base_dir=pkg_dir.name
    )
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app_id)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, on any file system Spark reads."""
    fs, p = _hadoop(spark, path)
    return bool(fs.exists(p))


def list_children(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Paths of a folder's children whose names start with ``prefix``."""
    fs, p = _hadoop(spark, path)
    return [s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith(prefix)] if fs.exists(p) else []


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder the library itself wrote (no error if there is none)."""
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def modified_ms(spark: SparkSession, path: str) -> int:
    """Modification time of a file or folder."""
    fs, p = _hadoop(spark, path)
    return int(fs.getFileStatus(p).getModificationTime())


def read_text(spark: SparkSession, path: str) -> str:
    """A small UTF-8 file."""
    fs, p = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file in one step: under a hidden name, then renamed.  False if the path is taken."""
    import uuid

    folder, _, name = path.rpartition("/")
    fs, hidden = _hadoop(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = fs.create(hidden, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    rename = getattr(hadoop, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.NONE
    files = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(hidden, hadoop.Path(path), options)
    except Exception:
        fs.delete(hidden, False)
        if not path_exists(spark, path):
            raise
        return False
    return True


def scratch_table_path(spark: SparkSession, label: str) -> str:
    """A fresh folder for an intermediate table under the shared checkpoint folder."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tracehound-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Cut lineage by writing ``df`` once as Parquet to the shared checkpoint folder and
    reading it back (one job; columnar and compressed; survives executor loss)."""
    path = scratch_table_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
