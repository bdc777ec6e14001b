"""Session helpers: local sessions for tests and the shared folder of a cluster."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: str | None = None
_SHIPPED: set[str] = set()
_SCRATCH: list[str] = []


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lodestrata")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else a checkpoint folder the application has set.

    Where neither is there, a local master gets a temporary folder of this
    process; on a cluster that is an error, as executors could not read it.
    """
    global _LOCAL_DIR
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    known = sc._jsc.sc().getCheckpointDir()
    if not named and known.isDefined():
        return known.get().rstrip("/")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _LOCAL_DIR is None:
            _LOCAL_DIR = tempfile.mkdtemp(prefix="lodestrata-")
            atexit.register(shutil.rmtree, _LOCAL_DIR, ignore_errors=True)
        named = _LOCAL_DIR
    if not known.isDefined():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder; it goes with the enclosing ``scratch_scope``, by ``clean_scratch`` or when the process ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(clean_scratch, spark)
    _SCRATCH.append(path)
    return path


def clean_scratch(spark: SparkSession, keep: int = 0) -> int:
    """Delete the paths this process made with ``scratch`` after the first ``keep``, once no frame reads them any more."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return 0
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while len(_SCRATCH) > keep:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What is written to the shared folder inside is deleted at its end, so results must be read or written before."""
    before = len(_SCRATCH)
    try:
        yield
    finally:
        clean_scratch(spark, before)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file of any file system Spark knows."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python workers, once per application.

    Workers need not have it installed; the archive lies in the shared folder.
    """
    sc = spark.sparkContext
    root = Path(__file__).parent
    if sc.applicationId in _SHIPPED or not root.is_dir():
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    path = f"{shared_dir(spark)}/{root.name}-{uuid.uuid4().hex}.zip"
    write_bytes(spark, path, packed.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` of a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
