"""Session settings and the shared scratch folder."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Runtime settings the library relies on. All of them may be changed per session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Recording the Python call site of every expression costs several JVM calls each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: str | int = "*", app: str = "pvseries", memory: str = "12g",
                  shuffle_partitions: int = 8) -> SparkSession:
    """Build a local session for tests and the benchmark."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.driver.memory", memory)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or else a part of the warehouse folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    return (base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch").rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/pvseries/{spark.sparkContext.applicationId}"


_SCOPE: ContextVar[str] = ContextVar("scratch_scope", default="")


def scope_dir(spark: SparkSession, scope: str) -> str:
    """The folder of the scratch tables made inside ``with scratch_scope(scope)``."""
    return f"{run_dir(spark)}/scope-{scope}"


@contextmanager
def scratch_scope(scope: str) -> Iterator[None]:
    """Scratch tables made inside go to a folder of their own, which can be deleted as a whole."""
    before = _SCOPE.set(scope)
    try:
        yield
    finally:
        _SCOPE.reset(before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's folder, or in that of the scope."""
    scope = _SCOPE.get()
    return f"{scope_dir(spark, scope) if scope else run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, path)
    return files.exists(place)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small text file by the rename of a finished one: no reader sees a part of it. Needs one writer at a time."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    files, place = _files(spark, path)
    draft = hadoop.Path(f"{path}.{uuid.uuid4().hex}")
    out = files.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(draft), files.makeQualified(place), options)


def fingerprint(spark: SparkSession, path: str) -> str:
    """A checksum of the names, sizes and times of a table's files: it changes when the table does."""
    files, place = _files(spark, path)
    found, each = [], files.listFiles(place, True)
    while each.hasNext():
        status = each.next()
        found.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def delete(spark: SparkSession, path: str) -> None:
    """Delete one scratch table that nothing reads any more."""
    files, place = _files(spark, path)
    files.delete(place, True)


def release(spark: SparkSession) -> None:
    """Delete this application's folder, when none of its tables is read any more."""
    files, place = _files(spark, run_dir(spark))
    files.delete(place, True)


def use_checkpoints(spark: SparkSession) -> None:
    """Point reliable checkpoints at the shared folder, unless already set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
