"""Working storage that driver and executors share: tables that end a lineage, and folders whose newest version is what counts."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of the batches that go between the JVM and Python: several are held at once in each task.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to at most BATCH_BYTES; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(name, None) or "").lower().rstrip("b")
    size = int(now[:-1]) << {"k": 10, "m": 20, "g": 30}[now[-1]] if now[-1:].isalpha() else int(now or 0)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one where that is unset and the master is local, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors of a cluster need a folder that they share")
        top = f"file://{tempfile.gettempdir()}/textquarry-work"
    out = f"{top.rstrip('/')}/textquarry/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, out)
    return out


def _path(spark: SparkSession, path: str):
    """Hadoop's path and the store it is in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session is gone: its owner clears spark.checkpoint.dir
        pass


def saved(df: DataFrame) -> DataFrame:
    """df as a written table: lineage ends here, and a lost executor costs no more than a reread. `release` deletes it before the session ends."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._textquarry_folder = path
    return out


def release(df: DataFrame) -> None:
    """Deletes a table made by `saved` that no later plan reads."""
    remove(df.sparkSession, df._textquarry_folder)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The versions under a path that were written whole."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    whole = lambda s: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.isDirectory() and whole(s))


def read_state(spark: SparkSession, path: str) -> dict | None:
    """The newest state under a path, None if there is none."""
    numbers = _numbers(spark, path)
    return json.loads(spark.read.text(f"{path}/{numbers[-1]}").first()["value"]) if numbers else None


def write_state(spark: SparkSession, path: str, state: dict) -> None:
    """A further version of the state. One writer at a time: a second that writes the same number fails."""
    number = (_numbers(spark, path) or [0])[-1] + 1
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/{number}")
