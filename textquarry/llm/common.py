"""Tables, shared working storage and word definitions of the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sorts null ids after all others: they count as one document, the last.
LAST_ID = (1 << 63) - 1


#: Bytes of the batches that go between the JVM and Python: several are held at once in each task.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to at most BATCH_BYTES; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(name, None) or "").lower().rstrip("b")
    size = int(now[:-1]) << {"k": 10, "m": 20, "g": 30}[now[-1]] if now[-1:].isalpha() else int(now or 0)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a temporary one where that is unset, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        top = f"file://{tempfile.gettempdir()}/textquarry-work"
    return f"{top.rstrip('/')}/textquarry/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder in whatever store it is."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    try:
        remove(spark, folder)
    except Exception:  # the session is gone: its owner clears spark.checkpoint.dir
        pass


def saved(df: DataFrame) -> DataFrame:
    """df as a written table in the shared folder: lineage ends here, and a lost executor costs no more than a reread.

    The table lives until the application ends; `release` deletes it sooner.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    folder = shared_folder(spark)
    df.write.parquet(folder)
    atexit.register(_remove_at_exit, spark, folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._textquarry_folder = folder
    return out


def release(df: DataFrame) -> None:
    """Deletes a table made by `saved` that no later plan reads."""
    remove(df.sparkSession, df._textquarry_folder)


def ordered_id(name: str = "doc_id"):
    """The id column as long, null last."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def packed(docs: DataFrame, apart: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """docs as the columns of `apart` and one struct `rest` of all others, whose names can't clash with any that are added."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in apart]
    return docs.select(*apart, (F.struct(*others) if others else F.lit(None).cast("int")).alias("rest"))


def unpacked(df: DataFrame, columns: list[str], apart: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The columns that were packed, in their order."""
    return df.select(*[F.col(c) if c in apart else F.col("rest").getField(c).alias(c) for c in columns])
