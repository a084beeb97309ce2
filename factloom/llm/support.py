"""What the text operators share: tables, word splitting, shared folders and worker set-up."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes for a word of letters, digits and anything outside ASCII: A-Z are lowered, all other ASCII separates.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
#: White space between words, as a Java character class body.
SPACE_CLASS = r"\x20\x09-\x0D"


def alnum_words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of UTF-8 bytes with A-Z lowered."""
    return text.translate(_WORD_BYTES).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes with A-Z lowered (bytes.lower and bytes.split know ASCII only)."""
    return text.lower().split()


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches, after which the worker, which stays for later tasks, gives back what it has freed."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that go to Python at once, at most: whole texts of ten thousand documents would take a worker's and its executor's
#: memory twice over.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver imported it from a plain folder, and send them few texts at
    once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if here not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, path) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where none is set, one of our own if there are no executors but
    the driver, as in tests, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            import tempfile

            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="factloom-shared-")
            spark.sparkContext.setCheckpointDir(base)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/factloom/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, as a table in the shared folder: smaller than a checkpoint where values repeat."""
    folder = fresh_dir(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Ask the driver to drop what nothing refers to any more, so that executors can delete the shuffle files of finished
    rounds; Spark does so only after the driver's garbage is collected, which it may not need for a long time. The last
    query's plan is held until another one runs. Then the driver gives back what its hundreds of threads have freed outside
    the heap, which glibc keeps for each of them."""
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trimmed(spark)


def trimmed(spark: SparkSession) -> bool:
    """Give the free native memory of the driver's JVM back to the system; whether the JVM can (on Linux, from 17.0.9 on)."""
    jvm = spark.sparkContext._jvm
    arguments = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)  # the last two stay null
    try:
        arguments[0], arguments[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # the server's own class is not public, so its method is taken from the interface
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), arguments)
    except Py4JError:
        return False
    return True


#: Bytes of arrays and texts in the rows of a side that is broadcast.
BROADCAST_BYTES = 8 << 20


def bounded(df: DataFrame, max_rows: int, bytes_of: Column | None = None) -> DataFrame:
    """A small side of a join: broadcast if it has at most max_rows rows, and at most BROADCAST_BYTES of bytes_of (what is not
    of a fixed size in a row), else joined by a shuffle. df must be kept()."""
    if df.limit(max_rows + 1).count() > max_rows or bytes_of is not None and (df.agg(F.sum(bytes_of)).first()[0] or 0) > BROADCAST_BYTES:
        return df
    return F.broadcast(df)


def file_system(uri: str):
    """(pyarrow file system, path) of a shared folder; any scheme that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def words_column(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text column, JVM side."""
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE_CLASS}]+"), F.lit(0))
