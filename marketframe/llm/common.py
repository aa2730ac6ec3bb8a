"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of letters and digits, every ASCII sign but these parts words. Java looks single signs up
#: in a table, but tries ranges one after another: the classes name them one by one.
ALNUM_WORD = rf"[0123456789{LOWER}\x{{80}}-\x{{10FFFF}}]+"
ALNUM_GAP = "[" + "".join(rf"\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for `name` under spark.checkpoint.dir, which all executors share.

    Where that setting is missing, a temporary folder takes its place in local mode, which has one
    machine; on a cluster it is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root and context.master.startswith("local[") or context.master == "local":
        root = root or _LOCAL.setdefault("root", tempfile.mkdtemp(prefix="marketframe-"))
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_SETTLED: list[str] = []


def settled() -> int:
    """How many folders settle() has written so far."""
    return len(_SETTLED)


def discard(spark: SparkSession, first: int) -> None:
    """Deletes the folders, but for the newest, that settle() has written since settled() was `first`: for
    callers whose newest folder holds all they want of the others."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    for p in _SETTLED[first:-1]:
        path(p).getFileSystem(conf).delete(path(p), True)
    del _SETTLED[first:-1]


#: Share of the driver's heap in use by the system from which garbage is collected between jobs.
HEAP_SHARE = 0.6


def free_driver(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage, and give the room back, if its heap has grown: plans, task
    results and broadcasts of many small jobs otherwise fill it up to its limit."""
    memory = spark._jvm.java.lang.Runtime.getRuntime()
    if memory.totalMemory() > HEAP_SHARE * memory.maxMemory():
        gc.collect()  # objects that only Python still refers to
        spark._jvm.java.lang.System.gc()


def settle(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again.

    Later jobs start from those files, also after executors are lost.
    """
    path = shared_dir(df.sparkSession, name)
    free_worker()  # the driver's Python, too, shares its memory with a JVM
    free_driver(df.sparkSession)
    df.write.parquet(path)
    _SETTLED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def alnum_words(text: Column) -> Column:
    """Array of the lower-cased words of letters and digits; empty for a null text."""
    return F.regexp_extract_all(F.coalesce(lower_ascii(text), F.lit("")), F.lit(ALNUM_WORD), F.lit(0))


def alnum_pieces(text: Column) -> Column:
    """alnum_words() with an empty string before or behind them where the text begins or ends with a gap, or is
    empty: parting at gaps costs less than finding words."""
    return F.split(F.coalesce(lower_ascii(text), F.lit("")), ALNUM_GAP)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of whole texts that go to a Python worker at a time; documents may have megabytes.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(df: DataFrame) -> None:
    """Bounds the Arrow batches of this session where it leaves Spark's defaults (10,000 rows, 64 MB).

    Spark reads these settings when a plan is run, so they can't be tied to one DataFrame; a session
    that sets its own bounds keeps them."""
    conf = df.sparkSession.conf
    for key, default, bound in (("maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("maxBytesPerBatch", "67108864b", f"{BATCH_BYTES}b")):
        if conf.get(f"spark.sql.execution.arrow.{key}") == default:
            conf.set(f"spark.sql.execution.arrow.{key}", bound)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow in bounded batches, so that memory is that of few texts."""
    bounded_batches(df)
    return df.mapInArrow(run, schema)


_CACHES: list[dict] = []


def worker_cache() -> dict:
    """A dictionary that lives as long as its Python worker, or until another operator needs the room."""
    _CACHES.append({})
    return _CACHES[-1]


def free_worker(keep: dict | None = None) -> None:
    """Drops what earlier operators left in this Python process, but for `keep`, and returns free memory
    to the system: workers are reused, and those of one executor share its memory with the JVM."""
    for cache in _CACHES:
        if cache is not keep:
            cache.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
