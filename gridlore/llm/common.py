"""What the operators share: materialised steps, process-wide caches and text rules."""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import shutil
import sys
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in one local process (tests) any will do."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    store = process_cache("shared_dir")
    if "dir" not in store:
        store["dir"] = tempfile.mkdtemp(prefix="gridlore-")
        atexit.register(shutil.rmtree, store["dir"], ignore_errors=True)
    return f"file://{store['dir']}"


#: Bytes of a batch that goes to or from Python while a step is written.
BATCH_BYTES = 8 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds the batches of what runs meanwhile: their buffers lie outside the heap, several to a task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: For rows of megabytes: a writer looks at the size of its page after every row, not after a hundred, and a row group has
#: two rows, as a reader decodes up to 4,096 rows of a group into one array.
LARGE_ROWS = {"parquet.block.row.count.limit": "2", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def materialise(df: DataFrame, name: str = "step", options: dict[str, str] | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut, and the rows outlive any executor."""
    return materialised_all([df], name, options)


def materialised_all(parts: Iterable[DataFrame], name: str = "step", options: dict[str, str] | None = None) -> DataFrame:
    """The rows of all parts, of one schema, each written when it comes: what it needs can go before the next one."""
    path, last = None, None
    for last in parts:
        spark = last.sparkSession
        path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        with small_batches(spark):
            last.write.mode("append").option("compression", "zstd").options(**options or {}).parquet(path)
        shrink_driver(spark)
    process_cache("steps").setdefault(threading.get_ident(), []).append(path)
    return last.sparkSession.read.schema(last.schema).parquet(path)


def give_back() -> None:
    """Returns to the system what this process has freed."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps what it likes
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shrink_heap(spark: SparkSession) -> None:
    """Collects the driver's garbage where its heap has grown beyond half of what it may: the heap gives memory back, and
    what plans and broadcasts held is cleaned up.  It would grow to its limit before it collects by itself."""
    heap = spark._jvm.Runtime.getRuntime()
    if heap.totalMemory() > heap.maxMemory() // 2:
        spark._jvm.System.gc()


def trim_native(spark: SparkSession) -> str:
    """Has the driver's JVM return to the system what its C library has freed: compilers, threads and network buffers leave
    it in many arenas, a sixth of the process after one small pipeline.  Empty where the JVM or the library cannot."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway

    def array(kind, *items):
        out = gateway.new_array(kind, len(items))
        for k, x in enumerate(items):
            out[k] = x
        return out

    with contextlib.suppress(Exception):  # the server's class is not public: its method is called by way of the interface
        lang = jvm.java.lang
        server = lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke = next(m for m in lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given, kinds = array(lang.Object, array(lang.String)), array(lang.String, "[Ljava.lang.String;")
        return str(invoke.invoke(server, array(lang.Object, name, "systemTrimNativeHeap", given, kinds)))
    return ""


def shrink_driver(spark: SparkSession) -> None:
    """Gives back what the driver's JVM does not need: of its heap where that has grown, and of its C library's."""
    shrink_heap(spark)
    trim_native(spark)


def clears_steps(operator: Callable) -> Callable:
    """``operator``, after which the steps written meanwhile are deleted but for those that its result still reads."""

    @functools.wraps(operator)
    def outer(*args, **named):
        steps = process_cache("steps").setdefault(threading.get_ident(), [])
        before = len(steps)
        out = operator(*args, **named)
        spark = SparkSession.getActiveSession()
        if spark is None:
            return out
        read = {f.rsplit("/", 2)[-2] for f in out.inputFiles()} if isinstance(out, DataFrame) else set()
        for path in [p for p in steps[before:] if p.rsplit("/", 1)[-1] not in read]:
            steps.remove(path)
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
        give_back()
        shrink_driver(spark)
        return out

    return outer


def tidy(run: Callable) -> Callable:
    """``run`` over a partition's batches; what it freed goes back to the system then, as the process lives on."""

    def outer(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return outer


def revived(kind: type, state: dict):
    """An object of ``kind`` from its broadcast state: broadcasts carry data only, code comes with the function."""
    out = kind.__new__(kind)
    out.__dict__.update(state)
    return out


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python process, whatever was pickled by value."""
    return sys.modules.setdefault("_gridlore_process_cache", type(sys)("_gridlore_process_cache")).__dict__.setdefault(name, {})


def ascii_lower(text: Column) -> Column:
    """A-Z only, whatever the locale or script."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def partitions_for(docs: DataFrame, text_col: str, bytes_each: int) -> int:
    """Partitions of about ``bytes_each`` bytes of text, from a count over the whole table."""
    total = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-int(total) // bytes_each))
