"""Session helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named a local session takes a temporary one; on a cluster, whose machines
    wouldn't see it, that is an error."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="cadenza-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    give_back_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of what is read: the files' bytes. Of a join it would be the product of the sides, hence only the leaves count; a leaf
    without an estimate makes the whole one unknown."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


def parts_for(df: DataFrame, each: int, least: int = 1, most: int = 1_000_000) -> int:
    """How many parts of about ``each`` bytes the input has. Parts grow with the data while their size stays, until there are ``most``,
    where their number would weigh more. Where Catalyst can't estimate the input, the session's number of shuffle partitions."""
    size = input_bytes(df)
    n = -(-size // each) if size < 1 << 60 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(least, n))


def dealt(docs: DataFrame, each: int = 32 << 20) -> DataFrame:
    """A table in fewer files than there are cores, and of at most ``each`` bytes a core, dealt over the cores: one file may be one row group, which one
    task would read and work on alone. Larger tables are left as they lie; rows are the same either way."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if input_bytes(docs) > each * cores or len(docs.inputFiles()) >= cores:
        return docs
    return docs.repartition(cores)


def in_few_files(rows: DataFrame, least: int = 1) -> DataFrame:
    """Short rows dealt to a part a core, or to ``least`` if that is more. On local disks Hadoop starts a process for every file that is made, and one more for
    its checksum; a join's parts would make hundreds."""
    return rows.repartition(max(least, rows.sparkSession.sparkContext.defaultParallelism))


def shuffle_parts(df: DataFrame, each: int) -> int:
    """Parts of about ``each`` bytes, and at least the session's number of shuffle partitions."""
    return parts_for(df, each, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def own_names(df: DataFrame) -> Callable[[str], str]:
    """Names for working columns, led by so many underscores that none of the caller's columns has one."""
    taken = {c.lower() for c in df.columns}
    lead = "_"
    while any(c.startswith(lead) for c in taken):
        lead += "_"
    return lambda name: lead + name


def spread(key: Column, *keys: Column) -> Column:
    """A second join key that makes Spark deal both sides anew, so that AQE can split a hot partition of either."""
    return F.xxhash64(key, *keys)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One batch in, one batch out (or none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns a worker's free memory to the system: workers are reused, and what one stage held would count in the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def give_back_driver(spark: SparkSession) -> str | None:
    """Returns the driver's free memory to the system, that of its Python and that which the C library holds for the JVM: its compilers take and free much
    for the code of every new plan, and a long chain of plans would pile it up beside a heap that is bounded. What the JVM says of it, or None if it has no such command."""
    give_back()
    try:
        gateway = spark.sparkContext._gateway
        jvm = gateway.jvm
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        # the server's own class is not open to callers, its interface is
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        values = gateway.new_array(jvm.java.lang.Object, 4)
        values[0], values[1] = name, "systemTrimNativeHeap"
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:  # an older Java, or another system
        return None


def bounded(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices batches to about ``most`` bytes each, and gives unused memory back after each batch."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * most / max(most, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        give_back()
