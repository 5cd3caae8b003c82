"""Shared folder tables, distributed prefix sums and small helpers."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Words as every contract of this subpackage reads them.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows that cross to Python and back at a time in a stage.
BATCH_ROWS = 1000

_made: list[str] | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``; only where that is unset and the master is
    local (tests on one machine) a temporary folder takes its place.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        at = sc._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
    if not at:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="outletlens-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str, tracked: bool = True) -> str:
    """A new path in the shared folder, deleted when the application ends; in a stage, when the next one begins."""
    path = f"{shared_dir(spark)}/outletlens-{name}-{uuid.uuid4().hex}"
    jvm, hconf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(hconf).deleteOnExit(target)
    if tracked and _made is not None:
        _made.append(path)
    return path


_last: list[str] = []


@contextlib.contextmanager
def stage(spark: SparkSession):
    """A stage of a pipeline, whose input is written: the tables of the stage before it go, its own stay until the next begins.

    From here on, batches between the JVM and Python hold ``BATCH_ROWS`` rows: a
    stage is run after it returns, and one batch of long texts must not fill a worker.
    """
    global _made
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    jvm, hconf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _last:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(hconf).delete(target, True)
    _last.clear()
    outer, _made = _made, []
    try:
        yield
    finally:
        _last.extend(_made)
        _made = outer


def save(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """The number of partitions that shuffles use."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt_sum(df: DataFrame, group: list[str], order: list[Column], value: Column, out: str, bucket: Column) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group``, computed in ordered buckets.

    ``bucket`` must not decrease along ``order``. A group, however large, is
    spread over its buckets; only one row for each (group, bucket) meets in
    the window that turns bucket totals into bucket offsets.
    """
    keys = [*group, "_bucket"]
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    totals = rows.groupBy(*keys).agg(F.sum("_value").alias("_total"))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    same = [rows[k].eqNullSafe(offsets[k]) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    joined = rows.join(offsets, on)
    return joined.select(*[rows[c] for c in df.columns], (F.col("_inside") + F.col("_offset")).alias(out))


def give_back() -> None:
    """Hand what this worker has freed back to the system; allocators keep it for themselves otherwise."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run, tokenizes: bool = False):
    """``run`` for a worker that others use before and after it.

    Workers live on from stage to stage and sit idle beside the JVM's own
    stages: unless this one ``tokenizes``, the encoders that an earlier one left
    go first, and freed memory goes back to the system at the end of each task.
    """

    def leaner(batches):
        from outletlens.llm import pieces

        if not tokenizes:
            pieces.forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return leaner


def own_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` made longer until they clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"{name}_"
        taken.add(name)
        out.append(name)
    return out


def runs(batches, key: str, columns: tuple[str, ...]):
    """Lists of Python rows of ``columns`` whose ``key`` is the same, from Arrow batches sorted by it."""
    now, held = None, []
    for batch in batches:
        for k, *row in zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
            if held and k != now:
                yield held
                held = []
            now = k
            held.append(row)
    if held:
        yield held


def unique_columns(df: DataFrame, *needed: str) -> DataFrame:
    """``df`` cut down to the columns an operator reads, whatever else it holds."""
    return df.select(*[F.col(f"`{c}`") for c in needed])


def arrow_schema(ddl: str):
    """The Arrow schema of "name type, name type" with plain types."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])
