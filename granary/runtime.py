"""Session setup, size checks and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import pathlib
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table handed to every executor, in rows. Callers that need more
# rows than this work in blocks or shuffle.
BROADCAST_ROWS = 200_000
# Rows of a question table handled in one pass.
QUERY_BLOCK_ROWS = 2_048


def get_spark(app: str = "granary", cpus: int | str = "*", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package() -> None:
    """Make this package importable in the Python workers of the application.

    The driver hands a zip of it to Spark, which serves it to the executors.
    Done once per application, by every operator that runs Python in tasks.
    """
    sc = SparkSession.active().sparkContext
    root = pathlib.Path(__file__).resolve().parent
    if sc.applicationId in _shipped or not root.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="granary-package-")
    sc.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a fresh scratch folder; a
    cluster session without it is an error, because a machine-local folder
    would lose data together with its executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = os.environ.get("GRANARY_LOCAL_SHARED") or tempfile.mkdtemp(prefix="granary-")
    spark.conf.set("spark.checkpoint.dir", folder)
    sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/granary/{name}-{uuid.uuid4().hex}"


# Removes the shuffles of a query when it has ended; else they stay until the driver
# happens to collect the objects that name them.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def remove_table(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


# Level of tables that are written with zstd.
ZSTD_LEVEL = 6


class Scratch:
    """Tables that ``materialize`` has written for one piece of work."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def keep(self, *frames: DataFrame) -> None:
        """Remove the tables that none of the frames reads."""
        read = [name for frame in frames for name in frame.inputFiles()]
        for path in self.paths:
            # A scratch name occurs once, however its folder is spelt.
            if not any(f"/{path.rsplit('/', 1)[1]}/" in name for name in read):
                remove_table(frames[0].sparkSession, path)
        self.paths.clear()


_scratch: list[Scratch] = []


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Collects the tables written inside, so that what is read no more can go."""
    own = Scratch()
    _scratch.append(own)
    try:
        yield own
    finally:
        _scratch.remove(own)


def materialize(df: DataFrame, name: str, codec: str | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage like ``checkpoint()`` does, and the Parquet copy keeps
    column pruning and filter pushdown for the jobs that follow. What the job
    shuffled goes when it ends. Rows lie in folders by the last column if ``by`` names it.
    """
    return materialize_all([df], name, codec, by)


def materialize_all(frames: Iterable[DataFrame], name: str, codec: str | None = None, by: str | None = None) -> DataFrame:
    """One table of several of the same schema, each written before the next is asked for."""
    path = None
    for df in frames:
        spark = df.sparkSession
        if path is None:
            path, schema = scratch_path(spark, name), df.schema
            for own in _scratch:
                own.paths.append(path)
        before = spark.conf.get(SHUFFLE_CLEANUP)
        spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            writer = df.write.option("parquet.compression.codec.zstd.level", ZSTD_LEVEL)
            writer.parquet(path, mode="append", compression=codec, partitionBy=by)
        finally:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


# Input below this size per core cannot keep the cores busy in its file splits.
SMALL_INPUT_BYTES_PER_CORE = 16 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash partition a table too small to fill the cores; leave others as read.

    The decision uses the optimizer's size estimate, so nothing is run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    if int(str(stats.sizeInBytes())) < cores * SMALL_INPUT_BYTES_PER_CORE:
        return df.repartition(cores, key)
    return df


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows; reads at most one more."""
    return df.limit(rows + 1).count() <= rows


def key_blocks(
    df: DataFrame, key: str, rows: int = QUERY_BLOCK_ROWS, inner: str | None = None
) -> Iterator[DataFrame]:
    """Split ``df`` by hashes of ``key`` into blocks of about ``rows`` rows.

    One block (the table itself) whenever the table is small. Blocks aim at
    half the bound, which leaves room for uneven hashes; ``inner`` names a
    column to count instead of the key, for tables with many rows per key.
    """
    if at_most(df, rows):
        yield df
        return
    total = df.select(inner or key).count()
    blocks = max(1, -(-2 * total // rows))
    for number in range(blocks):
        yield df.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == number)


# Texts handed from Arrow to Python at a time, and their bytes.
SLICE_ROWS = 256
SLICE_BYTES = 4 << 20


def text_slices(texts: pa.Array, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """A text column in slices of bounded rows and bytes (one text at least), so that
    Python objects and what is made of them are held for a slice, not for a batch."""
    at = held = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > at and (i - at >= rows or held + (n or 0) > size):
            yield texts.slice(at, i - at)
            at, held = i, 0
        held += n or 0
    if at < len(texts):
        yield texts.slice(at)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_position(
    df: DataFrame, order: list[str], name: str, start: int = 0, partitions: int | None = None
) -> DataFrame:
    """Contiguous numbers over a total order, without a one-task window.

    Rows are range partitioned and sorted, written to the shared folder
    with their place inside their partition, and shifted by the row
    counts of the partitions before them (one small row per partition).
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = materialize(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("__mid", F.monotonically_increasing_id())
        .withColumn("__pid", F.shiftrightunsigned("__mid", 33))
        .withColumn("__pos", F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__mid"),
        "positions",
        codec="zstd",
    )
    counts = local.groupBy("__pid").count().collect()  # one row per partition
    base, total = [], start
    for row in sorted(counts, key=lambda r: r["__pid"]):
        base.append((row["__pid"], total))
        total += row["count"]
    offsets = spark.createDataFrame(base, "__pid long, __base long")
    return (
        local.join(F.broadcast(offsets), "__pid")
        .withColumn(name, F.col("__base") + F.col("__pos"))
        .drop("__pid", "__pos", "__base")
    )
