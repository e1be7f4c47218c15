"""Shared helpers: durable tables, bounded Arrow batches, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one Arrow batch that holds whole texts, and its bytes; both bound a Python worker's memory.
TEXT_BATCH, TEXT_BATCH_BYTES = 512, 64 << 20
#: Rows of one run of a table that is put in order; the runs are what ``numbered`` keeps a row each of.
RUN_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``. Where that is unset and Spark runs
    on one machine, as in tests, a temporary one, which is then the checkpoint folder too; on a cluster, where a
    machine's own folder would not do, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="maskflow-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, instead_of: list[str] | None = None) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder, so that lost executors cost no recomputation. With
    ``instead_of``, tables at the paths in it, which nothing reads any more once this one stands, are removed, and
    the list then holds this one's path."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    if instead_of is not None:
        for old in instead_of:
            removed(df.sparkSession, old)
        instead_of[:] = [path]
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH) -> None:
    """Bound the rows and bytes of an Arrow batch, whose texts may be very long. The settings are the session's and
    stay, as plans run after this returns; they are only ever lowered."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    most = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")
    if not most.isdigit() or int(most) > TEXT_BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer until no column of ``df`` has them in any case."""
    there = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in there:
            n += "_"
        out.append(n)
    return out


def plain(df: DataFrame, *added: str) -> DataFrame:
    """``df`` without columns that are named, in any case, like the ones about to be added, which replace them."""
    low = {a.lower() for a in added}
    return df.drop(*[F.col(f"`{c}`") for c in df.columns if c.lower() in low])


def lean() -> None:
    """In a Python worker that handles arrays of megabytes: give their memory back when they go, not when the worker
    ends. Without glibc this does nothing."""
    try:
        import ctypes

        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 24)  # M_MMAP_THRESHOLD: smaller arrays use the heap again and again, and the trim gives it back
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass
    pa.default_memory_pool().release_unused()


def in_runs(rows: DataFrame, order: list[Column], tag: str, *, n_rows: int) -> DataFrame:
    """``rows`` in order, written: plus _run int (runs follow each other) and _nth long, the place in the run from 0.
    The runs are ranges of the order, so a key that many rows share makes one run longer unless the order tells them
    apart."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // RUN_ROWS))
    at = F.monotonically_increasing_id()  # the partition, and in the lower 33 bits the row in it
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", at)
    return written(placed.select(*rows.columns, F.shiftright("_at", 33).cast("int").alias("_run"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth")), tag)


def numbered(rows: DataFrame, order: list[Column], name: str, tag: str = "ordered") -> DataFrame:
    """``rows`` (a written table) plus ``name``: the place of each in the order of the whole table, from 0. No task
    sees more than a run; what is broadcast is one row for each run of about RUN_ROWS rows."""
    placed = in_runs(rows, order, tag, n_rows=rows.count())
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("_run").agg(F.count("*").alias("_n")).select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return placed.join(F.broadcast(runs), "_run").select(*rows.columns, (F.col("_first") + F.col("_nth")).cast("long").alias(name))


class Forest:
    """Union-find over integers; the smallest member is the root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _forest_of_partition(batches):
    forest = Forest()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            forest.link(x, y)
    rows = [(x, forest.find(x)) for x in forest.parent]
    for i in range(0, len(rows), 50_000):
        part = rows[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64())], names=["u", "v"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links of long ids -> (node, component) for every node with a link; component is its smallest node.

    Each partition first reduces its links to a spanning forest (less to shuffle, no group is gathered), then
    large-star and small-star steps alternate until every node points at its root. Each round is written to the
    shared folder in place of the one before; only two numbers per round come to the driver. An empty input gives an empty result; nulls and
    self-links are ignored."""
    e = edges.select(F.col(edges.columns[0]).cast("long").alias("u"), F.col(edges.columns[1]).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    mark, paths = None, []
    e = written(e.mapInArrow(_forest_of_partition, "u long, v long").distinct(), "links", paths)
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.explode(F.array(F.struct(F.col("b").alias("u"), F.col("m").alias("v")), F.struct(F.col("a").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = written(small, "links", paths)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())


def byte_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k-byte window of a byte array, k a power of two, by doubling."""
    x = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    m, step = 0x9E3779B97F4A7C15, 1
    while step < k:
        n = len(x) - step
        if n <= 0:
            return x[:0]
        x = x[:n] * np.uint64(m) + x[step : step + n]
        x ^= x >> np.uint64(29)
        m, step = (m * m + 2) & 0xFFFFFFFFFFFFFFFF | 1, step * 2
    return x


#: For SQL that has no checksum: the tables of CRC-32, and the checksum of the bytes whose hexadecimal digits are h.
SQL_CRC_TABLES = """steps AS (SELECT i, 0 AS n, i::UBIGINT AS c FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE n < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE n = 8)"""
SQL_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, [('0x' || h[2 * i + 1:2 * i + 2])::UBIGINT for i in range(len(h) // 2)]), lambda c, x: xor(c >> 8, tab.t[(xor(c, x) & 255)::INT + 1])), 4294967295::UBIGINT)"
