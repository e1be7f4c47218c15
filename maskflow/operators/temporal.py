"""Joins on time and on intervals without a product of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Length of the slices of time that a key's rows are dealt out by.
SLICE_SECONDS = 30 * 86_400
#: Rows that one task puts in order, about; more rows are more tasks.
TASK_ROWS = 500_000


def as_of(rows: DataFrame, versions: DataFrame, key: str, at: Column, since: str = "since", out: str = "version", slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """``rows`` plus ``out``: the struct of the columns of ``versions`` of the row's key that holds at the time ``at``,
    which is the last whose ``since`` is not after it; null if there is none, or where key or time is null.

    Both sides are sorted together within a key and a slice of time, and a version is carried forward; what held at a
    slice's begin comes from a table of each slice's last version, which is short. So a hot key is as many tasks as it
    has slices, and no row meets more than one version. Of versions that begin at once the greatest holds."""
    names, spark = rows.columns, rows.sparkSession
    width = F.lit(slice_seconds * 1_000_000).cast("long")
    sliced = lambda c: F.floor(F.unix_micros(c) / width).cast("long")
    held = F.struct(*[F.col(f"`{c}`") for c in versions.columns])
    v = versions.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{since}`").cast("timestamp").alias("_t"), held.alias("_v")).where("_k is not null and _t is not null").withColumn("_s", sliced(F.col("_t")))
    r = rows.select(F.col(f"`{key}`").alias("_k"), at.cast("timestamp").alias("_t"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_r")).withColumn("_s", sliced(F.col("_t")))
    tasks = max(spark.sparkContext.defaultParallelism, -(-(rows.count() + versions.count()) // TASK_ROWS))
    met = v.select("_k", "_s", F.struct("_t", "_v").alias("_last")).unionByName(r.where("_k is not null and _t is not null").select("_k", "_s"), allowMissingColumns=True)
    met = met.repartition(tasks, "_k", "_s").groupBy("_k", "_s").agg(F.max("_last")["_v"].alias("_last")).repartition(tasks, "_k")
    earlier = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = met.select("_k", "_s", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    both = v.select("_k", "_s", "_t", F.lit(0).alias("_side"), "_v").unionByName(r.select("_k", "_s", "_t", F.lit(1).alias("_side"), "_r"), allowMissingColumns=True).repartition(tasks, "_k", "_s")
    so_far = Window.partitionBy("_k", "_s").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = both.withColumn("_own", F.last("_v", ignorenulls=True).over(so_far)).where("_side = 1")
    d = d.join(carried, ["_k", "_s"], "left")
    holds = F.when(F.col("_k").isNotNull() & F.col("_t").isNotNull(), F.coalesce("_own", "_carried"))
    return d.select("_r", holds.alias("_holds")).select(*[F.col("_r")[c].alias(c) for c in names if c.lower() != out.lower()], F.col("_holds").alias(out))


def overlapping(left: DataFrame, right: DataFrame, key: str, start: str = "start", stop: str = "stop", width: int = 256) -> DataFrame:
    """Pairs (left, right: structs) of rows of one key whose intervals [start, stop) share a place, each once.

    An interval goes to every bin of ``width`` that it touches, bins meet by an equi-join on (key, bin), and a pair is
    kept in the bin in which the later of the two begins, so it counts once and a key with many intervals is spread
    over its bins. Empty intervals, and nulls in key or bounds, overlap nothing."""

    def binned(df, side):
        d = df.where(f"`{start}` < `{stop}`").select(F.col(f"`{key}`").alias("_k"), F.col(f"`{start}`").alias(f"_a{side}"), F.col(f"`{stop}`").alias(f"_z{side}"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(side))
        return d.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"_a{side}") / width), F.floor((F.col(f"_z{side}") - 1) / width))))

    a, b = binned(left, "left"), binned(right, "right")
    own = F.floor(F.greatest("_aleft", "_aright") / width)
    return a.join(b, ["_k", "_bin"]).where((F.col("_aleft") < F.col("_zright")) & (F.col("_aright") < F.col("_zleft")) & (F.col("_bin") == own)).select("left", "right")


def sessions(rows: DataFrame, key: str, ts: str, minutes: int = 60) -> DataFrame:
    """key, start, stop, n: runs of a key's rows that follow each other within ``minutes``, which is how long
    a mapping lives after it was last read."""
    return rows.where(f"`{key}` is not null").groupBy(F.col(f"`{key}`").alias(key), F.session_window(ts, f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
