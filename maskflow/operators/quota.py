"""Byte quotas: requests admitted in order while they fit into what their team has left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from .mask import _folded

#: A team of more requests than this is dealt out in runs of about so many.
RUN_ROWS = 1_000_000


def quota(requests: DataFrame, team: str, order: str, size: str, limit: int, run_rows: int = RUN_ROWS) -> DataFrame:
    """``requests`` plus ``admitted``: in order (then by size), a request is admitted if it fits into what its team has
    left. A refused one uses nothing up, so this is a fold and no running sum. Null sizes count as 0; requests without
    a team are a team.

    A team of up to ``run_rows`` requests is one task's, sorted with spilling and read batch by batch. A larger one is
    cut into runs and admitted in rounds, of which there are at most as many as ``limit`` has bits, and in which no
    task sees more than a run; see ``_rounds``."""
    names = [c for c in requests.columns if c.lower() != "admitted"]
    plain = {c: f"q{i}" for i, c in enumerate(names)}  # so that no name clashes with those used here
    rows = requests.select(*[F.col(f"`{c}`").alias(p) for c, p in plain.items()])
    team, order, size = plain[team], plain[order], plain[size]
    # at most one in run_rows requests has a row here
    large = written(rows.groupBy(F.col(team).alias("_team")).count().where(F.col("count") > run_rows).select("_team"), "quota-teams")
    is_large = F.col(team).eqNullSafe(F.col("_team"))
    if not large.limit(1).count():
        return _folded(rows, [team], [order, size], _fold(size, limit), "admitted").toDF(*names, "admitted")
    small = _folded(rows.join(F.broadcast(large), is_large, "left_anti"), [team], [order, size], _fold(size, limit), "admitted")
    rest = rows.join(F.broadcast(large), is_large, "left_semi")
    at = F.monotonically_increasing_id()  # the run, and in the lower 33 bits the place in it
    runs = max(2, -(-rows.count() // run_rows))
    rest = written(rest.repartitionByRange(runs, team, order, size).sortWithinPartitions(team, order, size).withColumn("_at", at), "quota-rows")
    need = F.coalesce(F.col(size).cast("long"), F.lit(0))
    rounds = _rounds(rest.select(F.struct(F.col(team).alias("t")).alias("team"), "_at", need.alias("size")), limit)
    fits = F.exists("_rounds", lambda r: (F.col("_at") > r["after"]) & (F.col("_at") <= r["last"]) & ((2 * need <= r["left"]) | F.coalesce(F.col("_at") == r["extra"], F.lit(False))))
    done = rest.join(F.broadcast(rounds), F.struct(F.col(team).alias("t")).eqNullSafe(F.col("_of")), "left")
    return small.unionByName(done.select(*plain.values(), F.coalesce(fits, F.lit(False)).alias("admitted"))).toDF(*names, "admitted")


def _fold(size: str, limit: int):
    def fold(used, row):
        need = (used or 0) + (row[size] or 0)
        return (need, True) if need <= limit else (used or 0, False)

    return fold


def _rounds(rows: DataFrame, limit: int) -> DataFrame:
    """_of (team), _rounds array<struct<after, last, left, extra>>: what each round admitted of rows (team, _at, size).

    Say a team has ``left`` bytes after the place ``after``. Requests of up to half of that are all admitted until
    they exceed the half together, and a larger one is admitted only if it fits beside those before it. So up to the
    first request that makes the admitted exceed a half, the small ones are those admitted; that one, ``extra``, is
    too. Then less than half is left, and the next round begins behind it. A round sums the small ones by run,
    carries the sums over the runs of a team, of which there are few, and looks for the extra one within each run."""
    last = (1 << 63) - 1
    state = rows.select("team").distinct().select("team", F.lit(-1).cast("long").alias("after"), F.lit(int(limit)).cast("long").alias("left"))
    state, done = written(state.where("left >= 0"), "quota-state"), []
    for _ in range(int(limit).bit_length() + 2):
        d = rows.join(F.broadcast(state), "team").where("_at > after and size <= left").withColumn("run", F.shiftright("_at", 33))
        small = F.when(2 * F.col("size") <= F.col("left"), F.col("size")).otherwise(0)
        sums = d.groupBy("team", "run").agg(F.sum(small).alias("own"))
        before_run = Window.partitionBy("team").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        carried = sums.select("team", "run", F.coalesce(F.sum("own").over(before_run), F.lit(0)).alias("carried"))
        before = Window.partitionBy("team", "run").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        d = d.withColumn("before", F.coalesce(F.sum(small).over(before), F.lit(0))).join(F.broadcast(carried), ["team", "run"])
        used = F.col("before") + F.col("carried")
        exceeds = F.when(2 * F.col("size") <= F.col("left"), 2 * (used + F.col("size")) > F.col("left")).otherwise(F.col("size") <= F.col("left") - used)
        first = d.where(exceeds).groupBy("team").agg(F.min(F.struct("_at", (used + F.col("size")).alias("used"))).alias("e"))
        now = state.join(first, "team", "left").select("team", "after", "left", F.col("e._at").alias("extra"), F.col("e.used").alias("used"))
        now = written(now, "quota-round")
        done.append(now.select("team", F.struct("after", F.coalesce("extra", F.lit(last)).alias("last"), "left", "extra").alias("r")))
        state = now.where("extra is not null").select("team", F.col("extra").alias("after"), (F.col("left") - F.col("used")).alias("left"))
        if not state.limit(1).count():
            break
    whole = done[0]
    for x in done[1:]:
        whole = whole.union(x)
    return whole.groupBy(F.col("team").alias("_of")).agg(F.collect_list("r").alias("_rounds"))
