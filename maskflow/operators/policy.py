"""Profiles: layer order, merging, fingerprints, seals and provider attribution."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_DEPTH = 8
# How much each oracle mode covers
COVERAGE = {"gazetteer_hit": 0, "sampled": 1, "any_local_finding": 2, "always": 3}


class PolicyError(ValueError):
    pass


def expand_layers(names: Iterable[str], extends: Callable[[str], list[str]]) -> list[str]:
    """Layers from the most general to the most specific: each after those it extends, each once. A cycle, or a
    chain deeper than MOST_DEPTH, is an error."""
    out: list[str] = []
    open_: list[str] = []

    def visit(name: str) -> None:
        if name in open_:
            raise PolicyError(f"{' -> '.join([*open_, name])} is a cycle")
        if len(open_) > MOST_DEPTH:
            raise PolicyError(f"{name} is nested too deeply")
        if name in out:
            return
        open_.append(name)
        for parent in extends(name):
            visit(parent)
        open_.pop()
        out.append(name)

    for n in names:
        visit(n)
    return out


def coverage(mode: Column) -> Column:
    head = F.lower(F.trim(F.substring_index(mode, ":", 1)))
    out = F.lit(-1)
    for name, rank in COVERAGE.items():
        out = F.when(head == name, rank).otherwise(out)
    return out


def merge_policies(layers: DataFrame, team: str = "team_id", order: str = "layer_no") -> DataFrame:
    """One policy per team from its layers, the strictest of each knob: least size, any block and guard, providers
    in all lists that are not null (null: no restriction), canaries of all in order, the widest oracle mode (the
    first of equals), closed before continue; retention from the last layer that has one. Layers of a team are few."""
    g = layers.groupBy(team).agg(
        F.min("size_threshold_bytes").alias("size_threshold_bytes"),
        F.bool_or("block_payloads").alias("block_payloads"),
        F.bool_or("dlp_guard").alias("dlp_guard"),
        F.max_by("oracle_mode", F.struct(coverage(F.col("oracle_mode")), -F.col(order))).alias("oracle_mode"),
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("allowed_providers").alias("p"), F.col("canary_patterns").alias("c")))).alias("rows"),
        F.when(F.bool_or(F.col("pre_pass_down") == "fail-closed"), "fail-closed").otherwise("continue").alias("pre_pass_down"),
        F.max_by("retention_hot_days", F.when(F.col("retention_hot_days").isNotNull(), F.col(order))).alias("retention_hot_days"),
        F.max_by("retention_cold_years", F.when(F.col("retention_cold_years").isNotNull(), F.col(order))).alias("retention_cold_years"),
    )
    lists = F.transform(F.filter("rows", lambda r: r["p"].isNotNull()), lambda r: r["p"])
    providers = F.when(F.size(lists) > 0, F.array_sort(F.aggregate(lists, F.get(lists, F.lit(0)), lambda a, p: F.array_intersect(a, p))))
    canaries = F.array_distinct(F.flatten(F.transform("rows", lambda r: F.coalesce(r["c"], F.array().cast("array<string>")))))
    return g.withColumns({"allowed_providers": providers, "canary_patterns": canaries}).drop("rows")


def provider(model: Column) -> Column:
    return F.when(model.startswith("claude") | F.lower(model).contains("anthropic"), "anthropic").otherwise("openai")


def provider_allowed(name: Column, providers: Column) -> Column:
    """Null providers restrict nothing; an empty list allows none."""
    return providers.isNull() | F.array_contains(providers, name)


def seal(files: dict[str, bytes]) -> str:
    """Hash of a bundle's files, whatever their order."""
    h = hashlib.sha256()
    for name in sorted(files):
        h.update(name.encode() + b"\0" + files[name] + b"\0")
    return h.hexdigest()


def with_team_profile(requests: DataFrame, teams: DataFrame, default: list[str]) -> DataFrame:
    """Requests with their team's profile ids: its own, else the default; null for an unknown team."""
    t = teams.select("team_id", F.when(F.size("profile_ids") > 0, F.col("profile_ids")).otherwise(F.array(*map(F.lit, default)).cast("array<string>")).alias("profile_ids"))
    return requests.join(t, "team_id", "left")


def lifecycle(teams: DataFrame) -> DataFrame:
    """Retention rule of each team, in days."""
    glacier = F.greatest(F.lit(1), F.col("retention_hot_days"))
    return teams.select("team_id", F.concat(F.col("team_id"), F.lit("/")).alias("prefix"), glacier.alias("glacier_days"), (glacier + 365 * F.col("retention_cold_years")).alias("expire_days"))


def partitions(spark, path: str) -> DataFrame:
    """team_id, dt, files, bytes of the partitions of a table of files at ``path`` (team_id=../dt=..), from the names
    and sizes of its files alone: no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    return files.groupBy(F.col("team_id").cast("string").alias("team_id"), F.col("dt").cast("date").alias("dt")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def retention_plan(found: DataFrame, teams: DataFrame, today: str) -> DataFrame:
    """``found`` plus age (days) and action by the team's rule (see ``lifecycle``): expire from expire_days on, archive
    from glacier_days on, else keep. A team without a rule, or a partition without a date, is kept."""
    rules = lifecycle(teams).select(F.col("team_id").cast("string").alias("team_id"), "glacier_days", "expire_days")
    d = found.join(rules, "team_id", "left").withColumn("age", F.datediff(F.lit(today).cast("date"), "dt"))
    action = F.when(F.col("age") >= F.col("expire_days"), "expire").when(F.col("age") >= F.col("glacier_days"), "archive").otherwise("keep")
    return d.withColumn("action", action).drop("glacier_days", "expire_days")


def carried_out(spark, plan: DataFrame, path: str, archive: str) -> dict[str, int]:
    """Expire and archive the partitions of a plan: expired ones are removed, archived ones moved to the same place
    below ``archive``. Partitions are renamed or removed whole by the file system, so nothing is read; what is gone
    already is passed over, so a second run after a lost driver finishes the first. The driver sees the names of the
    partitions to act on, a day's worth per team if it runs daily."""
    j, done = spark._jvm.org.apache.hadoop.fs, {"expire": 0, "archive": 0}
    fs = j.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in plan.where("action <> 'keep'").select("team_id", "dt", "action").toLocalIterator():
        name = f"team_id={r.team_id}/dt={r.dt}"
        at = j.Path(f"{path}/{name}")
        if not fs.exists(at):
            continue
        if r.action == "archive":
            to = j.Path(f"{archive}/{name}")
            fs.mkdirs(to.getParent())
            if not fs.rename(at, to):
                raise OSError(f"{name} was not moved")
        elif not fs.delete(at, True):
            raise OSError(f"{name} was not removed")
        done[r.action] += 1
    return done
