"""Containers to repositories, and group suggestions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import vocab


def _self_and_parents(path: Column) -> Column:
    segs = F.split(path, "/")
    return F.transform(segs, lambda s, i: F.array_join(F.slice(segs, F.lit(1), i + 1), "/"))


def container_paths(containers: DataFrame) -> DataFrame:
    """(container, compose, mount): bind mounts and compose working directories."""
    binds = F.transform(F.filter("mounts", lambda m: (m["Type"] == "bind") & (m["Source"] != "")),
                        lambda m: m["Source"])
    workdir = F.array_compact(F.array(F.try_element_at("labels", F.lit(vocab.COMPOSE_WORKDIR_LABEL))))
    return (containers.select(
        F.regexp_replace("name", "^/+", "").alias("container"),
        F.try_element_at("labels", F.lit(vocab.COMPOSE_PROJECT_LABEL)).alias("compose"),
        F.explode(F.concat(F.coalesce(binds, F.array().cast("array<string>")), workdir)).alias("mount"))
        .withColumn("mount", N.norm_mount_path(F.col("mount"))).filter("mount <> ''"))


def match_mounts(containers: DataFrame, repos: DataFrame) -> DataFrame:
    """(container, compose, repo_id) where a mount and a repo root overlap.

    Containment is an equality with one of the other path's parents, so both
    directions are plain equi joins."""
    mounts = container_paths(containers).distinct()
    roots = repos.select("repo_id", N.norm_mount_path(F.col("path")).alias("root")).filter("root <> ''")
    inside = (mounts.withColumn("root", F.explode(_self_and_parents(F.col("mount"))))
              .join(roots, "root"))
    around = (roots.withColumn("mount", F.explode(_self_and_parents(F.col("root"))))
              .join(mounts, "mount"))
    cols = ["container", "compose", "repo_id"]
    return inside.select(*cols).unionByName(around.select(*cols)).distinct()


def suggest_groups(matches: DataFrame, groups: DataFrame) -> DataFrame:
    """Compose projects (or lone containers) that span at least two repos."""
    key = F.when(F.coalesce("compose", F.lit("")) != "", F.concat(F.lit("compose:"), F.col("compose"))).otherwise(
        F.concat(F.lit("container:"), F.col("container")))
    by_key = matches.withColumn("key", key).groupBy("key").agg(
        F.max("compose").alias("compose"),
        F.array_sort(F.collect_set("repo_id")).alias("repo_ids"),
        F.array_sort(F.collect_set("container")).alias("containers")).filter(F.size("repo_ids") >= 2)
    existing = groups.select(F.array_sort(F.array_distinct("repo_ids")).alias("repo_ids")).distinct().withColumn(
        "already_grouped", F.lit(True))
    named = F.coalesce(F.when(F.col("compose") != "", F.col("compose")),
                       F.concat(F.lit("container "), F.get("containers", F.lit(0))))
    return by_key.join(existing, "repo_ids", "left").select(
        named.alias("name"), "key",
        F.when(F.col("compose") != "", F.array("compose")).otherwise(F.array().cast("array<string>")).alias("compose_projects"),
        "repo_ids", "containers", F.coalesce("already_grouped", F.lit(False)).alias("already_grouped"))


def confirm(suggestions: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups after confirming suggestions; identical membership adds nothing."""
    members = F.array_sort(F.array_distinct("repo_ids"))
    known = groups.select(members.alias("_members")).distinct()
    new = (suggestions.withColumn("_members", members).join(known, "_members", "left_anti")
           .groupBy("_members").agg(F.min("name").alias("name"), F.min_by("compose_projects", "name").alias("compose_projects")))
    new = new.select(
        F.concat(F.lit("g-"), F.substring(F.sha1(F.array_join("_members", "|")), 1, 10)).alias("group_id"), "name",
        F.col("_members").alias("repo_ids"), "compose_projects", F.lit(True).alias("confirmed"))
    return groups.unionByName(new)
