"""Row-level visibility of jobs and what builds on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allowed_owners(users: DataFrame) -> DataFrame:
    """(viewer_id, owner_id): the viewer's own id and everyone in the viewer's current team."""
    me = users.select(F.col("user_id").alias("viewer_id"), F.col("user_id").alias("owner_id"))
    left = users.filter("team_id IS NOT NULL").select(F.col("user_id").alias("viewer_id"), "team_id")
    mates = left.join(users.select(F.col("user_id").alias("owner_id"), "team_id"), "team_id").select("viewer_id", "owner_id")
    return me.unionByName(mates).distinct()


def visible(jobs: DataFrame, users: DataFrame, viewer_id: int) -> DataFrame:
    """Jobs one viewer may see: all for an admin, otherwise own and team jobs; a null owner matches nobody else."""
    viewer = users.filter(F.col("user_id") == viewer_id)
    mates = users.join(viewer.select("team_id"), "team_id", "left_semi")  # a null team has no mates
    owners = viewer.unionByName(mates).select(F.col("user_id").alias("owner_id")).distinct()
    admin = viewer.filter("role = 'admin'").limit(1).count() > 0
    return jobs if admin else jobs.join(owners, "owner_id", "left_semi").select(*jobs.columns)


def visible_pairs(jobs: DataFrame, users: DataFrame) -> DataFrame:
    """(viewer_id, job …) for all viewers that are no admins: one equi-join, no viewer loop."""
    plain = users.filter("role <> 'admin'").select(F.col("user_id").alias("viewer_id"))
    return jobs.join(allowed_owners(users).join(plain, "viewer_id", "left_semi"), "owner_id")


def browsable(jobs: DataFrame) -> DataFrame:
    """Children of benchmark runs stay out of listings."""
    return jobs.filter("run_id IS NULL")


def like_ci(col: str, q: str) -> Column:
    """Case-insensitive substring; % and _ in ``q`` keep their LIKE meaning."""
    return F.lower(col).like(f"%{q.lower()}%")


def in_folder(path: Column, folder: str) -> Column:
    return (path == folder) | path.startswith(folder + "/")


def status_chip(status: Column) -> Column:
    return F.when(status.isin("PENDING", "RUNNING"), "running").when(status == "FINISHED", "completed").when(status == "FAILED", "failed")
