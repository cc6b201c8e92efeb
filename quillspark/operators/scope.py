"""Tenant scope: who may see which rows.

Every public read goes through one of these; without a workspace nothing is planned. The dimension sides (assignments,
memberships) are semi-joined, so Spark broadcasts them only while they're small.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MissingWorkspace(ValueError):
    """A read without a tenant."""


@dataclass(frozen=True)
class Scope:
    workspace: str
    user: str | None = None
    admin: bool = False


def require_workspace(workspace: str | None) -> str:
    if workspace is None or not str(workspace).strip():
        raise MissingWorkspace("a workspace is required")
    return str(workspace)


def in_workspace(df: DataFrame, workspace: str | None, column: str = "workspace_id") -> DataFrame:
    return df.filter(F.col(column).cast("string") == require_workspace(workspace))


def candidates(chunks: DataFrame, workspace: str | None, kb: str | None = None, types: Sequence[str] | None = None, ready_only: bool = True) -> DataFrame:
    """A workspace's chunks; filters stand below everything else, so they reach the scan."""
    df = in_workspace(chunks, workspace)
    if kb is not None:
        df = df.filter(F.col("kb_id").cast("string") == str(kb))
    return _narrowed(df, types, ready_only)


def global_candidates(chunks: DataFrame, kb_ids: Sequence[str], types: Sequence[str] | None = None, ready_only: bool = True) -> DataFrame:
    """Chunks of shared knowledge bases (no workspace) that are assigned; none without assignments."""
    if not kb_ids:
        return chunks.limit(0)
    df = chunks.filter(F.col("workspace_id").isNull() & F.col("kb_id").cast("string").isin(*map(str, kb_ids)))
    return _narrowed(df, types, ready_only)


def _narrowed(df: DataFrame, types: Sequence[str] | None, ready_only: bool) -> DataFrame:
    if ready_only:
        df = df.filter(F.col("status") == "ready")
    if types:
        df = df.filter(F.col("type").isin(*types))
    return df


def visible_rows(df: DataFrame, scope: Scope, assignments: DataFrame, key: str = "kb_id") -> DataFrame:
    """Row security: own rows, or shared ones (no workspace) assigned to the workspace; all for an admin.

    assignments: (workspace_id, kb_id).
    """
    if scope.admin:
        return df
    workspace = require_workspace(scope.workspace)
    mine = assignments.filter(F.col("workspace_id") == workspace).select(F.col("kb_id").alias("__kb")).distinct()
    own = df.filter(F.col("workspace_id") == workspace)
    shared = df.filter(F.col("workspace_id").isNull()).join(mine, F.col(key) == F.col("__kb"), "left_semi")
    return own.unionByName(shared)


def member_workspaces(workspaces: DataFrame, members: DataFrame, scope: Scope) -> DataFrame:
    """The current workspace and those that the user is a member of; all for an admin."""
    if scope.admin:
        return workspaces
    mine = members.filter(F.col("user_id") == F.lit(scope.user)).select("workspace_id").distinct().withColumn("__member", F.lit(True))
    found = workspaces.join(mine, "workspace_id", "left").filter((F.col("workspace_id") == scope.workspace) | F.col("__member").isNotNull())
    return found.drop("__member")


def visible_agents(df: DataFrame, scope: Scope) -> DataFrame:
    """Agents of the workspace that nobody or the user owns; all of any workspace for an admin."""
    if scope.admin:
        return df
    owned = F.col("owner_user_id").isNull() | (F.col("owner_user_id") == F.lit(scope.user))
    return in_workspace(df, scope.workspace).filter(owned)


def admissible_tables(tables: DataFrame, scope: Scope, assignments: DataFrame) -> DataFrame:
    """Tables of the workspace's knowledge bases or of assigned shared ones."""
    return visible_rows(tables, scope, assignments)


def stale(started: Column, created: Column, cutoff: Column) -> Column:
    """Work whose last sign of life is at or before the cutoff."""
    return F.coalesce(started, created) <= cutoff
