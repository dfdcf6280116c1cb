"""Mirroring of refs: enumerate, rename, guard, restore.

All five are narrow projections and filters, except `enumerate_refs` (one
aggregation on the ref's key) and `stale` (one anti join on the target).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions.refs import PREFIX, in_namespace, mirrored_name


def enumerate_refs(refs: DataFrame) -> DataFrame:
    """Every branch and tag once; other kinds and null names are left out. Of several rows for a ref the greatest is kept, by the other columns in order."""
    known = refs.filter(F.col("kind").isin("branch", "tag") & F.col("name").isNotNull())
    others = [c for c in refs.columns if c not in ("kind", "name")]
    if not others:
        return known.distinct()
    return known.groupBy("kind", "name").agg(F.max(F.struct(*others)).alias("kept")).select("kind", "name", "kept.*").select(refs.columns)


def mirror(refs: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Adds `target`. A branch and a tag of one name share it; `kind` keeps them apart."""
    return refs.withColumn("target", mirrored_name(F.col("name"), prefix))


def guard(targets: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Adds `allowed`: whether a sync may write the target."""
    return targets.withColumn("allowed", in_namespace(F.col("target"), prefix))


def restore(mirrored: DataFrame, name: str, prefix: str = PREFIX) -> DataFrame:
    """The refs kept under one name; the filter reaches the scan."""
    return mirrored.filter(F.col("target") == prefix + name)


def stale(mirrored: DataFrame, refs: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Mirrored refs that the source no longer has. Syncing keeps them; this only reports."""
    return mirrored.join(mirror(enumerate_refs(refs), prefix).select("kind", "target"), ["kind", "target"], "left_anti")
