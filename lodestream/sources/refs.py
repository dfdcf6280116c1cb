"""Ref listings as input, the mirror table as output.

A listing is text with one ref on each line, an object id and a full ref name
between white space, which is what `git ls-remote` prints. Peeled tags (`^{}`)
and refs that are neither branch nor tag (HEAD, pull requests) are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.refs import in_namespace

REF_SCHEMA = "kind string, name string, object_id string"
MIRROR_SCHEMA = f"{REF_SCHEMA}, target string"


def parse_listing(lines: DataFrame) -> DataFrame:
    """(kind, name, object_id) of each branch and tag in a text DataFrame or stream."""
    found = F.regexp_extract
    line = r"^\s*(\S+)\s+refs/(heads|tags)/(\S+?)\s*$"
    return (
        lines.filter(F.col("value").rlike(line) & ~F.col("value").rlike(r"\^\{\}\s*$"))
        .select(
            F.when(found("value", line, 2) == "heads", "branch").otherwise("tag").alias("kind"),
            found("value", line, 3).alias("name"),
            found("value", line, 1).alias("object_id"),
        )
    )


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """The refs in a listing file or folder."""
    return parse_listing(spark.read.text(path))


def write_mirror(refs: DataFrame, path: str) -> None:
    """Write mirrored refs, one folder for each kind, replacing what the mirror held.

    The new mirror is written aside, and takes the old one's place only when it is whole: a target outside the
    namespace, or any other failure, leaves the old mirror as it was. Other folders beside `path` are not touched.
    """
    checked = refs.withColumn(
        "target",
        F.when(in_namespace(F.col("target")), F.col("target")).otherwise(
            F.raise_error(F.concat(F.lit("not below the mirror prefix: "), F.coalesce(F.col("target"), F.lit("null"))))
        ),
    )
    spark = refs.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    name = f"_{place.getName().replace('=', '-')}.{uuid.uuid4().hex}"
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f"{name}.{x}") for x in ("new", "old"))
    try:
        checked.write.partitionBy("kind").parquet(new.toString())
        _swap(fs, new, place, old)
    finally:
        fs.delete(new, True)


def _swap(fs, new, place, old) -> None:
    """Puts a folder in the place of another, which is put back if that fails."""
    had = fs.exists(place)
    if had and not fs.rename(place, old):
        raise OSError(f"{place} can't be moved")
    if not fs.rename(new, place):
        if had:
            fs.rename(old, place)
        raise OSError(f"{new} can't be put in place")
    if had:
        fs.delete(old, True)


def read_mirror(spark: SparkSession, path: str) -> DataFrame:
    """What write_mirror wrote."""
    return spark.read.schema(MIRROR_SCHEMA).option("basePath", path).parquet(path)


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """Of a folder of syncs, each ref as the last sync that had it left it."""
    syncs = spark.read.schema(f"{MIRROR_SCHEMA}, sync long").option("basePath", path).parquet(path)
    return syncs.groupBy("kind", "target").agg(F.max(F.struct("sync", "name", "object_id")).alias("last")).select("kind", "target", "last.name", "last.object_id")
