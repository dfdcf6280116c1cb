"""Queries on ref listings and on the star schema, each with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import refs as ops
from lodestream.session import shared_folder
from lodestream.sources.refs import read_current, read_mirror, write_mirror
from lodestream.sources.tables import table
from lodestream.streaming.sync import sync

#: Refs to mirror, among them the two names that the behaviour's description gives.
REFS = [
    ("branch", "main", "a1"),
    ("branch", "main", "a1"),
    ("branch", "fix/join", "b2"),
    ("tag", "v1.2.3", "c3"),
    ("tag", "main", "d4"),
    ("note", "commits", "e5"),
    ("branch", None, "f6"),
]


#: Listings that arrive one after another. A branch moves on, a tag goes, a branch comes.
LISTINGS = [
    [("a1", "HEAD"), ("a1", "refs/heads/main"), ("c3", "refs/tags/v1.2.3"), ("c4", "refs/tags/v1.2.3^{}"), ("b7", "refs/pull/7/head")],
    [("a9", "HEAD"), ("a9", "refs/heads/main"), ("d2", "refs/heads/fix/join")],
]


def _values() -> str:
    quoted = (", ".join("NULL" if v is None else f"'{v}'" for v in row) for row in REFS)
    return "(VALUES " + ", ".join(f"({row})" for row in quoted) + ") AS r(kind, name, object_id)"


def _refs(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_values()}")


def ref_enumerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.enumerate_refs(_refs(spark)).select("kind", "name", "object_id")


def ref_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.mirror(ops.enumerate_refs(_refs(spark))).select("kind", "name", "target")


def ref_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the mirrored names, and of the source's own, a sync may write."""
    refs = ops.enumerate_refs(_refs(spark))
    return ops.guard(ops.mirror(refs).select("kind", "target").unionByName(refs.select("kind", F.col("name").alias("target"))))


def ref_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.restore(ops.mirror(ops.enumerate_refs(_refs(spark))), "main").select("kind", "name", "target")


def ref_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the mirrored branches and tags, those that a source with branches only lacks."""
    mirrored = ops.mirror(ops.enumerate_refs(_refs(spark)))
    return ops.stale(mirrored, _refs(spark).filter("kind = 'branch'")).select("kind", "target")


def ref_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mirror, written and read back."""
    folder = f"{shared_folder(spark)}/mirror"
    write_mirror(ops.mirror(ops.enumerate_refs(_refs(spark))), folder)
    return read_mirror(spark, folder).select("kind", "name", "object_id", "target")


def _arrive(spark: SparkSession, folder: str, listing: list[tuple[str, str]]) -> None:
    lines = spark.createDataFrame([(f"{object_id}\t{name}",) for object_id, name in listing], "value string")
    lines.coalesce(1).write.mode("append").text(folder)


def ref_sync_on_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two syncs on demand, one after each listing, leave."""
    folder = shared_folder(spark)
    for listing in LISTINGS:
        _arrive(spark, f"{folder}/listings", listing)
        sync(spark, f"{folder}/listings", f"{folder}/mirror", f"{folder}/state", once=True).awaitTermination()
    return read_current(spark, f"{folder}/mirror").select("kind", "name", "object_id", "target")


def ref_sync_scheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sync on a schedule, here of a second, leaves after both listings."""
    folder = shared_folder(spark)
    _arrive(spark, f"{folder}/listings", LISTINGS[0])
    running = sync(spark, f"{folder}/listings", f"{folder}/mirror", f"{folder}/state", every="1 second")
    try:
        running.processAllAvailable()
        _arrive(spark, f"{folder}/listings", LISTINGS[1])
        running.processAllAvailable()
    finally:
        running.stop()
    return read_current(spark, f"{folder}/mirror").select("kind", "name", "object_id", "target")


def ref_restore_after_syncs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch that moved between syncs, as the last one left it."""
    return ops.restore(ref_sync_on_demand(spark, sf_dir), "main")


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums by flag and status; one pass, aggregated before its shuffle.

    Sums are of decimals: they don't depend on the order of rows.
    """
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("decimal(28,2)")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        money("l_quantity").alias("sum_qty"), money("l_extendedprice").alias("sum_price"), F.count("*").alias("n_lines")
    )


def segment_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value by market segment and year; the customer side joins after a partial aggregation of orders."""
    orders = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.year("o_orderdate").alias("year"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"), F.count("*").alias("n"))
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .groupBy("c_mktsegment", "year")
        .agg(F.sum("v").cast("decimal(28,2)").alias("revenue"), F.sum("n").cast("bigint").alias("n_orders"))
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (ref_enumerate, ref_mirror, ref_guard, ref_restore, ref_stale, ref_push, ref_sync_on_demand, ref_sync_scheduled, ref_restore_after_syncs, pricing_summary, segment_revenue)
}
ENTRY = pricing_summary

_ENUMERATED = f"(SELECT DISTINCT kind, name, object_id FROM {_values()} WHERE kind IN ('branch', 'tag') AND name IS NOT NULL)"
_LISTED = "(VALUES " + ", ".join(f"({n}, '{object_id}', '{name}')" for n, listing in enumerate(LISTINGS) for object_id, name in listing) + ") AS l(batch, object_id, full_name)"
_CURRENT = rf"""
        SELECT kind, name, arg_max(object_id, batch) AS object_id, 'mirror/' || name AS target
        FROM (SELECT batch, object_id, CASE WHEN starts_with(full_name, 'refs/heads/') THEN 'branch' ELSE 'tag' END AS kind,
                     regexp_replace(full_name, '^refs/(heads|tags)/', '') AS name
              FROM {_LISTED} WHERE regexp_matches(full_name, '^refs/(heads|tags)/') AND NOT ends_with(full_name, '^{{}}'))
        GROUP BY kind, name"""
SQL = {
    "ref_enumerate": f"SELECT kind, name, object_id FROM {_ENUMERATED}",
    "ref_mirror": f"SELECT kind, name, 'mirror/' || name AS target FROM {_ENUMERATED}",
    "ref_guard": f"""
        SELECT kind, target, starts_with(target, 'mirror/') AND length(target) > 7 AS allowed
        FROM (SELECT kind, 'mirror/' || name AS target FROM {_ENUMERATED} UNION ALL SELECT kind, name FROM {_ENUMERATED})""",
    "ref_restore": f"SELECT kind, name, 'mirror/' || name AS target FROM {_ENUMERATED} WHERE name = 'main'",
    "ref_push": f"SELECT kind, name, object_id, 'mirror/' || name AS target FROM {_ENUMERATED}",
    "ref_sync_on_demand": _CURRENT,
    "ref_sync_scheduled": _CURRENT,
    "ref_restore_after_syncs": f"SELECT * FROM ({_CURRENT}) WHERE name = 'main'",
    "ref_stale": f"""
        SELECT kind, 'mirror/' || name AS target FROM {_ENUMERATED} m
        WHERE NOT EXISTS (SELECT 1 FROM {_ENUMERATED} s WHERE s.kind = 'branch' AND s.kind = m.kind AND s.name = m.name)""",
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS sum_qty,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS sum_price,
               count(*) AS n_lines
        FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "segment_revenue": """
        SELECT c_mktsegment, CAST(year(o_orderdate) AS INTEGER) AS year,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS revenue, count(*) AS n_orders
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, year(o_orderdate)""",
}
