from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestream.llm.common import shared_folder
from lodestream.llm.op2_sharding import SQL, Conflict, Shards, op2_sharding
from tests.llm.conftest import DOCS


def same(df, duck, sql):
    cols = sorted(df.columns)
    return sorted(map(str, map(tuple, df.select(cols).collect()))) == sorted(map(str, duck.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()))


def test_query_equals_sql(spark, sf, duck):
    assert same(op2_sharding(spark, sf), duck, SQL)


def test_tiers_merge_and_versions_stay_whole(spark):
    shards = Shards(spark, shared_folder(spark), fanout=3)
    for i in range(7):
        shards.append(spark.range(i * 10, i * 10 + 10))
    assert shards.version() == 7 and len(shards.runs()) == 7
    shards.compact()
    assert len(shards.runs()) < 3 and sorted(r.id for r in shards.read().collect()) == list(range(70))
    assert sum(r["rows"] for r in shards.runs()) == 70


def test_second_writer_fails(spark):
    shards = Shards(spark, shared_folder(spark))
    shards.append(spark.range(3))
    shards.commit(shards.runs(), 1)
    with pytest.raises(Conflict):
        shards.commit([], 1)
    assert shards.read().count() == 3


def test_a_writer_between_claim_and_rename_excludes_others(spark):
    """One has claimed version 2 and not yet written it: another with base 1 must fail, not take version 3 and hide the first's rows."""
    shards = Shards(spark, shared_folder(spark))
    shards.append(spark.range(3))
    assert shards._create(shards._claim(2))
    with pytest.raises(Conflict):
        shards.append(spark.range(3, 5))
    assert shards.version() == 1 and shards.read().count() == 3
    shards.release_claim()
    assert shards.append(spark.range(3, 5)) == 2 and shards.read().count() == 5


def test_writers_at_once_lose_nothing(spark):
    from concurrent.futures import ThreadPoolExecutor

    shards = Shards(spark, shared_folder(spark))
    shards.append(spark.range(1))

    def write(i):
        try:
            return shards.commit([*shards.runs(1), {"path": f"run{i}", "bytes": 1, "rows": 1, "files": 1}], 1)
        except Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(write, range(8)))
    assert [n for n in done if n] == [2] and shards.runs(2)[-1]["path"] == f"run{done.index(2)}"


def test_old_versions_stay_readable_until_vacuum(spark):
    shards = Shards(spark, shared_folder(spark), fanout=2)
    for i in range(4):
        shards.append(spark.range(i * 10, i * 10 + 10), (F.col("id") % 2).cast("int"))
    in_flight = shards.read(3)
    shards.compact()
    assert [shards.read(v).count() for v in (1, 2, 3, 4)] == [10, 20, 30, 40] and in_flight.count() == 30
    last = shards.version()
    shards.vacuum(1)
    assert shards.read().count() == 40 and shards.read(last).count() == 40 and shards._versions() == [last]
    left = {s.getPath().getName() for s in shards._fs.listStatus(shards._path(f"{shards.folder}/runs"))}
    assert left == {r["path"].split("/runs/")[1].split("/")[0] for r in shards.runs()}


def test_columns_of_any_name_are_kept(spark):
    shards = Shards(spark, shared_folder(spark))
    rows = spark.createDataFrame([(1, "a", 2, "x"), (2, "b", 3, None)], "doc_id long, arrival string, lot int, path string")
    shards.append(rows, (F.col("doc_id") % 2).cast("int"))
    assert shards.read().columns == rows.columns and sorted(map(tuple, shards.read().collect())) == sorted(map(tuple, rows.collect()))


def test_awkward_and_empty(spark, awkward, write):
    assert op2_sharding(spark, write(awkward, DOCS)).count() == len(awkward)
    assert op2_sharding(spark, write([], DOCS)).count() == 0
