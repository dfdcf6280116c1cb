from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestream.operators import refs as ops
from lodestream.sources.refs import read_current, read_listing, read_mirror, write_mirror
from lodestream.streaming.sync import sync

LISTING = """aa HEAD
a1\trefs/heads/main
c3\trefs/tags/v1.2.3
c4\trefs/tags/v1.2.3^{}
b7\trefs/pull/7/head

"""


@pytest.fixture
def listing(tmp_path):
    folder = tmp_path / "listings"
    folder.mkdir()
    (folder / "a.txt").write_text(LISTING)
    return str(folder)


def test_listing_gives_branches_and_tags(spark, listing):
    assert sorted(map(tuple, read_listing(spark, listing).collect())) == [("branch", "main", "a1"), ("tag", "v1.2.3", "c3")]


def test_mirror_round_trip_and_restore(spark, listing, tmp_path):
    write_mirror(ops.mirror(ops.enumerate_refs(read_listing(spark, listing))), str(tmp_path / "out"))
    kept = read_mirror(spark, str(tmp_path / "out"))
    assert sorted(r.target for r in kept.collect()) == ["mirror/main", "mirror/v1.2.3"]
    assert [r.kind for r in ops.restore(kept, "main").collect()] == ["branch"]
    assert ops.restore(kept, "absent").count() == 0


def test_write_outside_the_namespace_fails(spark, tmp_path):
    refs = spark.createDataFrame([("branch", "main", "main")], "kind string, name string, target string")
    with pytest.raises(Exception, match="not below the mirror prefix"):
        write_mirror(refs, str(tmp_path / "bad"))


def test_a_rejected_write_leaves_the_old_mirror(spark, listing, tmp_path):
    path = str(tmp_path / "out")
    write_mirror(ops.mirror(ops.enumerate_refs(read_listing(spark, listing))), path)
    before = sorted(map(tuple, read_mirror(spark, path).collect()))
    bad = spark.createDataFrame([("branch", "ok", "a", "mirror/ok"), ("branch", "main", "a", "main")], "kind string, name string, object_id string, target string")
    with pytest.raises(Exception, match="not below the mirror prefix"):
        write_mirror(bad, path)
    assert sorted(map(tuple, read_mirror(spark, path).collect())) == before and len(before) == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["listings", "out"]
    write_mirror(bad.filter("name = 'ok'"), path)
    assert [r.target for r in read_mirror(spark, path).collect()] == ["mirror/ok"]


def test_of_several_rows_for_a_ref_the_greatest_is_kept(spark):
    rows = spark.createDataFrame([("branch", "x", "b"), ("branch", "x", "c"), ("branch", "x", None), ("tag", "x", "a")], "kind string, name string, object_id string")
    assert sorted(map(tuple, ops.enumerate_refs(rows.repartition(4)).collect())) == [("branch", "x", "c"), ("tag", "x", "a")]


def test_restore_takes_the_last_sync(spark, tmp_path):
    listings, out, state = (tmp_path / x for x in ("listings", "out", "state"))
    listings.mkdir()
    for i, text in enumerate(["a1 refs/heads/main\na2 refs/heads/dev\n", "b1 refs/heads/main\n"]):
        (listings / f"{i}.txt").write_text(text)
        sync(spark, str(listings), str(out), str(state), once=True).awaitTermination()
    current = read_current(spark, str(out))
    assert [r.object_id for r in ops.restore(current, "main").collect()] == ["b1"]
    assert [r.object_id for r in ops.restore(current, "dev").collect()] == ["a2"]


def test_scheduled_sync_goes_on(spark, tmp_path):
    listings, out = tmp_path / "listings", str(tmp_path / "out")
    listings.mkdir()
    (listings / "0.txt").write_text("a1 refs/heads/main\n")
    running = sync(spark, str(listings), out, str(tmp_path / "state"), every="500 milliseconds")
    try:
        running.processAllAvailable()
        (listings / "1.txt").write_text("a2 refs/heads/main\n")
        running.processAllAvailable()
        assert running.isActive
    finally:
        running.stop()
    assert [r.object_id for r in read_current(spark, out).collect()] == ["a2"]


def test_guard_defines_nulls_and_the_bare_prefix(spark):
    rows = spark.createDataFrame([(None,), ("mirror/",), ("mirror/x",), ("main",)], "target string")
    assert [r.allowed for r in ops.guard(rows).collect()] == [False, False, True, False]


def test_empty_refs(spark):
    empty = spark.createDataFrame([], "kind string, name string, object_id string")
    assert ops.mirror(ops.enumerate_refs(empty)).count() == 0


def test_sync_takes_new_listings_once(spark, listing, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        q = sync(spark, listing, out, state, once=True)
        q.awaitTermination()
    assert spark.read.parquet(out).select(F.countDistinct("target")).first()[0] == 2
    assert spark.read.parquet(out).count() == 2
