from __future__ import annotations

import random
from itertools import accumulate

import duckdb

from pyspark.sql import functions as F

from lodestream.llm import stages
from lodestream.llm.op5_mixing import RAMPS, SQL, hash_key, hash_range, mix, op5_mixing
from tests.llm.conftest import DOCS
from tests.llm.test_sharding import same


def test_query_equals_sql(spark, sf, duck):
    assert same(op5_mixing(spark, sf), duck, SQL)


def check(rows, source_of):
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size + 1e-6
        by.setdefault(source_of[r.doc_id], []).append(r)
    for own in by.values():
        assert len({(r.source_size, r.target) for r in own}) == 1 and sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1


def test_awkward_rows(spark, awkward, write):
    folder = write(awkward, DOCS)
    rows = op5_mixing(spark, folder).collect()
    assert len(rows) == len(awkward)
    check(rows, {r[0]: r[3] for r in awkward})
    assert rows == op5_mixing(spark, folder).collect()
    assert next(r for r in rows if r.doc_id == 0).size == 0
    assert op5_mixing(spark, write([], DOCS)).count() == 0


def test_caps_are_reshared(spark, write):
    # Sizes 10, 100, 100: the first source is capped at 20, the others share 315 - 20 by 1 : 2, the last capped at 200.
    rows = [(1, "a " * 10, None, "a", 0), (2, "b " * 100, None, "b", 0), (3, "c " * 100, None, "c", 0)]
    got = {r.doc_id: (r.target, r.taken) for r in op5_mixing(spark, write(rows, DOCS)).collect()}
    assert {k: round(v[0], 6) for k, v in got.items()} == {1: 20.0, 2: 98.333333, 3: 196.666667}
    assert got[1][1] == 20 and got[2][1] == 98 and got[3][1] == 196


def test_positions_follow_the_ramp(spark, sf):
    rows = [r for r in op5_mixing(spark, sf).collect() if r.position is not None]
    assert all(0 <= r.position <= 1 for r in rows)
    assert [r.position for r in rows] == sorted(r.position for r in rows)


def test_taken_words_follow_the_ramps_in_every_pass(spark, write):
    """Sources of 200 documents of 20 words, a and c taken about twice: by each time each source has what its ramp asks for."""
    sizes = {"a": 200, "b": 600, "c": 200}
    docs = [(i, source) for source, n in sizes.items() for i in range(1000 * ord(source), 1000 * ord(source) + n)]
    rows = mix(spark.createDataFrame([(i, s, 20) for i, s in docs], "doc_id long, source string, size long")).collect()
    copies = []
    for k, source in enumerate("abc"):
        own = [r for r in rows if r.source == source]
        a, b = RAMPS[k]
        slope, target = (a - b) / (a + b), own[0].target
        taken = sorted((t, min(r.size, r.taken - p * r.size)) for r in own for p, t in enumerate(r.positions or []))
        assert sum(w for _, w in taken) == sum(r.taken for r in own) == int(target)
        assert all(r.position == (r.positions or [None])[0] for r in own)
        for (t, w), done in zip(taken, accumulate(w for _, w in taken), strict=True):
            assert 0 <= t <= 1 and abs(target * (t + slope * (t - t * t)) - (done - w)) < 1e-3
        copies += [(t, w, source) for t, w in taken]
    assert any(len(r.positions or []) > 1 for r in rows)
    folder = write([(i, "w " * 20, None, s, 0) for i, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = stages.mix_sources(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    copies.sort()
    for end in range(100, len(copies), 100):
        for source in "abc":
            assert abs(sum(r.source == source for r in mixed[:end]) - sum(c[2] == source for c in copies[:end])) <= 2


def test_rows_without_an_id_are_a_range_for_each_size(spark, write):
    """A third of all rows has no doc_id; ids around them that share the start of their hash are in order, too."""
    rnd = random.Random(11)
    ids = [*range(40_000), *[None] * 20_000]
    rnd.shuffle(ids)
    rows = [(i, "w " * rnd.randint(0, 60), "en", rnd.choice("ab"), 0) for i in ids]
    folder = write(rows, DOCS, extra=None)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    assert same(op5_mixing(spark, folder), con, SQL)
    sizes = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", (F.length("text") / 2).cast("bigint").alias("size"))
    ranges = sizes.select("doc_id", "size", hash_key(F.col("doc_id")).alias("key"), hash_range(F.col("doc_id"), F.col("size")).alias("r")).collect()
    assert len({r.r for r in ranges if r.doc_id is None}) == 61
    assert {r.r[3:] for r in ranges if r.doc_id is not None} == {"", "0", "2"}
    order = sorted(ranges, key=lambda r: (r.key, r.doc_id is not None, r.doc_id or 0, r.size))
    assert [r.r for r in order] == sorted(r.r for r in order)
