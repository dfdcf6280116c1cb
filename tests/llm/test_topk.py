from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from lodestream.llm import op10_topk as op10
from tests.llm.test_sharding import same

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in whole:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q and len(b) == len(a))[:5]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_query_equals_sql(spark, sf, duck):
    assert same(op10.op10_topk(spark, sf), duck, op10.SQL)


def test_awkward_vectors(spark, write, monkeypatch):
    monkeypatch.setattr(op10, "shard_size", lambda rows: 100)
    monkeypatch.setattr(op10, "SLICE", 4)
    monkeypatch.setattr(op10, "LEAF", 4)
    rnd = random.Random(1)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(8)], 0) for i in range(200)] + [(i, [0.5] * 8, 0) for i in range(200, 300)]
    rows += [(300, None, 1), (350, [None] * 8, 1), (400, [float("nan")] * 8, 1), (401, [float("inf")] * 8, 1), (450, [1.0, 2.0], 1), (451, [2.0, 1.0], 1), (500, [], 1), (501, [], 1), (None, [0.1] * 8, 1), (550, [1.0] * 3, 1)]
    got = op10.op10_topk(spark, write(rows, SCHEMA, "embeddings")).collect()
    assert len(got) == len({tuple(r) for r in got}) and {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute(rows)
    assert op10.op10_topk(spark, write([], SCHEMA, "embeddings")).count() == 0


def test_large_products_are_exact():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [2.0**22, 5.0]])
    assert op10.products(a, b).tolist() == [[2**60 + 3, 2**62 + 15]]
    assert op10.products(a * 2**20, b).max() == 2**63 - 1


def test_search_prunes_and_finds_all():
    rng = np.random.default_rng(3)
    centres = rng.integers(-400, 400, (20, 16))
    points = (centres[rng.integers(0, 20, 3000)] + rng.integers(-20, 20, (3000, 16))).astype(float)
    queries, ids = points[:50], np.arange(3000)
    scores, found = op10.search(op10.ball_tree(points, ids), queries, np.arange(50), np.full(50, op10.NONE))
    exact = (queries @ points.T).astype(np.int64)
    exact[np.arange(50), np.arange(50)] = op10.NONE
    order = np.lexsort((np.broadcast_to(ids, exact.shape), -exact.astype(float)), axis=1)[:, :5]
    assert (found == order).all() and (scores == np.take_along_axis(exact, order, 1)).all()


def clustered(n=4000, dims=16, clusters=40):
    rng = np.random.default_rng(8)
    centres = rng.integers(-400, 400, (clusters, dims))
    return (centres[rng.integers(0, clusters, n)] + rng.integers(-10, 10, (n, dims))).astype(float)


def test_cells_are_pruned_before_queries_are_sent():
    points = clustered()
    pivots = {16: (points[:40], np.arange(40))}
    lists = lambda x: pa.array(list(map(list, x)), pa.list_(pa.float64()))
    (cells,) = op10.assign(pivots)(iter([pa.record_batch({"vec_id": pa.array(np.arange(4000)), "vector": lists(points)})]))
    cell, distance = (cells.column(c).to_numpy() for c in ("cell", "distance"))
    radius = np.array([distance[cell == c].max() for c in range(40)])
    sent = type("Sent", (), {"value": {16: (points[:40], radius, np.arange(40))}})
    exact = points[:200] @ points.T
    exact[np.arange(200), np.arange(200)] = -np.inf
    floor = np.sort(exact, axis=1)[:, -5].astype(np.int64)
    batch = pa.record_batch({"query_id": pa.array(np.arange(200)), "query_key": pa.array(np.arange(200)), "vector": lists(points[:200]), "floor": pa.array(floor), "home": pa.array(cell[:200]), "home_salt": pa.array(np.zeros(200, np.int64))})
    asked = [(q, c) for first in (True, False) for b in op10.ask(sent, first)(iter([batch])) for q, c in zip(b.column("query_id").to_pylist(), b.column("cell").to_pylist(), strict=True)]
    assert len(set(asked)) == len(asked) < 0.25 * 200 * 40
    needed = {(q, int(cell[i])) for q in range(200) for i in np.argsort(-exact[q])[:5]}
    assert needed <= set(asked)


@pytest.mark.parametrize("size", [64, 4000])
def test_hot_vector_and_clusters_equal_brute_force(spark, write, monkeypatch, size):
    """A third of all rows is one vector; queries of a shard come in many slices."""
    monkeypatch.setattr(op10, "shard_size", lambda rows: size)
    monkeypatch.setattr(op10, "SLICE", 7)
    points = clustered(600, 8, 12) / 256
    points[::3] = points[0]
    rows = [(i, list(map(float, v)), 0) for i, v in enumerate(points)]
    got = op10.op10_topk(spark, write(rows, SCHEMA, "embeddings")).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute(rows) and len(got) == 60


def test_a_packed_tree_is_the_same():
    tree = op10.ball_tree(clustered(500), np.arange(500))
    again = op10.Tree.unpacked(16, tree.packed())
    assert all((a == b).all() for a, b in zip(tree, again, strict=True))
    assert op10.Tree.unpacked(0, op10.ball_tree(np.zeros((3, 0)), np.arange(3)).packed()).points.shape == (3, 0)
