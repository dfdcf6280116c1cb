"""Exact top-k by inner product: a ball tree for each shard, branch and bound over blocks of queries.

Vectors fall into cells by the nearest of some pivots, at most `PIVOTS` of them, drawn by hash; cells of more vectors than a
shard takes are several shards. Each shard's tree is built once and written. A cell, as any node, is a ball that holds its
vectors, so that no inner product with q exceeds q.centre + |q| * radius. Nodes are visited in descending order of
that bound, and a query leaves a node when the bound is under its current kth score.

Each query first searches a shard of its own cell. The kth score found is shared: with it the query goes to the `NEXT` cells of
greatest bound, and with the kth score from these to all others whose bound is not under it, other cells being pruned
before anything is sent. Queries travel to shards as rows; a shard meets them `SLICE` at a time, in as many groups, so that no task's memory grows with
the number of queries. What is broadcast is the cells' balls, bounded by `PIVOTS`.

Vectors that are null or hold null or non-finite components take no part. Vectors of another length
than the query's have no inner product with it and are no candidates. Rows with the query's vec_id are
its own. Repeated rows are candidates each. Ties go to the smaller vec_id. Scores are exact integers, held to the range of a long.
An empty table has no results. Other columns of the table are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.llm.common import documents, materialize, release

K = 5
LEAF = 64
BLOCK = 1024
PIVOTS = 4096
NEXT = 4
#: Queries in a group, about.
SLICE = 1 << 16
NONE = -(1 << 63)


class Tree(NamedTuple):
    """Points in an order in which every node is a range of them; nodes, the root first, left is -1 at a leaf."""

    points: np.ndarray
    ids: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def packed(self) -> dict[str, bytes]:
        return {name: np.ascontiguousarray(value).tobytes() for name, value in zip(self._fields, self, strict=True)}

    @classmethod
    def unpacked(cls, dims: int, parts: dict[str, bytes]) -> Tree:
        def array(name: str) -> np.ndarray:
            values = np.frombuffer(parts[name], np.float64 if name in ("points", "centre", "radius") else np.int64)
            return values.reshape(-1, dims) if dims and name in ("points", "centre") else values

        tree = cls(*map(array, cls._fields))
        return tree if dims else tree._replace(points=np.zeros((len(tree.ids), 0)), centre=np.zeros((len(tree.radius), 0)))


def ball_tree(points: np.ndarray, ids: np.ndarray, leaf: int | None = None) -> Tree:
    leaf = LEAF if leaf is None else leaf
    rows, nodes = np.arange(len(points)), []
    stack = [(0, len(points), -1, 0)]
    while stack:
        first, last, parent, side = stack.pop()
        own = points[rows[first:last]]
        centre = own.mean(axis=0)
        gap = np.sqrt(((own - centre) ** 2).sum(axis=1))
        nodes.append([centre, float(gap.max()), first, last, -1, -1])
        if parent >= 0:
            nodes[parent][4 + side] = len(nodes) - 1
        if last - first <= leaf:
            continue
        # Between the point farthest from the centre and the one farthest from that; at the median, so that equal points split too.
        far = own[gap.argmax()]
        other = own[((own - far) ** 2).sum(axis=1).argmax()]
        rows[first:last] = rows[first:last][np.argsort(own @ (far - other), kind="stable")]
        half = first + (last - first) // 2
        stack += [(first, half, len(nodes) - 1, 0), (half, last, len(nodes) - 1, 1)]
    centres, *rest = zip(*nodes, strict=True)
    return Tree(points[rows], ids[rows], np.array(centres), np.array(rest[0]), *(np.array(x, np.int64) for x in rest[1:]))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows; as floats where those are exact, else by Python's integers."""
    most = max(1.0, np.abs(a).max(initial=0)) * max(1.0, np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, NONE + 1, 2**63 - 1).astype(np.int64)


def bounds(queries: np.ndarray, norms: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The most that the inner product of each query with a point of each ball can be, and a little more for rounding."""
    reach = norms[:, None] * radius[None, :]
    return queries @ centre.T + reach + 1e-9 * (norms[:, None] * np.sqrt((centre**2).sum(axis=1))[None, :] + reach) + 1e-6


def search(tree: Tree, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each query's k best of the tree's points that score no less than its floor; (NONE, 0) where there are fewer."""
    best = np.full((len(queries), k), NONE, np.int64)
    best_ids = np.zeros((len(queries), k), np.int64)
    kth = floor.astype(np.float64)
    norms = np.sqrt((queries**2).sum(axis=1))

    def bound(node: int, active: np.ndarray) -> np.ndarray:
        return bounds(queries[active], norms[active], tree.centre[node : node + 1], tree.radius[node : node + 1])[:, 0]

    stack = [(0, np.arange(len(queries)))]
    while stack:
        node, active = stack.pop()
        active = active[bound(node, active) >= kth[active]]
        if not len(active):
            continue
        if tree.left[node] >= 0:
            # The child with the greater bound is taken first.
            stack += sorted(((int(child), active) for child in (tree.left[node], tree.right[node])), key=lambda c: bound(c[0], active).sum())
            continue
        rows = slice(int(tree.first[node]), int(tree.last[node]))
        ids = tree.ids[rows]
        scores = products(queries[active], tree.points[rows])
        scores[ids[None, :] == query_ids[active][:, None]] = NONE
        gain = scores.max(axis=1).astype(np.float64) >= kth[active]
        active, scores = active[gain], scores[gain]
        if not len(active):
            continue
        all_scores = np.concatenate([best[active], scores], axis=1)
        all_ids = np.concatenate([best_ids[active], np.broadcast_to(ids, scores.shape)], axis=1)
        by_id = np.argsort(all_ids, axis=1, kind="stable")
        all_scores, all_ids = np.take_along_axis(all_scores, by_id, 1), np.take_along_axis(all_ids, by_id, 1)
        top = np.argsort(-all_scores.astype(np.float64) if np.abs(all_scores[all_scores > NONE]).max(initial=0) < 2**53 else -all_scores.astype(object), axis=1, kind="stable")[:, :k]
        best[active], best_ids[active] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)
        kth[active] = np.maximum(kth[active], best[active, k - 1].astype(np.float64))
    return best, best_ids


def rows_of(column: pa.Array | pa.ChunkedArray, rows: np.ndarray, dims: int) -> np.ndarray:
    """The given rows of a list column, all of one length, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    return flat[starts[rows][:, None] + np.arange(dims)[None, :]].astype(np.float64).reshape(len(rows), dims)


CELLS = "vec_id long, vector array<double>, cell long, distance double"


def assign(pivots: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Adds each vector's cell, the nearest pivot of its length, and the distance; lengths without a pivot are a cell each, -1 - length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column("vector").offsets.to_numpy())
            cell, distance = -1 - lengths.astype(np.int64), np.zeros(len(lengths))
            for n in np.unique(lengths).tolist():
                if n not in pivots:
                    continue
                centre, number = pivots[n]
                of_length = np.flatnonzero(lengths == n)
                for at in range(0, len(of_length), 512):
                    rows = of_length[at : at + 512]
                    points = rows_of(batch.column("vector"), rows, n)
                    near = ((centre**2).sum(axis=1)[None, :] - 2 * points @ centre.T).argmin(axis=1)
                    cell[rows] = number[near]
                    distance[rows] = np.sqrt(((points - centre[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(cell), pa.array(distance)], names=["vec_id", "vector", "cell", "distance"])

    return run


TREES = "cell long, salt long, dims int, " + ", ".join(f"{x} binary" for x in Tree._fields)


def build(table: pa.Table) -> pa.Table:
    """The tree of a shard's vectors (cell, salt, vec_id, vector), as one row."""
    lists = table["vector"].combine_chunks()
    dims = int(lists.offsets[1].as_py() - lists.offsets[0].as_py())
    tree = ball_tree(rows_of(lists, np.arange(len(lists)), dims), table["vec_id"].to_numpy())
    row = {"cell": table["cell"][0].as_py(), "salt": table["salt"][0].as_py(), "dims": dims, **tree.packed()}
    types = {"cell": pa.int64(), "salt": pa.int64(), "dims": pa.int32()}
    return pa.table({name: pa.array([value], types.get(name, pa.binary())) for name, value in row.items()})


FOUND = "query_id long, query_key long, vec_id long, score long"
ASKED = "query_id long, query_key long, vector array<double>, floor long, home long, home_salt long, cell long"


def search_shard(k: int):
    def run(trees: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if trees.num_rows and asked.num_rows:
            (row,) = trees.select(["dims", *Tree._fields]).to_pylist()
            tree = Tree.unpacked(row.pop("dims"), row)
            ids, keys, floor = (asked[c].to_numpy() for c in ("query_id", "query_key", "floor"))
            for at in range(0, len(ids), BLOCK):
                rows = np.arange(at, min(at + BLOCK, len(ids)))
                scores, found = search(tree, rows_of(asked["vector"], rows, tree.points.shape[1]), ids[rows], floor[rows], k)
                i, j = np.nonzero(scores > NONE)
                for column, values in zip(out, (ids[rows][i], keys[rows][i], found[i, j], scores[i, j]), strict=True):
                    column.append(values)
        names = ("query_id", "query_key", "vec_id", "score")
        return pa.table({n: pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for n, c in zip(names, out, strict=True)})

    return run


def ask(sent, first: bool):
    """Queries (those columns of ASKED but cell) with the cells to search: the NEXT of greatest bound, or else all others, if not under the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column("vector").offsets.to_numpy())
            floor = batch.column("floor").to_numpy().astype(np.float64)
            for n in np.unique(lengths).tolist():
                of_length = np.flatnonzero(lengths == n)
                centre, radius, number = sent.value.get(n, (np.zeros((1, n)), np.full(1, np.inf), np.array([-1 - n])))
                for at in range(0, len(of_length), 256):
                    rows = of_length[at : at + 256]
                    points = rows_of(batch.column("vector"), rows, n)
                    most = bounds(points, np.sqrt((points**2).sum(axis=1)) + (0.0 if n in sent.value else 1.0), centre, radius)
                    rank = np.argsort(np.argsort(-most, axis=1, kind="stable"), axis=1)
                    i, j = np.nonzero((most >= floor[rows][:, None]) & ((rank < NEXT) == first))
                    out = batch.take(pa.array(rows[i]))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(number[j])], names=[*out.schema.names, "cell"])

    return run


def shard_size(rows: int) -> int:
    """Vectors in a shard: about 8 * sqrt(rows), from 1024 to 32768, so that shards and trees grow with the input up to what a task holds."""
    return 2 ** min(15, max(10, round(math.log2(8 * math.sqrt(max(rows, 1))))))


def draw_pivots(whole: DataFrame, rows: int, count: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Pivots and their numbers, by length; about twice as many as wanted are drawn by hash and the first are taken."""
    drawn = F.shiftrightunsigned(F.xxhash64("vec_id", "vector"), 11) * F.lit(2.0**-53)
    share = min(1.0, (2 * count + 16) / max(rows, 1))
    found = whole.filter(drawn < share).select(drawn.alias("drawn"), "vector").dropDuplicates(["drawn"]).toArrow().to_pylist()
    by: dict[int, list[tuple[int, list[float]]]] = {}
    for number, r in enumerate(sorted(found, key=lambda r: r["drawn"])[:count]):
        by.setdefault(len(r["vector"]), []).append((number, r["vector"]))
    return {n: (np.array([v for _, v in x], np.float64).reshape(len(x), n), np.array([i for i, _ in x], np.int64)) for n, x in by.items()}


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors (vec_id long, vector array<double> of whole numbers)."""
    spark = vectors.sparkSession
    whole = vectors.filter("vec_id is not null and vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))").select("vec_id", "vector")
    rows = whole.count()
    size = shard_size(rows)
    pivots = draw_pivots(whole, rows, min(PIVOTS, -(-rows // size)))
    cells = materialize(whole.mapInArrow(assign(pivots), CELLS))
    salts = materialize(cells.groupBy("cell").agg(F.max("distance").alias("radius"), F.ceil(F.count("*") / size).cast("bigint").alias("salts")))
    # As many rows as there are pivots at most.
    radius = {r.cell: r.radius for r in salts.filter("cell >= 0").collect()}
    kept = {n: np.array([i in radius for i in number.tolist()], bool) for n, (_, number) in pivots.items()}
    balls = {n: (centre[kept[n]], np.array([radius[i] for i in number[kept[n]].tolist()]), number[kept[n]]) for n, (centre, number) in pivots.items()}
    sent = spark.sparkContext.broadcast(balls)
    # Numbered as scanned, so that repeated rows spread too; used once, to build the trees that are written.
    placed = cells.withColumn("number", F.monotonically_increasing_id()).join(salts, "cell").withColumn("salt", F.pmod("number", "salts"))
    trees = materialize(placed.select("cell", "salt", "vec_id", "vector").groupBy("cell", "salt").applyInArrow(build, TREES), "lz4")

    queries = (
        cells.filter(is_query).withColumn("query_key", F.xxhash64("vec_id", "vector")).dropDuplicates(["vec_id", "query_key"]).join(salts, "cell")
        .select(F.col("vec_id").alias("query_id"), "query_key", "vector", F.col("cell").alias("home"), F.pmod("query_key", "salts").alias("home_salt"))
    )
    queries = materialize(queries)
    slices = max(1, -(-queries.count() // SLICE))
    key = ["cell", "salt", "slice"]
    shards = trees.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")

    def searched(asked: DataFrame) -> DataFrame:
        dealt = asked.withColumn("slice", F.pmod(F.xxhash64("query_key"), F.lit(slices)).cast("int")).select(*key, "query_id", "query_key", "vector", "floor")
        return materialize(shards.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(search_shard(k), FOUND))

    found = searched(queries.withColumnsRenamed({"home": "cell", "home_salt": "salt"}).withColumn("floor", F.lit(NONE).cast("bigint")))
    for first in (True, False):
        kth = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(F.col("query_id").alias("kq"), F.col("query_key").alias("kk"), F.col("score").alias("floor"))
        asking = queries.join(kth, (F.col("query_id") == F.col("kq")) & (F.col("query_key") == F.col("kk")), "left").withColumn("floor", F.coalesce("floor", F.lit(NONE).cast("bigint")))
        wanted = asking.select("query_id", "query_key", "vector", "floor", "home", "home_salt").mapInArrow(ask(sent, first), ASKED).join(salts, "cell")
        to = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
        found = found.unionByName(searched(to.filter("cell <> home or salt <> home_salt")))
    release(cells)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    # floor gives a long: from 2**52 on, doubles are whole numbers already.
    scaled = F.transform("embedding", lambda x: F.lit(256.0) * x.cast("double"))
    whole = F.transform(scaled, lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y))
    vectors = documents(spark, sf_dir, "embeddings").select("vec_id", whole.alias("vector"))
    return top_k(vectors, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
