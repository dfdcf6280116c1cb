"""Packing by cutting stock: column generation over the histogram of lengths, patterns dealt to ranked documents.

A document's tokens are cut into full sequences and a remainder. Remainders are counted by length classes of `WIDTH`
tokens. A linear program covers the classes' counts by patterns, multisets of classes that fit a sequence; a knapsack
dynamic program over the current prices finds the pattern to add, until none pays. Pattern counts are rounded down;
what is left, some pieces for each pattern at most, is packed by best fit from long to short.

Each remainder has a rank in its class, from its place in its task and the tasks' counts, so that no class is one
task's work. A pattern takes a range of ranks of each of its classes, which tells a piece's sequence by arithmetic. What
the driver holds, histogram, patterns and ranges, is bounded by classes and patterns, whatever the number of rows.

Documents may come in windows, numbered in the order in which sequences are to be used, as along a curriculum: each
window is planned for itself, in a task of its own, and its sequences are numbered behind those of the windows before.

Null text is empty: one token, the end. Equal rows and rows with one doc_id are packed each for itself. An empty table has no
pieces. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.llm.common import documents, materialize, partitions, slices

LENGTH = 2048
WIDTH = 8
END = 1
#: A pattern enters when its pieces are worth more than this many sequences.
PAYS = 1.0005
VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"


class Encoder:
    """Token ids of texts: those of the tokenizers library, by tiktoken with the same ranks where both are known to agree.

    Both cut texts by one pattern; its classes of characters are checked to agree below U+0250, so that other texts, and
    those with the special token, are left to tokenizers.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64
        import re

        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._whole = Tokenizer.from_file(json_path)
        self._other = re.compile("[^\x00-ɏ]")

    def __call__(self, text: str) -> list[int]:
        if SPECIAL in text or self._other.search(text):
            return self._whole.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One for each process; the vocabulary's files are found on the machine that runs the task."""
    if vocabulary not in _ENCODERS:
        import public_tokenizers

        _ENCODERS[vocabulary] = Encoder(public_tokenizers.path(f"{vocabulary}.json"), public_tokenizers.path(f"{vocabulary}.tiktoken"), public_tokenizers.PATTERN)
    return _ENCODERS[vocabulary]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, task int, place long"


def cut_pieces(vocabulary: str, length: int, width: int):
    """Pieces of each document; class 0: full sequences, else the remainder's length over width, rounded up; place: count of the class in the task so far.

    The classes of window w are w times the number of classes higher.
    """
    classes = length // width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(vocabulary), TaskContext.get().partitionId()
        places: Counter[int] = Counter()
        for batch in batches:
            for part in slices(batch):
                out: list[tuple] = []
                for doc_id, text, window in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "window")), strict=True):
                    ids = np.array([*encode(text or ""), END], "<u4")
                    for at in range(0, len(ids), length):
                        piece = ids[at : at + length]
                        kind = window * classes + (0 if len(piece) == length else -(-len(piece) // width))
                        out.append((doc_id, at, len(piece), zlib.crc32(piece.tobytes()), len(ids), kind, task, places[kind]))
                        places[kind] += 1
                columns = list(zip(*out, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i in (5, 6) else pa.int64()) for i, c in enumerate(columns)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def best_pattern(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes (ascending) within room that is worth most, by dynamic programming over the room."""
    worth, choice = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        worth[c] = worth[c - 1]
        if k := fits[c]:
            values = prices[:k] + worth[c - sizes[:k]]
            i = int(values.argmax())
            if values[i] > worth[c] + 1e-12:
                worth[c], choice[c] = values[i], i
    pattern, c = np.zeros(len(sizes)), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(worth[room]), pattern


def cutting_stock(demand: dict[int, int], room: int) -> list[tuple[dict[int, int], float]]:
    """Patterns ({size: pieces}) and how often each is used, covering the demand by about the least number of sequences.

    The linear program by the revised simplex method from the patterns of one size each; columns are made by best_pattern.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), np.int64)
    m = len(sizes)
    if not m:
        return []
    columns = np.diag(room // sizes).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    x = inverse @ np.array([demand[s] for s in sizes.tolist()], float)
    cost = np.ones(m)
    for _ in range(20 * m + 200):
        prices = cost @ inverse
        if prices.min() < -1e-9:  # covering more than is asked for costs nothing
            entering, c = np.zeros(m), 0.0
            entering[prices.argmin()] = -1.0
        else:
            value, entering = best_pattern(sizes, np.maximum(prices, 0), room)
            c = 1.0
            if value <= PAYS:
                break
        step = inverse @ entering
        rising = step > 1e-9
        if not rising.any():
            break
        ratio = np.full(m, np.inf)
        ratio[rising] = np.maximum(x[rising], 0) / step[rising]
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        inverse[out] /= step[out]
        others = np.arange(m) != out
        inverse[others] -= step[others, None] * inverse[out]
        columns[:, out], cost[out] = entering, c
    return [({int(s): int(n) for s, n in zip(sizes, columns[:, j], strict=True) if n > 0}, float(x[j])) for j in range(m) if cost[j] and x[j] > 1e-9]


def best_fit(left: dict[int, int], room: int) -> list[dict[int, int]]:
    """Sequences for pieces by size, longest first, each where it leaves least room."""
    bins: list[Counter[int]] = []
    open_: list[tuple[int, int]] = []
    for size in sorted(left, reverse=True):
        for _ in range(left[size]):
            at = bisect_left(open_, (size, -1))
            if at < len(open_):
                free, b = open_.pop(at)
            else:
                free, b = room, len(bins)
                bins.append(Counter())
            bins[b][size] += 1
            if free > size:
                insort(open_, (free - size, b))
    return [dict(b) for b in bins]


def plan(demand: dict[int, int], room: int) -> tuple[dict[int, np.ndarray], int]:
    """For each size rows (first rank, pieces for each sequence, first sequence), by first rank, and the number of sequences."""
    used: Counter[int] = Counter()
    ranges: dict[int, list[tuple[int, int, int]]] = {s: [] for s in demand}
    sequence = 0

    def deal(pattern: dict[int, int], times: int) -> None:
        nonlocal sequence
        for size, n in pattern.items():
            if used[size] < demand[size]:
                ranges[size].append((used[size], n, sequence))
                used[size] = min(demand[size], used[size] + n * times)
        sequence += times

    for pattern, times in sorted(cutting_stock(demand, room), key=lambda p: (-p[1], sorted(p[0].items()))):
        if whole := int(times + 1e-6):
            deal(pattern, whole)
    for pattern in best_fit({s: n - used[s] for s, n in demand.items() if n > used[s]}, room):
        deal(pattern, 1)
    return {s: np.array(r, np.int64).reshape(-1, 3) for s, r in ranges.items()}, sequence


PLAN = "window int, size int, first long, each long, sequence long"


def plan_window(classes: int, room: int):
    """A window's plan from its classes' counts: for each size rows (first rank, pieces for each sequence, first sequence); size 0: full sequences, behind the others; -1: the number of sequences."""

    def run(table: pa.Table) -> pa.Table:
        demand = dict(zip((table["class"].to_numpy() % classes).tolist(), table["n"].to_pylist(), strict=True))
        full = demand.pop(0, 0)
        ranges, sequences = plan(demand, room)
        rows = [(size, *row) for size, found in ranges.items() for row in found.tolist()] + [(0, 0, 1, sequences), (-1, 0, 0, sequences + full)]
        window = [table["window"][0].as_py()] * len(rows)
        return pa.table([pa.array(c, pa.int32() if i < 2 else pa.int64()) for i, c in enumerate([window, *zip(*rows, strict=True)])], names=[x.split()[0] for x in PLAN.split(", ")])

    return run


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, width: int = WIDTH, window: Column | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all pieces of docs (doc_id, text). window: a document's window, an int from 0."""
    spark = docs.sparkSession
    classes = length // width + 1
    numbered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (F.lit(0) if window is None else window).alias("window"))
    pieces = materialize(numbered.mapInArrow(cut_pieces(vocabulary, length, width), PIECES))
    counts = pieces.groupBy("class", "task").agg(F.count("*").alias("n"))
    by_window = counts.groupBy("class").agg(F.sum("n").alias("n")).withColumn("window", F.floor(F.col("class") / classes).cast("int"))
    planned = by_window.repartition(partitions(spark), "window").groupBy("window").applyInArrow(plan_window(classes, length // width), PLAN).collect()
    # For each class a table of plan(), its sequences numbered behind those of the windows before.
    tables: dict[int, list[tuple[int, int, int]]] = {}
    sizes = sorted((r["window"], r["sequence"]) for r in planned if r["size"] < 0)
    bases = {w: end - n for (w, n), end in zip(sizes, accumulate(n for _, n in sizes), strict=True)}
    for r in planned:
        if r["size"] >= 0:
            tables.setdefault(r["window"] * classes + r["size"], []).append((r["first"], r["each"], bases[r["window"]] + r["sequence"]))
    ranges = {kind: np.array(sorted(rows), np.int64) for kind, rows in tables.items()}
    sent = spark.sparkContext.broadcast(ranges)
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = pieces.join(bases, ["class", "task"]).withColumn("rank", F.col("base") + F.col("place")).drop("base", "place", "task")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            at = np.zeros(len(rank), np.int64)
            for k in np.unique(kind).tolist():
                rows = np.flatnonzero(kind == k)
                table = sent.value[k]
                which = np.searchsorted(table[:, 0], rank[rows], "right") - 1
                first, each, base = table[which].T
                at[rows] = base + (rank[rows] - first) // each
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(at)], names=[*names, "sequence_id"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = ranked.select(*names, "class", "rank").mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
