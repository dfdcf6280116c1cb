"""Removes repeated passages: every byte in a string of `LENGTH` bytes that also starts earlier in the corpus.

A string's anchor is the least hash of the `GRAM`-byte grams in it. Equal strings have equal anchors, so that the corpus
falls into runs of neighbouring strings with one anchor, and only runs that share an anchor need be compared. Anchors are
counted first; a run whose anchor is the only one of its kind goes no further.

Runs with a shared anchor meet in one partition, sorted by anchor, and are taken some anchors at a time: a suffix array of
their bytes is built in two stages, in which suffixes smaller than their successors are sorted directly and the others are
induced by scanning the buckets of first bytes in order. Neighbours in it whose common prefix is `LENGTH` long are equal
strings; all but the earliest are marked. Runs of an anchor that has over `COMMON` bytes of them are dealt by anchor and content instead,
so that equal runs, however many, are one row from each task; the block of a suffix array is then a part of an anchor's runs, and
the strings that it leaves are dealt once more, each by its own hash, and compared likewise. That only splits the work:
in either way it is the bytes in a suffix array that tell strings equal. No passage, however frequent, is one task's work.

Texts equal to an earlier one are told by a 64-bit hash and need none of this: they go whole if they have `LENGTH` bytes.
Earlier means: smaller doc_id, null first; of rows with one doc_id smaller hash of the text; of equal rows one is the
earlier. Null and empty texts have no bytes. Shorter texts are kept. What a cut through a character leaves of its bytes is
kept as bytes; the pipeline stage drops it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import BASE, BYTE_WORDS, INVERSE, cached_powers, documents, materialize, mix, partitions, powers, release, slices, sorted_tables, text_bytes

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1
#: Bytes of runs that one suffix array takes; an anchor's runs may be more, if they are not common.
BLOCK = 1 << 20
#: Bytes of runs beyond which an anchor is common.
COMMON = BLOCK
LEAST = -(1 << 63)


def string_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings with one anchor: (row, first start, count, anchor); starts count from the first row's begin."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.view(np.uint64)
    grams = byte_hashes(data, GRAM)
    least, step = grams, 1
    while step * 2 <= SPAN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - step)], least[SPAN - step :])
    long = np.diff(offsets) >= LENGTH
    edge = np.zeros(n + 1, np.int8)
    edge[offsets[:-1][long]] += 1
    edge[offsets[1:][long] - LENGTH + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge, dtype=np.int8)[: len(least)])
    if not len(at):
        return none, none, none, none.view(np.uint64)
    anchor = least[at]
    starts = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    return np.searchsorted(offsets, at[starts], "right") - 1, at[starts], np.diff(np.append(starts, len(at))), anchor[starts]


def byte_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash for each stretch of so many bytes."""
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_WORDS[data] * cached_powers(BASE, n), out=prefix[1:])
    return mix((prefix[length:] - prefix[:-length]) * cached_powers(INVERSE, n)[: n - length + 1])


def anchor_places(data: np.ndarray, start: np.ndarray, count: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """1 for a run whose strings all have their first anchor gram at one place, else 2: only then can two of them be equal."""
    if not len(start):
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(byte_hashes(data, GRAM), SPAN)
    out = np.ones(len(start), np.int64)
    for at in range(0, len(start), 1 << 14):
        rows = slice(at, at + (1 << 14))
        last = start[rows] + count[rows] - 1
        a, b = ((windows[x] == anchor[rows][:, None]).argmax(axis=1) + x for x in (start[rows], last))
        out[rows] += a != b
    return out


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, text_hash, places, bytes) of each text once a task; bytes: of the anchor's runs."""
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch):
            ids = part.column("text_hash").to_numpy()
            fresh = np.zeros(len(ids), bool)
            for i, x in enumerate(ids.tolist()):
                fresh[i] = x not in seen
                seen.add(x)
            data, offsets = text_bytes(part.column("text"))
            row, start, count, anchor = string_runs(data, offsets)
            keep = fresh[row]
            row, start, count, anchor = row[keep], start[keep], count[keep], anchor[keep]
            order = np.lexsort((anchor, row))
            row, start, count, anchor = row[order], start[order], count[order], anchor[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])])) if len(row) else np.zeros(0, np.int64)
            places, size = (np.add.reduceat(x, first) if len(first) else x for x in (anchor_places(data, start, count, anchor), count + LENGTH - 1))
            yield pa.RecordBatch.from_arrays([pa.array(anchor[first].view(np.int64)), pa.array(ids[row[first]]), pa.array(places), pa.array(size)], names=["anchor", "text_hash", "places", "bytes"])


RUNS = "kind int, anchor long, at long, text_hash long, start long, strings long, bytes binary, content long, twice boolean"
_RUN_FIELDS = [x.split() for x in RUNS.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def run_rows(n: int, kind: int, **columns) -> pa.RecordBatch:
    """Rows of RUNS; columns that aren't given are null."""
    columns["kind"] = np.full(n, kind, np.int32)
    return pa.RecordBatch.from_arrays(
        [(c if isinstance(c := columns[k], pa.Array) else pa.array(c, _TYPES[t])) if k in columns else pa.nulls(n, _TYPES[t]) for k, t in _RUN_FIELDS], names=[k for k, _ in _RUN_FIELDS]
    )


def piece_hashes(pieces: list[bytes]) -> np.ndarray:
    """A hash of each piece's bytes, which only deals them out."""
    return np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in pieces], np.int64)


class CommonRuns:
    """Runs with common anchors of a task: of equal ones the earliest is kept, the others are repeats. Full, it is emptied."""

    def __init__(self, most: int):
        self.kept: dict[tuple[int, bytes], tuple] = {}
        self.later: list[tuple] = []
        self.size, self.most = 0, most

    def add(self, key: tuple[int, bytes], run: tuple) -> None:
        """run: (at, text_hash, start, strings, twice)."""
        known = self.kept.get(key)
        if known is None:
            self.kept[key] = run
            self.size += len(key[1]) + 200
        elif known[:3] != run[:3]:
            self.kept[key], later = (run, known) if run[:3] < known[:3] else (known, run)
            self.later.append(later)

    def rows(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Kind 1: the runs kept, with bytes; kind 2: the repeats."""
        if self.later and (last or len(self.later) > 1 << 14):
            at, ids, start, strings, _ = map(list, zip(*self.later, strict=True))
            yield run_rows(len(at), 2, at=at, text_hash=ids, start=start, strings=strings)
            self.later.clear()
        if self.kept and (last or self.size > self.most):
            pieces = [p for _, p in self.kept]
            at, ids, start, strings, twice = map(list, zip(*self.kept.values(), strict=True))
            yield run_rows(len(at), 1, anchor=[a for a, _ in self.kept], at=at, text_hash=ids, start=start, strings=strings, bytes=pieces, content=piece_hashes(pieces), twice=twice)
            self.kept.clear()
            self.size = 0


def shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts (at, text_hash, text, wanted) the runs with wanted anchors, with their bytes.

    Kind 0: with an anchor of few strings. Kind 1: with a common anchor, of equal runs of the task the earliest; kind 2: the others.
    """
    held = CommonRuns(8 * BLOCK)
    for batch in batches:
        for part in slices(batch):
            data, offsets = text_bytes(part.column("text"))
            row, start, count, anchor = string_runs(data, offsets)
            ats, ids = part.column("at").to_numpy(), part.column("text_hash").to_numpy()
            lists = part.column("wanted")
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
            table = dict(zip(zip(owner.tolist(), flat.field("anchor").to_pylist(), strict=True), flat.field("common").to_pylist(), strict=True))
            kind = np.array([table.get(k, -1) for k in zip(row.tolist(), anchor.view(np.int64).tolist(), strict=True)], np.int8)
            chosen = np.flatnonzero(kind >= 0)
            chosen, common = chosen[kind[chosen] == 0], chosen[kind[chosen] == 1]
            pieces = lambda rows: [data[s : s + c + LENGTH - 1].tobytes() for s, c in zip(start[rows].tolist(), count[rows].tolist(), strict=True)]  # noqa: E731, B023
            twice = lambda rows: anchor_places(data, start[rows], count[rows], anchor[rows]) > 1  # noqa: E731, B023
            places = lambda rows: (ats[row[rows]], ids[row[rows]], start[rows] - offsets[row[rows]], count[rows])  # noqa: E731, B023
            at, text_hash, begin, strings = places(chosen)
            yield run_rows(len(chosen), 0, anchor=anchor[chosen].view(np.int64), at=at, text_hash=text_hash, start=begin, strings=strings, bytes=pieces(chosen), twice=twice(chosen))
            for a, piece, *run in zip(anchor[common].view(np.int64).tolist(), pieces(common), *(x.tolist() for x in (*places(common), twice(common))), strict=True):
                held.add((a, piece), tuple(run))
            yield from held.rows(False)
    yield from held.rows(True)


def words_at(text: np.ndarray) -> np.ndarray:
    """For each byte the eight from it as a number that sorts like them; text must have eight bytes more than are asked for."""
    return np.ndarray((len(text) - 7,), ">u8", text.tobytes(), strides=(1,))


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether a suffix is smaller than the one that starts a byte later; the last one isn't."""
    n = len(text)
    if not n:
        return np.zeros(0, bool)
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = np.append(text[change] < text[change + 1], False)
    return rises[np.searchsorted(change, np.arange(n))]


def sort_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Starts in the order of `depth` bytes from each: sorted by eight bytes, then only what ties by the next eight."""
    key = words[at].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(at) else np.zeros(0, np.int64)
    for d in range(8, depth, 8):
        tied = np.zeros(len(at), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        key = words[np.minimum(at[rows] + d, len(words) - 1)].astype(np.uint64)
        order = np.lexsort((key, group[rows]))
        at[rows], key = at[rows][order], key[order]
        new = np.zeros(len(at), bool)
        new[rows[1:]] = key[1:] != key[:-1]
        new[1:] |= ~same
        group = np.cumsum(new)
    return at


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Starts of all suffixes in the order of at least `depth` bytes."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    words = words_at(np.concatenate([text, np.zeros(depth + 16, np.uint8)]))
    smaller = smaller_than_next(text)
    direct = sort_directly(np.flatnonzero(smaller), words, depth + 8)
    bounds = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    # The empty suffix is the least; the last byte's, not smaller than it, comes first in its bucket.
    induced[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        front = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        own = [front]
        while len(front):
            front = front[front > 0] - 1
            front = front[~smaller[front] & (text[front] == c)]
            own.append(front)
        items = np.concatenate([*own, direct[bounds[c] : bounds[c + 1]]])
        out.append(items)
        before = items[items > 0] - 1
        before = before[~smaller[before] & (text[before] > c)]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            for x in np.split(before, cuts[1:]):
                induced[text[x[0]]].append(x)
    return np.concatenate(out)


def common_prefix(text: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Whether each entry of the order has its first `most` bytes in common with the one before."""
    words = words_at(np.concatenate([text, np.zeros(most + 16, np.uint8)]))
    same = np.ones(max(len(order) - 1, 0), bool)
    rows = np.arange(len(same))
    for d in [*range(0, most - 8, 8), most - 8]:
        rows = rows[words[order[rows + 1] + d] == words[order[rows] + d]]
    same[:] = False
    same[rows] = True
    return np.concatenate([[False], same]) if len(order) else same


def mark_block(pieces: list[bytes], count: np.ndarray, document: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, strings) of stretches of strings that are later than an equal one; (row, start, bytes) of all other strings.

    document: ranks, earlier ones smaller.
    """
    text = np.frombuffer(b"".join(pieces), np.uint8)
    size = count + LENGTH - 1
    base = np.cumsum(size) - size
    row = np.repeat(np.arange(len(pieces)), size)
    inner = np.arange(len(text)) - base[row]
    valid = inner < count[row]
    order = suffix_array(text)
    order = order[valid[order]]
    group = np.cumsum(~common_prefix(text, order)) - 1
    when = (document[row[order]] << 32) + start[row[order]] + inner[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    later = order[when > np.minimum.reduceat(when, first)[group]]
    marked = np.zeros(len(text) + 1, bool)
    marked[later] = True
    least = np.flatnonzero(valid & ~marked[:-1])
    at = np.flatnonzero(marked)
    # A stretch ends with its run: the bytes after the last string of a run are no starts.
    begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1])) if len(at) else at
    lengths = np.diff(np.append(begins, len(at)))
    at = at[begins]
    return row[at], start[row[at]] + inner[at], lengths, row[least], start[row[least]] + inner[least], np.lib.stride_tricks.sliding_window_view(text, LENGTH)[least]


MARKS = "at long, text_hash long, start long, strings long"


def marked(table: pa.Table, alone: bool) -> Iterator[tuple[str, tuple]]:
    """Marks of a table of runs, sorted by anchor: ("later", columns of MARKS), and ("least", (run, start, bytes)) of the strings that aren't marked.

    Of equal runs the earliest is compared with the others of its anchor, some anchors at a time. Equal rows, in several tasks, have
    the same run more than once: it is no repeat of itself. Runs whose anchor has no other are compared with nothing, unless `alone`.
    """
    anchor, count, at, ids, start = (table[c].to_numpy() for c in ("anchor", "strings", "at", "text_hash", "start"))
    twice, content = table["twice"].to_numpy(), table["bytes"].to_pylist()
    rank = np.lexsort((ids, at))
    document = np.zeros(len(rank), np.int64)
    document[rank] = np.cumsum(np.concatenate([[0], (at[rank][1:] != at[rank][:-1]) | (ids[rank][1:] != ids[rank][:-1])]))
    order = np.lexsort((start, document, anchor))
    earliest: dict[tuple[int, bytes], int] = {}
    first, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    for i, (j, a) in enumerate(zip(order.tolist(), anchor[order].tolist(), strict=True)):
        k = earliest.setdefault((a, content[j]), j)
        first[i] = k == j
        later[i] = document[k] != document[j] or start[k] != start[j]
    whole = order[later]
    yield "later", (at[whole], ids[whole], start[whole], count[whole])
    order = order[first]
    if not alone:
        _, group, size = np.unique(anchor[order], return_inverse=True, return_counts=True)
        order = order[(size[group] > 1) | twice[order]]
    total = np.cumsum(count[order] + LENGTH - 1)
    ends = np.flatnonzero(np.concatenate([anchor[order][1:] != anchor[order][:-1], [True]])) + 1 if len(order) else order
    if alone:
        ends = np.arange(1, len(order) + 1)
    begin = 0
    while begin < len(order):
        fits = ends[(ends > begin) & (total[ends - 1] <= (total[begin - 1] if begin else 0) + BLOCK)]
        end = int(fits[-1]) if len(fits) else int(ends[np.searchsorted(ends, begin, "right")])
        rows = order[begin:end]
        row, place, strings, least, least_at, least_bytes = mark_block([content[j] for j in rows.tolist()], count[rows], document[rows], start[rows])
        yield "later", (at[rows[row]], ids[rows[row]], place, strings)
        yield "least", (at[rows[least]], ids[rows[least]], least_at, least_bytes)
        begin = end


def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of a partition's runs (or strings: runs of one), sorted by anchor."""
    for table, _ in sorted_tables(batches, ["anchor"], BLOCK):
        for what, columns in marked(table, False):
            if what == "later":
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["at", "text_hash", "start", "strings"])


def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with common anchors, dealt and sorted by anchor and content: repeats in a block (kind 2), and the other strings one by one (kind 1).

    A string's anchor, from here on, is its own hash: however common, it is one row from each block at most.
    """
    for table, _ in sorted_tables(batches, ["anchor", "content"], BLOCK):
        for what, (at, ids, start, rest) in marked(table, True):
            if what == "later":
                yield run_rows(len(at), 2, at=at, text_hash=ids, start=start, strings=rest)
                continue
            for i in range(0, len(at), 1 << 14):
                rows = slice(i, i + (1 << 14))
                flat = np.ascontiguousarray(rest[rows])
                n = len(flat)
                pieces = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * LENGTH).astype(np.int32)), pa.py_buffer(flat)])
                key = flat.astype(np.uint64) @ powers(BASE, LENGTH) if n else np.zeros(0, np.uint64)
                yield run_rows(n, 1, anchor=mix(key).view(np.int64), at=at[rows], text_hash=ids[rows], start=start[rows], strings=np.ones(n, np.int64), bytes=pieces, twice=np.zeros(n, bool))


def cut(data: bytes, marks: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left without strings that start in the marked stretches (start, strings), and how many stretches of bytes went."""
    kept, spans, at = [], 0, 0
    end = -1
    for start, strings in sorted(marks):
        if start > end:
            spans += 1
            kept.append(data[at:start])
        end = max(end, start + strings + LENGTH - 1)
        at = end
    kept.append(data[at:])
    return b"".join(kept), spans


def repeats(docs: DataFrame) -> DataFrame:
    """The documents' columns with text_hash, copy (a whole text that came earlier) and marks (start, strings), null without any."""
    spark = docs.sparkSession
    parts = partitions(spark)
    hashed = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("at", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST)))
    slim = hashed.groupBy("at", "text_hash").agg(F.count("*").alias("rows"))
    slim = materialize(slim)
    # Written, so that the join of a text with many copies can be split.
    earliest = materialize(slim.groupBy("text_hash").agg(F.min("at").alias("first")))
    found = materialize(hashed.filter(F.octet_length("text") >= LENGTH).select("text", "text_hash").mapInArrow(anchors, "anchor long, text_hash long, places long, bytes long"), "lz4")
    shared = (
        found.groupBy("anchor").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi"), F.max("places").alias("places"), F.sum("bytes").alias("bytes"))
        .filter("lo <> hi or places > 1").select("anchor", (F.col("bytes") > COMMON).alias("common"))
    )
    wanted = materialize(found.select("anchor", "text_hash").join(shared, "anchor").groupBy("text_hash").agg(F.collect_set(F.struct("anchor", "common")).alias("wanted")))
    release(found)
    originals = wanted.join(earliest, "text_hash").withColumnsRenamed({"text_hash": "of_hash", "first": "of_at"})
    texts = hashed.join(originals, (F.col("at") == F.col("of_at")) & (F.col("text_hash") == F.col("of_hash"))).select("at", "text_hash", "text", "wanted")
    runs = materialize(texts.mapInArrow(shared_runs, RUNS))
    columns = ["anchor", "at", "text_hash", "start", "strings", "bytes", "twice"]
    few = runs.filter("kind = 0").select(columns).repartition(parts, "anchor").sortWithinPartitions("anchor")
    common = runs.filter("kind = 1").select(*columns, "content").repartition(parts, "anchor", "content").sortWithinPartitions("anchor", "content")
    strings = materialize(common.mapInArrow(spread, RUNS))
    single = strings.filter("kind = 1").select(columns).repartition(parts, "anchor").sortWithinPartitions("anchor")
    repeated = reduce(DataFrame.unionByName, [few.mapInArrow(mark, MARKS), single.mapInArrow(mark, MARKS), *(x.filter("kind = 2").select("at", "text_hash", "start", "strings") for x in (runs, strings))])
    marks = materialize(repeated.groupBy("at", "text_hash").agg(F.collect_set(F.struct("start", "strings")).alias("marks")))
    release(runs, strings, wanted)
    known = (
        slim.join(earliest, "text_hash").select("at", "text_hash", "rows", (F.col("at") > F.col("first")).alias("copy"))
        .join(marks, ["at", "text_hash"], "left").withColumnsRenamed({"at": "of_at", "text_hash": "of_hash"})
    )
    joined = hashed.join(known, (F.col("at") == F.col("of_at")) & (F.col("text_hash") == F.col("of_hash")))
    told = joined.filter("copy or rows = 1").select(*docs.columns, "copy", "marks")
    if slim.filter("rows > 1").limit(1).count():
        told = told.unionByName(first_of_equal(joined.filter("rows > 1 and not copy")).select(*docs.columns, "copy", "marks"))
    return told


def first_of_equal(rows: DataFrame) -> DataFrame:
    """Of rows alike in at and text_hash all but one become copies; it doesn't matter which. However many are alike, no task gathers them."""
    numbered = materialize(rows.withColumn("row_no", F.monotonically_increasing_id()))
    first = numbered.groupBy("at", "text_hash").agg(F.min("row_no").alias("first_no")).select("first_no")
    return numbered.join(first, F.col("row_no") == F.col("first_no"), "left").withColumn("copy", F.col("first_no").isNull())


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [[], [], [], []]
        for data, spans, left in kept(batch):
            for c, x in zip(columns, (len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest()), strict=True):
                c.append(x)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def kept(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, bytes]]:
    """Each text's bytes, the number of stretches removed, and the bytes left."""
    for text, copy, marks in zip(batch.column("text"), batch.column("copy").to_pylist(), batch.column("marks").to_pylist(), strict=True):
        data = text.as_buffer().to_pybytes() if text.is_valid else b""
        if copy and len(data) >= LENGTH:
            yield data, 1, b""
        elif marks and not copy:
            left, spans = cut(data, [(m["start"], m["strings"]) for m in marks])
            yield data, spans, left
        else:
            yield data, 0, data


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(documents(spark, sf_dir).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    return found.mapInArrow(digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
