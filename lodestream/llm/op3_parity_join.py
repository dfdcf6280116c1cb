"""N-gram Jaccard join by parity sketches: XOR the shingles of a set into words, join words by pigeonhole, verify.

A document's set is its distinct word shingles. Documents with one set are a class, and only classes are joined.
A set's sketch has a power of two of 64-bit words; each shingle is XORed into the word that its hash names. A shingle
that only one of two sets has changes one word, so that the number of words that differ, the sketches' Hamming distance
over words, is at most the symmetric difference, and that of two linked sets of sizes a <= b is at most
(a + b) / 9 <= a / 4. Ordered alike, the first a // 4 + 1 words other than zero of both sketches then have one in common,
if any word is common: these are a class's keys. None need be where both sketches have no more words other than zero than may
differ, a // 4. A set with so few has keys of a second kind as well, its first a // 4 + 1 shingles themselves: linked sets have
one of these in common, since fewer differ than there are. The order puts words made of frequent shingles last. Sketches are compared within bands of
sizes that differ by less than two; a set within a quarter of the lower end is in the band below too.

Classes that share a key are first tried with the least of them, then, where a key still has classes of several components,
with those that meet most others: in a group of near copies these are the ones with fewest changes. That settles groups
without listing their pairs. Then all pairs are formed under each key, only across components. Candidates must pass a sketch
of bits as well, in which each shingle flips one: no more bits may differ than shingles can; the last pairs pass it before
they leave their task. What passes is verified on whole sets.

Sets of under four shingles link to equal sets only. Null and empty texts, and those of white space, have the empty set
and link to nothing. Rows with one doc_id are documents of their own; a null doc_id is passed over in the least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import documents, materialize, mix, partitions, shingle_hashes, slices, sorted_tables, text_bytes, word_hashes
from lodestream.llm.components import components

K = 5
#: In a slice of text, a shingle of so many documents is reported as frequent; the order of keys depends on it, no result.
FREQUENT = 8
FREQUENT_KEPT = 1 << 16
LINK = (100, 80)
#: Bytes of sorted keys that are taken at once.
BLOCK = 1 << 22
#: Classes of a key that a task pairs with each other, or with as many others, about.
PAIRED = 1 << 12
#: Classes of a key that are tried with all others of it before pairs are formed.
HUBS = 4
_WORD, _PLACE, _SET, _BIT, _SHINGLE = (np.uint64(x) for x in (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47, 0xC2B2AE3D27D4EB4F, 0xD1342543DE82EF95))


def shingle_sets(column: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in order, one text after another, and where each begins."""
    data, offsets = text_bytes(column)
    hashes, bounds = shingle_hashes(*word_hashes(data, offsets), k)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.argsort(hashes)
    order = order[np.argsort(row[order].astype(np.int32), kind="stable")]
    hashes, row = hashes[order], row[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[first], row[first]
    return hashes, np.searchsorted(row, np.arange(len(bounds)))


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds, modulo 2**64."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def class_of(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit word for each set, whatever the order of its hashes."""
    return signed(mix(per_row(mix(sets ^ _SET), bounds) + np.diff(bounds).astype(np.uint64)))


SKETCHED = "kind int, doc_id long, n long, class long, text_hash long, sketch binary, small binary"


def bit_sketches(sets: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """For each of the rows a bit sketch: each shingle flips the bit that its hash names, of the power of two that is at least twice the set's size."""
    size = bounds[rows + 1] - bounds[rows]
    bits = np.int64(1) << np.maximum(6, np.ceil(np.log2(np.maximum(2 * size, 1)))).astype(np.int64)
    base = np.cumsum(bits) - bits
    entry = np.repeat(np.arange(len(rows)), size)
    token = sets[np.arange(len(entry)) - (np.cumsum(size) - size)[entry] + bounds[rows][entry]]
    at = base[entry] + (mix(token ^ _BIT) & (bits[entry] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(bool), bitorder="little")
    return [packed[b // 8 : (b + n) // 8].tobytes() for b, n in zip(base.tolist(), bits.tolist(), strict=True)]


def hamming(x: np.ndarray, y: np.ndarray) -> int:
    """Bits that differ; the longer sketch is folded to the other's length, as if it had been made so long."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def folded(sketch: bytes, most: int = 128) -> bytes:
    """A sketch of `most` bytes at most: what it had been, made so long."""
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > most:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: a document's set size and class. 1: a frequent shingle (in class) and in how many documents (in n). 2: a class's bit sketch, once a task."""
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch):
            sets, bounds = shingle_sets(part.column("text"))
            rows = len(bounds) - 1
            token, count = np.unique(sets, return_counts=True)
            often = count >= FREQUENT
            token, count = token[often], count[often]
            size, name = np.diff(bounds), class_of(sets, bounds)
            new = fresh(name, size, seen)
            sketches = bit_sketches(sets, bounds, new)
            more = len(token) + len(new)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([0, 1, 2], np.int32), [rows, len(token), len(new)])),
                    pa.concat_arrays([part.column("doc_id").cast(pa.int64()), pa.nulls(more, pa.int64())]),
                    pa.array(np.concatenate([size, count, size[new]])),
                    pa.array(np.concatenate([name, signed(token), name[new]])),
                    pa.concat_arrays([part.column("text_hash"), pa.nulls(more, pa.int64())]),
                    *(pa.concat_arrays([pa.nulls(rows + len(token), pa.binary()), pa.array(x, pa.binary())]) for x in (sketches, [folded(x) for x in sketches])),
                ],
                names=["kind", "doc_id", "n", "class", "text_hash", "sketch", "small"],
            )


def fresh(name: np.ndarray, size: np.ndarray, seen: set[int]) -> np.ndarray:
    """Rows of classes, large enough to link to others, that the task hasn't met; they are added to those seen."""
    new = []
    for i, (c, n) in enumerate(zip(name.tolist(), size.tolist(), strict=True)):
        if n >= 4 and c not in seen:
            seen.add(c)
            new.append(i)
    return np.array(new, np.int64)


def band_keys(sets: np.ndarray, bounds: np.ndarray, rows: np.ndarray, bands: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for the given rows as members of the given bands: of each the first n // 4 + 1 words in order.

    Of a set with n // 4 words other than zero or fewer, also the first n // 4 + 1 shingles in order.
    """
    size = bounds[rows + 1] - bounds[rows]
    entry = np.repeat(np.arange(len(rows)), size)
    starts = np.cumsum(size) - size
    token = sets[np.arange(len(entry)) - starts[entry] + bounds[rows][entry]]
    words = np.int64(1) << bands
    place = (mix(token ^ _PLACE) & (words[entry] - 1).astype(np.uint64)).astype(np.int64)
    base = np.cumsum(words) - words
    at = base[entry] + place
    order = np.argsort(at, kind="stable")
    at, token, entry = at[order], token[order], entry[order]
    rare = np.ones(len(token), bool)
    if len(frequent) and len(token):
        rare = frequent[np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)] != token
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = np.bitwise_xor.reduceat(mix(token ^ _WORD), first)
    owner = entry
    common = ~np.logical_or.reduceat(rare, first)
    entry, place = entry[first], at[first] - base[entry[first]]
    key = mix(word ^ mix((place.astype(np.uint64) << np.uint64(8)) + bands[entry].astype(np.uint64)))
    entry, key, common = entry[word != 0], key[word != 0], common[word != 0]
    few = (np.bincount(entry, minlength=len(rows)) <= size // 4)[owner]
    found = first_keys(entry, key, common, size), first_keys(owner[few], mix(token[few] ^ _SHINGLE), ~rare[few], size)
    entry, key = (np.concatenate(x) for x in zip(*found, strict=True))
    return rows[entry], key


def first_keys(entry: np.ndarray, key: np.ndarray, common: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry's keys the first size // 4 + 1, as (entry, key): rare ones before common ones, then by key."""
    order = np.argsort((key >> np.uint64(1)) | (common.astype(np.uint64) << np.uint64(63)))
    order = order[np.argsort(entry[order].astype(np.int32), kind="stable")]
    entry, key = entry[order], key[order]
    rank = np.arange(len(entry)) - np.searchsorted(entry, np.arange(len(size)))[entry]
    keep = rank <= size[entry] // 4
    return entry[keep], key[keep]


def emit_keys(frequent):
    """Keys of each class once a task: (key, class, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = frequent.value, set()
        for batch in batches:
            for part in slices(batch):
                sets, bounds = shingle_sets(part.column("text"))
                n, name = np.diff(bounds), class_of(sets, bounds)
                rows = fresh(name, n, seen)
                own = np.frexp(n[rows].astype(np.float64))[1].astype(np.int64) - 1
                below = n[rows] * 4 < (np.int64(1) << own) * 5
                found = [band_keys(sets, bounds, rows, own, often), band_keys(sets, bounds, rows[below], own[below] - 1, often)]
                row, key = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(name[row]), pa.array(n[row])], names=["key", "class", "n"])

    return run


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, np.diff(np.append(starts, len(values)))


def near_size(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of such sizes can link."""
    return LINK[0] * np.minimum(a, b) >= LINK[1] * np.maximum(a, b)


BUCKETS = "kind int, a long, b long, n long"


def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of keys (key, class, n), sorted by key and class, kind 0: links to try (a, b) from each key's least class; kind 1: (key, class, n) of keys with three classes or more.

    Keys with the same classes are alike, and of those that meet one is kept. A key with very many classes is taken in parts, each with the least class.
    """
    lead: list[np.ndarray] = []
    for table, goes_on in sorted_tables(batches, ["key"], BLOCK, split=True):
        key, name, n = (table[c].to_numpy() for c in ("key", "class", "n"))
        if goes_on:
            key, name, n = (np.concatenate(x) for x in zip(lead, (key, name, n), strict=True))
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        key, name, n = key[keep], name[keep], n[keep]
        last = int(runs(key)[0][-1])  # the last key's least class, should the key go on
        lead = [key[last : last + 1], name[last : last + 1], n[last : last + 1]]
        starts, size = runs(key)
        split = np.zeros(len(starts), bool)
        split[0] = goes_on
        member = np.repeat((size > 1) | split, size)
        many_of = np.repeat((size > 2) | split, size)[member]
        key, name, n = key[member], name[member], n[member]
        starts, size = runs(key)
        alike = per_row(mix(name.view(np.uint64)), np.append(starts, len(key)))
        _, one = np.unique(alike, return_index=True)
        chosen = np.zeros(len(starts), bool)
        chosen[one] = True
        member = np.repeat(chosen, size)
        key, name, n, many = key[member], name[member], n[member], many_of[member]
        starts, size = runs(key)
        first = np.repeat(starts, size)
        spoke = np.arange(len(key)) != first
        pair = np.unique(np.stack([name[first], name], 1)[spoke & near_size(n[first], n)], axis=0) if len(key) else np.zeros((0, 2), np.int64)
        columns = [np.zeros(len(pair), np.int32), pair[:, 0], pair[:, 1], np.zeros(len(pair), np.int64)], [np.ones(many.sum(), np.int32), key[many], name[many], n[many]]
        for values in columns:
            for at in range(0, len(values[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in values], names=["kind", "a", "b", "n"])


def pairs_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of each key's HUBS classes that meet most others with its classes of other components. Sorted by key, met descending, class."""
    names = ("key", "class", "n", "root")
    heads: list[np.ndarray] = []
    for table, goes_on in sorted_tables(batches, ["key"], BLOCK, split=True):
        columns = [table[c].to_numpy() for c in names]
        if goes_on:
            columns = [np.concatenate(x) for x in zip(heads, columns, strict=True)]
        key, name, n, root = columns
        last = int(runs(key)[0][-1])
        heads = [c[last : last + HUBS] for c in columns]
        starts, size = runs(key)
        found = []
        for h in range(HUBS):
            enough = size > h
            hub, row = np.repeat(starts[enough] + h, size[enough]), np.flatnonzero(np.repeat(enough, size))
            good = (root[hub] != root[row]) & near_size(n[hub], n[row])
            found.append(np.stack([np.minimum(name[hub], name[row])[good], np.maximum(name[hub], name[row])[good]], 1))
        yield pairs_batch(np.unique(np.concatenate(found), axis=0))


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of classes under one key, of different components, whose sizes and small sketches let them link.

    A key's classes come in blocks, two at a time: pairs are formed within a block (lo = hi) or across the two. Sorted by key, lo, hi.
    """
    for table, _ in sorted_tables(batches, ["key", "lo", "hi"], BLOCK):
        out: list[np.ndarray] = []
        key, lo, hi, n = (table[c].to_numpy() for c in ("key", "lo", "hi", "n"))
        order = np.lexsort((n, hi, lo, key))
        name, n, root, block = (table[c].to_numpy()[order] for c in ("class", "n", "root", "block"))
        small = table["small"].to_pylist()
        group = np.cumsum(np.concatenate([[0], (key[order][1:] != key[order][:-1]) | (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])]))
        for start, size in zip(*(x.tolist() for x in runs(group)), strict=True):
            rows = slice(start, start + size)
            own = [small[i] for i in order[rows]]
            width = min(map(len, own))
            bits = np.frombuffer(b"".join(folded(x, width) for x in own), np.uint64).reshape(size, -1)
            m, r, c, part = n[rows], root[rows], name[rows], block[rows]
            both = lo[order[start]] != hi[order[start]]
            for i in range(size - 1):
                # Sizes ascend: those that can link to m[i] end where m[i] is under four fifths.
                last = int(np.searchsorted(m, m[i] * LINK[0] // LINK[1], "right"))
                fits = r[i + 1 : last] != r[i]
                if both:
                    fits &= part[i + 1 : last] != part[i]
                j = np.flatnonzero(fits) + i + 1
                j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1) <= (m[j] + m[i]) // 9]
                if len(j):
                    out.append(np.stack([np.minimum(c[i], c[j]), np.maximum(c[i], c[j])], 1))
        if out:
            yield pairs_batch(np.unique(np.concatenate(out), axis=0))


def in_blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows (key, size, class, ..) with block, lo and hi: a key's classes in blocks of about `most`, each pair of blocks once."""
    blocks = F.ceil(F.col("size") / most).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("class"), blocks).cast("int")).withColumn("other", other)
    return dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other")


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, tokens) of documents whose set is that of the class asked for."""
    for batch in batches:
        for part in slices(batch):
            sets, bounds = shingle_sets(part.column("text"))
            name = class_of(sets, bounds)
            rows = np.flatnonzero(name == np.asarray(part.column("class")))
            yield pa.RecordBatch.from_arrays([pa.array(name[rows]), pa.array([sets[bounds[i] : bounds[i + 1]].tobytes() for i in rows], pa.binary())], names=["class", "tokens"])


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            common = len(np.intersect1d(s, t, assume_unique=True))
            good.append(LINK[0] * common >= LINK[1] * (len(s) + len(t) - common))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bit sketches differ in no more bits than linked sets of their sizes can in shingles."""
    for batch in batches:
        limit = (np.asarray(batch.column("m")) + np.asarray(batch.column("n"))) // 9
        good = [hamming(*(np.frombuffer(v.as_buffer(), np.uint8) for v in p)) <= d for *p, d in zip(batch.column("x"), batch.column("y"), limit.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def verify(docs: DataFrame, classes: DataFrame, sketches: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: first by sketches, then by whole sets. classes: (class, holder), holder a doc_id and text_hash with the class's set."""
    m, x = sketches.select(F.col("class").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("x")), sketches.select(F.col("class").alias("b"), "n", F.col("sketch").alias("y"))
    pairs = materialize(pairs.join(m, "a").join(x, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(likely, "a long, b long"))
    need = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    held = need.join(classes, "class").select("class", F.col("holder.doc_id").alias("of_doc"), F.col("holder.text_hash").alias("of_hash"))
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    # By both: neither rows of one doc_id nor copies of one text meet more than their own.
    texts = hashed.join(held, (F.col("text_hash") == F.col("of_hash")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))).select("class", "text")
    tokens = materialize(texts.mapInArrow(sets_of, "class long, tokens binary").dropDuplicates(["class"]), "lz4")
    both = (
        pairs.join(tokens.select(F.col("class").alias("b"), F.col("tokens").alias("y")), "b")
        .join(tokens.select(F.col("class").alias("a"), F.col("tokens").alias("x")), "a")
    )
    return materialize(both.select("a", "b", "x", "y").mapInArrow(verified, "a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, root) of documents (doc_id, text); root names the component, null for the empty set."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    parts = partitions(spark)
    described = materialize(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(describe, SKETCHED))
    slim = described.filter("kind = 0").drop("kind", "sketch")
    sketches = described.filter("kind = 2").select("class", "n", "sketch", "small").dropDuplicates(["class"])
    often = described.filter("kind = 1").groupBy("class").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "class").limit(FREQUENT_KEPT).select("class").toArrow()["class"].to_numpy()
    frequent = spark.sparkContext.broadcast(np.sort(often.view(np.uint64)))
    classes = slim.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_hash")).alias("holder"))
    keys = docs.mapInArrow(emit_keys(frequent), "key long, class long, n long")
    buckets = materialize(keys.repartition(parts, "key").sortWithinPartitions("key", "class").mapInArrow(bucket, BUCKETS))
    links = verify(docs, classes, sketches, buckets.filter("kind = 0").select("a", "b").distinct())
    roots = components(links)
    crowded = buckets.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("class"), "n")
    def still_mixed(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """Rows of keys with classes of several components, by their present roots."""
        placed = rows.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).filter("lo < hi").select("key", "size")
        return materialize(placed.join(mixed, "key").select("key", "class", "n", "root", "size"))

    mixed = still_mixed(crowded, roots)
    if mixed.limit(1).count():
        met = mixed.groupBy("class").agg(F.sum("size").alias("met"))
        tried = mixed.join(met, "class").select("key", "class", "n", "root", "met").repartition(parts, "key").sortWithinPartitions("key", F.desc("met"), "class").mapInArrow(hubs, "a long, b long").distinct()
        links = links.unionByName(verify(docs, classes, sketches, tried))
        roots = components(links)
        mixed = still_mixed(mixed.select("key", "class", "n"), roots)
        paired = in_blocks(mixed, PAIRED).join(sketches.select("class", "small"), "class").select("key", "lo", "hi", "block", "class", "n", "root", "small")
        rest = materialize(paired.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(across, "a long, b long").distinct())
        if rest.limit(1).count():
            roots = components(links.unionByName(verify(docs, classes, sketches, rest)))
    labelled = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    names = labelled.join(least, "root").select(F.col("class").alias("of_class"), "component_id", "root")
    return slim.join(names, (F.col("class") == F.col("of_class")) & (F.col("n") > 0), "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root"
    )


def op3_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
