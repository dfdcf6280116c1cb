"""Document fingerprints by winnowing, in DataFrame and SQL functions only.

The hash of every k-gram of code points is taken, and of every window of w
neighbouring hashes the least is kept, the rightmost of equal ones, with its
position. Two texts that share a run of w + k - 1 code points share a kept hash.

A gram's hash is a rolling one: every code point is hashed once, and a gram's is the XOR of its
code points' hashes, each shifted by its distance from the gram's end. Neighbouring grams share the sums of
their parts: those of 2 code points are made from single ones, those of 4 from two of 2, those of 12 from three of 4.
Window minima are found likewise, over 4 hashes and then over 8. So the time is linear in a text's length.

Texts are UTF-32 while they are worked on, so that a code point is found by its place.
Texts are taken in segments that overlap by w + k - 2 code points: every window
lies whole in one segment, so that results don't depend on them and memory is
bounded by the segment, however long the text.

Null and empty texts have an empty fingerprint. A text shorter than k is one gram;
with fewer than w grams the whole text is one window. Equal texts have equal fingerprints, whatever their rows.
An empty table has no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.llm.common import documents, partitions

K, W = 12, 8
SEGMENT = 2048
POSITION_BITS = 31
LEAST = -(1 << 63)


def let(value: Column, body) -> Column:
    """Evaluates value once; within lambdas, expressions are not shared otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def window_count(size: Column, k: int = K, w: int = W) -> Column:
    """How many windows a text of so many code points has; a short one has one."""
    return F.when(size > 0, F.greatest(size - (w + k - 2), F.lit(1))).otherwise(F.lit(0))


def factors(k: int) -> list[int]:
    """Factors of k, of three at most where it has such: from how many parts the hashes of longer grams are made."""
    out, rest = [], k
    for f in (2, 3):
        while rest % f == 0:
            out.append(f)
            rest //= f
    return out + ([rest] if rest > 1 else [])


def gram_hashes(part: Column, k: int, finish=lambda h, i: h) -> Column:
    """The hash of the k-gram from each code point of a text in UTF-32, null where it doesn't fit; finish(hash, place) is what is returned of each."""
    hashes = F.transform(F.sequence(F.lit(1), F.octet_length(part) - 3, F.lit(4)), lambda byte: F.xxhash64(F.substring(part, byte, F.lit(4))))
    sizes = factors(k)
    if not sizes:
        return F.transform(hashes, finish)
    done = 1
    for f in sizes[:-1]:
        hashes = let(hashes, joined(f, done, lambda h, i: h))
        done *= f
    return let(hashes, joined(sizes[-1], done, finish))


def joined(parts: int, size: int, finish):
    """From the hashes of `size` code points those of `parts` times as many."""

    def sums(a: Column) -> Column:
        shifted = lambda u, j: F.shiftleft(u, (parts - 1 - j) * size) if j < parts - 1 else u
        return F.transform(a, lambda u, i: finish(reduce(Column.bitwiseXOR, [shifted(u, 0), *(shifted(F.get(a, i + j * size), j) for j in range(1, parts))]), i))

    return sums


def greatest_of(parts: int, size: int):
    """From maxima over `size` neighbours those over `parts` times as many; fewer at the end."""
    return lambda a: F.transform(a, lambda u, i: F.greatest(u, *(F.get(a, i + j * size) for j in range(1, parts))))


def windows(text: Column, first: Column, end: Column, k: int = K, w: int = W) -> Column:
    """What the windows first .. end - 1 of a text keep, packed: the complement of the hash in the upper 33 bits, position in the lower 31.

    So the greatest of packed values is the least hash at its rightmost place. w must be a power of two.
    """
    if w < 1 or w & (w - 1):
        raise ValueError("w must be a power of two")
    none = F.array().cast("array<bigint>")

    def segment(code: Column, at: Column, end: Column) -> Column:
        size = F.least(F.lit(SEGMENT), end - at) + (w + k - 2)
        return let(F.substring(code, at * 4 + 1, size * 4), lambda part: let((F.octet_length(part) / 4).cast("int") - k, lambda last: kept(part, at, F.greatest(last, F.lit(0)), last < 0)))

    def kept(part: Column, at: Column, last: Column, short: Column) -> Column:
        """last: the segment's last gram."""
        # Bits that all code points of a gram have a share in.
        pack = lambda h, i: F.shiftleft(F.shiftright(h, 16), POSITION_BITS).bitwiseOR(i.cast("bigint"))
        most = F.when(short, F.array(pack(F.xxhash64(part), F.lit(0)))).otherwise(gram_hashes(part, k, pack))
        reach = 1
        while reach < w:
            parts = 4 if reach * 4 <= w else 2
            most = let(most, greatest_of(parts, reach))
            reach *= parts
        whole = F.array_distinct(F.slice(most, F.lit(1), F.greatest(last - (w - 2), F.lit(1))))
        return let(at.cast("bigint"), lambda by: F.transform(whole, lambda v: v + by))

    def of_text(first: Column, end: Column) -> Column:
        starts = F.when(end > first, F.sequence(first, end - 1, F.lit(SEGMENT))).otherwise(F.array().cast("array<int>"))
        return let(F.encode(text, "UTF-32"), lambda code: F.transform(starts, lambda at: segment(code, at, end)))

    # Both ends are counted in code points, once for a text and not for each of its segments.
    found = let(first, lambda first: let(end, lambda end: of_text(first, end)))
    return F.coalesce(F.array_distinct(F.flatten(found)), none)


def up_to(fingerprint: Column, count: Column, w: int = W) -> Column:
    """What the first `count` windows of a text keep, of what all its windows keep.

    A kept hash's first window is the one in which it comes in, if it is no greater than the one kept before it, else the one in which
    that goes out. It is w - 1 places before the hash at most, so that only hashes about the last window need be looked at closely.
    """
    hash_, place = (lambda v: F.shiftright(v, POSITION_BITS)), (lambda v: v.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)))

    def first(v: Column, before: Column, i: Column) -> Column:
        return F.when(i == 0, F.lit(0)).otherwise(F.when(hash_(v) >= hash_(before), place(v) - (w - 1)).otherwise(place(before) + 1))

    def holds(a: Column, v: Column, i: Column) -> Column:
        return F.when(place(v) < count, F.lit(True)).otherwise(F.when(place(v) >= count + (w - 1), F.lit(False)).otherwise(first(v, F.get(a, i - 1), i) < count))

    # A window before the first is none, of a fingerprint whose first hash lies further on too.
    return F.when(count <= 0, F.array().cast("array<bigint>")).otherwise(let(fingerprint, lambda a: F.filter(a, lambda v, i: holds(a, v, i))))


def moved(fingerprint: Column, by: Column) -> Column:
    """A fingerprint with all its positions moved."""
    return F.transform(fingerprint, lambda v: v + by.cast("bigint"))


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """The fingerprint of a whole text, as `windows` packs it."""
    return windows(text, F.lit(0), window_count(F.length(text), k, w), k, w)


def grams(fingerprint: Column) -> Column:
    """A fingerprint's distinct hashes (their complements), without positions."""
    return F.array_distinct(F.transform(fingerprint, lambda v: F.shiftright(v, POSITION_BITS)))


def positions(fingerprint: Column) -> Column:
    """Where its grams begin."""
    return F.transform(fingerprint, lambda v: v.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of grams; of two empty ones 1."""
    of = lambda common, union: F.when(union == 0, F.lit(1.0)).otherwise(common / union)
    return let(F.size(F.array_intersect(a, b)), lambda common: let(F.size(a) + F.size(b) - common, lambda union: of(common, union)))


def digest(fingerprint: Column) -> Column:
    """128 bits of the kept hashes and positions as hexadecimal."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(fingerprint)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), fingerprint)), 16, "0")))


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `winnowed`: the packed fingerprint of a text column."""
    return df.withColumn("winnowed", winnow(F.col(text)))


def neighbours(df: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Rows dealt out by ranges of descending key, each range with a copy of the row that follows it.

    Adds `range_no`, `sent` (true: the copy), `at` and `tie` (the order within a range: sent, at descending, tie).
    The range after the last is the first. Bounds come from the keys' quantiles: as many as there are
    partitions, a few for each, so that what the driver holds is of the size of a plan. A null key comes last.
    """
    at = F.coalesce(F.col(key), F.lit(LEAST))
    parts = 4 * partitions(df.sparkSession)
    bounds = df.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], F.lit(max(10_000, 20 * parts)))).first()[0]
    bounds = sorted({LEAST, *(bounds or [])})
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    below = lambda a: F.size(F.filter(a, lambda b: b <= F.col("at")))
    longs = lambda a: F.array(*map(F.lit, a)).cast("array<bigint>")
    ranged = (
        df.select(*payload, at.alias("at"), F.xxhash64(*payload).alias("tie"))
        .withColumn("group_no", below(longs([g[0] for g in groups])) - 1)
        .withColumn("range_no", F.col("group_no") * width + below(F.get(F.array(*map(longs, groups)), F.col("group_no"))) - 1)
        .drop("group_no")
    )
    # The first row of a range, in the order of the window: of several with the top key the one with the least tie.
    firsts = {r.range_no: r.top for r in ranged.groupBy("range_no").agg(F.max(F.struct("at", F.bitwise_not("tie").alias("tie"))).alias("top")).collect()}
    tops = {i: firsts[i]["at"] for i in sorted(firsts)}
    ties = [~firsts[i]["tie"] if i in firsts else None for i in range(max(tops, default=0) + 1)]
    ahead = dict(zip([*tops][1:] + [*tops][:1], [*tops], strict=True))  # a range's rows are followed by the top of the range below
    to = {below_: range_no for range_no, below_ in ahead.items()}
    top_of = longs([tops.get(i) for i in range(max(tops, default=0) + 1)])
    goes_to = longs([to.get(i) for i in range(max(tops, default=0) + 1)])
    own = F.struct(F.col("range_no").cast("bigint").alias("range_no"), F.lit(False).alias("sent"))
    copy = F.struct(F.get(goes_to, F.col("range_no")).alias("range_no"), F.lit(True).alias("sent"))
    places = F.when((F.get(top_of, F.col("range_no")) == F.col("at")) & (F.get(longs(ties), F.col("range_no")) == F.col("tie")), F.array(own, copy)).otherwise(F.array(own))
    return ranged.withColumn("place", F.explode(places)).select(*payload, "at", "tie", "place.range_no", "place.sent")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    Of rows with one doc_id, the next is told by a hash of the row. A lone document is its own next.

    An edited text is the head of one text and the head of another. Windows that lie in either keep there what they keep in
    the whole text, which is fingerprinted anyway; only those across the seam are taken anew.
    """
    df = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("range_no").orderBy("sent", F.desc("at"), "tie")
    place = ["range_no", "sent", "at", "tie"]
    keep = ["doc_id", *place, "n_chars", "cut"]
    reach = W + K - 2
    texts = (
        neighbours(df, "doc_id", ["doc_id", "text"])
        .withColumn("n_chars", F.length("text")).withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int"))
        .withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
    )
    head, tail = F.substring("text", F.lit(1), F.col("n_chars") - F.col("cut")), F.substring("next", F.lit(1), F.col("cut"))
    cut_at, tail_size = F.col("n_chars") - F.col("cut"), F.length("tail")
    # Around the seam: as many code points on both sides as a window reaches, or all of a short edited text.
    across = F.concat(F.substring("head", cut_at - (reach - 1), F.lit(reach)), F.substring("tail", F.lit(1), F.lit(reach)))
    seam = F.when(cut_at <= reach, F.concat("head", "tail")).otherwise(F.when(tail_size > 0, across).otherwise(""))
    marked = (
        texts.withColumn("head", head).withColumn("tail", tail)
        .select(*keep, tail_size.alias("tail_size"), F.sha2(F.concat("head", "tail").cast("binary"), 256).alias("edited_sha256"), winnow(F.col("text")).alias("a"), winnow(seam).alias("seam"))
        .withColumn("next", F.lead("a").over(order)).filter(~F.col("sent"))
    )
    parts = F.concat(up_to(F.col("a"), cut_at - reach), moved(F.col("seam"), cut_at - reach), moved(up_to(F.col("next"), F.col("tail_size") - reach), cut_at))
    return (
        marked.withColumn("b", F.when(cut_at <= reach, F.col("seam")).otherwise(F.array_distinct(parts)))
        .withColumn("fingerprint", digest(F.col("a"))).withColumn("edited_fingerprint", digest(F.col("b")))
        .select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", grams(F.col("a")).alias("a"), grams(F.col("b")).alias("b"), grams(F.col("next")).alias("next"))
        .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("next")).alias("near_next"))
    )
