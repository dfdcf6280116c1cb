from __future__ import annotations

import hashlib
import random
from functools import reduce

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestream.llm.op1_fingerprints import K, W, digest, gram_hashes, grams, op1_fingerprints, up_to, window_count, windows, winnow
from tests.llm.conftest import DOCS


def gram_hash(gram):
    """33 bits of the shifted code points' hashes; of the whole where the text is shorter than a gram."""
    wide = lambda x: xxhash.xxh64(x.encode("utf-32-be"), seed=42).intdigest()
    if len(gram) < K:
        h = wide(gram)
    else:
        h = 0
        for c in gram:
            h = ((h << 1) & (2**64 - 1)) ^ wide(c)
    return ~signed(h >> 16, 33)


def signed(x, bits):
    x &= (1 << bits) - 1
    return x - (1 << bits) if x >> (bits - 1) else x


def brute(text):
    grams = [gram_hash(text[i : i + K]) for i in range(max(len(text) - K, 0) + 1)] if text else []
    kept = set()
    for i in range(max(len(grams) - W + 1, 1) if grams else 0):
        window = grams[i : i + W]
        least = min(window)
        kept.add((least, i + max(j for j, v in enumerate(window) if v == least)))
    return sorted(kept, key=lambda x: x[1])


def likeness(a, b):
    a, b = ({h for h, _ in brute(x)} for x in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_winnow_equals_brute_force(spark):
    rnd = random.Random(5)
    texts = ["", "a", "abcabcabc" * 3, "x" * 50, "x" * 5000, "\0" * 11, "\0" * 12, "".join(rnd.choice("abé\U0001f600") for _ in range(4200)), None]
    texts += ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    texts += ["".join(rnd.choice("abcdefgh ") for _ in range(n)) for n in (2047, 2048, 2065, 2066, 2067, 6200)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", winnow(F.col("t")).alias("f")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [(~(v >> 31), v & (2**31 - 1)) for v in r.f] == brute(texts[r.i])


@pytest.mark.parametrize("k", [1, 5, 8, 14])
def test_grams_of_other_lengths(spark, k):
    rnd = random.Random(k)
    text = "".join(rnd.choice("abcé") for _ in range(60))
    (row,) = spark.createDataFrame([(text,)], "t string").select(gram_hashes(F.encode("t", "UTF-32"), k).alias("h")).collect()
    wide = lambda c: xxhash.xxh64(c.encode("utf-32-be"), seed=42).intdigest()
    want = [reduce(lambda h, c: ((h << 1) & (2**64 - 1)) ^ wide(c), text[i : i + k], 0) for i in range(60 - k + 1)]
    assert [h & (2**64 - 1) for h in row.h[: 60 - k + 1]] == want and all(h is None for h in row.h[60 - k + 1 :])


def test_time_is_linear_in_a_text(spark):
    """Texts of 3 MB, more than a slice or segment of any operator, in seconds."""
    import time

    rnd = random.Random(9)
    unit = "".join(rnd.choice("abcdefghé ") for _ in range(20_000))
    times = []
    for n in (0.1, 0.75, 3):
        df = spark.createDataFrame([(unit * int(50 * n),)], "t string").select(F.size(winnow(F.col("t"))).alias("n"))
        began = time.time()
        assert df.first().n > 100_000 * n
        times.append(time.time() - began)
    assert times[2] < 30 and times[2] < 8 * max(times[1], 0.5)


def test_shared_runs_share_a_kept_gram(spark):
    """The guarantee: a shared run of w + k - 1 code points."""
    rnd = random.Random(2)
    text = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    pairs = []
    for _ in range(200):
        run = text(W + K - 1)
        pairs.append((text(rnd.randint(0, 40)) + run + text(rnd.randint(0, 40)), text(rnd.randint(0, 40)) + run + text(rnd.randint(0, 40))))
    got = spark.createDataFrame(pairs, "a string, b string").select(F.arrays_overlap(grams(winnow(F.col("a"))), grams(winnow(F.col("b")))).alias("x")).collect()
    assert all(r.x for r in got)


def test_first_windows_of_a_fingerprint(spark, sf):
    n = F.length("text")
    df = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([("ab" * 40,), ("x" * 70,), ("abc",)], "text string"), allowMissingColumns=True)
    for count in (F.lit(1), F.floor(n / 3).cast("int"), n):
        m = F.least(count, window_count(n))
        assert df.filter(m > 0).filter(~up_to(winnow(F.col("text")), m).eqNullSafe(windows(F.col("text"), F.lit(0), m))).count() == 0


def edited_and_wanted(spark, folder):
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()), reverse=True)
    edited = [(d, t[: len(t) - len(t) // 3] + rows[(i + 1) % len(rows)][1][: len(t) // 3]) for i, (d, t) in enumerate(rows)]
    want = spark.createDataFrame(edited, "doc_id long, t string").select("doc_id", digest(winnow(F.col("t"))).alias("want"))
    return op1_fingerprints(spark, folder).join(want, "doc_id")


def test_edited_fingerprints_are_those_of_the_edited_texts(spark, sf):
    assert edited_and_wanted(spark, sf).filter("edited_fingerprint <> want").count() == 0


def test_edits_of_all_short_lengths(spark, write):
    """Seams at every place, with heads and tails shorter and longer than a window reaches, and empty ones."""
    rnd = random.Random(12)
    sizes = [*range(70), *(rnd.choice((0, 1, 17, 18, 19, 20, 37, 38, 39, 55, 56, 57, 58, 60, 300)) for _ in range(130))]
    rnd.shuffle(sizes)
    rows = [(i, "".join(rnd.choice("abc") for _ in range(n)), None, None, None) for i, n in enumerate(sizes)]
    got = edited_and_wanted(spark, write(rows, DOCS))
    assert got.count() == len(rows) and got.filter("edited_fingerprint <> want").count() == 0


def check_edits(rows, got, every=1):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(r)
    for i, (doc_id, text, *_) in enumerate(order):
        if sum(r[0] == doc_id for r in rows) > 1 or sum(r[0] == order[(i + 1) % len(order)][0] for r in rows) > 1:
            continue
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        (r,) = found[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        if i % every == 0:
            assert r.near_edited == pytest.approx(likeness(text, edited), abs=1e-12) and r.near_next == pytest.approx(likeness(text, after), abs=1e-12)
        if edited == text:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op1_fingerprints(spark, sf).collect()
    check_edits(rows, got, every=4)
    texts = dict(rows)
    marks = {}
    for r in got:
        assert marks.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_awkward_rows(spark, awkward, write):
    check_edits(awkward, op1_fingerprints(spark, write(awkward, DOCS)).collect())
    assert op1_fingerprints(spark, write([], DOCS)).count() == 0
    (one,) = op1_fingerprints(spark, write([(1, "abcdef", None, None, None)], DOCS)).collect()
    assert one.near_next == 1
