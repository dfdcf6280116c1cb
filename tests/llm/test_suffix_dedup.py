from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lodestream.llm import op8_suffix_dedup as op8
from tests.llm.conftest import DOCS


def brute(rows, length=100):
    """Rows with one doc_id must have equal texts."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(data[p : p + length])
        left = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def run(spark, folder):
    return sorted(map(tuple, op8.op8_suffix_dedup(spark, folder).collect()), key=str)


def passages():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (25, 40, 120)]
    rows = []
    for i in range(60):
        parts = [text(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(shared)
            a = rnd.randint(0, len(p) // 2)
            parts += [p[a : rnd.randint(a, len(p))], text(rnd.randint(0, 3))]
        rows.append((i, " ".join(parts)))
    rows += [(100, "a" * 99), (101, "a" * 100), (102, "a" * 350), (103, "ab" * 60 + "x" + "ab" * 60), (104, ("abcdefg" * 9 + "-") * 5), (105, shared[2]), (106, shared[2]), (107, "\0" * 230)]
    return rows


@pytest.mark.parametrize("common", [op8.COMMON, 40])
def test_passages_equal_brute_force(spark, write, monkeypatch, common):
    monkeypatch.setattr(op8, "COMMON", common)
    monkeypatch.setattr(op8, "BLOCK", 4096)
    rows = passages()
    assert run(spark, write([(i, t, None, None, None) for i, t in rows], DOCS)) == brute(rows)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert run(spark, sf) == brute(rows)


def test_awkward_rows(spark, awkward, write):
    assert run(spark, write(awkward, DOCS)) == brute([r[:2] for r in awkward])
    assert run(spark, write([], DOCS)) == []


def test_rows_with_one_id(spark, write):
    rows = [(1, "x" * 120 + str(i), None, None, None) for i in (1, 2)]
    got = run(spark, write(rows, DOCS))
    # In the earlier text the strings after the first repeat it; in the later one all but the end's do.
    assert sorted(r[2] for r in got) == [119, 120]


def test_texts_over_a_slice(spark, write):
    """A text of 3 MB that repeats a passage of an earlier one near its end, and one that repeats itself."""
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, half = text(500), text(1_500_000)
    rows = [(1, "z" + passage + "z"), (2, text(3_000_000) + "y" + passage + "y"), (3, half + "x" + half)]
    got = run(spark, write([(i, t, None, None, None) for i, t in rows], DOCS))
    assert [r[:4] for r in got] == [(1, 502, 0, 0), (2, 3_000_502, 500, 1), (3, 3_000_001, 1_500_000, 1)]


@pytest.mark.parametrize("common", [op8.COMMON, 40])
@pytest.mark.parametrize("tasks", [1, 4])
def test_equal_rows_keep_one(spark, monkeypatch, tmp_path, common, tasks):
    """Equal rows that hold a passage first: one of them stays whole, in one task or in several."""
    monkeypatch.setattr(op8, "COMMON", common)
    passage = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(5, passage), (7, "before " + passage + " after"), (5, passage), (None, other), (8, other + " end"), (None, other), (5, passage), (9, passage)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(d, n, gone) for d, n, gone, _, _ in run(spark, str(tmp_path))]
    p, o = len(passage), len(other)
    want = [(5, p, 0), (5, p, p), (5, p, p), (7, p + 13, p), (8, o + 4, o), (9, p, p), (None, o, 0), (None, o, o)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_suffix_array_sorts():
    rng = np.random.default_rng(0)
    for _ in range(80):
        text = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 400)).astype(np.uint8)
        order, data = op8.suffix_array(text, 50), text.tobytes()
        assert sorted(order.tolist()) == list(range(len(text)))
        heads = [data[i : i + 50] for i in order]
        assert heads == sorted(heads)


def test_a_common_passage_is_few_rows():
    """A passage of 3 KB in 200 documents, each in a task of its own: rows by run, and strings only about its ends."""
    rnd = random.Random(6)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = text(3000)
    wanted = pa.list_(pa.struct([("anchor", pa.int64()), ("common", pa.bool_())]))
    rows, documents = [], [text(300) + passage + text(300) for _ in range(200)]
    for i, doc in enumerate(documents):
        column = pa.array([doc])
        _, _, _, anchor = op8.string_runs(*op8.text_bytes(column))
        batch = pa.record_batch({"at": pa.array([i]), "text_hash": pa.array([i]), "text": column, "wanted": pa.array([[{"anchor": a, "common": True} for a in set(anchor.view(np.int64).tolist())]], wanted)})
        rows += [r for b in op8.shared_runs(iter([batch])) for r in b.to_pylist()]
    runs = len(rows)
    dealt = {}
    for r in sorted(rows, key=lambda r: (r["anchor"], r["content"])):
        dealt.setdefault((r["anchor"] ^ r["content"]) % 20, []).append(r)
    schema = pa.schema([(k, op8._TYPES[t]) for k, t in op8._RUN_FIELDS])
    batches = lambda part: iter([pa.RecordBatch.from_pylist(part, schema=schema)])
    out = [r for part in dealt.values() for b in op8.spread(batches(part)) for r in b.to_pylist()]
    strings = sorted((r for r in out if r["kind"] == 1), key=lambda r: r["anchor"])
    marks = [r for r in out if r["kind"] == 2] + [r for b in op8.mark(batches(strings)) for r in b.to_pylist()]
    assert runs < 40_000 and len([r for r in out if r["kind"] == 2]) < 40_000
    # Strings that cross the ends are unique, and up to 69 of each end within the passage are one from each of the 20 parts.
    assert len(marks) - len([r for r in out if r["kind"] == 2]) < 20 * 2 * 70
    removed = 0
    for i, doc in enumerate(documents):
        left, _ = op8.cut(doc.encode(), [(r["start"], r["strings"]) for r in marks if r["at"] == i])
        removed += len(doc) - len(left)
        assert i == 0 or len(doc) - len(left) >= 3000
    assert 199 * 3000 <= removed < 199 * 3010
