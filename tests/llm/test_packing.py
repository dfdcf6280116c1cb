from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestream.llm import op4_packing as op4
from tests.llm.conftest import DOCS


def check(rows, got, exact=True):
    encode = op4.encoder()._whole
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text, *_ in rows:
        if sum(r[0] == doc_id for r in rows) > 1:
            continue
        ids = np.array([*encode.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
        padding += 2048 - at if at & (at - 1) else 0
    return padding / max(total + padding, 1)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check(rows, op4.op4_packing(spark, sf).collect()) < 0.02


def test_awkward_rows(spark, awkward, write):
    rows = [*awkward, (50, "a<|endoftext|>b", None, None, None), (51, "x " * 2047, None, None, None), (52, "some words of a long text, " * 120_000, None, None, None)]
    check(rows, op4.op4_packing(spark, write(rows, DOCS)).collect())
    assert op4.op4_packing(spark, write([], DOCS)).count() == 0


def test_encoder_agrees_with_tokenizers():
    encode, rnd = op4.encoder(), random.Random(1)
    letters = [chr(c) for c in range(0x250)]
    for _ in range(2000):
        text = "".join(rnd.choice(letters) if rnd.random() < 0.5 else rnd.choice(" a1'st\n\t ") for _ in range(rnd.randint(0, 40)))
        assert encode(text) == encode._whole.encode(text, add_special_tokens=False).ids


def test_plan_covers_the_demand_tightly():
    rnd = random.Random(2)
    for most in (5, 400):
        demand = {s: rnd.randint(1, most) for s in rnd.sample(range(1, 257), 60)}
        ranges, sequences = op4.plan(demand, 256)
        used = {}
        for size, table in ranges.items():
            assert len(table) and table[0][0] == 0
            for rank in range(demand[size]):
                first, each, base = table[np.searchsorted(table[:, 0], rank, "right") - 1]
                sequence = base + (rank - first) // each
                used[sequence] = used.get(sequence, 0) + size
        assert max(used.values()) <= 256 and max(used) < sequences
        patterns = op4.cutting_stock(demand, 256)
        assert sequences <= sum(n for _, n in patterns) + len(patterns)


def test_cutting_stock_finds_the_best_known():
    patterns = op4.cutting_stock({3: 100, 7: 100}, 10)
    assert abs(sum(n for _, n in patterns) - 100) < 1e-6
    assert all(sum(size * k for size, k in p.items()) <= 10 for p, _ in patterns)


def test_windows_are_packed_one_behind_the_other(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(f"w{rnd.randrange(1000)}" for _ in range(rnd.choice((10, 200, 900, 3000))))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = op4.pack(docs, window=(F.col("doc_id") / 40).cast("int")).collect()
    check([(*r, None, None, None) for r in rows], got)
    of = [{r.sequence_id for r in got if r.doc_id // 40 == w} for w in range(3)]
    assert max(of[0]) < min(of[1]) and max(of[1]) < min(of[2])
    assert set().union(*of) == set(range(max(of[2]) + 1))
