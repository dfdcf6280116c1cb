from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lodestream.llm import op7_language as op7
from lodestream.llm.op7_language import op7_language
from tests.llm.conftest import DOCS


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op7_language(spark, folder).collect()
    assert len(got) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(langs[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)


def test_awkward_rows(spark, awkward, write):
    got = op7_language(spark, write(awkward, DOCS)).collect()
    assert len(got) == len(awkward)
    by = {r.doc_id: r for r in got}
    for doc_id in (0, 1, 2, 11):
        assert (by[doc_id].lang_pred, by[doc_id].score) == ("und", 0.0)
    assert {r.lang_pred for r in got} <= {"und", "en", "zh"}
    assert op7_language(spark, write([], DOCS)).count() == 0


def test_nothing_to_learn_from(spark, write):
    got = op7_language(spark, write([(1, "some text", None, None, None)], DOCS)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_held_out_labels_are_not_learned(spark, write):
    rows = [(i, f"die katze und der hund {i}", "de" if zlib.crc32(str(i).encode()) % 3 != 1 else "wrong", None, 1) for i in range(60)]
    assert {r.lang_pred for r in op7_language(spark, write(rows, DOCS)).collect()} == {"de"}


def cells(text):
    """The cells of a text's byte 1- to 3-grams, one by one."""
    plain = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode())
    out = set(plain)
    for n in (2, 3):
        for i in range(len(plain) - n + 1):
            gram = int.from_bytes(plain[i : i + n], "big")
            out.add(((gram * 0x9E3779B1 + n) & 0xFFFFFFFF) >> (32 - op7.CELL_BITS))
    return out


def kernel(a, b):
    return len(a & b) / (len(a) * len(b)) ** 0.5


def test_scores_are_those_of_the_kernel_with_its_landmarks(monkeypatch):
    """Nystroem features and ridge regression from the kernel's definition, set by set, against the folded matrix."""
    monkeypatch.setattr(op7, "LANDMARKS", 25)
    rnd = random.Random(5)
    words = {"en": "the and of to there house river".split(), "de": "der die und nicht straße häuser".split(), "fr": "le la été où garçon rivière".split()}
    text = lambda lang, n: " ".join(rnd.choice(words[lang]) + rnd.choice("  ,.7") for _ in range(n))
    labels = [rnd.choice(["en", "en", "de", "fr"]) for _ in range(60)]
    texts = [text(lang, rnd.randint(1, 12)) for lang in labels]
    new = [text(lang, rnd.randint(1, 9)) for lang in ("en", "de", "fr") for _ in range(8)]
    assert [set(np.flatnonzero(row).tolist()) for row in op7.presence(pa.array([*texts, *new]))] == [cells(t) for t in [*texts, *new]]
    matrix, names = op7.fit(np.packbits(op7.presence(pa.array(texts)), axis=1), labels)
    got = op7.unit(op7.presence(pa.array(new))) @ matrix

    sets, marks = [cells(t) for t in texts], [cells(t) for t in texts[:25]]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = np.array([[kernel(a, b) for b in marks] for a in sets]) @ root
    share = np.array([1 / labels.count(y) for y in labels])
    share /= share.mean()
    wanted = np.array([[1.0 if y == n else -1.0 for n in names] for y in labels])
    weights = np.linalg.solve(features.T @ (share[:, None] * features) + op7.RIDGE * np.eye(features.shape[1]), features.T @ (share[:, None] * wanted))
    want = np.array([[kernel(cells(t), b) for b in marks] for t in new]) @ root @ weights
    assert names == ["de", "en", "fr"] and got == pytest.approx(want, abs=2e-3)
    assert (got.argmax(axis=1) == want.argmax(axis=1)).all()


def test_a_text_over_a_slice_is_read_whole(spark, write):
    """3 MB in one language but for its end, beyond a slice of other operators: all its n-grams count."""
    rows = [(i, t, lang, None, 1) for i in range(0, 90, 2) for t, lang in (("the house of the river and", "en"), ("der hund und die katze nicht", "de"))]
    long = "the house and the river of " * 120_000
    got = {r.doc_id: r for r in op7_language(spark, write([*rows, (1000, long, None, None, 1)], DOCS)).collect()}
    assert got[1000].lang_pred == "en" and len(long) > 3_000_000


def test_more_languages_than_rows_to_learn_from(spark, monkeypatch):
    """The bound holds: the most frequent languages, a row of each, however few a draw may give."""
    monkeypatch.setattr(op7, "TRAIN", 8)
    rows = [(1000 * k + i, f"wort{k} haus{k} baum{k} {i}", f"l{k:02d}") for k in range(12) for i in range(200 if k < 8 else 20)]
    model = op7.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model[1] == [f"l{k:02d}" for k in range(8)]
