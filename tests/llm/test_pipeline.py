from __future__ import annotations

import corpus_pipeline
from lodestream.llm import stages
from lodestream.llm.common import materialize
from tests.llm.conftest import DOCS
from tests.llm.test_packing import check
from tests.llm.test_parity_join import brute as components_of
from tests.llm.test_suffix_dedup import brute as repeats_of



def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = materialize(stages.keep_identified(spark, docs, sf))
    assert kept.columns == columns and kept.count() == docs.filter(r"text rlike '\\p{L}'").count()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    unique = materialize(stages.keep_one_of_each(spark, kept, sf))
    assert unique.columns == columns
    want = {c for _, n, c in components_of(rows) if n} | {d for d, n, _ in components_of(rows) if not n}
    assert sorted(r.doc_id for r in unique.collect()) == sorted(want)
    left = materialize(stages.remove_passages(spark, unique, sf))
    assert left.columns == columns
    digest = {d: (size, gone, sha) for d, size, gone, _, sha in repeats_of([(r.doc_id, r.text) for r in unique.collect()])}
    for r in left.collect():
        size, gone, sha = digest[r.doc_id]
        assert size - gone - len(r.text.encode()) < 8 and r.n_chars == len(r.text)
    mixed = materialize(stages.mix_sources(spark, left, sf))
    assert mixed.columns == columns
    sizes = {r.doc_id: len(r.text.split()) for r in left.collect()}
    taken = {}
    for r in mixed.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    assert all(n <= 2 * sizes[d] for d, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 0.02 * sum(sizes.values()) + 40
    packed = stages.pack_sequences(spark, mixed, sf).collect()
    assert check([], packed) < 0.05


def test_sequences_follow_the_order_of_training(spark, sf, monkeypatch):
    """In each tenth of the sequences a source has about the share of words that the mix gave it there."""
    monkeypatch.setattr(stages, "IN_WINDOW", 20)
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{words} {i}", "en", "abc"[i % 3], 0) for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = materialize(stages.mix_sources(spark, docs, sf))
        packed = stages.pack_sequences(spark, mixed, sf).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    source = {r[0]: r[3] for r in rows}
    end = max(r.sequence_id for r in packed) + 1
    sources = sorted({"a", "b", "c"})
    share = lambda tenth: [sum(r.length for r in packed if r.sequence_id * 10 // end == tenth and source[r.doc_id] == s) / sum(r.length for r in packed if r.sequence_id * 10 // end == tenth) for s in sources]
    first, last = share(0), share(9)
    # Weights 3, 1, 2 move to 1.5, 1, 2 times their ramps' start and end: a falls from 3/5.5 of the words, b rises from 0.5/5.5.
    assert first[0] > last[0] + 0.1 and first[1] < last[1] - 0.05


def test_equal_rows_are_one_document_in_the_mix(spark, sf):
    rows = [(1, "a b c d e f", "en", "s", 11)] * 4 + [(i, f"x{i} y z q r t", "en", "s", 1) for i in (2, 3, 4)]
    got = stages.mix_sources(spark, spark.createDataFrame(rows, DOCS), sf).collect()
    assert sum(len(r.text.split()) for r in got) == 36 and max(sum(r.doc_id == i for r in got) for i in (1, 2, 3, 4)) <= 2


def test_run_on_awkward_rows(spark, awkward, write):
    assert corpus_pipeline.run(spark, write(awkward, DOCS)).count() > 0
    assert corpus_pipeline.run(spark, write([], DOCS)).count() == 0


def test_first_words():
    assert stages.first_words(" a  b c", 2) == " a  b" and stages.first_words("a b", 5) == "a b" and stages.first_words("a", 0) == ""
