"""The operators as stages of the corpus pipeline: (spark, docs, sf_dir) to a DataFrame.

Clashing names: stages work on the columns of documents under names of their own and return what docs had. Null ids and
sources stay as they are; of rows that are alike in doc_id and text one goes on from the second stage; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import op3_parity_join as op3
from lodestream.llm import op4_packing as op4
from lodestream.llm import op5_mixing as op5
from lodestream.llm import op7_language as op7
from lodestream.llm import op8_suffix_dedup as op8
from lodestream.llm.common import bound_batches, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; lang becomes the prediction. Rejected: no text, no letter.

    A low score rejects nothing: short clean texts have low scores.
    """
    bound_batches(spark)
    found = op7.identify(docs.select(COLUMNS), op7.train(op7.learnable(docs)), COLUMNS)
    return found.filter("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the least doc_id, null last, then the least hash of its text.

    Documents without a shingle all stay, once for each doc_id and text.
    """
    at = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    known = materialize(op3.near_duplicates(docs.select("doc_id", "text")).select(at.alias("of_doc"), "text_hash", "root"))
    least = known.filter("root is not null").groupBy("root").agg(F.min(F.struct("of_doc", "text_hash")).alias("least")).select("least.of_doc", F.col("least.text_hash").alias("of_hash"))
    bare = known.filter("root is null").select("of_doc", F.col("text_hash").alias("of_hash")).distinct()
    rows = docs.select(COLUMNS).withColumn("at", at).withColumn("text_hash", F.xxhash64("text"))
    chosen = rows.join(least.unionByName(bare), (F.col("at") == F.col("of_doc")) & (F.col("text_hash") == F.col("of_hash")))
    # Of rows that are alike in these the one with the least source, lang and n_chars, null first.
    one = chosen.groupBy("at", "text_hash").agg(F.min(F.struct("source", "lang", "n_chars", "doc_id", "text")).alias("one"))
    return one.select(*(F.col(f"one.{c}").alias(c) for c in COLUMNS))


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that came earlier; bytes of characters that a passage's end cuts go too. A text that is used up goes."""
    found = op8.repeats(docs.select(COLUMNS))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [data.decode("utf-8", "ignore") for _, _, data in op8.kept(batch)]
            text = pa.array([x if t.is_valid else None for x, t in zip(left, batch.column("text"), strict=True)], pa.string())
            size = pa.array([len(x) if t.is_valid else n for x, t, n in zip(left, batch.column("text"), batch.column("n_chars").to_pylist(), strict=True)], pa.int64())
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), text, batch.column("lang"), batch.column("source"), size], names=COLUMNS)
            yield out.filter(pa.array([bool(x) for x in left], pa.bool_()))

    return found.mapInArrow(rewrite, docs.select(COLUMNS).schema)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of training, as often as the mix takes them, each time at its own position: whole, and where it stops within one, its first words.

    Rows alike in doc_id, source and text are one document. The order is that of rows in files by their part numbers.
    """
    at = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = docs.select(*COLUMNS, at.alias("at"), F.xxhash64("doc_id", "source", "text").alias("row_hash"))
    sized = materialize(rows.select("doc_id", "source", "at", "row_hash", op5.word_count(F.col("text")).alias("size")).dropDuplicates(["at", "row_hash"]))
    taken = op5.mix(sized).filter("taken > 0").select(F.col("row_hash").alias("of_row"), F.col("at").alias("of_doc"), "size", "taken", "positions")
    joined = rows.dropDuplicates(["at", "row_hash"]).join(taken, (F.col("row_hash") == F.col("of_row")) & (F.col("at") == F.col("of_doc"))).drop("at", "row_hash")
    copies = joined.select("*", F.posexplode("positions").alias("pass", "position")).withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size")))

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if w >= n else first_words(t, w) for t, w, n in zip(batch.column("text").to_pylist(), batch.column("words").to_pylist(), batch.column("size").to_pylist(), strict=True)]
            columns = [*(batch.column(c) if c != "text" else pa.array(texts, pa.string()) for c in COLUMNS), batch.column("position")]
            columns[COLUMNS.index("n_chars")] = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=[*COLUMNS, "position"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(COLUMNS).schema) + ", position double"
    return copies.mapInArrow(shorten, schema).orderBy("position", "doc_id").select(COLUMNS)


def first_words(text: str, count: int) -> str:
    """A text up to the end of so many words."""
    import re

    end = 0
    for n, word in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)):
        if n == count:
            break
        end = word.end()
    return text[:end]


#: Parts of the order of documents that sequences keep, at most, and documents in each, at least.
WINDOWS, IN_WINDOW = 16, 8192


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences, as op4 returns them, numbered along the order of training.

    That is the order of part numbers in docs' files: runs of files make up to WINDOWS windows, packed one behind the other. Docs
    that aren't of such files are one window.
    """
    name = F.regexp_extract(F.input_file_name(), r"part-(\d{1,9})[^/]*$", 1)
    part = F.when(name == "", F.lit("0")).otherwise(name).cast("int")
    # As many rows as the writer had partitions.
    counts = sorted(map(tuple, docs.select(part.alias("part")).groupBy("part").count().collect()))
    total = sum(n for _, n in counts)
    windows = max(1, min(WINDOWS, total // IN_WINDOW))
    bounds, before, last = [], 0, 0
    for number, n in counts:
        if before * windows // max(total, 1) > last:
            bounds.append(number)
            last = before * windows // total
        before += n
    window = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<int>"), lambda b: b <= part)) if bounds else F.lit(0)
    return op4.pack(docs, window=window)
