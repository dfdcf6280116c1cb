"""Language ID: blended-spectrum string kernel, Nystroem landmarks, one-versus-rest kernel ridge regression.

A text is the set of its byte 1- to 3-grams (A-Z in lower case, digits and punctuation as space), hashed to
`CELLS`; the kernel is the size of two sets' intersection over the root of the product of their sizes. `LANDMARKS`
training texts span the Nystroem features; ridge regression to +1 and -1 for each language gives weights. As the
kernel is an inner product of the sets, landmarks and weights fold into one cells-by-languages matrix: scoring is a
product of a batch's sets with it. Every n-gram of a whole text counts.

Learned from a sample of at most `TRAIN` labelled rows, drawn by a hash of doc_id in like number for each language
(a bound, so that the model's cost doesn't grow); of more than `TRAIN` languages the most frequent. All rows are predicted. Rows with a null doc_id are not learned
from and not held out. Texts that are null or have no letter are `und` with score 0, as are all if nothing can be
learned. Of languages with equal scores the first in order wins. Scores map a regression value of -1 to 0, 1 to 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import documents, slices, text_bytes

TRAIN = 4096
LANDMARKS = 512
RIDGE = 0.1
CELL_BITS = 15
CELLS = 1 << CELL_BITS
#: Texts, and bytes of them but for a longer text, that are taken at once.
ROWS, BYTES = 128, 1 << 19

_PLAIN = np.arange(256, dtype=np.int64)
_PLAIN[:128] = 32
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)


def presence(column: pa.Array) -> np.ndarray:
    """A row of CELLS booleans for each text."""
    data, offsets = text_bytes(column)
    out = np.zeros((len(offsets) - 1) * CELLS, bool)
    x = _PLAIN[data]
    base = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64) << CELL_BITS, np.diff(offsets))
    gram = x.copy()
    out[base + gram] = True
    for n in (2, 3):
        gram = (gram[:-1] << 8) | x[n - 1 :]
        same = base[n - 1 :] == base[: len(gram)]
        cell = ((gram * 0x9E3779B1 + n) & 0xFFFFFFFF) >> (32 - CELL_BITS)
        out[(base[: len(gram)] + cell)[same]] = True
    return out.reshape(-1, CELLS)


def unit(sets: np.ndarray) -> np.ndarray:
    x = sets.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def fit(bits: np.ndarray, labels: list[str]) -> tuple[np.ndarray, list[str]]:
    """The cells-by-languages matrix and its languages, from sets as packed bits. The first LANDMARKS rows are landmarks."""
    names = sorted(set(labels))
    marks = unit(np.unpackbits(bits[:LANDMARKS], axis=1))
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    kernel = np.concatenate([unit(np.unpackbits(bits[at : at + ROWS], axis=1)) @ marks.T for at in range(0, len(bits), ROWS)])
    features = kernel.astype(np.float64) @ root
    # Each language weighs the same, however many of the sampled rows it has.
    share = np.array([1 / labels.count(y) for y in labels])
    share = share / share.mean()
    wanted = np.array([[1.0 if y == name else -1.0 for name in names] for y in labels])
    weights = np.linalg.solve(features.T @ (features * share[:, None]) + RIDGE * np.eye(features.shape[1]), features.T @ (wanted * share[:, None]))
    return (marks.T @ (root @ weights).astype(np.float32)).astype(np.float32), names


def draw(hash_: Column) -> Column:
    """A number from 0 to 1 for a row."""
    return F.shiftrightunsigned(hash_, 11) * F.lit(2.0**-53)


def train(labelled: DataFrame) -> tuple[np.ndarray, list[str]] | None:
    """Fits on (doc_id, text, lang); None without a text to learn from."""
    known = labelled.filter(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    counts = dict(map(tuple, known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(TRAIN).collect()))
    if not counts:
        return None
    quota = TRAIN // len(counts)
    # Half more than the quota is drawn, and some, so that chance seldom leaves less, of a quota of one too; what is over is cut off below.
    share = F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*(F.lit(v) for name, n in counts.items() for v in (name, min(1.0, (1.5 * quota + 16) / n)))), lambda k, v: k == F.col("lang"))), F.lit(0)), F.lit(0.0))
    order = F.xxhash64("doc_id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                bits = np.packbits(presence(part.column("text")), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("order"), part.column("lang"), pa.array([b.tobytes() for b in bits], pa.binary())], names=["order", "lang", "bits"])

    rows = known.filter(draw(order) < share).select(order.alias("order"), "lang", "text").mapInArrow(sets, "order long, lang string, bits binary").collect()
    taken: dict[str, int] = {}
    chosen = []
    for r in sorted(rows, key=lambda r: (r.order % (1 << 64), r.lang, bytes(r.bits))):
        taken[r.lang] = taken.get(r.lang, 0) + 1
        if taken[r.lang] <= quota:
            chosen.append(r)
    if not chosen:
        return None
    return fit(np.array([np.frombuffer(r.bits, np.uint8) for r in chosen]), [r.lang for r in chosen])


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for run in slices(batch, most=BYTES):
        for at in range(0, run.num_rows, ROWS):
            yield run.slice(at, ROWS)


def identify(docs: DataFrame, model, columns: list[str]) -> DataFrame:
    """The named columns of docs (which has text) with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select(*columns, *([] if "text" in columns else ["text"]), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*columns).schema) + ", lang_pred string, score double"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                letters = np.asarray(part.column("has_letter").to_numpy(zero_copy_only=False), dtype=bool)
                langs, score = np.full(len(letters), "und", dtype=object), np.zeros(len(letters))
                if sent.value is not None and letters.any():
                    matrix, names = sent.value
                    found = unit(presence(part.column("text"))) @ matrix
                    langs[letters] = np.array(names, dtype=object)[found.argmax(axis=1)][letters]
                    score[letters] = np.clip((found.max(axis=1).astype(np.float64) + 1) / 2, 0, 1)[letters]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(langs, pa.string()), pa.array(score)], names=[*columns, "lang_pred", "score"])

    return frame.mapInArrow(predict, schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), train(learnable(docs)), ["doc_id", "held_out"])
