"""URL filter: rules on host and path, else a character language-model ratio.

Two Markov models of bytes, one of the urls that rules allow and one of those they block, interpolate
the orders 1 to `ORDER`: an order's estimate leans on the order below it as on `PRIOR` observations. A url's
score is the difference of its log-likelihoods for each byte; the threshold is calibrated on a fifth of the
labelled urls, held out by hash, to the best mean of both classes' accuracies. The counts that scores are
made of are those of all labelled urls, for calibration of all but the fifth. They are exact, in a table of n-grams
that is never gathered: urls are scored in chunks, each of which joins its own n-grams with the table.

Null urls and urls without `://` have empty host and path, and fit no rule. A null or empty url scores 0.
Without labelled urls of both kinds everything that fits no rule is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import documents, materialize, slices, text_bytes

#: (verdict, host, path), fixed values.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ORDER = 5
#: Bytes of urls in a chunk; a longer url is a chunk of its own.
CHUNK = 1 << 18
PRIOR = 2.0
BIN = 0.02
#: In place of grams: all bytes, and all urls that have any.
BYTES, URLS = -1, -2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z in lower case) and path."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    return (
        df.withColumn("rest", rest)
        .withColumn("host", host)
        .withColumn("path", F.regexp_extract(F.substring(F.col("rest"), F.length("host") + 1, F.length("rest")), r"^[^?#]*", 0))
        .withColumn("host", F.translate("host", UPPER, LOWER))
        .drop("rest")
    )


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path as one string) and its verdict; null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    host, path = F.col("host"), F.col("path")
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    chain = lambda values: reduce(lambda done, x: F.when(x[0], F.lit(x[1])).otherwise(done), reversed(list(zip(fits, values, strict=True))), F.lit(None).cast("string"))
    return chain([h + p for _, h, p in ordered]), chain([v for v, _, _ in ordered])


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the urls its 1- to ORDER-grams (ORDER rows), as numbers that are theirs alone, and the urls' offsets."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    pad = ORDER - 1
    size = np.diff(offsets)
    padded = np.zeros(len(data) + n * pad, np.uint64)
    at = np.arange(len(data)) + (np.repeat(np.arange(n), size) + 1) * pad
    padded[at] = data.astype(np.uint64) + np.uint64(1)
    out = np.empty((ORDER, len(data)), np.int64)
    packed = np.zeros(len(data), np.uint64)
    for o in range(ORDER):
        packed = packed | (padded[at - o] << np.uint64(9 * o))
        out[o] = (packed * np.uint64(8) + np.uint64(o)).astype(np.int64)
    return out, offsets


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, held, allowed, blocked) of each slice of urls (url, held, blocked); grams BYTES and URLS count bytes and urls."""
    for batch in batches:
        for part in slices(batch, "url", CHUNK):
            found, offsets = grams(part.column("url"))
            size = np.diff(offsets)
            kind = np.asarray(part.column("held").to_numpy(zero_copy_only=False), np.int64) * 2 + np.asarray(part.column("blocked").to_numpy(zero_copy_only=False), np.int64)
            row = np.repeat(kind, size)
            more = [np.full(len(row), BYTES), np.full(int((size > 0).sum()), URLS)]
            gram, at = np.unique(np.concatenate([found.ravel(), *more]), return_inverse=True)
            of = np.concatenate([np.tile(row, ORDER), row, kind[size > 0]])
            total = np.bincount(at * 4 + of, minlength=4 * len(gram)).reshape(-1, 2, 2)
            for held in (0, 1):
                some = np.flatnonzero(total[:, held].any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(gram[some]), pa.array(np.full(len(some), bool(held))), *(pa.array(total[some, held, k].astype(np.int64)) for k in (0, 1))], names=["gram", "held", "allowed", "blocked"])


def scores(gram: np.ndarray, counts: np.ndarray, totals: np.ndarray, column: pa.Array) -> np.ndarray:
    """Log-likelihood under the first model less that under the second, for each byte of a url.

    gram: ascending; counts: (2, grams) of both models, totals: (2, 2) their bytes and urls.
    """
    wanted, offsets = grams(column)
    n = wanted.shape[1]
    gram, counts = np.append(gram, np.iinfo(np.int64).max), np.concatenate([counts, np.zeros((2, 1))], axis=1)
    at = np.searchsorted(gram, wanted)
    at[gram[at] != wanted] = len(gram) - 1
    logs, starts = np.zeros(n), offsets[:-1][np.diff(offsets) > 0]
    for kind, sign in ((0, 1.0), (1, -1.0)):
        p, context = np.full(n, 1 / 256), np.full(n, totals[kind, 0])
        for o in range(ORDER):
            found = counts[kind][at[o]]
            p = (found + PRIOR * p) / (context + PRIOR)
            # The next order's context is this order's gram one byte before; before the first byte, a url's start.
            context = np.concatenate([totals[kind, 1:], found[:-1]])[:n]
            context[starts] = totals[kind, 1]
        logs += sign * np.log(p)
    # Summed url by url: a url's score doesn't depend on those beside it.
    sums = np.zeros(len(offsets) - 1)
    if n:
        sums[np.diff(offsets) > 0] = np.add.reduceat(logs, starts)
    return sums / np.maximum(np.diff(offsets), 1)


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds chunk, a number for about CHUNK bytes of urls of one task."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, "url", CHUNK):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, chunk))], names=[*part.schema.names, "chunk"])
            chunk += 1


def wanted_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, gram) of chunks' urls, once for each run of a chunk's rows."""
    for batch in batches:
        chunk = np.asarray(batch.column("chunk"))
        cuts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]])) if len(chunk) else np.zeros(1, np.int64)
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            gram = np.unique(grams(batch.column("url").slice(begin, end - begin))[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), chunk[begin])), pa.array(gram)], names=["chunk", "gram"])


def scored(urls: DataFrame, counts: DataFrame, totals: np.ndarray) -> DataFrame:
    """urls (chunk, url, and any others; materialized) with score, by counts (gram, allowed, blocked)."""
    wanted = urls.select("chunk", "url").mapInArrow(wanted_grams, "chunk long, gram long").distinct()
    found = wanted.join(counts, "gram").select("chunk", "gram", "allowed", "blocked")

    def score(rows: pa.Table, known: pa.Table) -> pa.Table:
        gram, allowed, blocked = (known[c].to_numpy() for c in ("gram", "allowed", "blocked"))
        order = np.argsort(gram)
        values = scores(gram[order], np.stack([allowed, blocked])[:, order].astype(np.float64), totals, rows["url"].combine_chunks())
        return rows.append_column("score", pa.array(values, pa.float64()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in urls.schema) + ", score double"
    return urls.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(score, schema)


def threshold(bins: dict[str, list]) -> float:
    """The middle of the gap between bins of held out scores that parts allowed (a) and blocked urls (b) best."""
    na, nb = sum(bins["a"]), sum(bins["b"])
    if not na or not nb:
        return 0.0
    ordered = sorted(zip(bins["bin"], bins["a"], bins["b"], strict=True))
    cuts, a, b, end = [], 0, 0, ordered[0][0]
    for start, more_a, more_b in ordered:
        middle = (end + start) / 2 * BIN  # of the gap between the bins below and above
        cuts.append((a / na - b / nb, abs(middle), middle))  # below it: allowed ones lost, blocked ones caught
        a, b, end = a + more_a, b + more_b, start + 1
    return min(cuts)[2]


def train(urls: DataFrame) -> tuple[DataFrame, np.ndarray, float] | None:
    """(gram, allowed, blocked) of all labelled urls, their bytes and urls by kind, and the threshold; None without urls of both kinds.

    urls: (chunk, url, verdict), materialized; verdict is null for those not labelled.
    """
    labelled = urls.filter("verdict is not null").select("chunk", "url", (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("held"), (F.col("verdict") == "block").alias("blocked"))
    counted = labelled.select("url", F.coalesce("held", F.lit(False)).alias("held"), "blocked").mapInArrow(count_grams, "gram long, held boolean, allowed long, blocked long")
    sums = materialize(counted.groupBy("gram").agg(*(F.sum(F.when(~F.col("held") | F.lit(everything), F.col(k)).otherwise(0)).alias(f"{k}_{name}") for name, everything in (("part", False), ("all", True)) for k in ("allowed", "blocked"))))

    def model(name: str) -> tuple[DataFrame, np.ndarray]:
        table = sums.select("gram", F.col(f"allowed_{name}").alias("allowed"), F.col(f"blocked_{name}").alias("blocked"))
        by = {r.gram: (r.allowed, r.blocked) for r in table.filter(F.col("gram").isin(BYTES, URLS)).collect()}
        return table, np.array([by.get(x, (0, 0)) for x in (BYTES, URLS)], np.float64).T

    (table, totals), (part, part_totals) = model("all"), model("part")
    if not totals[:, 0].all():
        return None
    if not part_totals[:, 0].all():
        return table, totals, 0.0
    bins = scored(labelled.filter("held"), part, part_totals).groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(F.count_if(~F.col("blocked")).alias("a"), F.count_if("blocked").alias("b")).toArrow().to_pydict()
    return table, totals, threshold(bins)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of pages (page_id, url); score is null where a rule decides."""
    rule, verdict = rule_columns(rules)
    split = split_url(pages.select("page_id", "url")).withColumn("rule", rule).withColumn("verdict", verdict)
    ruled = materialize(split.mapInArrow(chunked, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in split.schema) + ", chunk long"))
    trained = train(ruled.select("chunk", "url", "verdict"))
    open_ = ruled.filter("verdict is null")
    decided = open_.withColumn("score", F.lit(0.0)) if trained is None else scored(open_, *trained[:2])
    decided = decided.withColumn("verdict", F.when(F.col("score") >= F.lit(0.0 if trained is None else trained[2]), "allow").otherwise("block"))
    columns = ["page_id", "host", "path", "rule", "verdict", "score"]
    return ruled.filter("verdict is not null").withColumn("score", F.lit(None).cast("double")).select(columns).unionByName(decided.select(columns))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir, "pages"))
