"""Size-tiered compaction of shards under a versioned manifest; data moves by DataFrame reads and writes only.

Arrivals are appended as runs: folders of small immutable Parquet shards, written where they are read, without
a shuffle. Runs of similar size (one tier: sizes within a factor of `FANOUT`) are merged once there are `FANOUT` of
them, into one run of files of about `TARGET` bytes; merging coalesces the scan's partitions and shuffles nothing
either. Merging goes on until no tier is full.

A manifest names the runs that make up a version. Whoever creates the claim on the number after its base, which only one can,
writes the manifest aside and renames it into place: of writers with one base all but one fail with `Conflict`, whatever they
do between, and readers see a whole version or the one before. Runs stay when they are merged, so that every version remains
readable; `vacuum` deletes those that only older versions need. A job that dies leaves files that no manifest names, which
`vacuum` takes too, and at worst a claim without a manifest, which `release_claim` takes away once its writer is known
to be dead. The driver holds run-level figures, which don't grow with rows.

Rows are kept as they are, nulls, empty and repeated ones among them, under whatever names their columns have. An empty table is
a version with no rows.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import documents, shared_folder

FANOUT = 4
TARGET = 128 << 20
ARRIVALS = 16


class Conflict(RuntimeError):
    """Another writer has taken the version."""


class Shards:
    """A table of shards in a folder."""

    def __init__(self, spark: SparkSession, folder: str, target: int = TARGET, fanout: int = FANOUT):
        self.spark, self.folder, self.target, self.fanout = spark, folder, target, fanout
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{folder}/manifests"))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/manifests"))]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit())

    def _new_run(self) -> str:
        return f"{self.folder}/runs/{uuid.uuid4().hex}"

    def _create(self, name: str) -> bool:
        """Creates an empty file; False if there is one."""
        path = self._fs.makeQualified(self._path(name))
        if path.toUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then
            return self.spark._jvm.java.io.File(path.toUri().getPath()).createNewFile()
        try:
            self._fs.create(path, False).close()
            return True
        except Exception:
            if self._fs.exists(path):
                return False
            raise

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        return max(self._versions(), default=0)

    def runs(self, version: int | None = None) -> list[dict]:
        """A version's runs: path, bytes, rows, files."""
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["runs"]
        finally:
            stream.close()

    def commit(self, runs: list[dict], base: int) -> int:
        """Makes the runs the version after `base`, which only one writer can."""
        number = base + 1
        if base and base not in self._versions():
            raise Conflict(f"there is no version {base}")
        if not self._create(self._claim(number)):
            raise Conflict(f"version {number} is taken")
        aside, place = (self._path(f"{self.folder}/manifests/{n}") for n in (f"_{number}.{uuid.uuid4().hex}", f"{number:010d}.json"))
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"version": number, "base": base, "runs": runs}).encode()))
        out.close()
        if not self._fs.rename(aside, place):
            raise Conflict(f"version {number} can't be put in place")
        return number

    def _claim(self, number: int) -> str:
        return f"{self.folder}/manifests/{number:010d}.claim"

    def release_claim(self) -> None:
        """Takes away the claim on the next version. Only for when its writer is dead: a live one would still commit."""
        self._fs.delete(self._path(self._claim(self.version() + 1)), False)

    def vacuum(self, retain: int = 10) -> None:
        """Deletes manifests but for the last `retain`, and the runs that none of those names. No writer may be at work."""
        versions = self._versions()
        needed = {r["path"] for v in versions[-retain:] for r in self.runs(v)}
        named = lambda path: any(n == path or n.startswith(path + "/") for n in needed)
        if self._fs.exists(self._path(f"{self.folder}/runs")):
            for run in self._fs.listStatus(self._path(f"{self.folder}/runs")):
                path = run.getPath().toString()
                if not named(path):
                    self._fs.delete(run.getPath(), True)
                    continue
                for lot in self._fs.listStatus(run.getPath()):
                    if lot.isDirectory() and path not in needed and not named(lot.getPath().toString()):
                        self._fs.delete(lot.getPath(), True)
        for v in versions[:-retain]:
            self._fs.delete(self._path(f"{self.folder}/manifests/{v:010d}.json"), False)

    def _measured(self, paths: list[str]) -> list[dict]:
        """Figures of new runs, from the files' own metadata; reads no column."""
        if not paths:
            return []
        files = self.spark.read.parquet(*paths).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        runs = files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("path")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.count("*").alias("files"))
        return [{"path": r.path, "bytes": r.bytes, "rows": r.rows, "files": r.files} for r in sorted(runs.collect())]

    def append(self, arrivals: DataFrame, by: Column | None = None) -> int:
        """Adds rows as one run, or with `by` (a small integer, not stored) as a run for each of its values, in one job."""
        base = self.version()
        have = self.runs(base)
        at = self._new_run()
        if by is None:
            arrivals.write.option("compression", "zstd").parquet(at)
            new = [at]
        else:
            lot = f"lot_{uuid.uuid4().hex}"  # clashes with no column
            arrivals.withColumn(lot, by).write.option("compression", "zstd").partitionBy(lot).parquet(at)
            new = [s.getPath().toString() for s in self._fs.listStatus(self._path(at)) if s.isDirectory()]
            if not new:  # no rows, hence no folder that could tell the columns
                arrivals.write.mode("overwrite").parquet(at)
                new = [at]
        return self.commit(have + (self._measured(new) or [self._empty(at)]), base)

    def _empty(self, at: str) -> dict:
        return {"path": self._fs.makeQualified(self._path(at)).toString(), "bytes": 0, "rows": 0, "files": 0}

    def tier(self, size: int) -> int:
        return int(math.log(max(size, 1) / (1 << 16), self.fanout)) if size > 1 << 16 else 0

    def compact(self, retain: int | None = None) -> int:
        """Merges full tiers until none is left; the version then. retain: vacuum after each merge, where nobody else reads or writes."""
        while True:
            base = self.version()
            runs = self.runs(base)
            tiers = defaultdict(list)
            for r in runs:
                tiers[self.tier(r["bytes"])].append(r)
            full = [t for t in sorted(tiers) if len(tiers[t]) >= self.fanout]
            if not full:
                return base
            merged = tiers[full[0]]
            at = self._new_run()
            rows = self.read(runs=merged).coalesce(max(1, -(-sum(r["bytes"] for r in merged) // self.target)))
            rows.write.option("compression", "zstd").parquet(at)
            kept = [r for r in runs if r not in merged]
            self.commit(kept + (self._measured([at]) or [self._empty(at)]), base)
            if retain is not None:
                self.vacuum(retain)

    def read(self, version: int | None = None, runs: list[dict] | None = None) -> DataFrame:
        """The rows of a version, the last if none is named, or of the given runs."""
        return self.spark.read.parquet(*(r["path"] for r in (self.runs(version) if runs is None else runs)))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in ARRIVALS lots, by a hash of doc_id; the compacted shards are read back through the manifest.

    The folder is this query's own, so that versions before the last are not kept.
    """
    shards = Shards(spark, shared_folder(spark))
    docs = documents(spark, sf_dir)
    shards.append(docs, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)).cast("int"))
    shards.compact(retain=1)
    return shards.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"
