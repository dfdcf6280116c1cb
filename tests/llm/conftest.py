from __future__ import annotations

import glob
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward():
    """Nulls in every column, empty and long texts, ties, repeated rows, other scripts."""
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [
        (0, None, None, None, None),
        (1, "", "en", "b", 0),
        (2, "   \t\n ", "en", "b", 5),
        (3, "One two", "en", "a", 7),
        (4, "one TWO", "en", None, 7),
        (5, passage, "en", "a", len(passage)),
        (6, passage, "en", "a", len(passage)),
        (6, passage, "en", "a", len(passage)),
        (7, "before " + passage + " after", None, "a", None),
        (8, passage.replace("word30", "other"), "en", "c", 1),
        (9, "ab" * 4000, "en", "c", 8000),
        (10, "你好 世界 \U0001f600 " * 30, "zh", "é", 1),
        (11, "1234 !!", "en", "b", 7),
        (None, "a row without an id", "en", "b", 1),
        (12, " ".join(f"w{i % 997}x{i}" for i in range(30_000)), "en", "b", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def write(spark, tmp_path_factory):
    """Writes rows as one table of a new data directory, with an extra column of a clashing name."""

    def make(rows, schema, name="documents", extra="key"):
        folder = str(tmp_path_factory.mktemp("data"))
        df = spark.createDataFrame(rows, schema)
        if extra:
            df = df.withColumn(extra, df[df.columns[0]])
        df.write.parquet(f"{folder}/{name}.parquet")
        return folder

    return make
