from __future__ import annotations

import base64
import hashlib
import io
import os

import pytest
import zstandard

from lodestream.llm import op9_warc as op9
from lodestream.llm.common import materialize, shared_folder
from tests.llm.test_sharding import same

SCHEMA = "page_id long, url string, html string"
PAGES = [(1, None, "same"), (2, "http://a/\r\nX: y", "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 400_000), (6, "u", "\r\n\r\n"), (None, "u", "same"), (7, "u", "twice"), (7, "u", "twice"), (7, "u", "other")]


def test_query_equals_sql(spark, sf, duck):
    assert same(op9.op9_warc(spark, sf), duck, op9.SQL)


def test_awkward_pages(spark, write):
    got = sorted((tuple(r) for r in op9.op9_warc(spark, write(PAGES, SCHEMA, "pages")).collect()), key=str)
    largest = {}
    for page_id, _, html in PAGES:
        if page_id is not None:
            largest[html or ""] = max(largest.get(html or "", page_id), page_id)
    want = []
    for page_id, _, html in PAGES:
        body = (html or "").encode()
        first = page_id == largest[html or ""]
        want.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else largest[html or ""]))
    assert got == sorted(want, key=str)
    assert op9.op9_warc(spark, write([], SCHEMA, "pages")).count() == 0


@pytest.fixture
def archived(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    folder = shared_folder(spark)
    op9.archive(pages, folder, frame_size=1 << 14, bundle_size=1 << 16)
    return pages, folder.removeprefix("file://"), op9.bundles(spark, folder)


def test_bundles_are_seekable_files(archived):
    pages, folder, files = archived
    html = {r.page_id: r.html for r in pages.collect()}
    data = {}
    for name in os.listdir(folder):
        if name.startswith("part-"):
            with open(f"{folder}/{name}", "rb") as f:
                data[name] = f.read()
    assert len(data) > 1 and any(len(op9.read_seek_table(x)) > 2 for x in data.values())
    entries = op9.index(files).collect()
    assert sorted(r.page_id for r in entries) == sorted(html)
    for r in entries:
        ((headers, payload),) = op9.records(data[r.bundle.rpartition("/")[2]], [(r.frame_no, r.offset, r.size)])
        assert headers["warc-record-id"] == f"<urn:page:{r.page_id}>"
        assert payload == (html[r.page_id].encode() if headers["warc-type"] == "response" else b"")
    for x in data.values():
        # Any Zstandard reader takes the file as it is.
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(x), read_across_frames=True).read()
        assert len(whole) == sum(t[3] for t in op9.read_seek_table(x)) and whole.startswith(b"WARC/1.1")


def test_some_records_are_fetched_by_the_index(archived):
    _, _, files = archived
    entries = op9.index(files)
    assert sorted(r.page_id for r in op9.fetch(files, entries.filter("page_id % 7 = 3")).collect()) == sorted(r.page_id for r in entries.filter("page_id % 7 = 3").collect())


@pytest.mark.parametrize("what", ["seek table", "index"])
def test_a_damaged_seek_table_or_index_is_noticed(spark, archived, what):
    _, folder, files = archived
    entries = materialize(op9.index(files))
    path = entries.groupBy("bundle").count().orderBy("bundle").first().bundle.removeprefix("file:")
    with open(path, "rb") as f:
        data = bytearray(f.read())
    if what == "seek table":
        data[-9 - 8 * len(op9.read_seek_table(bytes(data)))] ^= 1  # the first frame's size
    else:
        at, size, _, _ = op9.read_seek_table(bytes(data))[-1]
        data[at + 8 + 1 + 8 + 4] ^= 1  # the first record's offset
    with open(path, "wb") as f:
        f.write(data)
    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    again = op9.bundles(spark, f"file://{folder}")
    with pytest.raises(Exception):  # noqa: B017
        op9.fetch(again, entries if what == "seek table" else op9.index(again)).collect()
    with pytest.raises(Exception):  # noqa: B017
        op9.fetch(again).collect()


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 9), (4, "b", 9)], "page_id long, sha1 string, payload_bytes long")
    assert {r.page_id: (r.record_type, r.refers_to) for r in op9.roles(pages, 5).collect()} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
