"""Syncing on a schedule or on demand.

Each trigger takes the listings that arrived since the last one. A batch is
written under its own number, replacing what is there, so that a batch that is run again
after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestream.operators.refs import enumerate_refs, mirror
from lodestream.sources.refs import parse_listing, write_mirror

EVERY = "15 minutes"


def sync(spark: SparkSession, listings: str, out: str, state: str, once: bool = False, every: str = EVERY) -> StreamingQuery:
    """Mirror listings from a folder into `out`, at every interval; once=True takes what is there and ends.

    `read_current` gives the refs as the syncs so far left them.
    """

    def batch(lines: DataFrame, number: int) -> None:
        write_mirror(mirror(enumerate_refs(parse_listing(lines))), f"{out}/sync={number}")

    writer = spark.readStream.text(listings).writeStream.foreachBatch(batch).option("checkpointLocation", state)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=every).start()
