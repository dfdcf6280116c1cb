"""Readers and writers."""

from lodestream.sources.refs import read_current, read_listing, read_mirror, write_mirror
from lodestream.sources.tables import table

__all__ = ["read_current", "read_listing", "read_mirror", "table", "write_mirror"]
