"""Structured Streaming jobs."""

from lodestream.streaming.sync import EVERY, sync

__all__ = ["EVERY", "sync"]
