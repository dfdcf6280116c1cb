"""Column functions."""

from lodestream.functions.refs import in_namespace, mirrored_name

__all__ = ["in_namespace", "mirrored_name"]
