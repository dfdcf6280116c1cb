"""DataFrame operators."""

from lodestream.operators.refs import enumerate_refs, guard, mirror, restore, stale

__all__ = ["enumerate_refs", "guard", "mirror", "restore", "stale"]
