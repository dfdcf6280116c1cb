"""Names of refs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "mirror/"


def mirrored_name(name: Column, prefix: str = PREFIX) -> Column:
    """The name under which a ref is kept; null for a null name."""
    return F.concat(F.lit(prefix), name)


def in_namespace(target: Column, prefix: str = PREFIX) -> Column:
    """Whether a target may be written: a name below the prefix, never null."""
    return F.coalesce(target.startswith(prefix) & (F.length(target) > len(prefix)), F.lit(False))
