"""Pseudonym expressions for identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pseudonym(col: Column | str, method: str = "sha2", salt: str = "") -> Column:
    """Pseudonym of an identifier column.

    ``sha2``: hex SHA-256 of ``salt || id``; NULL stays NULL.
    ``murmur3``: Spark's 32-bit ``hash`` of the id, the function the
    reference applies in its private zone (collides beyond ~10^5 ids,
    unsalted, and maps NULL to 42; kept for parity only).
    """
    c = F.col(col) if isinstance(col, str) else col
    if method == "sha2":
        return F.sha2(F.concat(F.lit(salt), c.cast("string")), 256) if salt else F.sha2(c.cast("string"), 256)
    if method == "murmur3":
        return F.hash(c)
    raise ValueError(f"unknown pseudonym method: {method!r}")


def pseudonym_of(value: str, method: str = "sha2", salt: str = "") -> Column:
    """The pseudonym of one clear identifier, for lookups in a private store."""
    return pseudonym(F.lit(value), method=method, salt=salt)
