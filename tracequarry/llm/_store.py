"""What the operators share: intermediate tables and sizes (from the library) and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracequarry.store import fresh, hot_keys, met, parts, removed, scratch, shared_dir, size_of, stored

__all__ = ["crc", "fresh", "hot_keys", "met", "parts", "removed", "scratch", "shared_dir", "size_of", "stored"]


def crc(text: Column) -> Column:
    """Unsigned CRC32 of the UTF-8 bytes as long."""
    return F.crc32(text.cast("binary"))
