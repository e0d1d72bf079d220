"""Entity ids: collection 1 uses ids >= 0, collection 2 uses ids < 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_second(file_id: Column) -> Column:
    """Signed id of a collection-2 entity numbered ``file_id`` (0, 1, 2, ...)."""
    return -(file_id + F.lit(1))


def decode_second(entity_id: Column) -> Column:
    return -entity_id - F.lit(1)


def is_first(entity_id: Column) -> Column:
    return entity_id >= 0


def is_second(entity_id: Column) -> Column:
    return entity_id < 0
