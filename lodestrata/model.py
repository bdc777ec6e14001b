"""Data model: the change log's schema, options and errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: A change log: every put and delete of every key, in any physical order.
LOG = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("seq", T.LongType()),
    T.StructField("is_delete", T.BooleanType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("expires_at", T.LongType()),
    T.StructField("meta", T.ByteType()),
])
#: A pointer to a separated value.
POINTER = T.StructType([
    T.StructField("fid", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("len", T.LongType()),
])


@dataclass(frozen=True)
class Options:
    """Tunables of a store; sizes in bytes. Defaults are the usual ones of such engines."""

    value_threshold: int = 1024
    value_file_bytes: int = 64 << 20
    max_batch_count: int = 10_000
    max_batch_size: int = 1 << 20
    base_level_size: int = 10 << 20
    level_multiplier: int = 10
    base_table_size: int = 5 << 20
    table_multiplier: int = 2
    memtable_size: int = 1024
    l0_tables: int = 15
    levels: int = 7
    checkpoint_deletions: int = 10_000
    checkpoint_ratio: int = 10
    bloom_fpp: float = 0.01
    max_key_bytes: int = 65_536


class StoreError(Exception):
    """Base of this engine's errors."""


class EmptyKeyError(StoreError):
    """A key is null or empty."""


class KeyNotFoundError(StoreError):
    """No live entry of the key."""


class BatchTooBigError(StoreError):
    """A batch reaches the limit of entries or bytes."""


class InvalidRequestError(StoreError):
    """A parameter is outside its range."""


class NoRewriteError(StoreError):
    """Garbage collection found no file worth rewriting."""


class RejectedError(StoreError):
    """Another commit came first."""


class BlockedWritesError(StoreError):
    """The store is closed for writes."""


class ChecksumError(StoreError):
    """Stored bytes do not match their checksum."""


class MissingTableError(StoreError):
    """The manifest names a run that is not there."""
