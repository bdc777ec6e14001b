"""Column expressions of the key-value model; all run in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.session import ship


def is_live(now: Column | int, is_delete: str = "is_delete", expires_at: str = "expires_at") -> Column:
    """Neither deleted nor expired; ``expires_at`` 0 or null never expires, ``= now`` is expired."""
    now = now if isinstance(now, Column) else F.lit(now)
    e = F.coalesce(F.col(expires_at), F.lit(0))
    return ~F.coalesce(F.col(is_delete), F.lit(False)) & ((e == 0) | (e > now))


def status(now: int, is_delete: str = "is_delete", expires_at: str = "expires_at") -> Column:
    """'deleted', 'expired' or 'live'."""
    e = F.coalesce(F.col(expires_at), F.lit(0))
    return (
        F.when(F.coalesce(F.col(is_delete), F.lit(False)), "deleted")
        .when((e != 0) & (e <= now), "expired").otherwise("live")
    )


def with_ttl(at_seconds: Column, ttl: int) -> Column:
    """Expiry of an entry written at ``at_seconds``."""
    return (at_seconds + F.lit(ttl)).cast("long")


def uvarint_size(x: Column) -> Column:
    """Bytes of an unsigned varint: seven bits each, at least one."""
    bits = F.when(x > 0, F.length(F.bin(x))).otherwise(1)
    return F.ceil(bits / F.lit(7)).cast("long")


def record_size(key_len: Column, value_len: Column, expires_at: Column) -> Column:
    """Bytes of a value-log record: meta, three varints, key, value, checksum."""
    return 1 + uvarint_size(key_len) + uvarint_size(value_len) + uvarint_size(expires_at) + key_len + value_len + 4


def wal_size(key_len: Column, value_len: Column, expires_at: Column) -> Column:
    """Bytes of a write-ahead record: the same without meta."""
    return record_size(key_len, value_len, expires_at) - 1


def estimate_size(key_len: Column, value_len: Column, threshold: int = 1024) -> Column:
    """Bytes an entry takes in a run: its value inline, or a twelve-byte pointer."""
    return F.when(value_len < threshold, key_len + value_len + 1).otherwise(key_len + 12 + 1)


def is_inline(value_len: Column, threshold: int = 1024) -> Column:
    """Values strictly below the threshold stay in the run."""
    return value_len < threshold


def prefix_end(prefix: bytes) -> bytes | None:
    """The smallest key after all keys with ``prefix``; None if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def has_prefix(key: Column, prefix: bytes | str) -> Column:
    """Prefix test as a range, which reaches the Parquet scan as a pushed filter."""
    text = isinstance(prefix, str)
    raw = prefix.encode() if text else prefix
    end = prefix_end(raw)
    test = key >= F.lit(prefix if text else raw)
    if end is None:
        return test
    try:
        return test & (key < F.lit(end.decode() if text else end))
    except UnicodeDecodeError:
        return key.startswith(prefix)


def ranges_overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Closed intervals overlap."""
    return (lo_a <= hi_b) & (lo_b <= hi_a)


def internal_key(key: Column, seq: Column) -> Column:
    """Key and inverted sequence number, so newer versions sort first within a key."""
    inverted = F.lpad(F.hex(F.lit(-1).cast("long") - seq), 16, "0")
    return F.concat(key, F.unhex(inverted))


def parse_key(internal: Column) -> Column:
    """The user key of an internal key."""
    return F.substr(internal, F.lit(1), F.octet_length(internal) - 8)


def next_power_of_two(x: Column) -> Column:
    """Smallest power of two that is at least x (x >= 1)."""
    return F.when(x <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.length(F.bin(x - 1)))).cast("long")


def big_endian(x: Column, width: int) -> Column:
    """The low ``width`` bytes of a number, highest first (4 for u32, 8 for u64); they sort as unsigned numbers do."""
    return F.unhex(F.substr(F.lpad(F.hex(x.cast("long")), 16, "0"), F.lit(17 - 2 * width), F.lit(2 * width)))


def from_big_endian(b: Column) -> Column:
    """The number of at most eight bytes, highest first; eight bytes with the top bit set are a negative long."""
    digits = F.lpad(F.hex(b), 16, "0")
    half = lambda at: F.conv(F.substr(digits, F.lit(at), F.lit(8)), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def file_name(id: Column, suffix: str = ".sst") -> Column:
    """Name of a table's file: its number in five digits at least."""
    text = id.cast("string")
    return F.concat(F.when(F.length(text) < 5, F.lpad(text, 5, "0")).otherwise(text), F.lit(suffix))


def file_id(name: Column, suffix: str = ".sst") -> Column:
    """Number of a table's file by its name, folders before it aside; null for other names."""
    base = F.element_at(F.split(name, "/"), -1)
    digits = F.substr(base, F.lit(1), F.length(base) - len(suffix))
    return F.when(base.endswith(suffix) & digits.rlike("^[0-9]+$"), digits.cast("long"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many bytes two binary values share at their beginning."""
    x, y = F.hex(a), F.hex(b)
    places = F.sequence(F.lit(1), F.least(F.octet_length(a), F.octet_length(b)))
    differs = F.filter(places, lambda i: F.substring(x, 2 * i - 1, 2) != F.substring(y, 2 * i - 1, 2))
    shorter = F.least(F.octet_length(a), F.octet_length(b))
    return F.when(shorter == 0, 0).when(F.size(differs) > 0, differs[0] - 1).otherwise(shorter)


def uvarint(x: Column) -> Column:
    """A number as unsigned varint: seven bits a byte, lowest first, the high bit where more follow."""
    n = uvarint_size(x).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(
        F.call_function("shiftrightunsigned", x.cast("long"), i * 7).bitwiseAND(F.lit(127)) + F.when(i < n - 1, 128).otherwise(0)), 2, "0"))
    return F.unhex(F.array_join(each, ""))


def from_uvarint(b: Column) -> Column:
    """The number of an unsigned varint; null if it ends too early or goes beyond 63 bits."""
    digits = F.hex(b)
    byte = lambda i: F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10).cast("long")
    bytes_ = F.transform(F.sequence(F.lit(0), F.octet_length(b) - 1), byte)
    more = F.size(F.filter(bytes_, lambda x, i: (x >= 128) & (i < F.octet_length(b) - 1)))
    whole = (F.octet_length(b) > 0) & (F.octet_length(b) <= 9) & (more == F.octet_length(b) - 1) & (F.element_at(bytes_, -1) < 128)
    total = F.aggregate(F.transform(bytes_, lambda x, i: F.call_function("shiftleft", x.bitwiseAND(F.lit(127)), i * 7)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return F.when(whole, total)


def random_entries(spark: SparkSession, n: int, value_bytes: int = 16, seed: int = 0):
    """``n`` change-log entries with distinct random keys and values of 0 to ``value_bytes`` bytes; the same for one seed."""
    word = lambda *salt: F.hex(F.xxhash64(F.lit(seed), *[F.lit(s) for s in salt], "id"))
    text = F.concat(*[word("value", i) for i in range(-(-value_bytes // 8))]) if value_bytes else F.lit("")
    size = F.pmod(F.xxhash64(F.lit(seed), F.lit("size"), "id"), F.lit(value_bytes + 1)).cast("int")
    return spark.range(n).select(
        F.unhex(F.concat(word("key"), F.lpad(F.hex("id"), 16, "0"))).alias("key"), (F.col("id") + 1).alias("seq"), F.lit(False).alias("is_delete"),
        F.unhex(F.substr(text, F.lit(1), 2 * size)).alias("value"), F.lit(0).cast("long").alias("expires_at"), F.lit(0).cast("byte").alias("meta"),
    )


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1).astype(np.uint32)
    return table


def crc32c_bytes(values: list[bytes | None]) -> list[int | None]:
    """CRC-32 with the Castagnoli polynomial of each value, all values in lockstep."""
    known = [v or b"" for v in values]
    length = np.array([len(v) for v in known])
    order = np.argsort(-length, kind="stable")
    crc = np.full(len(known), 0xFFFFFFFF, np.uint32)
    table = _crc_table()
    data = np.frombuffer(b"".join(known), np.uint8)
    start = np.cumsum(length) - length
    at, live = 0, len(order)
    sizes = length[order]
    while live and sizes[0] > at:
        live = int(np.searchsorted(-sizes, -at, side="left"))
        rows = order[:live]
        crc[rows] = table[(crc[rows] ^ data[start[rows] + at]) & 0xFF] ^ (crc[rows] >> np.uint32(8))
        at += 1
    return [None if v is None else int(c) for v, c in zip(values, crc ^ np.uint32(0xFFFFFFFF), strict=True)]


@F.pandas_udf(T.LongType())
def _crc32c(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield pd.Series(crc32c_bytes([None if v is None else bytes(v) for v in s]), dtype="Int64")


def crc32c(value: Column) -> Column:
    """CRC-32C of a binary column; Spark's crc32 has another polynomial."""
    ship(SparkSession.active())
    return _crc32c(value)
