"""Applying a stream of inserts, updates and deletes (associative patch composition).

An ordered operation on a key is a function from the key's state (a row, or
absent) to its next state:

* insert  -> the constant function "this row" (it replaces a live row),
* delete  -> the constant function "absent",
* update  -> "the same row with these columns overwritten" (a null column of an
  update leaves the column as it is; an update of an absent row does nothing).

A *patch* is the composition of the functions of a range of the order.  It has
a normal form of constant width: the last constant function of the range
(``reset``) and, per column, the last overwrite (``set``), each with its place
in the order.  Composing two patches keeps, component by component, the one
placed later; that is associative and idempotent, so repeated deliveries are
harmless and ranges can be reduced as a tree.

``compose`` reduces (key, range chunk) first and the chunks of a key next.
Both levels are plain aggregates, so Spark also combines on the map side: a
key holding a third of all changes is spread over its range chunks and no task
ever sees more than one patch per (map task, chunk) of it.  ``apply_patches``
then applies the one patch of each key to a base table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def operation(op: Column, spellings: Mapping[str, Sequence[str]]) -> Column:
    """``op`` as one of insert, update, delete; null where it is none of the spellings.

    Case and surrounding white space do not count.
    """
    plain = F.upper(F.regexp_replace(op.cast("string"), r"^\s+|\s+$", ""))
    found = F.lit(None).cast("string")
    for kind, words in spellings.items():
        found = F.when(plain.isin([w.upper() for w in words]), F.lit(kind)).otherwise(found)
    return found


def place(major: Column, minor: Column, tie: Column) -> Column:
    """(major, minor) packed into one decimal that sorts alike.

    One number instead of a struct keeps the aggregates on hash aggregation.
    The last nine digits come from ``tie`` (a hash of the change's content):
    two different changes claiming one place resolve the same way in each run.
    """
    wide = major.cast("decimal(19,0)") * F.lit(4294967296).cast("decimal(10,0)")
    wide = wide + (minor.cast("decimal(10,0)") + F.lit(2147483648).cast("decimal(10,0)"))
    wide = wide.cast("decimal(29,0)") * F.lit(1000000000).cast("decimal(10,0)")
    return (wide + F.pmod(tie, F.lit(1000000000)).cast("decimal(9,0)")).cast("decimal(38,0)")


def leaves(
    changes: DataFrame,
    *,
    key: str,
    major: str,
    minor: str,
    kind: Column,
    columns: Sequence[str],
    chunk_span: int,
) -> DataFrame:
    """One patch per change.

    Changes without a key, a place in the order or a known operation change
    nothing and are left out.
    """
    src = changes.select(
        F.col(f"`{key}`").alias("k"),
        F.col(f"`{major}`").alias("ma"),
        F.col(f"`{minor}`").alias("mi"),
        kind.alias("op"),
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)],
    ).where("k is not null and ma is not null and mi is not null and op is not null")
    cs = [f"c{i}" for i in range(len(columns))]
    at = place(F.col("ma"), F.col("mi"), F.xxhash64("op", *cs))
    constant = F.col("op") != UPDATE
    out = [
        F.col("k"),
        F.floor(F.col("ma") / F.lit(chunk_span)).cast("long").alias("chunk"),
        F.when(constant, at).alias("reset_at"),
        F.when(constant, F.col("op") == INSERT).alias("reset_live"),
    ]
    for c in cs:
        changed = ~constant & F.col(c).isNotNull()
        out += [
            F.when(F.col("op") == INSERT, F.col(c)).alias(f"reset_{c}"),
            F.when(changed, at).alias(f"set_at_{c}"),
            F.when(changed, F.col(c)).alias(f"set_{c}"),
        ]
    return src.select(*out)


def _combine(columns: Sequence[str]) -> list[Column]:
    keep = [
        F.max_by("reset_live", "reset_at").alias("reset_live"),
        F.max("reset_at").alias("reset_at"),
    ]
    for c in columns:
        keep += [
            F.max_by(f"reset_{c}", "reset_at").alias(f"reset_{c}"),
            F.max_by(f"set_{c}", f"set_at_{c}").alias(f"set_{c}"),
            F.max(f"set_at_{c}").alias(f"set_at_{c}"),
        ]
    return keep


def compose(patches: DataFrame, n_columns: int, *, fan_in: int = 64, levels: int = 1) -> DataFrame:
    """Tree reduction: range chunks of each key, ``levels`` times ``fan_in`` to one, then keys."""
    cs = [f"c{i}" for i in range(n_columns)]
    for level in range(levels):
        if level:
            patches = patches.withColumn("chunk", F.floor(F.col("chunk") / F.lit(fan_in)).cast("long"))
        patches = patches.groupBy("k", "chunk").agg(*_combine(cs))
    return patches.groupBy("k").agg(*_combine(cs))


def apply_patches(base: DataFrame | None, patches: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """State after the patches: ``base`` (one row per key, or None for empty) with each patch applied."""
    p = patches
    if base is None:
        p = p.withColumn("base_live", F.lit(False))
        for i in range(len(columns)):
            p = p.withColumn(f"base_c{i}", F.lit(None).cast(p.schema[f"reset_c{i}"].dataType))
    else:
        b = base.where(F.col(f"`{key}`").isNotNull()).select(
            F.col(f"`{key}`").alias("k"),
            F.lit(True).alias("base_live"),
            *[F.col(f"`{c}`").alias(f"base_c{i}") for i, c in enumerate(columns)],
        )
        p = b.join(p, "k", "full_outer").withColumn("base_live", F.coalesce("base_live", F.lit(False)))
    was_reset = F.col("reset_at").isNotNull()
    live = F.when(was_reset, F.col("reset_live")).otherwise(F.col("base_live"))
    out = [F.col("k").alias(key)]
    for i, name in enumerate(columns):
        before = F.when(was_reset, F.col(f"reset_c{i}")).otherwise(F.col(f"base_c{i}"))
        later = F.col(f"set_at_c{i}").isNotNull() & (~was_reset | (F.col(f"set_at_c{i}") > F.col("reset_at")))
        out.append(F.when(later, F.col(f"set_c{i}")).otherwise(before).alias(name))
    return p.where(live).select(*out)


def apply_changes(
    changes: DataFrame,
    *,
    key: str,
    major: str,
    minor: str,
    op: str,
    columns: Sequence[str],
    spellings: Mapping[str, Sequence[str]],
    base: DataFrame | None = None,
    chunk_span: int = 512,
    fan_in: int = 64,
    levels: int = 1,
) -> DataFrame:
    """Current state of a table after a change feed, in any order of arrival.

    ``major`` and ``minor`` (integers) give a change's place; ``columns`` are
    the payload.  Result: ``key`` and ``columns``, one row per live key.

    Defined cases: a null key, place or unknown operation: the change is
    ignored; a repeated change counts once; two different changes at one place:
    a content hash decides, the same in each run; a null payload of an insert
    stays null, of an update leaves the column; an empty feed gives the base;
    further columns of ``changes`` are ignored, whatever their names.
    """
    patches = leaves(
        changes, key=key, major=major, minor=minor,
        kind=operation(F.col(f"`{op}`"), spellings), columns=columns, chunk_span=chunk_span,
    )
    return apply_patches(base, compose(patches, len(columns), fan_in=fan_in, levels=levels), key, columns)


#: Spellings of the manifest's operation enum (fixed values).
MANIFEST_OPERATIONS = {INSERT: ("CREATE", "0"), DELETE: ("DELETE", "1")}


def live_tables(manifest: DataFrame, **options) -> DataFrame:
    """Live tables and their levels (id, level) after all manifest changes."""
    return apply_changes(
        manifest, key="id", major="version", minor="ordinal", op="op",
        columns=["level"], spellings=MANIFEST_OPERATIONS, **options,
    )
