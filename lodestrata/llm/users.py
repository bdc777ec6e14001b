"""Current user documents and their arrays as sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import map_arrow


def id_sets(lists: pa.ListArray) -> pa.ListArray:
    """Each list as a sorted set of ids without spaces around them; null and blank ids do not count, a null list is empty."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    size = np.where(np.asarray(lists.is_valid()), np.diff(ends), 0)
    values = pc.utf8_trim(lists.flatten(), " ").dictionary_encode()  # the entries of null lists are not in it
    owner = np.repeat(np.arange(len(lists)), size)
    known = np.asarray(pc.fill_null(pc.greater(pc.binary_length(values.dictionary), 0), False)) if len(values.dictionary) else np.zeros(0, bool)
    code = pc.fill_null(values.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    kept = (code >= 0) & np.r_[known, False][code]
    owner, code = owner[kept], code[kept]
    in_order = pc.sort_indices(values.dictionary).to_numpy().astype(np.int64)  # by bytes
    rank = np.empty(len(in_order), np.int64)
    rank[in_order] = np.arange(len(in_order))
    place = np.unique(owner * (len(rank) + 1) + rank[code])
    owner, code = np.divmod(place, len(rank) + 1)
    offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(lists)))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values.dictionary.take(pa.array(in_order[code])))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), *(id_sets(c) for c in batch.columns[1:])], names=batch.schema.names)


def current_users(user_doc: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(id, *fields): the version with the highest seq of each id, ``fields`` as sets (``id_sets``).

    Null and blank ids and null seq do not count; a null array is an empty set.
    """
    src = user_doc.select(F.trim("id").alias("id"), "seq", F.struct(*[F.col(f"`{c}`") for c in fields]).alias("doc")).where("length(id) > 0 and seq is not null")
    newest = src.groupBy("id").agg(F.max_by("doc", "seq").alias("doc"))
    return map_arrow(newest.select("id", "doc.*"), _clean, f"id string, {', '.join(f'`{c}` array<string>' for c in fields)}")
