"""Encoding of a whole corpus with a public byte-level BPE vocabulary (transducer lexicon).

1. Words are counted over the whole corpus; the ``lexicon_words`` most frequent
   (a parameter, it bounds the lexicon and changes no result) are merged once
   and compiled into a minimal acyclic transducer on the driver.
2. The transducer is one file in the shared folder, handed to each executor
   and memory-mapped there by all its Python workers.
3. Each batch of texts is cut into words by the vocabulary's pattern; the
   distinct words of the batch walk the transducer together, and words it lacks
   are merged exactly by the vocabulary's ranks.  Whole texts are encoded; there
   is no shuffle besides the word count.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.lexicon import Lexicon, build
from lodestrata.llm.pieces import WHITE, expanded, gather, slices
from lodestrata.session import map_arrow, shared_dir, write_bytes

#: Splits text before the merges; the published pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Folder of the vocabularies; an argument of ``encode`` overrides it.
VOCABULARIES = "/opt/tokenizers"
#: White space and what follows it up to the next: words never cross its ends.
_CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_WORDS = regex.compile(PATTERN).findall

_MERGERS: dict[str, object] = {}
_LEXICONS: dict[str, Lexicon] = {}
_ADDED: set[tuple[str, str]] = set()


def _merger(path: str):
    """The vocabulary's exact merges of one word, kept by this process."""
    if path not in _MERGERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        _MERGERS[path] = own._core_bpe.encode_single_piece
    return _MERGERS[path]


def _encoder(vocabulary: str, lexicon_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = _merger(vocabulary)
        if lexicon_file not in _LEXICONS:
            _LEXICONS.clear()
            _LEXICONS[lexicon_file] = Lexicon(SparkFiles.get(lexicon_file))
        lexicon = _LEXICONS[lexicon_file]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids_of(texts[a:b], lexicon, merge)], names=["id", "ids"])

    return run


def ids_of(texts: list[str | None], lexicon: Lexicon, merge) -> pa.ListArray:
    """Token ids of each text: every distinct word walks the lexicon once, or is merged once."""
    per_text, code, distinct = expanded(texts, _CHUNK, _WORDS)
    start, length = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    table = [np.asarray(lexicon.ids)]
    if len(distinct):
        _, offsets, data = distinct.buffers()
        offsets = np.frombuffer(offsets, np.int64)[distinct.offset:distinct.offset + len(distinct) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        ordinal = lexicon.ordinals(data, offsets)
        known = ordinal >= 0
        start[known] = lexicon.offsets[ordinal[known]]
        length[known] = lexicon.offsets[ordinal[known] + 1] - start[known]
        size, raw = len(table[0]), data.tobytes()
        for i in np.flatnonzero(~known).tolist():
            merged = merge(raw[offsets[i]:offsets[i + 1]])
            start[i], length[i] = size, len(merged)
            size += len(merged)
            table.append(np.array(merged, np.int64))
    flat = np.concatenate(table)[gather(start, length, code)]
    word_ends = np.r_[0, np.cumsum(length[code])]
    text_ends = word_ends[np.r_[0, np.cumsum(per_text)]]
    return pa.ListArray.from_arrays(text_ends.astype(np.int32), pa.array(flat.astype(np.int32)))


def frequent_words(docs: DataFrame, text: str, most: int) -> DataFrame:
    """The ``most`` most frequent words of the corpus as the vocabulary's pattern cuts them, letters only."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(r" ?\p{L}+"), F.lit(0))).alias("word"))
    return words.groupBy("word").count().where(F.col("count") > 1).orderBy(F.desc("count"), "word").limit(most)


def encode(
    docs: DataFrame, *, id: str, text: str, vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken", lexicon_words: int = 1 << 16,
) -> DataFrame:
    """(``id``, ids): token ids of each text, without special tokens.

    Strings that look like special tokens are ordinary text.  Defined cases:
    null and empty text: an empty list; a repeated row: a row each; null ids
    are kept; an empty table: no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    merge = _merger(vocabulary)
    words = [r[0].encode() for r in frequent_words(docs, text, lexicon_words).select("word").collect()]
    built = build(words, [merge(w) for w in words])
    name = f"lexicon-{hashlib.sha256(built).hexdigest()[:32]}.bin"  # executors know the file by it; one corpus, one file
    if (spark.sparkContext.applicationId, name) not in _ADDED:
        path = f"{shared_dir(spark)}/{name}"  # stays as long as executors may come
        write_bytes(spark, path, built)
        spark.sparkContext.addFile(path)
        _ADDED.add((spark.sparkContext.applicationId, name))
    out_type = docs.schema[id].dataType.simpleString()
    src = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    out = map_arrow(src, _encoder(vocabulary, name), f"id {out_type}, ids array<int>")
    return out.withColumnRenamed("id", id)
