"""Evaluation texts leaking into training text (template canonicalisation).

Texts become words (maximal runs of letters and digits after NFKC, removal of
format characters and lower-casing).  In a *template* numbers, names and units
are replaced by typed placeholders; each window of ``window`` words has a
template hash.  Windows of documents are matched with those of the items by
template hash, and the slots decide:

* equal slots: the passage itself (``leaks``);
* slots that differ, but consistently, equal values of the item always
  standing for equal values of the document and the other way round: the same
  question with other parameters (``reparameterised``).

For ``leaks`` the template is a function of the words alone, so a passage that
stands in a document word by word always shares its templates; none is missed.
Windows meet by template and slots together, so a template that very many
windows share (a table of numbers) brings no pairs of different passages.
``reparameterised`` reads each text in three ways (see ``READINGS``), as the
other values need not occur in any item, nor have as many words.  The items
are the stated query set: their windows are matched in blocks of at most
``BLOCK_WINDOWS``, each block's hashes are broadcast, and only matching
windows of documents leave the scan.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.pieces import WHITE, expanded, slices
from lodestrata.operators.skew import fits, split_join
from lodestrata.session import cut, map_arrow

#: Windows of items whose hashes are broadcast at a time (8 MB of template hashes).
BLOCK_WINDOWS = 1 << 20
#: Readings of a text for ``reparameterised``, (names by capitals, values folded): names by the items' list; names by the text's own capitals;
#: the same with each number (1,204.5) and each run of names (Ada Lovelace) as one token, so that values may differ in their number of words.
READINGS = ((False, False), (True, False), (True, True))
#: Texts of which so much of the words inside sentences have a capital give nouns one; a word behind an article is no name there.
CAPITAL_SHARE, ARTICLE = 0.15, 3
#: Words that stand for units (fixed values).
UNITS = frozenset(
    "mm cm dm m km mg g kg t ml cl l s sec min h ms inch inches ft feet yard yards mile miles oz lb lbs pound pounds "
    "percent procent prozent eur euro euros usd dollar dollars gbp celsius fahrenheit km² m² m³ kwh watt volt "
    "second seconds minute minutes hour hours day days week weeks month months year years".split()
)
_FORMAT = regex.compile(r"\p{Cf}+")
#: Runs without white space; normalisation and words never cross their ends.
_CHUNK = re.compile(f"[^{WHITE}]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_DIGIT = regex.compile(r"\p{N}")
#: Chunks with the line end behind them, which ends a sentence.
_LINED = re.compile(f"[^{WHITE}]+(?:[ \\t]*[\\n\\r])?")
#: Marks of a tagged token: what stands before it, behind it (a break, a comma, nothing), its capital, its separator from the number before.
_BREAK, _COMMA, _NONE = "012"
_GROUPED = regex.compile(r"[.,'’](?=\p{N}{3}(?!\p{N}))")
_U = np.uint64


def words_of(text: str | None) -> list[str]:
    """The words of a text."""
    if not text:
        return []
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = _FORMAT.sub("", text)
    return _WORD.findall(text.lower())


def slot_of(word: str, names: frozenset) -> str:
    """Placeholder of a word, '' for an ordinary word."""
    if _DIGIT.search(word):
        return "<num>"
    if word in UNITS:
        return "<unit>"
    return "<name>" if word in names else ""


def _between(text: str) -> str:
    return _NONE if not text or text in "-'’" else _COMMA if text in ",;" else _BREAK


def tagged(chunk: str) -> list[str]:
    """The words of a chunk, each behind four marks: before, behind, capital ('1'), separator within a number (or ' ')."""
    line = chunk[-1] in "\n\r"
    text = chunk.rstrip(" \t\n\r")
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = _FORMAT.sub("", text)
    lower = text.lower()
    if len(lower) != len(text):  # a letter that becomes two: no capital but the first
        text = text[:1] + lower[1:]
    found = list(_WORD.finditer(lower))
    out = []
    for k, m in enumerate(found):
        gap = lower[found[k - 1].end():m.start()] if k else ""
        before = _between(gap) if k else (_NONE if not m.start() else _BREAK)
        end = found[k + 1].start() if k + 1 < len(found) else len(lower)
        behind = _BREAK if line and k + 1 == len(found) else _between(lower[m.end():end])
        joined = k and len(gap) == 1 and gap in ".,'’/:" and _DIGIT.match(lower[m.start() - 2]) and _DIGIT.match(m[0])
        first = text[m.start():m.start() + 1]
        out.append(f"{before}{behind}{int(first.isupper() or first.istitle())}{gap if joined else ' '}{m[0]}")
    return out


def _rolled(codes: np.ndarray, window: int) -> np.ndarray:
    """Polynomial hash of each window of ``codes``."""
    n = len(codes) - window + 1
    total = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(window if n > 0 else 0):
            total = total * _U(0x9E3779B97F4A7C15) + codes[j:j + n]
        return (total ^ (total >> _U(29))) * _U(0xBF58476D1CE4E5B9)


def _windows(texts: list[str | None], window: int, names: frozenset):
    """(distinct words, code of each word, owner of each window, its start, template hash, hash of each distinct word)."""
    per_text, code, distinct = expanded(texts, _CHUNK, words_of)
    distinct = distinct.to_pylist()
    owner = np.repeat(np.arange(len(texts)), per_text)
    n = len(code) - window + 1
    if n <= 0:
        empty = np.empty(0, np.int64)
        return distinct, code, empty, empty, np.empty(0, np.uint64), np.empty(0, np.uint64)
    slots = [slot_of(w, names) for w in distinct]
    own = np.fromiter((xxhash.xxh3_64_intdigest("w" + w) for w in distinct), np.uint64, len(distinct))
    placeholder = {s: xxhash.xxh3_64_intdigest(s) for s in set(slots) if s}
    hashes = np.array([placeholder[s] if s else h for s, h in zip(slots, own.tolist(), strict=True)], np.uint64)
    inside = np.flatnonzero(owner[:n] == owner[window - 1:])
    return distinct, code, owner[inside], inside, _rolled(hashes[code], window)[inside], own


def _number(text: str) -> str:
    """A number without separators of its thousands, and with a point."""
    return _GROUPED.sub("", text).replace(",", ".")


def _read(texts: list[str | None], window: int, names: frozenset, ordinary: frozenset, articles: frozenset):
    """For each of READINGS (number, tokens of a window by its start, owner of each window, its start, template hash, number of slots)."""
    per_text, code, distinct = expanded(texts, _LINED, tagged)
    n = len(code)
    if not n:
        return
    marks = distinct.to_pylist()
    words = [m[4:] for m in marks]
    owner = np.repeat(np.arange(len(texts)), per_text)
    of = lambda values, kind: np.fromiter(values, kind, len(words))[code]
    before, behind = of((int(m[0]) for m in marks), np.int8), of((int(m[1]) for m in marks), np.int8)
    first = np.r_[True, owner[1:] != owner[:-1]]
    link = np.where(first, 0, np.minimum(before, np.r_[0, behind[:-1]]))
    fixed = [slot_of(w, frozenset()) for w in words]
    listed = of((not s and w in names for s, w in zip(fixed, words, strict=True)), bool)
    capital = of((not s and m[2] == "1" for s, m in zip(fixed, marks, strict=True)), bool)
    common = of((w in ordinary for w in words), bool)
    # where nouns have capitals (German), those behind an article are nouns
    within = (link == int(_NONE)) & ~first
    high = np.bincount(owner, capital & within, len(texts)) >= CAPITAL_SHARE * np.bincount(owner, within, len(texts))
    article = of((w in articles and m[2] == "0" for w, m in zip(words, marks, strict=True)), bool)
    noun = capital & high[owner] & within & np.r_[False, article[:-1]]
    capital, listed = capital & ~noun, listed & ~noun
    # at the start of a sentence a capital alone says nothing: the items' ordinary words stay words there
    named = capital & ((link > 0) | ~common) | listed & ~common
    plain = of((xxhash.xxh3_64_intdigest(s or "w" + w) for s, w in zip(fixed, words, strict=True)), np.uint64)
    name_hash = _U(xxhash.xxh3_64_intdigest("<name>"))
    slot = of((bool(s) for s in fixed), bool)
    in_number = ~first & of((m[3] != " " for m in marks), bool)
    for reading, (by_capitals, folded) in enumerate(READINGS):
        name = named if by_capitals else listed
        head = np.arange(n)
        if folded:
            in_name = name & np.r_[False, name[:-1]] & (link == int(_NONE))
            head = np.flatnonzero(~(in_number | in_name))
            if len(head) == n:
                continue
        hashes, slots = np.where(name, name_hash, plain)[head], (slot | name)[head]
        whose = owner[head]
        k = len(head) - window + 1
        if k <= 0:
            continue
        ends = np.r_[head[1:], n]

        def tokens(start: int, head=head, ends=ends) -> list[str]:
            out = []
            for a, b in zip(head[start:start + window].tolist(), ends[start:start + window].tolist(), strict=True):
                run = code[a:b].tolist()
                text = "".join(marks[c][3] + words[c] for c in run)[1:]
                out.append(_number(text) if fixed[run[0]] == "<num>" else text)
            return out

        inside = np.flatnonzero(whose[:k] == whose[window - 1:])
        total = np.r_[0, np.cumsum(slots)]
        yield reading, tokens, whose[inside], inside, _rolled(hashes, window)[inside], (total[window:] - total[:k])[inside]


def _look(window: int, names_bc, wanted_bc):
    """Windows of texts as ``_scan`` has them, of each reading, that hold an ordinary word and a slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (names, ordinary, articles), wanted = names_bc.value, wanted_bc.value[0] if wanted_bc is not None else None
        if wanted is not None:
            sieve = np.zeros(1 << 22, bool)
            sieve[wanted >> _U(42)] = True
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                for reading, tokens, owner, start, hashes, n_slots in _read(texts[a:b], window, names, ordinary, articles):
                    hashes = hashes ^ _U(reading)
                    keep = np.flatnonzero((n_slots > 0) & (n_slots < window))
                    if wanted is not None:
                        keep = keep[sieve[hashes[keep] >> _U(42)]]
                        at = np.minimum(np.searchsorted(wanted, hashes[keep]), len(wanted) - 1)
                        keep = keep[wanted[at] == hashes[keep]]
                    if len(keep):
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).slice(a, b - a).take(pa.array(owner[keep])),
                                pa.array(hashes[keep].view(np.int64)), pa.array(np.zeros(len(keep), np.int64)),
                                pa.array([tokens(s) for s in start[keep].tolist()], pa.list_(pa.string())),
                            ],
                            names=["id", "template", "filled", "words"],
                        )

    return run


def _scan(window: int, names_bc, wanted_bc):
    """Windows of texts with their template and the hash of what stands in its slots and between; with ``wanted_bc`` only those in it."""

    def values(own: np.ndarray, code: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Hash of all words of the windows at ``start``."""
        total = np.zeros(len(start), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(window):
                total = (total ^ own[code[start + j]]) * _U(0xBF58476D1CE4E5B9)
                total ^= total >> _U(31)
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (names, _, _), wanted = names_bc.value, wanted_bc.value if wanted_bc is not None else None
        if wanted is not None:
            templates, slots = wanted
            sieve = np.zeros(1 << 22, bool)  # first look: 22 bits of the hash
            sieve[templates >> _U(42)] = True
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                words, code, owner, start, hashes, own = _windows(texts[a:b], window, names)
                keep = np.arange(len(hashes))
                if wanted is not None:
                    keep = keep[sieve[hashes[keep] >> _U(42)]]
                    at = np.minimum(np.searchsorted(templates, hashes[keep]), len(templates) - 1)
                    keep = keep[templates[at] == hashes[keep]]
                filled = values(own, code, start[keep])
                if wanted is not None:
                    at = np.minimum(np.searchsorted(slots, filled), len(slots) - 1)
                    right = slots[at] == filled
                    keep, filled = keep[right], filled[right]
                if len(keep):
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(a, b - a).take(pa.array(owner[keep])), pa.array(hashes[keep].view(np.int64)), pa.array(filled.view(np.int64)),
                            pa.array([[words[c] for c in code[s:s + window].tolist()] for s in start[keep].tolist()], pa.list_(pa.string())),
                        ],
                        names=["id", "template", "filled", "words"],
                    )

    return run


def _names(items: DataFrame, text: str) -> tuple[frozenset, frozenset, frozenset]:
    """Of the items: words that only occur capitalised inside sentences (names), words that occur without a capital (ordinary),
    and words without a capital that stand before at least ARTICLE different words with one (articles and the like)."""
    inner = F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(r"(?<=[\p{Ll},;] )\p{L}+"), F.lit(0))).alias("w")
    small = F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(r"(?<![\p{L}\p{N}])\p{Ll}[\p{L}\p{N}]*"), F.lit(0))).alias("w")
    couple = F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(r"(?<![\p{L}\p{N}])\p{Ll}+ (?=\p{Lu})\p{L}+"), F.lit(0))).alias("w")
    seen = items.select(inner).groupBy(F.lower("w").alias("w")).agg(F.min(F.col("w").rlike(r"^\p{Lu}")).alias("always"))
    names = frozenset(r[0] for r in seen.where("always").select("w").collect())
    before = items.select(couple).select(F.split("w", " ").alias("p")).groupBy(F.col("p")[0].alias("w")).agg(F.count_distinct(F.col("p")[1]).alias("n"))
    articles = frozenset(r[0] for r in before.where(F.col("n") >= ARTICLE).select("w").collect())
    return names, frozenset(r[0] for r in items.select(small).select(F.lower("w")).distinct().collect()), articles


def _matches(docs: DataFrame, items: DataFrame, *, doc: str, item: str, text: str, window: int, scan=_scan) -> DataFrame:
    """(doc, item, dw, iw): windows of documents and items of equal template, for ``leaks`` of equal slots too.

    A template may be that of very many windows (a table of numbers is one
    template all through): where its windows cannot be broadcast, crowded templates are joined in blocks.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    doc_type, item_type = docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()
    names = sc.broadcast(_names(items, text))
    shape = "template bigint, filled bigint, words array<string>"
    of_items = items.where(F.col(f"`{item}`").isNotNull()).select(F.col(f"`{item}`").alias("id"), F.col(f"`{text}`").alias("text"))
    queries = cut(map_arrow(of_items, scan(window, names, None), f"id {item_type}, {shape}").distinct())
    blocks = max(1, -(-queries.count() // BLOCK_WINDOWS))
    src = docs.where(F.col(f"`{doc}`").isNotNull()).select(F.col(f"`{doc}`").alias("id"), F.col(f"`{text}`").alias("text"))
    key = F.struct("template", "filled").alias("key")
    found = None
    for block in range(blocks):
        mine = queries.where(F.pmod("template", F.lit(blocks)) == block)
        rows = mine.select("template", "filled").distinct().toPandas()
        if not len(rows):
            continue
        hashes = tuple(np.unique(rows[c].to_numpy().view(np.uint64)) for c in ("template", "filled"))
        hits = map_arrow(src, scan(window, names, sc.broadcast(hashes)), f"id {doc_type}, {shape}")
        hits = hits.select(key, F.col("id").alias("doc"), F.col("words").alias("dw"))
        sides = mine.select(key, F.col("id").alias("item"), F.col("words").alias("iw"))
        part = hits.join(F.broadcast(sides), "key") if fits(sides) else split_join(cut(hits.distinct()), sides, "key")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"key int, doc {doc_type}, dw array<string>, item {item_type}, iw array<string>")
    return found.drop("key")


def leaks(docs: DataFrame, items: DataFrame, *, doc: str, item: str, text: str, window: int = 12) -> DataFrame:
    """(doc, item) wherever a document holds ``window`` consecutive words of an item.

    Defined cases: null, empty and shorter texts hold no passage; rows with a
    null id are left out; repeated rows and passages count once; an item that
    shares the passage with another is reported as well; empty tables give no
    rows; further columns are ignored.
    """
    found = _matches(docs, items, doc=doc, item=item, text=text, window=window)
    same = found.where(F.col("dw") == F.col("iw"))
    return same.select(F.col("doc").alias(doc), F.col("item").alias(item)).distinct()


def reparameterised(docs: DataFrame, items: DataFrame, *, doc: str, item: str, text: str, window: int = 12) -> DataFrame:
    """(doc, item, n_windows): passages of an item with other numbers, names or units.

    A window of tokens counts if its template is the item's in one of the
    READINGS, it holds an ordinary word, some slot differs, and slots map one
    to one: equal values of the item to equal values of the document and back.
    A name is a word with a capital inside a sentence, in texts that give nouns
    capitals not behind an article; at a sentence's start, where any word has
    one, a word that the items never write without it.  The
    items' own names count without a capital as well; other names in texts
    without capitals cannot be told from words.  ``n_windows`` counts distinct
    pairs of windows, of all readings.  Defined cases as for ``leaks``.
    """
    found = _matches(docs, items, doc=doc, item=item, text=text, window=window, scan=_look).where(F.col("dw") != F.col("iw")).distinct()
    moved = F.array_distinct(F.arrays_zip(F.col("iw").alias("i"), F.col("dw").alias("d")))
    one_to_one = (F.size(moved) == F.size(F.array_distinct("iw"))) & (F.size(moved) == F.size(F.array_distinct("dw")))
    return found.where(one_to_one).groupBy(F.col("doc").alias(doc), F.col("item").alias(item)).agg(F.count(F.lit(1)).alias("n_windows"))
