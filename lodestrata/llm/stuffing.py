"""Keyword-stuffed and link-list pages (recurrence gaps and positional autocorrelation).

A page's words are read as a signal over positions, and how terms come back
decides what is a sentence; no list of words is used.

1. Carriers.  On a page of prose the function words of its language come back
   at short and irregular gaps; names and nouns come back late or not at all,
   and stuffed keywords on few pages only.  So a term is a *carrier* of a
   language if on at least ``CARRIER_SHARE`` of its pages, hosts counting
   alike, it comes back with a mean gap of at most ``SHORT`` words whose spread
   is at least ``IRREGULAR`` of it.  Bounded: a page has few such terms, so a
   language has few of that share.
2. Chrome.  A piece of text between line ends and separators that stands on
   ``CHROME_SHARE`` of a language's pages is a menu, a notice or an error
   message and counts on neither side.  Pages of which there are very many
   copies do not count in 1 and 2, or they would make their own words common.
3. A word stands in a sentence if its segment is calm (few separators and
   links), holds carriers in the share that prose has, and one of them stands
   within ``REACH`` positions.
4. Regular repetition is never a sentence: windows of ``LAG_WINDOW`` words of
   which ``REGULAR`` equal the word ``lag`` before (autocorrelation), and terms
   that come back at an unnaturally even gap.

A page is flagged when less than ``share`` of its words stand in sentences.
A page without familiar terms (a language the corpus hardly has) is judged by
its own recurrence alone: in prose a minority of the terms comes back at short,
irregular gaps among words that mostly do not come back.  Everything is
computed on whole texts in numpy, a slice of pages at a time; what is shuffled
are counts of carriers and pieces, summed per slice before.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.pieces import expanded, slices
from lodestrata.session import cut, map_arrow

LAG_WINDOW, LAGS, REGULAR = 48, 12, 0.5
REACH = 6
#: Recurrence of a carrier: occurrences on a page, mean gap, spread of the gaps against their mean, share of the pages.
OCCURRENCES, SHORT, IRREGULAR, CARRIER_SHARE = 3, 64, 0.3, 0.32
#: A term that comes back on this share of a language's pages is familiar; a page of a known language has that share of them.
FAMILIAR_SHARE, FAMILIAR_WORDS = 0.02, 0.05
#: A piece on this share of a language's pages is chrome; with more words it never is.
CHROME_SHARE, CHROME_WORDS = 0.02, 24
#: On fewer pages nothing is a carrier, familiar or chrome.
LEAST_PAGES = 5
#: Pages with equal longest lines count as copies; more copies than this share (at least so many) do not count in the statistics.
COPIES_SHARE, COPIES = 0.0002, 5
#: Languages of a smaller share of the pages are taken together.
LANGUAGE_SHARE = 0.01
#: A sentence has at least so many words (characters of scripts without spaces: half as many) and so many carriers.
SENTENCE_WORDS, SENTENCE_CARRIERS, CARRIER_DENSITY = 6, 2, 0.1
#: Where nearly all characters were lost to a wrong charset, runs of them stand for words, and fewer make a sentence.
LOST_WORDS = 2
#: A footer, a line with a copyright sign, has at most so many words.
FOOTER_WORDS = 12
#: Pages with fewer words beside chrome are error pages or empty: no case.
LEAST_WORDS = 20


#: Stands before a character that is a token of its own.
_CHAR = "\ue000"
_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}々ー"
_TOKEN = regex.compile(
    r"(?:https?://|www\.|data:)\S+|[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+/\S*|(?<!\S)/[\p{L}\p{N}][\p{L}\p{N}/_-]*|#[\p{L}\p{N}]\S*"
    rf"|\p{{Hiragana}}+|[\p{{Han}}々]+|[\p{{Katakana}}ー]+|\p{{Hangul}}+|(?:(?![{_CJK}])[\p{{L}}\p{{N}}\p{{M}}�])+(?:['’\-_.,:][\p{{L}}\p{{N}}�]+)*"
    r"|[\r\n\x0b\x0c\x85  ]+|[.!?…]+(?=\s|$)|[。！？]|[|•·»;★/©、・]"
)
#: Line ends, and runs without white space; tokens never cross them.
_CHUNK = re.compile(r"[\r\n\x0b\x0c\x85  ]+|\S+")
_LINK = regex.compile(r"(?:https?://|www\.|data:|/|#).|[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+/")
_HIRAGANA, _HAN, _HANGUL = regex.compile(r"\p{Hiragana}"), regex.compile(r"[\p{Han}々]"), regex.compile(r"\p{Hangul}")
_CJK_FIRST = regex.compile(rf"[{_CJK}]").match
_DIGIT = regex.compile(r"\p{N}|_")
_WIDE = re.compile(r"[^\x00-\x7f]")
_ACCENTED, _LATIN = re.compile(r"[\xc0-\xff]"), re.compile(r"[A-Za-z]")
_BLOB = re.compile(r"\S{40,}")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
#: Frequent Russian letters (fixed values).
_FREQUENT = "оеаинт"
_LOWER, _INNER_UPPER = re.compile("[а-яё]"), re.compile("(?<=[А-Яа-яЁё])[А-ЯЁ]")
_WORD_K, _LINK_K, _BREAK_K, _SEP_K, _LOST_K, _FOOT_K = range(6)
_U = np.uint64


@dataclass(frozen=True)
class Lexicon:
    """What the corpus says: carriers, familiar terms, and the hashes of chrome pieces in order."""

    carriers: frozenset[str] = frozenset()
    familiar: frozenset[str] = frozenset()
    chrome: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))


def _as_byte(problem: UnicodeEncodeError) -> tuple[bytes, int]:
    """Characters a charset lacks: the byte of their code point; a lost one most likely was 0x81; others are invalid."""
    chars = problem.object[problem.start:problem.end]
    return b"".join(bytes([ord(c)]) if ord(c) < 256 else b"\x81" if c == "\ufffd" else b"\xff" for c in chars), problem.end


codecs.register_error("lodestrata_byte", _as_byte)


def repaired(text: str) -> str:
    """Text decoded with a wrong charset, decoded again; other text unchanged.

    UTF-8 read as a one-byte charset shrinks and stays valid when undone.
    Cyrillic read as Latin has accented letters nearly only; read with the
    other Cyrillic charset, its small letters become capitals.
    """
    if text.isascii():
        return text
    wide = len(_WIDE.findall(text))
    if wide < 8:
        return text
    best, accented = text, len(_ACCENTED.findall(text))
    cyrillic = 0 if accented > 0.9 * wide else len(_CYRILLIC.findall(text))
    usual = cyrillic > 0.5 * wide and len(_LOWER.findall(text)) >= 0.7 * wide  # Cyrillic that reads as it should
    for name, letters in (("cp1252", accented), ("cp1251", 0 if usual else cyrillic), ("latin-1", accented)):
        if letters < wide * 0.3:  # lead bytes of sequences would be such letters
            continue
        again = text.encode(name, "lodestrata_byte").decode("utf-8", "replace")
        # right if nearly all wide characters were parts of sequences
        if len(again) < len(best) - wide * 0.3 and again.count("\ufffd") <= wide * 0.25:
            best = again
    if best is not text:
        return best
    if cyrillic and not usual and len(_INNER_UPPER.findall(text)) > len(_LOWER.findall(text)):  # the two cases change places
        both = (text.encode(a, "lodestrata_byte").decode(b, "replace") for a, b in (("cp1251", "koi8-r"), ("koi8-r", "cp1251")))
        return max(both, key=lambda x: sum(map(x.count, _FREQUENT)))
    if accented >= 0.3 * wide and accented > 2 * len(_LATIN.findall(_BLOB.sub("", text))):
        return text.encode("cp1252", "lodestrata_byte").decode("cp1251", "replace")
    return text


def tokens_of(chunk: str) -> list[str]:
    """Tokens of a run without white space.

    Japanese is cut where the script changes; Chinese (no hiragana in the run)
    and Korean, whose endings are not set apart, into characters.
    """
    found = _TOKEN.findall(chunk)
    if chunk.isascii():
        return found
    apart = _HIRAGANA.search(chunk) is None
    out = []
    for t in found:
        if t[0] > "\u2e7f" and (_HANGUL.match(t) or apart and _HAN.match(t)):
            out.extend(_CHAR + c for c in t)
        else:
            out.append(t)
    return out


def _kind(token: str) -> int:
    first = token[0]
    if first in "\r\n\x0b\x0c\x85  " or first in ".!?…。！？":
        return _BREAK_K
    if first in "|•·»;★、・" or token == "/":
        return _SEP_K
    if first == "©":
        return _FOOT_K
    if _LINK.match(token):
        return _LINK_K
    return _LOST_K if "�" in token else _WORD_K


def _weight(token: str, kind: int) -> int:
    """Half words a token stands for: scripts without spaces count two characters as a word."""
    if kind in (_BREAK_K, _SEP_K, _FOOT_K):
        return 0
    if token[0] == _CHAR:
        return 1
    return len(token) if token[0] > "\u2e7f" and _CJK_FIRST(token) else 2


@dataclass
class _Read:
    """Texts as arrays over their tokens."""

    owner: np.ndarray
    kind: np.ndarray
    weight: np.ndarray
    term: np.ndarray  # code of the lower-case token
    terms: list[str]
    segment: np.ndarray  # between line or sentence ends
    piece: np.ndarray  # between these or separators


def _tokens(texts: list[str | None]) -> _Read | None:
    per_text, code, distinct = expanded([repaired(t) if t else "" for t in texts], _CHUNK, tokens_of)
    if not len(code):
        return None
    owner = np.repeat(np.arange(len(texts)), per_text)
    distinct = distinct.to_pylist()
    kinds = np.fromiter((_kind(t) for t in distinct), np.int8, len(distinct))
    weights = np.fromiter((_weight(t, k) for t, k in zip(distinct, kinds.tolist(), strict=True)), np.int64, len(distinct))
    lower: dict[str, int] = {}
    folded = np.fromiter((lower.setdefault(t.lower().replace("’", "'"), len(lower)) for t in distinct), np.int64, len(distinct))
    kind = kinds[code]
    first = np.r_[True, owner[1:] != owner[:-1]]
    ends = (kind == _BREAK_K) | first
    return _Read(owner, kind, weights[code], folded[code], list(lower), np.cumsum(ends), np.cumsum(ends | (kind == _SEP_K) | (kind == _FOOT_K)))


def _gaps(owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, ...]:
    """Recurrence gaps: (positions by text and term, group of each, and of each group: text, term, gaps, their mean and spread)."""
    pos = np.lexsort((code, owner))
    new = np.r_[True, (code[pos][1:] != code[pos][:-1]) | (owner[pos][1:] != owner[pos][:-1])]
    group = np.cumsum(new) - 1
    gap = np.r_[0, np.diff(pos)].astype(float)
    gap[new] = 0
    count = np.bincount(group) - 1
    mean = np.bincount(group, gap) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(np.bincount(group, gap * gap) / np.maximum(count, 1) - mean * mean, 0))
    head = pos[new]
    return pos, group, owner[head], code[head], count, mean, spread


def _irregular(count: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Groups that come back at short, irregular gaps."""
    return (count >= OCCURRENCES - 1) & (mean <= SHORT) & (spread >= IRREGULAR * mean)


def _piece_hashes(r: _Read) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first position) of each piece; its separator does not count."""
    own = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in r.terms), np.uint64, len(r.terms))
    new = np.r_[True, r.piece[1:] != r.piece[:-1]]
    start = np.flatnonzero(new)
    place = np.arange(len(r.piece)) - start[np.cumsum(new) - 1]
    marks = (r.kind == _BREAK_K) | (r.kind == _SEP_K) | (r.kind == _FOOT_K)
    place -= marks[start][np.cumsum(new) - 1]  # a piece begins with its mark
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(place.max()) + 2, 0x9E3779B97F4A7C15, np.uint64))
        value = np.where(marks, _U(0), own[r.term] * power[np.maximum(place, 0)])
        total = np.add.reduceat(value, start)
        return (total ^ (total >> _U(29))) * _U(0xBF58476D1CE4E5B9), start


def _repetition(codes: np.ndarray, owner: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Words in windows of high autocorrelation of their content terms, and content terms of even recurrence gaps."""
    n = len(codes)
    regular = np.zeros(n, bool)
    held = np.r_[0, np.cumsum(content)]
    for lag in range(1, min(LAGS, n - 1) + 1):
        if n <= LAG_WINDOW:
            break
        same = np.zeros(n, np.int32)
        same[lag:] = (codes[lag:] == codes[:-lag]) & (owner[lag:] == owner[:-lag]) & content[lag:]
        total = np.r_[0, np.cumsum(same)]
        inside = held[LAG_WINDOW:] - held[:-LAG_WINDOW]
        start = np.flatnonzero((inside >= LAG_WINDOW // 4) & (total[LAG_WINDOW:] - total[:-LAG_WINDOW] >= REGULAR * inside))
        start = start[owner[start] == owner[start + LAG_WINDOW - 1]]
        if len(start):
            mark = np.zeros(n + 1, np.int32)
            np.add.at(mark, start, 1)
            np.add.at(mark, start + LAG_WINDOW, -1)
            regular |= np.cumsum(mark)[:n] > 0
    at = np.flatnonzero(content)
    if len(at):
        # gaps in all words, not in content words only
        pos, group, _, _, count, _, _ = _gaps(owner[at], codes[at])
        real = at[pos]
        new = np.r_[True, group[1:] != group[:-1]]
        gap = np.where(new, 0, np.r_[0, np.diff(real)]).astype(float)
        mean = np.bincount(group, gap) / np.maximum(count, 1)
        spread = np.sqrt(np.maximum(np.bincount(group, gap * gap) / np.maximum(count, 1) - mean * mean, 0))
        even = (count >= 5) & (mean <= LAGS) & (spread <= 0.15 * mean)
        regular[real[even[group]]] = True
    return regular


def _own_carriers(r: _Read, word: np.ndarray, familiar: np.ndarray, n: int) -> np.ndarray:
    """Carriers of pages the lexicon says nothing about, from their own recurrence."""
    at = np.flatnonzero(word)
    per_page = np.bincount(r.owner[at], minlength=n)
    unknown = np.bincount(r.owner[at], familiar[at], n) < FAMILIAR_WORDS * per_page
    at = at[unknown[r.owner[at]]]
    if not len(at):
        return np.zeros(len(word), bool)
    pos, group, page, _, count, mean, spread = _gaps(r.owner[at], r.term[at])
    mine = _irregular(count, mean, spread)
    size = (count + 1).astype(float)
    total = np.bincount(page, size, n)
    held = np.bincount(page, size * mine, n)
    rare = np.bincount(page, size * (count <= 1), n)
    prose = (held >= 0.1 * total) & (held <= 0.6 * total) & (rare >= 0.6 * (total - held))
    out = np.zeros(len(word), bool)
    out[at[pos[(mine & prose[page])[group]]]] = True
    return out


def shares(texts: list[str | None], lexicon: Lexicon = Lexicon()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: its words, those in sentences, those in repetition."""
    n = len(texts)
    r = _tokens(texts)
    if r is None:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    owner, kind, weight, segment = r.owner, r.kind, r.weight, r.segment
    n_seg = int(segment[-1]) + 1

    def per_segment(mask: np.ndarray) -> np.ndarray:
        return np.bincount(segment, mask, n_seg)

    chrome = np.zeros(len(kind), bool)
    if len(lexicon.chrome):
        hashes, start = _piece_hashes(r)
        at = np.minimum(np.searchsorted(lexicon.chrome, hashes), len(lexicon.chrome) - 1)
        chrome = np.repeat(lexicon.chrome[at] == hashes, np.diff(np.r_[start, len(kind)]))
    footer = (per_segment(kind == _FOOT_K) > 0) & (per_segment(weight) <= 2 * FOOTER_WORDS)
    counted = (weight > 0) & ~chrome & ~footer[segment]

    link, sep, lost = kind == _LINK_K, kind == _SEP_K, kind == _LOST_K
    known, familiar = (np.fromiter((t in words for t in r.terms), bool, len(r.terms))[r.term] for words in (lexicon.carriers, lexicon.familiar))
    carrier = (kind == _WORD_K) & known & counted
    carrier |= _own_carriers(r, (kind == _WORD_K) & counted, known | familiar, n)
    words = per_segment(weight * (counted & ~link)) / 2
    tokens = per_segment(counted & ~link)
    cjk = weight * (counted & (kind == _WORD_K) & (weight != 2))
    unspaced = per_segment(cjk) >= words
    least, fewest = np.where(unspaced, SENTENCE_WORDS / 2, SENTENCE_WORDS), np.where(unspaced, SENTENCE_CARRIERS / 2, SENTENCE_CARRIERS)
    parted, linked, carried_by = per_segment(sep), per_segment(link), per_segment(carrier)
    calm = (parted * 6 <= words) & (linked * 3 <= words)
    sentence = (words >= least) & (carried_by >= fewest) & (carried_by >= CARRIER_DENSITY * tokens) & calm
    # characters lost to a wrong charset: carriers cannot be told, the shape must do
    lost_in = per_segment(lost & counted)
    garbled = (words >= SENTENCE_WORDS) & (lost_in >= 0.3 * words) | (words >= LOST_WORDS) & (lost_in >= 0.8 * words)
    sentence |= garbled & (parted + linked == 0)

    # nearest carrier of the same segment, before and after
    place = np.arange(len(kind))
    anchor = carrier | lost
    before = np.maximum.accumulate(np.where(anchor, place, -1))
    after = np.minimum.accumulate(np.where(anchor, place, 1 << 60)[::-1])[::-1]
    carried = (before >= 0) & (place - before <= REACH) & (segment[before] == segment)
    ahead = np.minimum(after, len(kind) - 1)
    carried |= (after < 1 << 60) & (after - place <= REACH) & (segment[ahead] == segment)

    regular = np.zeros(len(kind), bool)
    at = np.flatnonzero(counted)
    if len(at):
        regular[at] = _repetition(r.term[at], owner[at], ((kind == _WORD_K) & ~carrier | link)[at])
    good = counted & sentence[segment] & carried & ~regular & ~link
    total, inside, again = (np.bincount(owner, weight * m, n).astype(np.int64) for m in (counted, good, regular & counted))
    return (total + 1) // 2, (inside + 1) // 2, (again + 1) // 2


_COUNTS = pa.schema([
    ("kind", pa.int32()), ("lang", pa.string()), ("host", pa.string()), ("term", pa.string()), ("piece", pa.int64()), ("n", pa.int64()), ("short", pa.int64()),
])
_PAGES, _TERMS, _PIECES = range(3)


def _rows(kind: int, size: int, **columns) -> pa.RecordBatch:
    """Counts of a kind; columns that are not given are null."""
    columns["kind"] = np.full(size, kind, np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _COUNTS], schema=_COUNTS,
    )


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each is there."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)
    return a[first], b[first], np.diff(np.r_[first, len(a)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice: pages of each (language, host), pages on which a term comes back, at short irregular gaps too, pages that hold a piece."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        groups: dict[tuple, int] = {}
        group = np.fromiter((groups.setdefault(g, len(groups)) for g in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True)), np.int64, len(texts))
        langs, hosts = (np.array([g[i] for g in groups], object) for i in (0, 1))
        codes: dict[str, int] = {}
        lang_of = np.fromiter((codes.setdefault(x, len(codes)) for x in langs), np.int64, len(langs))[group]
        spoken = np.array(list(codes), object)
        for a, b in slices(texts):
            mine, n = np.unique(group[a:b], return_counts=True)
            yield _rows(_PAGES, len(mine), lang=langs[mine], host=hosts[mine], n=n)
            r = _tokens(texts[a:b])
            if r is None:
                continue
            at = np.flatnonzero(r.kind == _WORD_K)
            if len(at):
                _, _, page, term, count, mean, spread = _gaps(r.owner[at], r.term[at])
                plain = np.fromiter((not _DIGIT.search(t) for t in r.terms), bool, len(r.terms))
                back = (count > 0) & plain[term]
                pair, where = np.unique(group[a + page[back]] * len(r.terms) + term[back], return_inverse=True)
                g, t = np.divmod(pair, len(r.terms))
                short = np.bincount(where, _irregular(count, mean, spread)[back], len(pair)).astype(np.int64)
                yield _rows(_TERMS, len(pair), lang=langs[g], host=hosts[g], term=np.array(r.terms, object)[t], n=np.bincount(where, minlength=len(pair)), short=short)
            hashes, start = _piece_hashes(r)
            words = np.add.reduceat(r.weight, start)
            kept = (words > 0) & (words <= 2 * CHROME_WORDS)
            page, piece, _ = _distinct(r.owner[start[kept]], hashes[kept])  # a page counts once
            lang, piece, n = _distinct(lang_of[a + page], piece)
            yield _rows(_PIECES, len(n), lang=spoken[lang], piece=piece.view(np.int64), n=n)


def learn(docs: DataFrame, *, text: str, lang: str | None = None, host: str | None = None) -> Lexicon:
    """Carriers and chrome of a corpus.

    ``lang`` and ``host``: columns with each page's language and host, where
    there are such; wrong or missing languages do little harm, as shares are
    taken over all pages of a language and all languages' carriers serve every page.
    """
    body = F.col(f"`{text}`")
    lines = F.transform(F.split(body, r"[\r\n]+"), lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))
    named = lambda c: F.lower(F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))) if c else F.lit("")
    src = docs.where(F.length(body) > 0).select(named(lang).alias("lang"), named(host).alias("host"), body.alias("text"), F.xxhash64(F.array_max(lines)["x"]).alias("copy"))
    by_lang = cut(src.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    pages = by_lang.agg(F.sum("n")).first()[0] or 0
    large = [r[0] for r in by_lang.where(F.col("n") >= LANGUAGE_SHARE * pages).select("lang").collect()]  # at most 1 / LANGUAGE_SHARE
    # at most 1 / COPIES_SHARE texts have so many copies, hence the broadcast is bounded
    copies = src.groupBy("copy").count().where(F.col("count") > F.lit(max(COPIES, int(COPIES_SHARE * pages)))).select("copy")
    src = src.join(F.broadcast(cut(copies)), "copy", "left_anti")
    src = src.select(F.when(F.col("lang").isin(large), F.col("lang")).otherwise("").alias("lang"), "host", "text")
    counted = map_arrow(src, _count, "kind int, lang string, host string, term string, piece bigint, n bigint, short bigint")
    counted = counted.groupBy("kind", "lang", "host", "term", "piece").agg(F.sum("n").alias("n"), F.sum("short").alias("short"))
    counted = cut(counted.where((F.col("kind") != _PIECES) | (F.col("n") >= LEAST_PAGES)))
    of_host = counted.where(F.col("kind") == _PAGES).select("lang", "host", F.col("n").alias("pages"))
    of_lang = of_host.groupBy("lang").agg(F.count(F.lit(1)).alias("hosts"), F.sum("pages").alias("pages"))  # a row per large language
    terms = counted.where(F.col("kind") == _TERMS).join(of_host, ["lang", "host"]).groupBy("lang", "term").agg(
        F.sum(F.col("short") / F.col("pages")).alias("share"), F.sum("short").alias("short"), F.sum("n").alias("n"),
    )
    terms = terms.join(F.broadcast(of_lang), "lang").withColumn("carries", (F.col("short") >= LEAST_PAGES) & (F.col("share") >= CARRIER_SHARE * F.col("hosts")))
    terms = terms.where(F.col("carries") | (F.col("n") >= LEAST_PAGES) & (F.col("n") >= FAMILIAR_SHARE * F.col("pages"))).groupBy("term").agg(F.max("carries").alias("carries"))
    pieces = counted.where(F.col("kind") == _PIECES).join(F.broadcast(of_lang), "lang").where(F.col("n") >= CHROME_SHARE * F.col("pages"))
    # all lists are bounded: pages hold few pieces and fewer terms that come back, and each is on a fixed share of a language's pages
    chrome = np.array([r[0] for r in pieces.select("piece").distinct().collect()], np.int64).view(np.uint64)
    found = terms.collect()
    return Lexicon(frozenset(r["term"] for r in found if r["carries"]), frozenset(r["term"] for r in found), np.sort(chrome))


def _measure(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *map(pa.array, shares(texts[a:b], lexicon.value))], names=["id", "n_words", "n_sentence", "n_repeated"]
                )

    return run


def page_words(docs: DataFrame, *, id: str, text: str, lang: str | None = None, host: str | None = None, lexicon: Lexicon | None = None) -> DataFrame:
    """(id, n_words, n_sentence, n_repeated) of each page, chrome and footers aside.

    Without ``lexicon`` it is learned from ``docs`` first (``learn``).

    Defined cases: null, empty and blank texts have no words; a text of any
    length is read whole; repeated rows: a row each; a null language or host
    is one of its own; further columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[id].dataType.simpleString()
    found = docs.sparkSession.sparkContext.broadcast(lexicon or learn(docs, text=text, lang=lang, host=host))
    src = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return map_arrow(src, _measure(found), f"id {kind}, n_words bigint, n_sentence bigint, n_repeated bigint").withColumnRenamed("id", id)


def stuffed_pages(
    docs: DataFrame, *, id: str, text: str, lang: str | None = None, host: str | None = None, share: float = 0.25,
    least_words: int = LEAST_WORDS, lexicon: Lexicon | None = None,
) -> DataFrame:
    """Ids of pages of which less than ``share`` of the words stand in sentences.

    Pages of fewer than ``least_words`` words (empty, error pages) are no cases.
    """
    measured = page_words(docs, id=id, text=text, lang=lang, host=host, lexicon=lexicon)
    return measured.where((F.col("n_words") >= least_words) & (F.col("n_sentence") < F.lit(share) * F.col("n_words"))).select(id)
