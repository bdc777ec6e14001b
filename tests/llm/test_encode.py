"""The transducer lexicon and the encoding, against the vocabulary's own library."""

import random
import sys

import numpy as np
import pytest

from lodestrata.llm import encode
from lodestrata.llm.lexicon import Lexicon, build


def lookup(lex, words):
    data = np.frombuffer(b"".join(words), np.uint8)
    return lex.ordinals(data, np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64))


def test_lexicon_finds_exactly_its_words():
    rnd = random.Random(1)
    words = list({bytes(rnd.choice(b"abc\xff\x00") for _ in range(rnd.randrange(1, 9))) for _ in range(500)})
    inside, outside = words[:300], words[300:] + [b"", b"zzz", words[0] + b"a" * 40]
    ids = [[rnd.randrange(50_000) for _ in range(rnd.randrange(4))] for _ in inside]
    lex = Lexicon(build(inside, ids))
    for w, o, want in zip(inside, lookup(lex, inside), ids, strict=True):
        assert lex.ids[lex.offsets[o]:lex.offsets[o + 1]].tolist() == want, w
    assert (lookup(lex, outside) == -1).all()
    assert (lookup(Lexicon(build([], [])), [b"a", b""]) == -1).all()


def test_suffixes_are_shared():
    lex = Lexicon(build([p + b"ation" for p in (b"st", b"n", b"r", b"or")], [[i] for i in range(4)]))
    assert len(lex.key) < 15  # a trie of these has 26 edges


def test_memory_mapped_file(tmp_path):
    path = tmp_path / "lex.bin"
    path.write_bytes(build([b"a", b"ab"], [[1], [2, 3]]))
    lex = Lexicon(str(path))
    assert lookup(lex, [b"ab", b"a", b"b"]).tolist() == [1, 0, -1]


TEXTS = [
    None, "", " ", "\n", "hello world", "  two  spaces  ", "don't we'll I'd", "a b　c", "x\x1cy\x1d z", "<|endoftext|> is text",
    "tabs\t\tand\r\nlines \n\n end ", "日本語のテキスト。", "Привет, мир!", "😀👍🏽 emoji‍zwj", "１２３ ½ Ⅷ", "﻿bom", "a" * 3000, " " * 500 + "x",
    " line par\x85nel", "é́ ́", "!!!???...", "1234567890 12 3", "word " * 2000, "    ", "ſ'S 'LL",
]


@pytest.fixture(scope="module")
def reference():
    sys.path.insert(0, encode.VOCABULARIES)
    tokenizers = pytest.importorskip("tokenizers")
    try:
        t = tokenizers.Tokenizer.from_file(f"{encode.VOCABULARIES}/byte_bpe_50k.json")
    except Exception:
        pytest.skip("no vocabulary here")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("lexicon_words", [0, 5, 1000])
def test_ids_equal_the_library(spark, reference, lexicon_words):
    rnd = random.Random(2)
    texts = TEXTS + ["".join(rnd.choice([" ", "  ", "\n", "ab", "é", "9", "'s", "!", " ", "\x1c", "漢", "\t "]) for _ in range(rnd.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string").repartition(3)
    got = encode.encode(df, id="doc_id", text="text", lexicon_words=lexicon_words)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    ids = {r["doc_id"]: r["ids"] for r in got.collect()}
    assert [ids[i] for i in range(len(texts))] == reference(texts)


def test_every_character_splits_alike(reference):
    """White space and classes of the pattern as the vocabulary's library sees them."""
    merge = encode._merger(f"{encode.VOCABULARIES}/byte_bpe_50k.tiktoken")
    lex = Lexicon(build([], []))
    chars = [chr(c) for c in [*range(0x3100), *range(0xFE00, 0x10000)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{c} {c}{c}b" for c in chars]
    got = encode.ids_of(texts, lex, merge).to_pylist()
    wrong = [hex(ord(c)) for c, g, w in zip(chars, got, reference(texts), strict=True) if g != w]
    assert not wrong


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert encode.encode(df, id="doc_id", text="text").count() == 0
