"""Leaked passages against a brute-force search."""

import random
import unicodedata

from lodestrata.llm import leak

DOC, ITEM = "doc_id bigint, text string, item_id string", "item_id bigint, text string, bench string"


def words(t):
    t = "".join(c for c in unicodedata.normalize("NFKC", t or "") if unicodedata.category(c) != "Cf").lower()
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in t).split()


def found(docs, items, n=12):
    grams = {}
    for i, t, _ in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = set()
    for d, t, _ in docs:
        w = words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k:k + n]), ()) if d is not None}
    return {p for p in out if None not in p}


def make(seed):
    rnd = random.Random(seed)
    vocab = ["the", "Anna", "km", "12", "3,5", "river", "ﬁsh", "Straße", "ÉCOLE", "o​ne", "２０", "кот", "half", "kg", "walks", "to"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(5, 40))), "b") for i in range(40)]
    items += [(100, items[3][1], "b"), (101, None, "b"), (102, "", "b"), (None, items[4][1], "b"), items[0]]
    docs = []
    for d in range(120):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(60))]
        if rnd.random() < 0.5:
            src = (rnd.choice(items)[1] or "").split(" ")
            a = rnd.randrange(len(src))
            w[5:5] = src[a:a + rnd.randrange(8, 20)]
        docs.append((d, rnd.choice([" ", "\n", " , ", " "]).join(w), "clash"))
    docs += [(500, None, ""), (501, "", ""), (None, items[0][1], ""), docs[0], (502, "x " * 30_000 + items[1][1], "")]
    return docs, items


def test_leaks_match_brute_force(spark, monkeypatch):
    for blocks in (1 << 20, 100):  # one block of windows, and several
        monkeypatch.setattr(leak, "BLOCK_WINDOWS", blocks)
        docs, items = make(blocks % 97)
        got = leak.leaks(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(items, ITEM), doc="doc_id", item="item_id", text="text").collect()
        assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == found(docs, items)
        assert len(got) > 10


def test_reparameterised(spark):
    q = "A train from the old town leaves with {} people and drives {} {} until it stops and then {} more come in"
    items = [(1, q.format(12, 40, "km", 12), "b")]
    docs = [
        (1, q.format(12, 40, "km", 12), ""),  # the item itself
        (2, q.format(15, 70, "miles", 15), ""),  # other values, alike where alike
        (3, q.format(15, 70, "miles", 99), ""),  # 12 stands for two values
        (4, q.replace("stops", "halts").format(15, 70, "km", 15), ""),
    ]
    got = leak.reparameterised(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), doc="doc_id", item="item_id", text="text", window=20).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(2, 1)}


def test_empty_tables(spark):
    docs, items = make(1)
    d, i = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    assert leak.leaks(d.limit(0), i, doc="doc_id", item="item_id", text="text").count() == 0
    assert leak.leaks(d, i.limit(0), doc="doc_id", item="item_id", text="text").count() == 0


def test_long_and_dirty_words():
    assert leak.words_of("A­B c​d ①② ﬀ Ǆ İ") == words("A­B c​d ①② ﬀ Ǆ İ")
    assert leak.words_of(None) == [] and leak.words_of(" \n") == []


def test_reparameterised_by_values_of_no_item(spark):
    q = "On the way home {} counts {} old coins and shows them to {} before the shop closes"
    dense = "from {} to {} and {} then {} plus {} or {} gives a sum"
    items = [(1, q.format("Natalia", 83, "Weng"), "b"), (2, dense.format(1, 2, 3, 4, 5, 6), "b"), (3, "Natalia, 7 x 7 " * 3, "b")]
    docs = [
        (1, q.format("Natalia", 83, "Weng"), ""),
        (2, q.format("Oluwaseun", 83, "Björk"), ""),  # names that stand in no item
        (3, q.format("Natalia", "1,204.5", "Weng"), ""),  # a number of three words
        (4, q.format("Ada Lovelace", "16.9", "Oluwaseun"), ""),  # a name of two words
        (5, q.format("natalia", 12, "weng"), ""),  # an item's names without capitals
        (6, q.replace("coins", "stamps").replace("shows", "sells").format("Natalia", 12, "Weng"), ""),
        (7, "Home. " + dense.format(10, 20, 30, 40, 50, 60), ""),  # six slots of twelve words
        (8, "1 2 3 4 5 6 7 8 9 10 11 12 13 14", ""),  # no ordinary word
        (9, q.format("Weng", 83, "Weng"), ""),  # one name for two
    ]
    got = leak.reparameterised(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), doc="doc_id", item="item_id", text="text").collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert {(2, 1), (3, 1), (4, 1), (5, 1), (7, 2)} <= pairs
    assert not {(1, 1), (6, 1)} & pairs and 8 not in {d for d, _ in pairs}


def test_tagged_words_are_the_words():
    for t in ("Anna's 1,204.5 km: \"Über\" 3½ x", "İstanbul o​ne ǅ 16.9% (The) a_b", "ﬁsh; Jean-Luc…"):
        tokens = [w for chunk in leak._LINED.findall(t) for w in leak.tagged(chunk)]
        assert [w[4:] for w in tokens] == leak.words_of(t) and all(len(w) > 4 for w in tokens)


def test_tables_of_numbers_share_a_template(spark, monkeypatch):
    """Every window of a table of numbers has one template; only equal numbers are a leak, and crowded templates are joined in blocks."""
    from lodestrata.operators import skew

    rnd = random.Random(8)
    numbers = lambda n: " ".join(str(rnd.randrange(1000)) for _ in range(n))
    items = [(i, numbers(60), "b") for i in range(6)]
    docs = [(d, numbers(150) + (" " + items[d % 6][1][:80] if d % 3 == 0 else ""), "") for d in range(40)]
    d, i = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    for blocks in (False, True):
        if blocks:
            monkeypatch.setattr(leak, "fits", lambda df: False)
            monkeypatch.setattr(skew, "PART_ROWS", 3)
        got = leak.leaks(d, i, doc="doc_id", item="item_id", text="text").collect()
        assert {tuple(r) for r in got} == found(docs, items) and 0 < len(got) < 40
    q = "{} of the {} have {}"  # few words between the values
    tables = [(i, " ".join(q.format(*(rnd.randrange(1000) for _ in range(3))) for _ in range(9)), "b") for i in range(4)]
    pages = [(d, " ".join(q.format(*(rnd.randrange(1000) for _ in range(3))) for _ in range(12)), "") for d in range(10)]
    once = {}
    for blocks in (True, False):
        monkeypatch.setattr(leak, "fits", lambda df, small=not blocks: small)
        rows = leak.reparameterised(spark.createDataFrame(pages, DOC), spark.createDataFrame(tables, ITEM), doc="doc_id", item="item_id", text="text").collect()
        once[blocks] = sorted(tuple(r) for r in rows)
    assert once[True] == once[False] and len({r[:2] for r in once[True]}) == 40


def consistent(dw, iw):
    pairs = set(zip(dw, iw))
    return dw != iw and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_reparameterised_matches_brute_force(spark):
    """Texts whose only slots are numbers and units: the readings are one, and windows can be compared word by word."""
    rnd = random.Random(12)
    plain = "the river carries more boats than old bridges and every winter farmers store grain near mills".split()
    make = lambda: [rnd.choice([str(rnd.randrange(6)), rnd.choice(["km", "kg"]), *rnd.sample(plain, 4)]) for _ in range(30)]
    items = [(i, " ".join(make()), "b") for i in range(12)]
    docs = []
    for d in range(40):
        w = items[d % 12][1].split()
        other = {str(n): str(rnd.randrange(6)) for n in range(6)} | {"km": rnd.choice(["km", "kg"]), "kg": rnd.choice(["km", "kg"])}
        docs.append((d, " ".join([*make()[:9], *(other.get(x, x) for x in w[4:24]), *make()[:5]]), ""))
    got = leak.reparameterised(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), doc="doc_id", item="item_id", text="text").collect()
    slot = lambda w: leak.slot_of(w, frozenset())
    want = set()
    for d, dt, _ in docs:
        for i, it, _ in items:
            a, b = dt.split(), it.split()
            for x in range(len(a) - 11):
                for y in range(len(b) - 11):
                    v, w = a[x:x + 12], b[y:y + 12]
                    if [slot(p) or p for p in v] == [slot(p) or p for p in w] and consistent(v, w) and not all(slot(p) for p in v):
                        want.add((d, i))
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) > 5


def test_nouns_with_capitals_are_no_names(spark):
    q = "Am Morgen zählt {} hinter dem {} zwölf kleine Münzen und bringt {} die {} bis der Markt wieder schließt"
    more = "Der Hund sieht das Tor und der Baum trägt die Frucht, dem Kind gefällt das Lied und die Sonne wärmt den Garten hinter dem Zaun und dem Haus das Dach."
    items = [(1, q.format("Natalia", "Haus", "Weng", "Kiste"), "b"), (2, more, "b")]
    docs = [
        (1, q.format("Oluwaseun", "Haus", "Björk", "Kiste"), ""),  # other names
        (2, q.format("Natalia", "Turm", "Weng", "Schale"), ""),  # other nouns: another text
    ]
    got = leak.reparameterised(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), doc="doc_id", item="item_id", text="text").collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1)}
