"""Keyword-stuffed pages."""

import random
from pathlib import Path

import pytest

from lodestrata.llm import stuffing as S

PROSE = "The old bridge crosses a river near our village, and every morning some people walk to the market before it opens. "
# sentences of the corpora the operator learns from
SENTENCES = {
    "en": [
        "The river behind the mill is cold in the morning and the children of the village play on its stones.",
        "A baker walks over the bridge to the market, but the market opens late in the winter.",
        "In the evening the people of the town sit near the fire and talk of the storm that broke the tower.",
        "The teacher told us that the train to the coast is slow and that the tickets are cheap.",
        "It was the first time that the gardener had seen a fox in the yard of the school.",
        "They painted the door of the house in a dark green and put a lamp over the steps.",
        "The doctor says that the water of the lake is clean and that a swim is good for the heart.",
        "Our neighbour keeps the tools in a shed at the end of the path and lends them to the whole street.",
        "When the rain stops, the farmers bring the hay into the barn and count the bales in the light of a torch.",
        "A letter from the captain of the ship lay on the table, and the ink on it was still wet.",
    ],
    "pl": [
        "W domu nad rzeką mieszka stary rybak i co rano idzie na targ w mieście, bo ryby są tam drogie.",
        "Na stole leży list od brata i nikt w rodzinie nie wie, co jest w nim napisane.",
        "Dzieci bawią się na łące i nie chcą wracać do domu, choć na niebie widać już chmury.",
        "W szkole na rogu ulicy uczy pani, która zna się na gwiazdach i na starych mapach.",
        "Nie wiem, czy pociąg do Krakowa jedzie w nocy, ale na dworcu na pewno jest rozkład.",
        "Ogrodnik sadzi drzewa w parku i na placu, a w zimie odpoczywa w ciepłym pokoju.",
        "To jest książka o człowieku, który nie bał się morza i w burzę wypłynął na połów.",
        "Babcia piecze chleb w piecu i na wieczór zaprasza sąsiadów na herbatę w ogrodzie.",
    ],
    "tr": [
        "Köyde bir değirmen ve bir köprü var, bu köprü çok eski ve dar bir yoldur.",
        "Bu sabah bir çocuk bahçede bir kedi buldu ve onu eve getirdi.",
        "Annem bu akşam bir çorba pişirdi ve komşular da bir ekmek aldı.",
        "Bir balıkçı denizde bir fırtına gördü ve bu yüzden erken döndü.",
        "Bu okulda bir öğretmen var ve o da her gün bir hikâye anlatır.",
        "Tren bu gece geç kaldı ve yolcular bir saat kadar bekledi.",
        "Bu kitap bir adam ve bir at için yazıldı ve çok okundu.",
        "Pazarda bir satıcı elma ve armut satar, bu elma çok tatlı bir elmadır.",
    ],
    "ko": [
        "아침에 아이들은 강가에서 놀고 어른들은 시장에 가서 생선을 삽니다.",
        "선생님은 학교에서 별과 바다에 대한 이야기를 학생들에게 들려 주었습니다.",
        "우리 마을에는 오래된 다리가 있고 그 다리를 건너면 작은 빵집이 있습니다.",
        "어제 저녁에 비가 많이 내려서 기차가 늦게 도착했습니다.",
        "할머니는 마당에 나무를 심고 겨울에는 따뜻한 방에서 책을 읽습니다.",
        "의사는 호수의 물이 깨끗해서 수영을 하는 것이 좋다고 말했습니다.",
        "편지는 책상 위에 있었고 누구도 그 내용을 알지 못했습니다.",
    ],
    "zh": [
        "早上孩子们在河边玩，大人去市场买鱼，因为那里的鱼是最好的。",
        "我们的老师在学校里给学生讲了一个关于大海的故事。",
        "村子里有一座很老的桥，过了桥就是一家小小的面包店。",
        "昨天晚上下了很大的雨，所以火车来得很晚，我们等了一个小时。",
        "奶奶在院子里种了一棵树，冬天的时候在暖和的房间里看书。",
        "医生说湖里的水是干净的，在那里游泳对身体是好的。",
        "桌子上的信是他的哥哥写的，家里的人都不知道里面写了什么。",
    ],
    "ru": [
        "Каждый вечер наш сосед идёт через старый мост, потому что его дом стоит за рекой и за лесом.",
        "В деревне на берегу реки живёт рыбак, и в любую погоду он выходит на лодке в море.",
        "На столе лежит письмо, и никто в семье не знает, что в нём написано и кто его принёс.",
        "Дети играют на лугу и не хотят идти домой, хотя на небе уже видны тучи и в лесу темно.",
        "В школе на углу улицы учит женщина, и она знает всё о звёздах и о старых картах.",
        "Он не знал, что поезд в город идёт ночью, и на вокзале в холоде ждал до утра.",
        "Врач говорит, что вода в озере чистая и что в жару плавать в нём полезно и приятно.",
    ],
}
SPAM = {
    "tags": " ".join(f"#tag{i}" for i in range(60)),
    "links": "\n".join(f"* http://www.shop{i}.example/page-{i}" for i in range(30)),
    "prices": "\n".join(f"wooden lantern A{i} {i}.99" for i in range(30)),
    "keywords": "Keywords: " + " | ".join(f"kettle saddle {i}" for i in range(40)),
    "slogans": "\n".join(f"• Best kettle {i} now!" for i in range(20)),
    "places": " · ".join(f"cheap plumber Town{i}" for i in range(40)),
    "anchors": "\n".join(f"A quiet window https://blog{i}.example/w" for i in range(25)),
    "commas": ", ".join(f"garden{i}, golden harbour" for i in range(50)),
    "german": ", ".join(f"Garten{i}, alte Brücke" for i in range(50)),
    "japanese": "市 / 森 / 村雨 / 家空秋 / 冬 / 川冬庭 / " * 10,
    "chinese": " | ".join("河市鱼桥树"[i % 5] + "村雨车夜"[i % 4] for i in range(60)),
}
FINE = {
    "prose": PROSE * 4,
    "unpunctuated": "\n".join([PROSE.strip().rstrip(".")] + [f"the {x} sells a lantern under the {y} while it rains" for x, y in zip(("man", "girl", "baker"), ("tower", "arch", "roof"))]),
    "mixed": PROSE * 6 + "\n".join(f"- Team {i} 2:{i}" for i in range(12)),
    "russian": SENTENCES["ru"][0] * 4,
    "mojibake": (SENTENCES["ru"][0] * 4).encode().decode("cp1251", "replace"),
    "wrong charset": (SENTENCES["ru"][0] * 4).encode("cp1251").decode("latin-1"),
    "koi8": (SENTENCES["ru"][0] * 4).encode("koi8-r").decode("cp1251", "replace"),
    "cp1251 as koi8": (SENTENCES["ru"][0] * 4).encode("cp1251").decode("koi8-r", "replace"),
    "japanese": "今日は友達と公園へ行きました。とても静かでした。また行きたいと思います。" * 5,
    "error": "Home | About | Contact\n404\nSession expired.\n© 2020 x.example",
    "menu": "Home | About | Contact | News | Shop | Terms | Privacy\n" * 9,
    "null": None, "empty": "", "blank": " \n\t ",
}
CHROME = "Home | Shop | Terms\nWe use cookies to make this site work.\n{}\n© 2020 a.example"


def corpus(each=24, seed=3):
    """(id, text, language, host): pages of sentences."""
    rnd = random.Random(seed)
    rows = []
    for lang, known in SENTENCES.items():
        for i in range(each):
            picked = rnd.sample(known, 7)
            menu = " | ".join(rnd.sample(["Home", "Shop", "Terms", "About", "Contact", "News", "Privacy"], 5))
            body = ("" if lang in ("zh", "ko") else " ").join(picked)
            rows.append((f"{lang}{i}", f"{menu}\nWe use cookies to make this site work.\n{body}", lang, f"h{i % 6}.example"))
    for i in range(each):  # Japanese: the same particles, other nouns
        nouns = "市森村雨家空秋冬川庭花猫犬車道山海船"
        kinds = ("{}は{}を見つけました。", "{}と{}へ行きました。", "{}は静かでした。", "{}を直しています。", "{}が好きです。")
        pick = lambda n: "".join(rnd.choice(nouns) for _ in range(n))
        rows.append((f"ja{i}", "".join(rnd.choice(kinds).format(pick(4), pick(3)) for _ in range(24)), "ja", f"h{i % 6}.example"))
    return rows


@pytest.fixture(scope="module")
def lexicon(spark):
    df = spark.createDataFrame(corpus(), "id string, text string, lang string, host string")
    return S.learn(df, text="text", lang="lang", host="host")


@pytest.fixture(scope="module")
def spoken(lexicon):
    """Without chrome: the few sentences above stand on most of their pages."""
    return S.Lexicon(lexicon.carriers, lexicon.familiar)


def test_carriers_are_found_by_their_recurrence(lexicon):
    assert {"the", "a", "w", "na", "bir", "и", "を"} <= lexicon.carriers
    assert not {"bridge", "river", "home", "rybak", "köprü", "мост", "市"} & lexicon.carriers
    assert len(lexicon.chrome) and "the" in lexicon.familiar


def test_kinds(spark):
    rows = [(k, CHROME.format(v), "xx", "spam.example") for k, v in SPAM.items()]
    rows += [(k, v, "xx", "fine.example") for k, v in FINE.items()] + [(None, SPAM["tags"], None, None), ("tags", SPAM["tags"], "", "")]
    df = spark.createDataFrame(corpus() + rows, "id string, text string, lang string, host string").withColumn("n_words", S.F.lit("clash")).repartition(2)
    got = sorted(r[0] or "" for r in S.stuffed_pages(df, id="id", text="text", lang="lang", host="host").collect())
    assert got == sorted(["", "tags", *SPAM])


@pytest.mark.parametrize("known", [True, False])
def test_prose_of_any_language_is_not_flagged(spark, spoken, known):
    """In a corpus that has the language, and alone, where only the page's own recurrence tells."""
    rows = [(lang, ("" if lang == "zh" else " ").join(s), None) for lang, s in SENTENCES.items()]
    df = spark.createDataFrame(rows, "id string, text string, lang string")
    got = S.stuffed_pages(df, id="id", text="text", lang="lang", lexicon=spoken if known else None).collect()
    assert got == []


def test_recurrence_decides(spoken):
    """Without the recurrence gaps of the corpus and of the page nothing is a sentence."""
    text = " ".join(SENTENCES["en"])
    total, inside, _ = S.shares([text], spoken)
    assert inside[0] > 0.8 * total[0]
    _, inside, _ = S.shares([text], S.Lexicon(frozenset(), spoken.familiar))
    assert inside[0] == 0


def test_copies_do_not_make_their_words_common(spark):
    """A page held a hundred times is a third of all rows; its keywords and lines stay what they are."""
    nouns = "kettle saddle harbour lantern orchard timber".split()
    rnd = random.Random(4)
    spam = "\n".join(" ".join(rnd.choice(nouns) for _ in range(9)) for _ in range(12)) + "\n" + " ".join(rnd.choice(nouns) for _ in range(60))
    rows = corpus(12) + [(f"copy{i}", spam, "en", f"h{i % 6}.example") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, text string, lang string, host string")
    got = {r[0] for r in S.stuffed_pages(df, id="id", text="text", lang="lang", host="host").collect()}
    assert got == {f"copy{i}" for i in range(60)}


def test_long_text_is_read_whole(spoken):
    text = " ".join(SENTENCES["en"]) + " "
    total, inside, _ = S.shares([text * 2_000 + "\n#tag" * 5], spoken)
    assert total[0] == 2_000 * len(text.split()) + 5 and inside[0] > 0.8 * total[0]


def test_regular_repetition_is_found_whatever_its_words(spoken):
    total, inside, again = S.shares(["buy the best kettle of the town " * 40, PROSE], spoken)
    assert again[0] > 0.6 * total[0] and inside[0] < 0.25 * total[0] and again[1] == 0


def test_slices_do_not_matter(lexicon):
    texts = [*SPAM.values(), *FINE.values(), PROSE]
    whole = S.shares(texts, lexicon)
    for i, t in enumerate(texts):
        assert [x[0] for x in S.shares([t], lexicon)] == [x[i] for x in whole], i


def test_held_out_labels(spark):
    """Nothing is fitted to the labels; most of them agree although some are wrong."""
    sf = "/root/testdata/sf0.01"
    if not Path(sf).exists():
        pytest.skip("no test data")
    labels = spark.read.parquet(f"{sf}/page_label.parquet").where("label is not null").select("doc_id", "label").distinct()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r[0] for r in S.stuffed_pages(docs, id="doc_id", text="text", lang="lang", host="source").collect()}
    rows = labels.collect()
    agree = sum((r["label"] == "spam") == (r["doc_id"] in found) for r in rows)
    assert agree >= 0.9 * len(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, text string")
    assert S.stuffed_pages(df, id="id", text="text").count() == 0
