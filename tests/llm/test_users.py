"""Current documents, co-occurrence and similar sets."""

import random
from collections import Counter
from itertools import combinations

import pytest

from lodestrata.llm import cooccur, setsim, users


def test_current_users(spark):
    rows = [
        ("1", ["a", " a ", "b", None, "", "  "], 2), ("1", ["z"], 1), (" 1 ", ["c"], 3), (" 1 ", ["c"], 3),
        ("2", None, 1), ("", ["x"], 9), (None, ["x"], 9), ("3", [], None),
    ]
    got = users.current_users(spark.createDataFrame(rows, "id string, following array<string>, seq bigint"), ("following",)).collect()
    assert {r["id"]: r["following"] for r in got} == {"1": ["c"], "2": []}
    one = users.current_users(spark.createDataFrame(rows[:2], "id string, following array<string>, seq bigint"), ("following",)).first()
    assert one["following"] == ["a", "b"]


def baskets(seed, n=400):
    rnd = random.Random(seed)
    same = sorted(rnd.sample("abcdefghij", 5))
    rows = [same] * (n // 3)  # one basket holds a third
    for _ in range(n):
        rows.append(sorted({*(["hot"] if rnd.random() < 0.7 else []), *(f"i{int(rnd.random() ** 2 * 40)}" for _ in range(rnd.randrange(9)))}))
    rows += [sorted(f"w{i:03d}" for i in range(40))] * 9
    return rows


def pairs(rows, least, lift):
    rows = [r for r in rows if r]
    n, single, joint = len(rows), Counter(x for r in rows for x in r), Counter(p for r in rows for p in combinations(r, 2))
    return {(a, b, c, single[a], single[b], n) for (a, b), c in joint.items() if c >= least and c * n >= lift * single[a] * single[b]}


@pytest.mark.parametrize("block, most", [(7, 1000), (256, 1000), (256, 5)])
@pytest.mark.parametrize("lift", ["0", "1", "3.0"])
def test_pairs_match_brute_force(spark, monkeypatch, block, most, lift):
    monkeypatch.setattr(cooccur, "CODED_ITEMS", most)  # handed to every task, or joined
    rows = baskets(3)
    df = spark.createDataFrame([(r, 1) for r in rows] + [(None, 1), ([], 1)], "items array<string>, weight int")
    got = cooccur.together(df, "items", min_count=8, min_lift=lift, block=block).collect()
    assert {(r["a"], r["b"], r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in got} == pairs(rows, 8, float(lift))
    for r in got:
        assert abs(r["lift"] - r["n_ab"] * r["n"] / (r["n_a"] * r["n_b"])) < 1e-9
        sure = r["n_ab"] == r["n_a"]
        want = None if sure else (1 - r["n_b"] / r["n"]) / (1 - r["n_ab"] / r["n_a"])
        assert r["conviction"] == want or abs(r["conviction"] - want) < 1e-9


def test_exact_bound_counts(spark):
    # lift exactly 3: a and b in 2 of 6 baskets each, together in 2 -> 2*6/(2*2)
    df = spark.createDataFrame([(r,) for r in [["a", "b"], ["a", "b"], ["c"], ["d"], ["e"], ["f"]]], "items array<string>")
    assert [(r["a"], r["b"]) for r in cooccur.together(df, "items", min_count=2, min_lift="3.0").collect()] == [("a", "b")]


def test_no_baskets(spark):
    df = spark.createDataFrame([], "items array<string>")
    assert cooccur.together(df, "items", min_count=1).count() == 0


def similar(rows, fields, t, least):
    out = set()
    for f in fields:
        sets = [(r["id"], set(r[f])) for r in rows if r["id"] is not None and r[f] is not None and len(r[f]) >= least]
        for (a, x), (b, y) in combinations(sorted(sets, key=lambda s: s[0]), 2):
            if a != b and len(x & y) >= t * len(x | y) - 1e-12:
                out.add((f, a, b))
    return out


def nested(seed, n=150):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        base = rnd.sample(range(300), rnd.randrange(4, 15)) + [1000, 1001]  # two ids in every set
        rows.append({"id": f"u{len(rows)}", "x": base, "y": rnd.sample(range(12), rnd.randrange(0, 6))})
        for _ in range(rnd.randrange(3)):  # near copies
            near = [v for v in base if rnd.random() > 0.12] + rnd.sample(range(300, 400), rnd.randrange(2))
            rows.append({"id": f"u{len(rows)}", "x": near, "y": rows[-1]["y"]})
    rows += [{"id": f"c{i}", "x": [1, 2, 3, 4, 5], "y": None} for i in range(25)]  # copies
    rows += [{"id": None, "x": [1, 2, 3, 4, 5], "y": []}, {"id": "e", "x": [], "y": None}]
    return [{"id": r["id"], "x": sorted({str(v) for v in r["x"]}), "y": None if r["y"] is None else sorted({str(v) for v in r["y"]})} for r in rows]


SETS = "id string, x array<string>, y array<string>, items int"


@pytest.mark.parametrize("crowded, block, huge, mapped", [(2, 3, 1 << 17, 0), (64, 1024, 1 << 17, 10_000), (2, 1024, 3, 10_000)])
def test_similar_pairs_match_brute_force(spark, monkeypatch, crowded, block, huge, mapped):
    monkeypatch.setattr(setsim, "BLOCK", block)
    monkeypatch.setattr(setsim, "MAPPED_SETS", mapped)
    monkeypatch.setattr(setsim, "HUGE_ROWS", huge)
    rows = nested(crowded)
    df = spark.createDataFrame([(r["id"], r["x"], r["y"], 0) for r in rows + rows[-3:]], SETS)
    got = setsim.similar_pairs(df, id="id", fields=("x", "y"), threshold=0.7, least=4, crowded=crowded).collect()
    want = similar(rows, ("x", "y"), 0.7, 4)
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == want and len(want) > 300


def test_crowded_small_sets_at_a_low_threshold(spark):
    """Sets of one and two ids that share one only are similar at 0.4, however often their key is split."""
    rows = [{"id": f"s{i}", "x": x, "y": None} for i, x in enumerate([["a"], *(["a", f"b{j}"] for j in range(30)), ["a", "b1", "c"], ["a", "b2", "c", "d"]])]
    df = spark.createDataFrame([(r["id"], r["x"], None, 0) for r in rows], SETS)
    got = setsim.similar_pairs(df, id="id", fields=("x",), threshold=0.4, bands=40, rows=1, crowded=2).collect()
    assert {tuple(r) for r in got} == similar(rows, ("x",), 0.4, 1)


def test_similar_classes(spark):
    rows = nested(5)
    df = spark.createDataFrame([(r["id"], r["x"], r["y"], 0) for r in rows + rows[-3:]], SETS)
    members, links = (d.collect() for d in setsim.similar_classes(df, id="id", fields=("x", "y"), threshold=0.7, least=4))
    of = {}
    for r in members:
        of.setdefault((r["field"], r["class"]), []).append(r["id"])
    pairs = {(f, *sorted((a, b))) for (f, _), ids in of.items() for a, b in combinations(ids, 2)}
    for r in links:
        pairs |= {(r["field"], *sorted((a, b))) for a in of[r["field"], r["class_a"]] for b in of[r["field"], r["class_b"]]}
    assert pairs == similar(rows, ("x", "y"), 0.7, 4) and len(members) == len({(r["field"], r["id"]) for r in members})
    ends = [c for r in links for c in (r["class_a"], r["class_b"])]
    assert all(r["n_links"] == ends.count(r["class"]) for r in members)


def test_similar_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "id string, x array<string>")
    assert setsim.similar_pairs(df, id="id", fields=("x",), threshold=0.7).count() == 0
    with pytest.raises(ValueError):
        setsim.similar_pairs(df, id="id", fields=("x",), threshold=0.0)
