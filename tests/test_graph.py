"""Graph queries on crowded ids, and over all current documents."""

from collections import Counter
from itertools import combinations

from compare import compare, connect

import __spark_entry__ as entry
from lodestrata.operators import graph, skew

HUB = {(f"u{i}", "hub") for i in range(40)} | {("hub", f"v{i}") for i in range(30)}
EDGES = sorted(HUB | {(f"u{i}", f"u{i * 7 % 40}") for i in range(40)} | {("v1", "u3"), ("x", "x")})


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_crowded_ids_are_split(spark, monkeypatch):
    monkeypatch.setattr(skew, "PART_ROWS", 8)
    e = spark.createDataFrame(EDGES, "src string, dst string")
    assert rows(graph.two_hop(e)) == {(a, d) for a, b in EDGES for c, d in EDGES if b == c and a != d}
    both = Counter((a, c) for a, b in EDGES for c, d in EDGES if b == d and a != c)
    assert rows(graph.common_neighbours(e)) == {(*p, n) for p, n in both.items() if p[0] < p[1]}
    asked = spark.createDataFrame([("u3",), ("u9",), ("absent",)], "id string")
    assert rows(graph.common_neighbours(e, of=asked)) == {(*p, n) for p, n in both.items() if p[0] in ("u3", "u9")}
    near = {frozenset(p) for p in EDGES if p[0] != p[1]}
    ids = sorted({i for p in EDGES for i in p})
    assert rows(graph.triangles(e)) == {t for t in combinations(ids, 3) if all(frozenset(p) in near for p in combinations(t, 2))}
    # no part of a crowded id holds more than a block of it
    x = e.selectExpr("src as a", "dst")
    assert skew.split_join(x, e, "dst").count() == sum(n * n for n in Counter(d for _, d in EDGES).values())


def test_all_current_documents(spark, sf):
    con, queries, sql = connect(sf), entry.queries(), entry.oracle_sql()
    for name in ("json_users", "graph_two_hop", "graph_khop", "graph_common_neighbours", "graph_triangles"):
        assert compare(spark, con, f"{name}_current", queries[f"{name}_current"], sql[f"{name}_current"], sf) == ""
        assert "user_doc" in sql[f"{name}_current"]
