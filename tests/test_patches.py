"""Patch composition against a sequential fold."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import patches as P

SCHEMA = "k bigint, v bigint, o int, op string, a int, b string, level string"
WORDS = {P.INSERT: ["create", "0"], P.UPDATE: ["update"], P.DELETE: ["delete", "1"]}


def fold(base, rows):
    state = {k: list(v) for k, v in base.items()}
    for k, v, o, op, a, b, _ in sorted({r for r in rows if None not in (r[0], r[1], r[2])}, key=lambda r: (r[1], r[2])):
        op = (op or "").strip().lower()
        if op in ("create", "0"):
            state[k] = [a, b]
        elif op in ("delete", "1"):
            state.pop(k, None)
        elif op == "update" and k in state:
            state[k] = [a if a is not None else state[k][0], b if b is not None else state[k][1]]
    return {k: tuple(v) for k, v in state.items()}


def apply(spark, rows, base=None, **kw):
    feed = spark.createDataFrame(rows, SCHEMA)
    b = None if base is None else spark.createDataFrame([(k, *v) for k, v in base.items()], "k bigint, a int, b string")
    got = P.apply_changes(feed, key="k", major="v", minor="o", op="op", columns=["a", "b"], spellings=WORDS, base=b, **kw)
    return {r["k"]: (r["a"], r["b"]) for r in got.collect()}


@pytest.mark.parametrize("levels", [1, 2])
def test_matches_fold(spark, levels):
    rnd = random.Random(levels)
    rows = []
    for n in range(1500):
        k = 7 if rnd.random() < 0.35 else rnd.randrange(40)  # one key holds a third
        op = rnd.choice(["create", " Create", "0", "UPDATE", "update ", "delete", "1"])
        rows.append((k, n // 5, n % 5, op, rnd.choice([None, rnd.randrange(9)]), rnd.choice([None, "x", ""]), "c"))
    rows += rnd.sample(rows, 300)  # delivered again
    rnd.shuffle(rows)
    base = {k: (k, "base") for k in range(30, 60)}
    assert apply(spark, rows, base, chunk_span=16, fan_in=4, levels=levels) == fold(base, rows)


def test_nulls_and_unknown_change_nothing(spark):
    rows = [(None, 1, 1, "create", 1, "x", ""), (1, None, 1, "create", 1, "x", ""), (1, 1, None, "create", 1, "x", ""),
            (1, 1, 1, None, 1, "x", ""), (1, 1, 2, "frob", 1, "x", ""), (2, -5, -1, "create", None, None, "")]
    assert apply(spark, rows) == {2: (None, None)}


def test_empty_feed_gives_base(spark):
    assert apply(spark, [], {1: (2, "b")}) == {1: (2, "b")}
    assert apply(spark, []) == {}


def test_conflict_at_one_place_is_the_same_each_run(spark):
    rows = [(1, 1, 1, "create", i, "x", "") for i in range(5)]
    first = apply(spark, rows)
    assert apply(spark, rows[::-1]) == first and len(first) == 1


def test_place_keeps_order(spark):
    big = (1 << 63) - 1
    at = [(-3, 2), (0, -(1 << 31)), (0, 0), (0, 5), (1, 0), (big, 1), (big, 2)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(at)], "i int, v bigint, o int")
    got = df.select("i", P.place(F.col("v"), F.col("o"), F.lit(999_999_999)).alias("p")).orderBy("p").collect()
    assert [r["i"] for r in got] == list(range(len(at)))


def test_queries_agree_with_sql(spark, sf):
    from compare import compare, connect

    from lodestrata.plans import core_problems as c

    con = connect(sf)
    for name, sql in c.SQL.items():
        assert compare(spark, con, name, c.QUERIES[name], sql, sf) == "", name
