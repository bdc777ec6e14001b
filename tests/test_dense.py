"""Dense accumulators against a plain loop."""

import random

import pytest

from lodestrata.operators import dense


def loop(rows, k):
    first, n = {}, {}
    for u, f, s, *_ in rows:
        u, f = (u or "").strip(" "), (f or "").strip(" ")
        if u and f and s is not None:
            n[u] = n.get(u, 0) + 1
            d = first.setdefault(u, {})
            d[f] = min(s, d.get(f, s))
    return {(u, f, s, i + 1, n[u]) for u, d in first.items() for i, (f, s) in enumerate(sorted(d.items(), key=lambda x: (x[1], x[0].encode()))[:k])}


def test_matches_loop(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(4000):
        u = rnd.choice(["hot"] * 4 + [f"u{rnd.randrange(200)}", f" u{rnd.randrange(9)} ", "", None, "  ", "ü"])
        rows.append((u, rnd.choice([f"f{rnd.randrange(50)}", f"f{rnd.randrange(5)} ", None, " ", "é"]), rnd.choice([rnd.randrange(60), None, i]), "clash"))
    rows += rows[:500]
    df = spark.createDataFrame(rows, "user_id string, follower string, seq bigint, key string").repartition(5)
    for k in (1, 3):
        got = dense.first_k(df, key="user_id", item="follower", seq="seq", k=k).collect()
        assert {tuple(r) for r in got} == loop(rows, k) and len(got) == len(loop(rows, k))


def test_small_chunks_reduce_alike():
    """The partial and the summing pass, fed batch by batch."""
    import pyarrow as pa

    rnd = random.Random(3)
    rows = [(f"u{rnd.randrange(30)}", f"f{rnd.randrange(20)}", i % 97) for i in range(3000)]
    table = pa.table({"key": [r[0] for r in rows], "item": [r[1] for r in rows], "seq": [r[2] for r in rows], "n": [1] * len(rows)})
    old = dense.CHUNK_ROWS
    dense.CHUNK_ROWS = 100
    try:
        parts = pa.Table.from_batches(list(dense._merge_splits(3)(iter(table.to_batches(max_chunksize=37)))))
        placed = pa.Table.from_batches(list(dense._place_rows(3)(iter(parts.sort_by("key").to_batches(max_chunksize=11)))))
    finally:
        dense.CHUNK_ROWS = old
    got = {(r["key"], r["item"], r["seq"], r["place"], r["n_rows"]) for r in placed.to_pylist()}
    assert got == loop(rows, 3)


def test_splits_larger_than_a_chunk(spark):
    """More rows in a split, and more keys, than are reduced at a time; a third of them of one key."""
    from pyspark.sql import functions as F

    n = 900_000
    user = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), (F.col("id") % 200_003).cast("string")))
    df = spark.range(0, n, 1, 2).select(user.alias("user_id"), (F.col("id") % 1009).cast("string").alias("follower"), (n - F.col("id")).alias("seq"))
    got = dense.first_k(df, key="user_id", item="follower", seq="seq", k=3)
    hot = got.where("user_id = 'hot'").orderBy("place").collect()
    top = [i for i in range(n - 1, 0, -1) if i % 3 == 0][:3]
    assert [(r["follower"], r["seq"]) for r in hot] == [(str(i % 1009), n - i) for i in top] and hot[0]["n_rows"] == n // 3
    assert got.where("place = 1").agg(F.sum("n_rows")).first()[0] == n


def test_empty_and_bad_k(spark):
    df = spark.createDataFrame([], "user_id string, follower string, seq bigint")
    assert dense.first_k(df, key="user_id", item="follower", seq="seq", k=3).count() == 0
    with pytest.raises(ValueError):
        dense.first_k(df, key="user_id", item="follower", seq="seq", k=0)
