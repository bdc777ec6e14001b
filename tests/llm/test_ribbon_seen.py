"""Ribbon filters and the seen-before operator."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import seen
from lodestrata.llm.ribbon import Generations, RibbonFilter


def hashes(n, seed):
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 64, n, dtype=np.uint64), r.integers(0, 1 << 64, n, dtype=np.uint64)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 20_000])
@pytest.mark.parametrize("bits", [4, 16])
def test_no_key_is_missed_and_the_rate_is_as_designed(n, bits):
    f = RibbonFilter(*hashes(n, n + 1), bits=bits)
    assert f.contains(*hashes(n, n + 1)).all()
    wrong = f.contains(*hashes(50_000, 99)).mean()
    assert wrong <= 1.5 * 2.0**-bits + 1e-4
    if n == 20_000:
        assert f.n_bytes / n < 4  # two bytes of fingerprint and the band's slack
        assert len(f.bumped) < 0.02 * n


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=300), st.integers(1, 40))
def test_generations_answer_exactly_up_to_fingerprints(keys, step):
    h1, h2 = hashes(401, 5)
    g, known = Generations(bits=16, seal=16, seal_most=64), set()
    for a in range(0, len(keys), step):
        part = keys[a:a + step]
        got = g.add(h1[part], h2[part])
        for k, hit in zip(part, got, strict=True):
            assert hit or k not in known  # never a miss
            assert not hit or hit == 2 or k in known  # what is open is exact
            known.add(k)


SCHEMA = "key binary, at bigint, win string"


def cases(rows):
    first = {}
    for k, a, _ in rows:
        if k and a is not None:
            first[k] = min(a, first.get(k, a))
    return sorted(a for k, a, _ in rows if k and a is not None and a > first[k])


@pytest.mark.parametrize("crowded", [40, 1 << 16])
@pytest.mark.parametrize("bits", [2, 16])
def test_matches_brute_force(spark, monkeypatch, bits, crowded):
    monkeypatch.setattr(seen, "CROWDED_ROWS", crowded)
    rnd = random.Random(bits)
    rows = []
    for a in rnd.sample(range(-500, 5000), 2000):
        k = b"hot" if rnd.random() < 0.33 else rnd.choice([None, b"", bytes([rnd.randrange(256), 255, 0]), str(rnd.randrange(900)).encode(), b"long" * 3000])
        rows.append((k, a, "clash"))
    rows += [(b"x", None, ""), *rows[:40]]  # no place; delivered again
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "50")  # many batches
    try:
        got = seen.seen_before(df, key="key", order="at", bits=bits, seal=32, seal_most=128, window=64)
        assert got.columns == ["at"]
        assert sorted(r[0] for r in got.collect()) == cases(rows)
    finally:
        spark.conf.set(name, old)


def test_error_rate_is_reported(spark):
    rows = [(str(i).encode(), i, "") for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    r = seen.error_rate(df, key="key", order="at", bits=3, seal=64, seal_most=256, audit_keys=3000).first()
    assert r["n_audit"] == 3000 and 0.05 < r["audit_rate"] < 0.99 and r["n_wrong"] == r["n_positive"] == r["n_by_filter"] > 0
    r = seen.error_rate(df, key="key", order="at", audit_keys=50_000).first()
    assert r["n_filters"] > 0 and r["n_wrong"] <= 3 and r["audit_rate"] < 1e-3


def test_most_repeats_are_answered_by_filters(spark):
    rnd = random.Random(9)
    rows = [(str(rnd.randrange(6000)).encode(), i, "") for i in range(20_000)]
    r = seen.error_rate(spark.createDataFrame(rows, SCHEMA), key="key", order="at", audit_keys=10).first()
    assert r["n_positive"] >= 20_000 - 6000 and r["n_by_filter"] > 0.6 * r["n_positive"]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert seen.seen_before(df, key="key", order="at").count() == 0
    assert seen.error_rate(df, key="key", order="at", audit_keys=10).first()["wrong_rate"] is None
