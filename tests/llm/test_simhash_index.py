"""The segment tables of SimHash against a comparison of all pairs."""

import numpy as np
import pytest

from matloom.llm import simhash


def prints_of_crowds():
    rng = np.random.default_rng(11)
    out = {0, (1 << 64) - 1, 1, 3, 7, 1 << 63, (1 << 63) | (1 << 31)}
    for base in rng.integers(0, 1 << 63, 12).tolist():
        out.add(base)
        for _ in range(12):
            out.add(base ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 5))}))
    # Crowds that agree in 32 and in 48 bits, in either half.
    for shift, width in ((0, 32), (32, 32), (0, 16), (16, 16), (32, 16), (48, 16)):
        base = int(rng.integers(0, 1 << 63))
        hole = ((1 << width) - 1) << shift
        for _ in range(60):
            near = sum({1 << int(b) for b in rng.integers(0, width, rng.integers(0, 4))}) << shift
            out.add((base & ~hole) | ((base ^ near) & hole))
    return sorted(p - (1 << 64) if p >> 63 else p for p in out)


@pytest.mark.parametrize("longest", [0, 1, 5, 40, 10_000])
def test_no_pair_is_lost_whatever_the_length_of_lists(spark, ws, monkeypatch, longest):
    monkeypatch.setattr(simhash, "LIST", longest)
    fps = prints_of_crowds()
    df = spark.createDataFrame([(p,) for p in fps], "fp long").repartition(3)
    got = sorted(tuple(r) for r in simhash.links(ws, df).select("src", "dst").collect())
    apart = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    assert got == sorted((a, b) for a in fps for b in fps if a < b and apart(a, b) <= 2)


def test_a_crowd_is_met_in_short_lists(spark, ws, monkeypatch):
    """What the probes of a crowd fetch grows with its fingerprints, not their pairs."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(simhash, "LIST", 8)
    fetched = []
    real = simhash._lookup

    def counted(ws, table, probes, key):
        short = table.groupBy(*key).count().where(f"count <= {simhash.LIST}")
        fetched.append(probes.join(table.join(short.select(*key), key), key).count())
        return real(ws, table, probes, key)

    monkeypatch.setattr(simhash, "_lookup", counted)
    seen = {}
    for n in (300, 1200):
        fetched.clear()
        low = rng.choice(1 << 32, n, replace=False).tolist()
        df = spark.createDataFrame([((77 << 32) | x,) for x in low], "fp long")
        simhash.links(ws, df).collect()
        seen[n] = sum(fetched)
    assert seen[1200] <= 12 * seen[300]
