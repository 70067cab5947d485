import numpy as np
import pytest
from conftest import dense, matrix, values, vector

from matloom import Permutation
from matloom.operators import products, stats, structure, sums

A = [[1, 2, 3], [0, 4, 5], [0, 0, 6]]
B = [[1, 0, 0], [2, 4, 0], [3, 5, 6]]


def test_sum_and_product_goldens(spark):
    a, b = matrix(spark, A), matrix(spark, B)
    assert dense(sums.add(a, b)).tolist() == [[2, 2, 3], [2, 8, 5], [3, 5, 12]]
    assert dense(products.matmul(a, b)).tolist() == [[14, 23, 18], [23, 41, 30], [18, 30, 36]]
    assert dense(products.matmul(a, b, trans_a=True)).tolist() == [[1, 0, 0], [10, 16, 0], [31, 50, 36]]
    assert values(products.matvec(a, vector(spark, [1, 2, 3]))) == [14, 23, 18]


def test_unordered_symmetric_storage_gives_the_same_product(spark):
    full = [[1, 1, 0, 0, 0], [1, 1, 0, 1, 0], [0, 0, 1, 0, 0], [0, 1, 0, 1, 1], [0, 0, 0, 1, 1]]
    a, ones = matrix(spark, full), vector(spark, [1] * 5)
    half = structure.to_symmetric(a)
    assert values(products.matvec(a, ones)) == values(products.matvec(half, ones)) == [2, 3, 1, 3, 2]


def test_empty_rows_give_zero_and_beta_zero_ignores_x(spark):
    a = matrix(spark, [[0, 0], [1, 0]])
    nan = vector(spark, [float("nan"), float("nan")])
    assert values(products.matvec(a, vector(spark, [3, 4]), beta=0.0, x=nan)) == [0, 3]


def test_cancelled_entries_stay_until_pruned(spark):
    a = matrix(spark, A)
    gone = sums.add(a, a, -1.0)
    assert gone.df.count() == 6
    assert structure.prune(gone).df.count() == 0


@pytest.mark.parametrize("n", [4, 11])
def test_random_identities(spark, n):
    rng = np.random.default_rng(n)
    raw = np.where(rng.random((n, n)) < 0.4, rng.integers(1, 9, (n, n)), 0)
    raw[0, 0] = 1
    a = matrix(spark, raw.tolist())
    assert (dense(structure.transpose(structure.transpose(a))) == raw).all()
    low, d, up = structure.split_ldu(a)
    assert (dense(low) + np.diag(values(d)) + dense(up) == raw).all()
    order = rng.permutation(n)
    p = Permutation(
        spark.createDataFrame([(i, int(o)) for i, o in enumerate(order)], "new_id long, old_id long"), n
    )
    moved = structure.permute(a, p, p)
    assert (dense(moved) == raw[np.ix_(order, order)]).all()
    assert (dense(structure.permute(moved, p.inverse(), p.inverse())) == raw).all()
    sym = np.triu(raw) + np.triu(raw, 1).T
    half = structure.symmetric_permute(matrix(spark, np.triu(raw).tolist()), p)
    assert (dense(structure.to_full(half)) == sym[np.ix_(order, order)]).all()
    assert (dense(structure.block(a, 1, 2, 2, 50)) == raw[1:3, 2:]).all()


def test_block_beyond_the_rows_is_refused(spark):
    with pytest.raises(ValueError):
        structure.block(matrix(spark, A), 2, 0, 2, 1)


def test_symmetry_and_validity_reports(spark):
    a = matrix(spark, [[1, 2, 0], [3, 1, 0], [4, 0, 1]])
    r = stats.symmetry(a).first()
    assert (r["pattern_misses"], r["value_misses"], r["symmetric"]) == (1, 1, False)
    v = stats.validity(a.with_entries(a.df.union(a.df.limit(1)), ncols=2)).first()
    assert (v["out_of_range"], v["duplicates"], v["valid"]) == (1, 1, False)


def test_weighted_partition_follows_the_running_weight(spark, ws):
    weights = [5, 1, 1, 1, 9, 1, 0, 4]
    df = spark.createDataFrame(list(enumerate(weights)), "id long, w long")
    prefix = np.concatenate([[0], np.cumsum(weights)])
    for parts in (1, 3, 5, 40):
        size, extra = divmod(int(prefix[-1]), parts)
        goal = [t * size + extra if t >= extra else t * (size + 1) for t in range(parts)]
        firsts = [0] + [int(np.searchsorted(prefix, g)) for g in goal[1:]]
        got = stats.weighted_partition(ws, df, parts).orderBy("part").collect()
        assert [r["first"] for r in got] == firsts
        assert [r["past"] for r in got] == firsts[1:] + [8]


def test_top_entries_break_ties_by_column(spark):
    a = matrix(spark, [[3, -3, 2, 3], [1, 0, 0, 0]])
    assert sorted((r["i"], r["j"]) for r in stats.top_entries(a, 2).df.collect()) == [(0, 0), (0, 1), (1, 0)]
