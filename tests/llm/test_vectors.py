"""Whitening and hard negatives beside plain computations in numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import feast, gnat, whitening
from tessera.llm.common import shared_dir

KINDS = "vec_id long, embedding array<float>, label int"


def grid(vector) -> list[int] | None:
    """Coordinates of a whole vector."""
    if vector is None or not len(vector) or any(c is None or not np.isfinite(c) for c in vector):
        return None
    return [int(np.floor(256 * float(np.float32(c)))) for c in vector]


def odd_rows(rng: np.random.Generator, n: int, width: int) -> list[tuple]:
    """Clustered vectors with repeated ones, null and broken ones, null ids and labels."""
    centres = rng.standard_normal((5, width))
    rows = [(i, (centres[i % 5] + 0.3 * rng.standard_normal(width)).astype(np.float32).tolist(), int(rng.integers(0, 10))) for i in range(n)]
    rows += [(n + i, rows[3][1], i % 3) for i in range(40)]
    broken = [None, [], [None] * width, [float("nan")] * width, [float("inf")] + [0.0] * (width - 1), [1.0] * (width + 1)]
    return rows + [(10_000 + i, vector, 1) for i, vector in enumerate(broken)] + [(20_000, rows[0][1], None), (100, rows[100 % n][1], rows[100 % n][2])]


# --- eigenpairs -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [2, 2, 1, 1, 1, 1], [1] * 6, [1, 0, 0, 0, 0], [0, 0, 0], [7], [1e6, 1, 1e-6, 0], [1, 1 - 1e-9, 1 - 2e-9, 0.1], [-1, -2, -3, 4]])
def test_pairs_are_those_of_the_matrix(values):
    rng = np.random.default_rng(len(values))
    turn = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    v = turn @ np.diag(np.array(values, dtype=float)) @ turn.T
    v = (v + v.T) / 2
    found, vectors = feast.top(v, 4)
    assert np.allclose(found, sorted(values, reverse=True)[:4], rtol=0, atol=1e-13 * max(1, np.abs(values).max()))
    assert np.abs(v @ vectors - vectors * found).max() <= 1e-12 * max(1, np.abs(values).max())
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-11


def test_inertia_counts_what_is_above():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 30):
        b = rng.standard_normal((n, n))
        v = b + b.T
        values = np.linalg.eigvalsh(v)
        for shift in (*((values[1:] + values[:-1]) / 2), values[0] - 1, values[-1] + 1):
            assert feast.above(v, shift) == (values > shift).sum()
    assert feast.above(np.zeros((3, 3)), 0.0) == 0


def test_many_pairs_come_from_many_intervals():
    b = np.random.default_rng(6).standard_normal((40, 80))
    v = b @ b.T
    assert len(feast.intervals(v, 30)) >= 4
    assert np.allclose(feast.top(v, 40)[0], np.linalg.eigvalsh(v)[::-1], rtol=1e-12)


# --- whitening ------------------------------------------------------------------------------------------------------


def test_whitened_rows_beside_numpy(spark):
    rows = odd_rows(np.random.default_rng(1), 230, 6)
    got = whitening.whitened(spark.createDataFrame(rows, KINDS).withColumn("n", F.lit("x"))).collect()
    kept = [(r[0], grid(r[1])) for r in rows if grid(r[1]) and len(r[1]) == 6]
    fit = np.unique(np.array([x for _, x in kept]), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    covariance = np.cov(fit.T, bias=True)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n}
    by_id: dict = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.component), set()).add((r.deviation, r.whitened))
    for c in range(4):
        want = {(i, x_id): (np.array(x) - sums / n) @ vectors[:, c] / np.sqrt(values[c]) for i, (x_id, x) in enumerate(kept)}
        mine = [(min(by_id[x_id, c + 1], key=lambda d: abs(abs(d[1]) - abs(w)))[1], w) for (_, x_id), w in want.items()]
        sign = np.sign(sum(a * b for a, b in mine))
        assert max(abs(a - sign * b) for a, b in mine) < 1e-9
    for x_id, x in kept:
        assert int(((n * np.array(x) - sums) ** 2).sum()) in {d for d, _ in by_id[x_id, 1]}
    assert max(r.identity_error for r in got) < 1e-10
    assert np.allclose(sorted({r.explained for r in got}, reverse=True), values[:4] / values.sum(), rtol=1e-10)


def test_whitening_of_little(spark):
    def rows(*vectors):
        return whitening.whitened(spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], KINDS)).collect()

    assert rows() == [] and rows(None, [None], []) == []
    same = rows([1.0, 2.0], [1.0, 2.0])
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in sorted(same)] == [(i, c, 1, 0, None, None) for i in (0, 1) for c in (1, 2)]
    line = rows([0.0, 0.0], [1.0, 0.0], [2.0, 0.0])
    assert {(r.component, r.whitened is None, r.explained) for r in line} == {(1, False, 1.0), (2, True, 0.0)}
    assert {(r.vec_id, r.deviation) for r in line} == {(0, (3 * 256) ** 2), (1, 0), (2, (3 * 256) ** 2)}


def test_offsets_far_from_zero_cost_no_digits(spark):
    rng = np.random.default_rng(2)
    near = rng.integers(-3, 4, (60, 3)) / 256
    here, far = ([(i, row.tolist(), 0) for i, row in enumerate(near + shift)] for shift in (0, 2.0**14))
    kinds = KINDS.replace("float", "double")
    ends = [sorted((r.vec_id, r.component, r.deviation, r.whitened) for r in whitening.whitened(spark.createDataFrame(rows, kinds)).collect()) for rows in (here, far)]
    assert ends[0] == ends[1]
    huge = whitening.whitened(spark.createDataFrame([(0, [1e12, 0.0], 0), (1, [-1e12, 1.0], 0)], kinds)).collect()
    assert {r.deviation for r in huge} == {None} and all(abs(abs(r.whitened) - 1) < 1e-9 for r in huge if r.component == 1)


# --- hard negatives -------------------------------------------------------------------------------------------------


def negatives(rows: list[tuple], n_positives: int = 5, n_negatives: int = 10) -> list[tuple]:
    """All anchors against all rows."""
    kept = [(r[0], (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2], np.array(x)) for r in rows if r[0] is not None and r[2] is not None and (x := grid(r[1])) and len(x) == 6]
    found = []
    for a_id, a_label, a in {(i, label, tuple(x)): (i, label, x) for i, label, x in kept if i % 100 == 0}.values():
        others = sorted((-int(x @ a), i, label) for i, label, x in kept if i != a_id)
        for score, p_id, label in [o for o in others if o[2] == a_label][:n_positives]:
            fits = [(-s, i) for s, i, other in others if other != a_label and 30 * -score <= 100 * -s <= 90 * -score][:n_negatives]
            found += [(a_id, p_id, rank + 1, n_id, -score, s) for rank, (s, n_id) in enumerate(fits)]
    return sorted(found)


def label_of():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize("leaf,fanout", [(20, 3), (10_000, 8)])
def test_negatives_beside_all_pairs(spark, monkeypatch, leaf, fanout):
    monkeypatch.setattr(gnat, "LEAF", leaf)
    monkeypatch.setattr(gnat, "FANOUT", fanout)
    monkeypatch.setattr(gnat, "BLOCK", 16)
    monkeypatch.setattr(gnat, "ANCHORS", 2)
    rows = odd_rows(np.random.default_rng(3), 900, 6)
    df = spark.createDataFrame(rows + [(None, rows[1][1], 2)], KINDS).withColumn("x", F.lit(0))
    got = sorted(tuple(r) for r in gnat.mined(df, F.col("vec_id") % 100 == 0, label=label_of()).collect())
    assert got == negatives(rows) and len(got) > 50


def test_few_rows_and_ties(spark):
    def run(rows):
        return sorted(tuple(r) for r in gnat.mined(spark.createDataFrame(rows, KINDS), F.col("vec_id") % 100 == 0, label=label_of()).collect())

    assert run([]) == [] and run([(0, [1.0] * 6, 1)]) == []
    ones, half = [1.0] * 6, [0.5] * 6
    rows = [(0, ones, 1), *[(i, ones, 2) for i in (1, 2, 3)], *[(i, half, 5) for i in range(20, 40)], (100, [-1.0] * 6, 2), (200, [0.0] * 6, 2)]
    assert run(rows) == negatives(rows) != []


def test_tree_passes_over_what_cannot_be_near(spark):
    rng = np.random.default_rng(4)
    centres = 40 * rng.standard_normal((12, 6))
    x = np.floor(256 * (centres[np.arange(6000) % 12] + 0.1 * rng.standard_normal((6000, 6)))).astype(np.int64)
    tree = gnat.fitted(spark.createDataFrame([(row.tolist(),) for row in x], "x array<long>"), 6)
    own = (x[:50] * x[:50]).sum(axis=1)
    needed = tree.needed(x[:50], (0.999 * own).astype(np.int64), np.full(50, gnat.MOST))
    assert tree.leaves > 10 and needed.mean() < 0.4
    leaf = tree.routed(x)
    scores = x[:50] @ x.T
    for i in range(50):
        assert needed[i, np.unique(leaf[scores[i] >= int(0.999 * own[i])])].all()
    assert sum(tree.sizes.values()) == 6000


def test_tables_of_a_run_go(spark):
    import os

    place = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(place))
    df = spark.createDataFrame(odd_rows(np.random.default_rng(7), 120, 6), KINDS)
    whitening.whitened(df).count()
    gnat.mined(df, F.col("vec_id") % 100 == 0).count()
    assert [x.split("-")[0] for x in set(os.listdir(place)) - before] == ["negatives"]  # the result itself
