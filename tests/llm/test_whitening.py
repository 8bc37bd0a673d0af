"""Whitening against numpy on whole tables and matrices that are hard for the solver."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

from costweave.llm import whitening
from costweave.llm.queries import QUERIES

DRAW = np.random.default_rng(0)


def spun(values):
    q, _ = np.linalg.qr(DRAW.normal(size=(len(values), len(values))))
    return (q * values) @ q.T


WILKINSON = np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1) + 2 * np.eye(21)
MATRICES = {
    "noise": DRAW.normal(size=(5000, 64)),
    "graded": DRAW.normal(size=(300, 40)) * np.logspace(0, -6, 40),
    "identity": 3 * np.eye(30),
    "low rank": DRAW.normal(size=(200, 7)) @ DRAW.normal(size=(7, 40)),
    "repeated values": spun(np.repeat([5.0, 3.0, 1.0], 12)),
    "pairs nearly equal": np.linalg.cholesky(WILKINSON).T,
    "fewer rows": DRAW.normal(size=(3, 8)),
    "empty column": np.array([[1e-3, 0, 1], [2, 0, 1], [3, 0, 5]]),
    "one entry": np.array([[2.5]]),
}


@pytest.mark.parametrize("name", MATRICES)
def test_directions(name):
    a = MATRICES[name]
    squares, basis = whitening.directions(whitening.triangle(a), 32)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    rank = int((want > 1e-24 * want[0]).sum())
    assert len(squares) == rank and basis.shape[1] == min(32, rank)
    assert np.allclose(squares, want[:rank], rtol=1e-9 if name == "graded" else 1e-12)
    k = basis.shape[1]
    assert np.abs(basis.T @ basis - np.eye(k)).max() < 1e-10
    assert np.abs(a.T @ (a @ basis) - basis * squares[:k]).max() < 1e-11 * squares[0]


def test_no_spread_no_direction():
    squares, basis = whitening.directions(np.zeros((4, 4)))
    assert not len(squares) and basis.shape == (4, 0)


def plain_rows(table):
    """Remaining (key, x) of a table of (key, vector)."""
    fine = [(k, v) for k, v in table if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    most = max((len(v) for _, v in fine), default=0)
    return [(k, [math.floor(64.0 * c) + 1_000_000 for c in v]) for k, v in fine if len(v) == most and most]


@pytest.mark.parametrize("name", ["tables", "odd", "none"])
def test_whole_tables(name, spark, sf_dir, odd_dir, none_dir):
    folder = {"tables": sf_dir, "odd": odd_dir, "none": none_dir}[name]
    table = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    rows = plain_rows(table)
    got = defaultdict(list)
    for r in QUERIES["op13_whitening"](spark, folder).collect():
        got[r["vec_id"], r["deviation"]].append((r["component"], r["n"], r["whitened"], r["explained"], r["identity_error"]))
    if not rows:
        assert not got
        return
    x = np.array([v for _, v in rows])
    n, sums = len(x), x.sum(axis=0)
    centred = (x - sums / n).astype(np.longdouble).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(32, int((values > 1e-10 * values[0]).sum()))
    white = centred @ vectors[:, :k] / np.sqrt(values[:k])
    deviations = [int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums))) for v in x]
    signs = None
    for (key, _), deviation, expected in zip(rows, deviations, white):
        mine = sorted(got[key, deviation])
        values_of = np.array([m[2] for m in mine[:: len(mine) // k]])
        assert [m[0] for m in mine] == [c for c in range(1, k + 1) for _ in range(len(mine) // k)]
        assert {m[1] for m in mine} == {n} and all(m[4] <= 1e-4 for m in mine)
        assert np.allclose([m[3] for m in mine[:: len(mine) // k]], values[:k] / values.sum(), rtol=1e-9)
        signs = np.sign(values_of * expected) if signs is None else signs
        assert np.allclose(values_of * signs, expected, rtol=1e-6, atol=1e-7)
    assert sum(len(m) for m in got.values()) == n * k


def test_parts_meet_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rows = [(i, [float(v) for v in DRAW.normal(size=5)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(13)
    x = whitening.whole_vectors(df, "vec_id", "embedding")
    moments, _ = whitening.measured(x)
    r = whitening.centred_triangle(x, moments)
    all_x = np.array([v for _, v in plain_rows([(k, np.float32(v).tolist()) for k, v in rows])], float)
    centred = all_x - all_x.mean(axis=0)
    assert np.allclose(r.T @ r, centred.T @ centred)


def test_equal_vectors_and_deviations_beyond_a_long(spark):
    equal = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(equal).collect() == []
    wide = spark.createDataFrame([(0, [0.0]), (1, [3e7]), (2, [1e300])], "vec_id long, embedding array<double>")
    rows = whitening.whiten(wide).collect()
    assert [r["deviation"] for r in rows] == [(64 * 30_000_000) ** 2] * 2  # 1e300 is no long and goes
    wider = spark.createDataFrame([(0, [0.0]), (1, [1e9])], "vec_id long, embedding array<double>")
    assert [r["deviation"] for r in whitening.whiten(wider).collect()] == [None, None]
