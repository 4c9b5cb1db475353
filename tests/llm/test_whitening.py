"""Whitening against a dense eigensolver and exact integers."""

import numpy as np
import pytest

from ledgerfold.llm import whitening
from ledgerfold.llm.common import table
from ledgerfold.llm.queries import QUERIES
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
SHAPE = "vec_id bigint, embedding array<float>"


def plain(rows, most=16):
    """Per row (id, deviation, whitened up to sign), and n, shares: by Python integers for
    the sums and a dense eigensolver."""
    good = [(i, [int(np.floor(64.0 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    distinct = sorted({tuple(x) for _, x in good})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in distinct])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    result = []
    for i, x in good:
        y = [n * a - s for a, s in zip(x, sums)]
        result.append((i, sum(v * v for v in y), np.array(y) / n @ vectors / np.sqrt(values)))
    return n, values / np.trace(centred.T @ centred / n), result


def check(rows, n, shares, want):
    """Rows of ``components``, each component up to one sign for all rows."""
    by = {}
    for r in rows:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert abs(r["explained"] - shares[r["component"] - 1]) < 1e-9 * r["explained"]
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    assert by.keys() == {(i, d) for i, d, _ in want}
    for k in range(1, len(shares) + 1):
        got = np.array([by[i, d][k][0] for i, d, _ in want])
        plain_ = np.array([w[k - 1] for _, _, w in want])
        assert min(np.abs(got - plain_).max(), np.abs(got + plain_).max()) < 1e-7


def test_query(spark):
    rows = QUERIES["op11_embedding_whitening"](spark, FOLDER).collect()
    vectors = [tuple(r) for r in table(spark, FOLDER, "embeddings").select("vec_id", "embedding").collect()]
    n, shares, want = plain(vectors)
    assert len(rows) == 16 * len(want)
    check(rows, n, shares, want)


@pytest.mark.parametrize("size", [1, 2, 3, 64, 130])
def test_split_of_a_matrix(size):
    noise = np.random.default_rng(size)
    basis, _ = np.linalg.qr(noise.standard_normal((size, size)))
    spectra = {
        "any": noise.random(size), "falling": 2.0 ** -np.arange(size), "two": np.repeat([3.0, 1.0], [size // 2, size - size // 2]),
        "close": 1 + 1e-9 * noise.random(size), "all equal": np.ones(size), "nothing": np.zeros(size), "both signs": noise.random(size) - 0.5,
    }
    for name, spectrum in spectra.items():
        a = (basis * spectrum) @ basis.T
        a = (a + a.T) / 2
        values, columns = whitening.leading(a, 16)
        scale = max(np.abs(spectrum).max(), 1e-300)
        assert len(values) == min(16, size) and (np.diff(values) <= 1e-15 * scale).all(), name
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:16]).max() <= 1e-14 * scale, name
        assert np.abs(a @ columns - columns * values).max() <= 1e-14 * scale, name
        assert np.abs(columns.T @ columns - np.eye(len(values))).max() <= 1e-14, name


def test_sign_of_an_ill_conditioned_matrix():
    a = np.diag([1.0, 1e-5, 1e-12, -1e-12, -1e-3, -1.0])
    assert np.abs(whitening.sign(a) - np.diag([1, 1, 1, -1, -1, -1])).max() < 1e-10


def test_odd_rows(spark):
    noise = np.random.default_rng(3)
    good = [(i % 9, [float(np.float32(c)) for c in v]) for i, v in enumerate(noise.standard_normal((40, 3)))]
    good += good[:5] + [(None, [0.5, -0.25, 1.0])] + [(77, good[0][1])]
    odd = [(1, None), (2, []), (3, [1.0, None, 2.0]), (4, [float("nan"), 0.0, 0.0]), (5, [float("inf"), 0.0, 0.0]), (6, [1e38, 0.0, 0.0]), (7, [1.0, 2.0])]
    vectors = spark.createDataFrame(good + odd, SHAPE).select("*", F.lit("a").alias("x"), F.lit("b").alias("row"), F.lit("c").alias("deviation"), F.lit("d").alias("n"))
    n, shares, want = plain(good)
    rows = whitening.components(vectors).collect()
    assert len(rows) == 3 * len(good)
    check(rows, n, shares, want)
    kept = whitening.whitened(vectors, whitening.fit(vectors))
    assert kept.count() == len(good) and {"x", "row", "n", "whitened"} <= set(kept.columns) and kept.where("row = 'b'").count() == len(good)


def test_without_a_component(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SHAPE)
    assert whitening.components(same).count() == 0 and whitening.whitened(same, whitening.fit(same)).count() == 2
    empty = same.limit(0)
    assert whitening.fit(empty) is None and whitening.components(empty).count() == 0
    assert whitening.whitened(same, None).count() == 0


def test_values_far_apart_stay_exact(spark):
    rows = [(1, [2.0 ** 50, 1.0]), (2, [0.0, 2.0]), (3, [-(2.0 ** 50), 5.0])]
    vectors = spark.createDataFrame(rows, SHAPE)
    kept = whitening.whitened(vectors, whitening.fit(vectors)).orderBy("vec_id").collect()
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    assert [int(r["deviation"]) for r in kept] == [sum((3 * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    assert {r["deviation"] for r in whitening.components(vectors).where("vec_id <> 2").collect()} == {None}
